"""The store: commits, merges, migrations, numbers; reports and progress kept from events."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from siteweave.operators import ledger, reports
from siteweave.operators.ledger import Conflict
from siteweave.operators.migrations import MIGRATIONS, Field, Migration
from siteweave.operators.rules import Registry
from siteweave.operators.store import FEW, ResultStore, append_keyed, numbered
from siteweave.streaming import events as streams
from siteweave.streaming import progress

PAGES = "url string, link_type string, seq long"


def made(spark, path):
    store = ResultStore(spark, str(path))
    store.migrate()
    return store


def test_bytes_grow_with_batches(spark, tmp_path):
    store, sizes = made(spark, tmp_path / "s"), []
    run, batch = store.create_run("https://a.example/"), lambda b: spark.range(200).select(F.sha2((F.col("id") + b * 200).cast("string"), 256).alias("url"), F.lit("Internal").alias("link_type")).coalesce(1)
    for b in range(FEW + 2):
        store.add_pages(run, batch(b))
        sizes.append(store.files.size(f"{store.path}/site_page"))
    steps = [b - a for a, b in zip([0, *sizes], sizes, strict=False)]
    assert max(s for i, s in enumerate(steps) if i != FEW - 1) < 2 * steps[0]  # one batch merges what came before, once
    assert sizes[-1] < 2.5 * len(sizes) * steps[0]
    assert store.read("site_page").count() == 200 * (FEW + 2) and len(store.ledger.state().tables["site_page"][str(run)]) == 3
    other = store.create_run("https://b.example/")
    before = store.ledger.state().tables["site_page"][str(run)]
    store.add_pages(other, batch(0))
    assert store.ledger.state().tables["site_page"][str(run)] == before  # a run's partition is its own
    assert store.read("site_page", [other]).count() == 200
    held = store.bytes()
    assert store.expire(older_than=0) == FEW and store.bytes() < held and store.read("site_page", [run]).count() == 200 * (FEW + 2)


def test_first_and_last_hold_through_merges(spark, tmp_path):
    store = made(spark, tmp_path / "s")
    run = store.create_run("https://a.example/")
    for b in range(2 * FEW):
        store.add_pages(run, spark.createDataFrame([("u", f"T{b}", 0), (f"v{b}", "x", 0)], PAGES))
        store.add_results(run, spark.createDataFrame([("u", "r", b % 2 == 0)], "url string, rule_id string, passed boolean"))
    assert {r.url: r.db_link_type for r in store.read("site_page").collect()}["u"] == "T0" and store.read("site_page").count() == 2 * FEW + 1
    assert [r.passed for r in store.read("page_rule_result").collect()] == [False]


def test_dead_writers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "PATIENCE", 0.2)
    store = made(spark, tmp_path / "s")
    run = store.create_run("https://a.example/")
    pages = store.page_rows(spark.createDataFrame([(run, "lost", "Internal")], "site_run_id int, url string, link_type string"))
    store._put("site_page", pages, store.ledger.state(), "0000000099-dead")  # its writer died before the commit
    (tmp_path / "s" / "_commits" / f"{store.ledger.state().version + 1:010d}.json").write_text('{"add": {"site')  # and this one in it
    store.add_pages(run, spark.createDataFrame([("kept", "Internal", 0)], PAGES))
    for reader in (store, ResultStore(spark, store.path)):
        assert [r.url for r in reader.read("site_page").collect()] == ["kept"]
    assert store.expire(older_than=0) == 1


def test_two_writers(spark, tmp_path):
    first, errors, numbers = made(spark, tmp_path / "s"), [], []
    run = first.create_run("https://a.example/")

    def work(w):
        try:
            store = ResultStore(spark, first.path)
            for b in range(4):
                store.add_pages(run, spark.createDataFrame([(f"{w}-{b}", "Internal", 0)], PAGES))
                numbers.append(store.create_run("https://a.example/"))
        except BaseException as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and first.read("site_page").count() == 8
    assert sorted(numbers) == list(range(run + 1, run + 9)) and first.read("site_run").count() == 9


def test_one_number_has_one_commit(spark, tmp_path):
    """Of writers that ask for a number at once, one gets it."""
    own = [ledger.Ledger(spark, str(tmp_path)) for _ in range(8)]
    for n in range(40):
        start, won = threading.Barrier(len(own)), []

        def work(w, n=n, start=start, won=won):
            start.wait()
            if own[w]._create(f"{n:010d}.json", json.dumps({"by": w})):
                won.append(w)

        threads = [threading.Thread(target=work, args=(w,)) for w in range(len(own))]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(won) == 1 and own[0]._read(f"{n:010d}.json") == {"by": won[0]}


def test_a_commit_after_the_look_is_seen(spark, tmp_path, monkeypatch):
    mine, other, done = ledger.Ledger(spark, str(tmp_path)), ledger.Ledger(spark, str(tmp_path)), []
    base, look = mine.state(), mine.state

    def then():
        found = look()
        if not done:
            done.append(other.commit({"add": {"site_run": {"0": [["a", 0]]}}}, other.state()))
        return found

    monkeypatch.setattr(mine, "state", then)
    with pytest.raises(Conflict):
        mine.commit({"add": {"site_run": {"0": [["b", 0]]}}}, base, alone=[("site_run", "0")])


def test_a_commit_from_an_old_state_is_refused(spark, tmp_path):
    store = made(spark, tmp_path / "s")
    base = store.ledger.state()
    store.ledger.commit({"add": {"site_page": {"1": [["a", 0]]}}}, base)
    with pytest.raises(Conflict):
        store.ledger.commit({"add": {"site_page": {"1": [["b", 0]]}}}, base, alone=[("site_page", "1")])
    now = store.ledger.commit({"replace": {"site_page": {"1": [["a"], [["ab", 1]]]}}}, store.ledger.state())
    with pytest.raises(Conflict):
        store.ledger.commit({"replace": {"site_page": {"1": [["a"], [["x", 1]]]}}}, base.apply(2, {"add": {"site_page": {"1": [["a", 0]]}}}))
    for i in range(2 * ledger.WHOLE):
        now = store.ledger.commit({"add": {"site_page": {"2": [[str(i), 0]]}}}, now)
    again = ledger.Ledger(spark, store.path).state()
    assert again == now and len(again.tables["site_page"]["2"]) == 2 * ledger.WHOLE and again.tables["site_page"]["1"] == [["ab", 1]]


def test_a_batch_is_stored_once(spark, tmp_path):
    store = made(spark, tmp_path / "s")
    rows = store.page_rows(spark.createDataFrame([(1, "u", "Internal")], "site_run_id int, url string, link_type string"))
    assert store.add({"site_page": rows}, batch=("q", 0)) and not store.add({"site_page": rows}, batch=("q", 0)) and store.add({"site_page": rows}, batch=("other", 0))


def test_an_ephemeral_store(spark):
    with ResultStore.ephemeral(spark) as one, ResultStore.ephemeral(spark) as other:
        one.create_run("https://a.example/")
        assert one.read("site_run").count() == 1 and other.read("site_run").isEmpty() and one.path != other.path
    assert not one.files.exists(one.path) and not other.files.exists(other.path)
    with pytest.raises(RuntimeError), ResultStore.ephemeral(spark) as failed:
        raise RuntimeError("in the middle")
    assert not failed.files.exists(failed.path)


EXTRA = [
    *MIGRATIONS,
    Migration("page_language", add=(("site_page", Field("language", "language", "string", "en")),)),
    Migration("link_kind", rename=(("site_page", "db_link_type", "kind"),)),
]


def test_up_down_up_keeps_rows(spark, tmp_path):
    store = made(spark, tmp_path / "s")
    run = store.create_run("https://a.example/")
    store.add_pages(run, spark.createDataFrame([("old", "Internal", 0)], PAGES))
    later = ResultStore(spark, store.path, migrations=EXTRA)
    later.up(1)
    rows = later.page_rows(spark.createDataFrame([(run, "new", "External")], "site_run_id int, url string, link_type string")).withColumn("language", F.lit("fr"))
    later.add({"site_page": rows})
    assert {r.url: r.language for r in later.read("site_page").collect()} == {"old": "en", "new": "fr"}
    later.up()
    assert {r.url: r.kind for r in later.read("site_page").collect()} == {"old": "Internal", "new": "External"} and later.applied()[-1] == "link_kind"
    later.down(2)
    assert "language" not in later.read("site_page").columns and store.read("site_page").count() == 2
    for i in range(FEW):
        store.add_pages(run, spark.createDataFrame([(f"more{i}", "Tel", 0)], PAGES))  # merged while the column is hidden
    later.up()
    assert {r.url: (r.language, r.kind) for r in later.read("site_page").collect()}["new"] == ("fr", "External")
    later.down(99)
    with pytest.raises(Exception, match="no table"):
        later.read("site")
    later.up()
    assert later.read("site_page").count() == 2 + FEW and later.read("site").count() == 1


def test_a_broken_step_recreates(spark, tmp_path):
    store = made(spark, tmp_path / "s")
    store.create_run("https://a.example/")
    broken = ResultStore(spark, store.path, migrations=[*MIGRATIONS, Migration("again", create={"site": EXTRA[0].create["site"]})])
    with pytest.raises(ValueError):
        broken.up()
    assert store.read("site_run").count() == 1
    broken.migrate()
    assert broken.read("site_run").isEmpty() and broken.applied() == [m.name for m in MIGRATIONS] and broken.create_run("https://b.example/") == 1


def test_numbers_without_gaps_or_one_task(spark):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("url")).repartition(7)
    found = numbered(rows, F.col("url"), first=11)
    assert [r.id for r in found.orderBy("url").collect()] == list(range(11, 5011))
    assert "Window" not in found._jdf.queryExecution().toString() and "SinglePartition" not in found._jdf.queryExecution().toString()
    more = append_keyed(found.filter("id < 100").select("id", "url"), rows, "url", F.col("url"))
    assert more.select("id").distinct().count() == 5000 == more.count() and more.agg(F.max("id")).first()[0] == 99 + 5000 - 89
    assert numbered(rows.limit(0), F.col("url")).isEmpty()


def stream_of(seed, runs=3, pages=12):
    """Batches of events of several runs: verdicts change, pages come again, batches repeat in part."""
    rng, out = random.Random(seed), []
    for run in range(1, runs + 1):
        rows = [(-1, run, "AnalysisStart", "base", None, None, None, None, None)]
        for turn in range(3):
            for p in range(pages):
                if rng.random() < 0.7:
                    rows.append((2 * turn, run, "FoundLink", f"u{p}", rng.choice(["Internal", "Internal", "External"]), None, None, None, None))
                if rng.random() < 0.7:
                    rows += [(2 * turn + 1, run, "AnalyzedPage", f"u{p}", None, r, rng.random() < 0.5, None, None) for r in ("title.has_title", "axe.tabindex", "unknown.rule")]
        rows += [(streams.SITE, run, "AnalyzedSite", "u0", None, "orphaned_page.check", False, None, None)]
        if run != 2:
            rows.append((streams.END, run, "AnalysisFinished", "base", None, None, None, 9, 9))
        out += rows
    third = len(out) // 3
    return [out[:third], out[third : 2 * third] + out[third - 5 : third], out[2 * third :] + out[:7]]


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_equal_a_recount(spark, tmp_path, seed):
    store, rules = made(spark, tmp_path / "s"), Registry.default().dimension(spark)
    store.seed_rules(rules)
    for _ in range(3):
        store.create_run("https://a.example/")
    for number, rows in enumerate(stream_of(seed)):
        batch = spark.createDataFrame(rows, streams.EVENT)
        for _ in range(2 if number == 1 else 1):  # the second is replayed
            streams.apply_batch(store, batch, number)
    store.add({"category_count": store.read("category_count").limit(0)}, batch=("events", 1))
    whole = store.read("page_rule_result")
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    columns = ["site_run_id", "category", "total", "passed", "failed"]
    assert rows(reports.kept_category_result(store.read("category_count")).select(columns)) == rows(reports.category_result(whole, rules, by=["site_run_id"]).select(columns)) != []
    assert rows(reports.kept_link_counts(store.read("link_count"))) == rows(reports.link_counts(store.read("site_page"), by=["site_run_id"])) != []
    runs = store.read("site_run")
    history = ["site_run_id", "category", "total", "passed"]
    assert rows(reports.kept_category_history(store.read("category_count"), runs, depth=2).select(history)) == rows(reports.category_history(whole, rules, runs, depth=2).select(history))
    assert {r.id: r.status for r in runs.collect()} == {1: "Finished", 2: "Running", 3: "Finished"}


def test_progress_after_a_restart(spark, tmp_path):
    store, batches = made(spark, tmp_path / "s"), stream_of(4)
    folder = str(tmp_path / "events")
    seen = []
    for rows in batches:  # each time the stream is started anew and goes on with its state
        spark.createDataFrame(rows, streams.EVENT).coalesce(1).write.mode("append").parquet(folder)
        seen += rows
        progress.follow(streams.read_events(spark, folder), store, str(tmp_path / "state")).awaitTermination()
        want = {tuple(r) for r in progress.parts_of(spark.createDataFrame(seen, streams.EVENT)).collect()}
        columns = ["site_run_id", "part", "total_pages", "completed_pages", "started", "finished", "last_seq", "kind", "url"]
        assert {tuple(r) for r in store.read("run_progress").select(columns).collect()} == want
    told = {r.site_run_id: r for r in reports.run_progress(store.read("run_progress")).collect()}
    assert told[1].finished and not told[2].finished and told[1].kind == "AnalysisFinished" and told[3].total_pages == len({r[3] for r in seen if r[1] == 3 and r[4] == "Internal"})
    assert json.dumps(store.ledger.state().batches) and os.path.exists(f"{store.path}/run_progress")
