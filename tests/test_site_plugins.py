"""Site plugins with states, and polite fetching."""

import http.server
import sys
import threading
import time
from collections import Counter, defaultdict

from pyspark import cloudpickle
from pyspark.sql import functions as F

from siteweave.functions.html import parse_pages
from siteweave.operators.rules import Registry, Rule, RuleConfig
from siteweave.operators.site_plugins import AggregatePlugin, FoldPlugin
from siteweave.operators.site_rules import DescriptionUniqueness
from siteweave.sources.fetch import fetch_one, http_fetch, in_turn

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests


def rule(name):
    return [Rule(name, name, "own", "Info", "SEO", name, "yes", "no", rule_type="Site")]


class Descriptions(AggregatePlugin):
    name = description = "descriptions, as aggregates"

    def rules(self):
        return rule("meta_description_uniqueness")

    def state(self):
        return {"total": F.count("p.description"), "kinds": F.countDistinct("p.description")}

    def finish(self):
        return (F.col("total") == 0) | (F.col("kinds") * 100 >= F.col("total") * 90)

    def names(self, passed):
        return F.col("p.description") if passed else None


class CommonTitle(FoldPlugin):
    """Fails a site one of whose titles stands on most of its pages: counters that merge."""

    name = description = "common titles"
    columns = {"title": "p.title"}

    def rules(self):
        return rule("own.common_title")

    def zero(self):
        return Counter()

    def update(self, state, page):
        state[page["title"]] += 1
        return state

    def merge(self, left, right):
        return left + right

    def finish(self, state):
        return max(state.values()) * 2 <= sum(state.values())


def site_pages(spark):
    rows = []
    for i in range(400):
        site = "https://big.example" if i % 2 else f"https://s{i % 16}.example"  # one site has half of the pages
        text = i if i % 4 else 0
        rows.append((f"{site}/{i}", site, f"<title>t{i % 3 if i % 2 else 0}</title>" + (f"<meta name=description content='d{text if site != 'https://s2.example' else 0}'>" if i % 5 else "")))
    return parse_pages(spark.createDataFrame(rows, "url string, site string, html string").repartition(9))


def test_the_rule_of_descriptions_as_aggregates(spark):
    pages = site_pages(spark)
    nodes, edges = pages.select("site", "url"), spark.createDataFrame([], "url string, source_type string")
    rows = lambda plugin: sorted(map(tuple, plugin.check(nodes, edges, pages).select("site", "rule_id", "passed", "key", "url").collect()), key=str)
    assert rows(Descriptions()) == rows(DescriptionUniqueness()) != []
    assert {r.passed for r in Descriptions().verdicts(pages).collect()} == {True, False}
    plan = Descriptions().verdicts(pages)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "collect" not in plan


def test_states_in_python_merge(spark):
    pages = site_pages(spark)
    want = defaultdict(Counter)
    for r in pages.select("site", "p.title").collect():
        want[r.site][r.title] += 1
    got = {r.site: r.passed for r in CommonTitle().verdicts(pages).collect()}
    assert got == {s: max(c.values()) * 2 <= sum(c.values()) for s, c in want.items()} and len(set(got.values())) == 2
    assert CommonTitle().verdicts(pages.limit(0)).isEmpty()
    registry = Registry(RuleConfig({"own.common_title": True}))
    registry.register_site(CommonTitle())
    found = registry.analyze_site(pages.select("site", "url"), spark.createDataFrame([], "url string, source_type string"), pages)
    assert {r.site: r.passed for r in found.collect()} == got


def test_hosts_in_turn():
    began, seen = time.monotonic(), []
    for url in in_turn(["http://a/1", "http://a/2", "http://b/1", "no url", "http://a/3"], 0.05):
        seen.append((url, time.monotonic() - began))
    assert [u for u, _ in seen][:3] == ["http://a/1", "http://b/1", "no url"] and len(seen) == 5
    at = dict(seen)
    assert at["http://a/2"] - at["http://a/1"] >= 0.05 and at["http://a/3"] - at["http://a/2"] >= 0.05


def test_polite_fetching_asks_once(spark, tmp_path):
    asked, lock = defaultdict(list), threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                asked[self.headers["Host"].split(":")[0]].append((time.monotonic(), self.path))
            self.send_response(404 if self.path == "/gone" else 200)
            self.end_headers()
            self.wfile.write(b"ok")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    urls = [f"http://{h}:{server.server_port}/{p}" for h in ("127.0.0.1", "localhost") for p in ("a", "b", "c", "gone")]
    table = spark.createDataFrame([(u,) for u in urls + urls[:2] + [None]], "url string").repartition(5)
    fetch = lambda: http_fetch(concurrency=4, delay_ms=80, ledger=str(tmp_path / "ledger"))(table)
    first = fetch()
    spoiled = first.select(F.when(F.col("url").endswith("/c"), F.raise_error(F.lit("lost"))).otherwise(F.col("url")))
    try:
        spoiled.collect()
        raise AssertionError("the job should have died")
    except Exception as e:
        assert "lost" in str(e)
    rows = {r.url: r for r in fetch().collect()}  # a new job with the same ledger: what was fetched is not asked for again
    server.shutdown()
    assert set(rows) == set(urls) and all(r.error == u.endswith("gone") for u, r in rows.items()) and rows[urls[0]].html == "ok"
    for host in ("127.0.0.1", "localhost"):
        times = [t for t, _ in sorted(asked[host])]
        assert sorted(p for _, p in asked[host]) == ["/a", "/b", "/c", "/gone"]  # each page once
        assert min(b - a for a, b in zip(times, times[1:], strict=False)) >= 0.075
    assert fetch_one("http://127.0.0.1:1/x", 0.2)["error"]
