"""Operators for training data against brute force, SQL, the tokenizers library or held-out labels."""

import hashlib
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siteweave.llm import ann, bpe, hpylm, langid, packing, sharding, simhash, sstable, suffixdedup, topk
from siteweave.llm.common import scratch

SF = "/root/testdata/sf0.001"
END = 0


def oddities():
    base = "the quick brown fox jumps over the lazy dog and runs away from it all day long " * 9
    texts = [None, "", "!!!", "a", "One two", base, base, base + "tail", base.replace("lazy", "lively", 1), "é" * 150, "x" * 199, "ab" * 300, "<|endoftext|> and more\n\n text " * 20, "日本語 text", "w " * 30000]
    return [(i, t, "en" if i % 2 else None, "s", 0.5) for i, t in enumerate(texts)] + [(5, base, "en", "s", 0.5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(oddities(), "doc_id long, text string, lang string, source string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(bpe.vocabulary_path())
    made.no_truncation()
    made.no_padding()
    return made


def vectors(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(n)]
    rows += [(n + i, rows[20][1]) for i in range(40)] + [(n + 41, None), (n + 42, [1.0, None] + [0.0] * 6), (n + 43, [float("nan")] * 8), (n + 44, [0.0] * 8), (n + 45, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all()]


def test_top_k(spark):
    table, good = vectors(spark)
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in topk.top_k(table, 20, is_query=F.col("id") % 20 == 0).collect()}
    m = {i: np.floor(64 * np.array(v)).astype(int) for i, v in good}
    want = {}
    for q in (i for i in m if i % 20 == 0):
        best = sorted(((-int(m[q] @ m[c]), c) for c in m if c != q))[:20]
        want |= {(q, r + 1): (c, -s) for r, (s, c) in enumerate(best)}
    assert got == want
    assert topk.top_k(table.limit(0), 20, is_query=F.col("id") % 20 == 0).isEmpty()


def test_top_k_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, topk.op1_topk(spark, SF).select("query_id", "rank", "vec_id", "score").collect())) == sorted(con.execute(topk.ORACLE).fetchall())


def test_neighbours(spark):
    table, good = vectors(spark)
    good = [(i, np.array(v)) for i, v in good if any(v)]
    got = {}
    for r in ann.nearest(table, 5, is_query=F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    hits = total = 0
    for q, v in good:
        if q % 50 == 0:
            exact = sorted(((-round(cos(v, w), 12), c) for c, w in good if c != q))[:5]
            hits += len({c for _, c in exact} & {c for _, c, _ in got[q]})
            total += 5
            for _, c, s in got[q]:
                assert abs(s - cos(v, dict(good)[c])) < 1e-9
    assert hits / total >= 0.9
    assert ann.nearest(table.limit(0), 5, is_query=F.col("id") % 50 == 0).isEmpty()


def test_probes_come_in_order_of_success():
    place = np.array([0.1, 0.7, 0.45])
    cost = lambda m: sum(place[i] ** 2 if x < 0 else (1 - place[i]) ** 2 for i, x in enumerate(m) if x)
    made = ann.probes(place, 27)
    costs = [cost(m) for m in made]
    assert len({tuple(m) for m in made}) == 27 and costs == sorted(costs)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, empty):
    got = {(r.doc_id, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(docs).collect()}
    fps = [(r[0], brute_fingerprint(r[1])) for r in oddities()]
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in combinations(fps, 2):
        if (x ^ y).bit_count() <= 2:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {(i, f, find(i)) for i, f in fps}
    assert simhash.near_duplicates(empty).isEmpty()


def test_crowded_values_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fps = {int(rng.integers(2**62))}
    while len(fps) < 300:
        f = sorted(fps)[int(rng.integers(len(fps)))]
        fps.add(f ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 4), replace=False)))
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = simhash.components(simhash.links(distinct)).collect()
    monkeypatch.setattr(simhash, "PAIRS", 1)
    assert sorted(simhash.components(simhash.links(distinct)).collect()) == sorted(want)


def test_sharding(spark, docs, empty):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    mine = sharding.op3_sharding(spark, SF)
    assert sorted(map(tuple, mine.collect())) == sorted(con.execute(f"SELECT {', '.join(mine.columns)} FROM ({sharding.ORACLE})").fetchall())
    out = sharding.assign_shards(docs, 1000).toPandas()
    assert len(out) == len(oddities()) and ((out.shard_bytes <= 1000) | out.oversized).all()
    assert sharding.assign_shards(empty, 10).isEmpty()


def probability(model, before, word):
    """Of a word (None: the end) after another (None: at the beginning), from the model's packed tables."""
    row_of = lambda w: model.seatings.filter(F.col("key") == int(hpylm._numbers([w]).view(np.int64)[0])).first()
    word = hpylm.END if word is None else word
    frequent = before in model.frequent
    ctx = hpylm.ENDINGS + model.frequent.index(before) if frequent else hpylm.ending(before or hpylm.END)
    row = row_of(word)
    if row is None:
        own, p = np.zeros((1, hpylm.SAMPLES)), model.unknown[None]
    else:
        inner, middle = np.frombuffer(row.inner, hpylm.INNER), np.frombuffer(row.middle, hpylm.MIDDLE)
        if (inner["ctx"] == ctx).any():
            return float(inner["value"][inner["ctx"] == ctx][0])
        above = middle["above"][middle["end"] == hpylm.ending(before or hpylm.END)]
        own, p = above if len(above) else np.zeros((1, hpylm.SAMPLES)), np.frombuffer(row.p, "<f4")[None]
    value = float(model.value(np.array([ctx]), np.zeros(1), own, p)[0])
    last = row_of(before) if before and not frequent else None
    if last is None:
        return value
    after, number = np.frombuffer(last.after, hpylm.AFTER), int(hpylm._numbers([word])[0])
    met = after["value"][(after["high"] == number >> 32) & (after["low"] == number >> 16 & 0xFFFF)]
    return 10**last.own * (value + (float(met[0]) if len(met) else 0))


def test_tables_are_drawn_as_by_seating_one_by_one():
    d, w = 0.6, 1.7
    # all ways to seat c customers, each weighed by its new tables and by sizes less the discount
    exact = {1: {1: 1.0}}
    for c in range(1, 8):
        exact[c + 1] = {}
        for t, p in exact[c].items():
            exact[c + 1][t] = exact[c + 1].get(t, 0) + p * (c - d * t)
            exact[c + 1][t + 1] = exact[c + 1].get(t + 1, 0) + p * w
    keys = np.random.default_rng(1).integers(0, 2**63, 40000).astype(np.uint64)
    for c in (2, 3, 8):
        drawn = np.bincount(hpylm.draw_tables(np.full(len(keys), c), np.full(len(keys), w), d, keys, 3), minlength=c + 1)[1:] / len(keys)
        want = np.array([exact[c][t] for t in range(1, c + 1)])
        assert drawn == pytest.approx(want / want.sum(), abs=0.012)
    number = np.arange(1, hpylm.EXACT + 1)
    for w in (0.02, 1.7, 30.0, 2000.0):  # beyond that number of customers, the limit is close to the last exact law
        logs = hpylm.stirling(d)[hpylm.EXACT, 1:] + np.log(w) * number
        p = np.exp(logs - logs.max())
        p /= p.sum()
        large = hpylm.draw_tables(np.full(len(keys), hpylm.EXACT + 1), np.full(len(keys), w), d, keys, 3)
        mean = (p * number).sum()
        assert large.mean() == pytest.approx(mean, rel=0.06) and large.std() == pytest.approx(np.sqrt((p * (number - mean) ** 2).sum()), rel=0.2)


def test_language_model_beats_kneser_ney(spark):
    """Bigrams with one discount and continuation counts below, over all words before, and again with a level of endings."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 7 == 2 for i in table.doc_id])
    texts = [hpylm.tokens((t or "").encode()) for t in table.text]
    two = Counter()
    for words, out in zip(texts, held, strict=True):
        if not out:
            two.update(zip([hpylm.END, *words], words, strict=False))
    known = len({b for _, b in two})
    levels = [two, Counter((hpylm.ending(a), b) for a, b in two)]
    levels.append(Counter(b for _, b in levels[1]))
    plain = Counter(b for _, b in two)

    def summed(pairs):
        n, kinds = Counter(), Counter()
        for (a, _), c in pairs.items():
            n[a] += c
            kinds[a] += 1
        return n, kinds

    sums = [summed(x) for x in levels[:2]]

    def backed(count, n, kinds, below, d=0.75):
        return (max(count - d, 0) + d * kinds * below) / n if n else below

    total, count = np.zeros(2), 0
    for words, out in zip(texts, held, strict=True):
        if out:
            for a, b in zip([hpylm.END, *words], words, strict=False):
                root = [backed(x[b], sum_, len(x), 1 / (known + 1)) for x, sum_ in ((plain, len(two)), (levels[2], len(levels[1])))]
                e = hpylm.ending(a)
                root[1] = backed(levels[1][e, b], sums[1][0][e], sums[1][1][e], root[1])
                total += np.log10([backed(two[a, b], sums[0][0][a], sums[0][1][a], r) for r in root])
                count += 1
    got = hpylm.op4_hpylm(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert got.n_tokens.sum() == count and got.score.sum() > total.max() + 0.02 * count, (got.score.sum() / count, total / count)


def test_language_model(spark, docs, empty):
    train = [r for r in oddities() if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    model = hpylm.fit(spark.createDataFrame(train, docs.schema))
    counts = Counter(w for r in train for w in hpylm.tokens((r[1] or "").encode()))
    n, v = sum(counts.values()), len(counts)
    got = {}
    for r in hpylm.score(docs, model).collect():
        got.setdefault(r.doc_id, r)
    for i, text, *_ in oddities():
        words = hpylm.tokens((text or "").encode())
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r.score < 0
    # after any word, known words and one unknown word have probabilities that sum to one
    rare = next(w for w in sorted(counts) if counts[w] == 1)
    assert rare not in model.frequent
    for before in (None, b"the", b"never-seen", rare):
        assert sum(probability(model, before, w) for w in [*counts, b"unknown"]) == pytest.approx(1, abs=1e-5)
    rows = [hpylm.tokens((r[1] or "").encode()) for r in train]
    followed = dict(pair for words in rows for pair in zip(words, words[1:], strict=False))
    words = [b"the", b"lazy", b"never-seen", b"dog", rare, b"the", *([rare, followed[rare]] if followed[rare] != hpylm.END else [rare])]
    asked = spark.createDataFrame([(b" ".join(words).decode(), 7)], "text string, rid int")
    want = sum(np.log10(probability(model, a, b)) for a, b in zip([None, *words], [*words, None], strict=True))
    assert hpylm.score(asked, model).first().score == pytest.approx(want, rel=1e-5)
    assert hpylm.score(empty, hpylm.fit(empty)).isEmpty()


def test_language(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op5_langid(spark, "/root/testdata/sf0.01").join(table.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out[out.held_out].lang == out[out.held_out].lang_pred).mean() > 0.95
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[2].rejected and got[5].lang_pred == "en"
    assert langid.fit(empty) is None and langid.predict(empty, None).isEmpty()


def test_bpe(spark, docs, empty, tokenizer):
    got = {r.doc_id: r for r in bpe.digest(docs, bpe.fit_lexicon(docs)).collect()}
    for i, text, *_ in oddities():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest(empty, bpe.fit_lexicon(empty)).isEmpty()


def test_cuts_at_spaces_change_no_token(tokenizer):
    rng = np.random.default_rng(8)
    signs = list("ab 1'\n\t \u3000\x1c\u200b!\u00e9.  ") + [" the", "'ll ", "  x", " \n ", "\u65e5"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(4000)] + ["a" * 1000 + " " + "ab" * 400]
    words = bpe.vocabulary(bpe.vocabulary_path())
    lexicon = bpe.Lexicon(bpe.build_lexicon({w: words.merge(w) for w in (b" the", b" a", b"ab", b" b", "\u00e9".encode())}))
    own = bpe.Coder(words, lexicon)
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == want.ids
        assert own.decode(packed) == tokenizer.decode(want.ids, skip_special_tokens=False)


def test_packing(spark, docs, empty, tokenizer):
    rows = packing.pack(docs.dropDuplicates(["doc_id"]), with_ids=True).toPandas()
    for i, text, *_ in oddities()[:-1]:
        own = rows[rows.doc_id == i].sort_values("start")
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, END], "<u4")
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]] and b"".join(own.ids) == ids.tobytes()
        assert own.ids_crc32.tolist() == [zlib.crc32(x) for x in own.ids] and (own.doc_tokens == len(ids)).all()
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 1024
    assert packing.pack(empty).isEmpty()


def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        points = [0, *np.cumsum(rng.integers(1, 9, 14)).tolist()]
        penalties = rng.integers(0, 4, len(points)).astype(float).tolist()
        penalties[-1] = 0.0
        cost = lambda ends: sum((0 if (n := points[b] - points[a]) & (n - 1) == 0 else 16 - n) + penalties[b] + 1 for a, b in zip([0, *ends], ends)) if all(points[b] - points[a] <= 16 for a, b in zip([0, *ends], ends)) else 1e9  # noqa: B023, B905, E731
        last = len(points) - 1
        best = min(cost([*c, last]) for n in range(last) for c in combinations(range(1, last), n))
        assert cost(packing.choose_cuts(points, penalties, 16, 1.0)) == best


def brute_spans(texts, length):
    raws, seen = [(t or "").encode() for t in texts], {}
    for i, r in enumerate(raws):
        for p in range(len(r) - length + 1):
            seen.setdefault(r[p : p + length], []).append((i, p))
    covered = [np.zeros(len(r) + 2, np.int8) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                covered[i][p + 1 : p + length + 1] = 1
    return [(len(r), int(c.sum()), int((np.diff(c) == 1).sum()), hashlib.sha256(bytes(b for b, x in zip(r, c[1:-1]) if not x)).hexdigest()) for r, c in zip(raws, covered)]  # noqa: B905


@pytest.mark.parametrize("crowd", [2048, 6, 1])
def test_repeated_strings(spark, docs, empty, monkeypatch, crowd):
    monkeypatch.setattr(suffixdedup, "CROWD", crowd)
    rng = np.random.default_rng(2)
    base = "".join(rng.choice(list("abcdefgh "), 2500))
    texts = [r[1] for r in oddities()[:-2]]
    for _ in range(20):
        t = list(base[rng.integers(400) : rng.integers(1200, 2500)])
        for at in rng.integers(0, len(t), rng.integers(9)):
            t[at] = "Z"
        texts.append("".join(t))
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.deduplicate(table).collect()}
    assert got == dict(enumerate(brute_spans(texts, 200)))
    assert suffixdedup.deduplicate(empty).isEmpty()


def test_cover():
    d = suffixdedup.cover(32)
    assert {int(a - b) % 32 for a in d for b in d} == set(range(32))


def test_tables(spark, docs, empty, tokenizer):
    own = docs.dropDuplicates(["doc_id"])
    manifest = sstable.write_tables(own, scratch(spark, "ids"))
    got = {r.doc_id: r for r in sstable.read_tables(manifest, with_ids=True).collect()}
    start = 0
    for i, text, *_ in oddities()[:-1]:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, END], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, bytes(got[i].ids)) == (start, len(ids), zlib.crc32(ids), ids.tobytes())
        start += len(ids)
    asked = spark.createDataFrame([(3,), (7,), (99,)], "doc_id long")
    assert {r.doc_id: bytes(r.ids) for r in sstable.lookup(manifest, asked).collect()} == {i: bytes(got[i].ids) for i in (3, 7)}
    assert sstable.read_tables(sstable.write_tables(empty, scratch(spark, "ids"))).isEmpty()


def test_stages_keep_own_columns(spark, docs):
    names = ["lang_pred", "rejected", "raw", "rid", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256", "row", "_row", "own", "key", "c0"]
    table = docs
    for i, name in enumerate(names):
        table = table.withColumn(name, F.lit(float(i)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns
        for r in out.collect():
            assert r.score == 0.5 and [r[n] for n in names] == [float(i) for i in range(len(names))], name


def test_clashing_columns_of_operators(spark, docs):
    extra = docs.withColumn("raw", F.lit(1)).withColumn("rid", F.lit(2)).withColumn("w", F.lit(3)).withColumn("base", F.lit(4)).withColumn("body", F.lit(5)).withColumn("key", F.lit(6))
    got = hpylm.score(extra, hpylm.fit(extra)).collect()
    assert len(got) == len(oddities()) and all((r.raw, r.rid, r.w, r.base, r.body, r.key) == (1, 2, 3, 4, 5, 6) for r in got)
    assert suffixdedup.deduplicate(extra.withColumn("spans", F.lit(7))).filter("raw = 1 AND rid = 2 AND spans = 7").count() == len(oddities())
    own = docs.dropDuplicates(["doc_id"]).withColumn("shard", F.lit("mine"))
    path = scratch(spark, "shards")
    sharding.write_shards(own, path, 1000)
    assert spark.read.parquet(path).filter("shard = 'mine' AND _shard LIKE 'b%'").count() == own.count()


COLUMNS = {
    "op1_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_hpylm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_suffixdedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op10_sstable": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op11_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op13_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_keep_their_contracts(spark, name):
    from siteweave.llm.registry import QUERIES

    out = QUERIES[name](spark, SF)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c, _ in (x.split(" ") for x in COLUMNS[name].split(", "))} == dict(x.split(" ") for x in COLUMNS[name].split(", "))
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name == "op11_whitening":
        assert out.count() == 8 * out.select("vec_id").distinct().count()
    elif name not in ("op1_topk", "op6_ann", "op8_packing"):
        assert out.select("doc_id").distinct().count() == out.count() == n


def test_pipeline_as_a_whole(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch(spark, "whole")
        stage(spark, table, SF).write.parquet(path)
        table = spark.read.parquet(path)
    assert set(out.doc_id) == {r[0] for r in table.select("doc_id").collect()} and (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()


def test_pipeline(spark, docs, empty):
    table, columns = docs.withColumn("n_chars", F.lit(1).cast("long")), None
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = table.columns
        path = scratch(spark, "stage")
        stage(spark, table, SF).write.parquet(path)
        table = spark.read.parquet(path)
        kept[name] = sorted(r[0] for r in table.select("doc_id").collect())
        assert name == "pack" or table.columns == columns
    assert not {0, 1, 2} & set(kept["language"]) and 13 in kept["language"]
    assert kept["near_duplicates"].count(5) == 1 and 6 not in kept["near_duplicates"]
    assert set(kept["pack"]) == set(kept["passages"]) == set(kept["near_duplicates"])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).isEmpty()


def brute_similar(rows, words=5, similarity=0.8):
    tokens = {i: tuple((t or "").encode().lower().split()) for i, t in rows}
    sets = {}
    for i, w in tokens.items():
        k = min(words, len(w))
        sets[i] = {w[j : j + k] for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in tokens}
    changed = True
    while changed:
        changed = False
        for i, j in combinations(tokens, 2):
            both = len(sets[i] & sets[j])
            if (tokens[i] == tokens[j] or (both and both >= similarity * (len(sets[i]) + len(sets[j]) - both))) and root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    return root


def test_similar_texts(spark, docs, empty):
    rng = np.random.default_rng(5)
    rows = [(r[0], r[1]) for r in oddities()]
    for group in range(12):
        words = [f"w{x}" for x in rng.integers(0, 3000, 200)]
        rows.append((100 + 10 * group, " ".join(words)))
        for copy in range(1, 4):  # one to three words changed: similarities from 0.86 to 0.95
            edited = list(words)
            for at in rng.choice(200, copy, replace=False):
                edited[at] = "changed"
            rows.append((100 + 10 * group + copy, " ".join(edited)))
    # more different copies than are paired one by one
    rows += [(1000 + i, "hot " + " ".join(f"h{x}" for x in range(150)) + f" end{i}") for i in range(simhash.CROWD + 30)]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string").repartition(3)
    got = [(r.doc_id, r.component) for r in simhash.similar_texts(table).collect()]
    want = brute_similar(rows)
    assert sorted(got) == sorted((i, want[i]) for i, _ in rows)
    assert simhash.similar_texts(empty).isEmpty()


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 3000, rng.integers(0, 900))).astype(np.uint64) << np.uint64(17) for _ in range(2))
        bits = (int.from_bytes(simhash.sketch(x), "big") ^ int.from_bytes(simhash.sketch(y), "big")).bit_count()
        assert bits <= len(np.setxor1d(x, y))


def similar_as_brute_force(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_similar(rows)
    got = [(r.doc_id, r.component) for r in simhash.similar_texts(table).collect()]
    assert sorted(got) == sorted((i, want[i]) for i, _ in rows)
    return want


def test_similar_texts_with_changed_blocks(spark):
    rng = np.random.default_rng(11)
    rows = []
    for group in range(60):
        words = [f"w{x}" for x in rng.integers(0, 100000, 200)]
        block = [f"b{x}" for x in rng.integers(0, 100000, 47)]
        cut, at = int(rng.integers(34, 40)), int(rng.integers(20, 140))
        swapped = [*words[:at], *block[:17], *words[at + 17 :]]
        kinds = [words, words + block, words[cut:], swapped]  # similarities from 0.8 to 0.83
        rows += [(10 * group + i, " ".join(k)) for i, k in enumerate(kinds)]
    want = similar_as_brute_force(spark, rows)
    assert all(want[i] == i - i % 10 for i, _ in rows)


def test_similar_texts_with_repeated_lines(spark):
    line = " ".join(f"line{x}" for x in range(12))
    rows = []
    for group in range(20):
        own = " ".join(f"g{group}w{x}" for x in range(100))
        rows += [(10 * group + i, " ".join([own] + [line] * n)) for i, n in enumerate((3, 60))]
    want = similar_as_brute_force(spark, rows)
    assert all(want[i] == i - i % 10 for i, _ in rows)


def test_rare_languages_are_learned(spark):
    rows = [(1000 * i + n, f"{name} text {n}", name) for i, name in enumerate("abcdefg") for n in range(400 if name != "d" else 8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=70)
    assert set(model.languages) == set("abcdefg")


def test_foreign_texts_are_rejected(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(3)
    noise = [(-i - 1, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 400)), "en") for i in range(30)]
    junk = spark.createDataFrame(noise, table.schema)
    held_out = F.col("doc_id") % 4 == 1
    model = langid.fit(table.filter(F.col("lang").isin("en", "de") & ~held_out).unionByName(junk.filter("doc_id > -3")))
    out = langid.predict(table.filter(held_out & F.col("text").rlike("[a-z]")).unionByName(junk.filter("doc_id < -10")), model).toPandas()
    noisy, known = out.doc_id < 0, out.lang.isin(["en", "de"])
    assert out[noisy].rejected.all()
    assert out[~noisy & (out.lang == "es") & (out.text.str.len() > 200)].rejected.mean() > 0.9
    assert (~out[~noisy & known].rejected).mean() > 0.97


def test_crowds_of_similar_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 2)
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 100000, 178)]
    rows = []
    for group in range(150):  # groups have 0.78 in common with each other
        own = [f"g{group}x{x}" for x in range(22)]
        for copy in range(3):
            rows.append((10 * group + copy, " ".join([*base, *own[:-1], f"end{copy}"])))
    stream = [f"s{x}" for x in rng.integers(0, 100000, 1000)]
    rows += [(5000 + i, " ".join(stream[10 * i : 10 * i + 150])) for i in range(80)]  # a chain: only neighbours are similar
    want = similar_as_brute_force(spark, rows)
    assert all(want[i] == (5000 if i >= 5000 else i - i % 10) for i, _ in rows)


def test_similar_texts_link_fingerprints_first(spark, monkeypatch):
    """Fingerprints of the shingle sets are linked by the pigeonhole, and these links are known before shingles meet."""
    rng = np.random.default_rng(11)
    rows = [(g * 10 + c, [f"v{x}" for x in rng.integers(0, 5000, 400)]) for g in range(6) for c in range(1)]
    rows += [(i + c, [*words[:200], f"new{c}", *words[201:]]) for i, words in rows for c in range(1, 6)]
    rows += [(900 + i, "a crowd of short texts that end alike but for this".split() + [f"n{i}"]) for i in range(4)]
    rows = [(i, " ".join(words)) for i, words in rows]
    verified, known = [], []
    by_fingerprint, tie = simhash._by_fingerprint, simhash._tied

    def linked(*args):
        verified.append(by_fingerprint(*args))
        return verified[-1]

    def tied(met, before, *rest):
        known.extend(before.collect())
        return tie(met, before, *rest)

    monkeypatch.setattr(simhash, "_by_fingerprint", linked)
    monkeypatch.setattr(simhash, "_tied", tied)
    got = {(r.doc_id, r.component) for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_similar(rows)
    assert got == set(want.items())
    sets = {simhash.text_name(t.encode()): set(simhash.shingle_set(t.encode(), 5).tolist()) for _, t in rows}
    links = [(r.a, r.b) for r in verified[0].collect()]
    assert links and known and all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in links)


def test_pairs_of_a_crowd_around_one_text(spark, monkeypatch):
    """A text and copies with few to many words changed: those far from it are compared with few others, not with all."""
    rng = np.random.default_rng(4)
    base = [f"b{x}" for x in rng.integers(0, 100000, 150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        words = list(base)
        for at in rng.choice(150, 1 + i % 9, replace=False):  # up to three changes keep it similar to the first, mostly
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    compared = []
    verify = simhash._verified

    def verified(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(simhash, "_verified", verified)
    similar_as_brute_force(spark, rows)
    assert sum(compared) <= 4 * len(rows), compared
