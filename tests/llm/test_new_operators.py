"""Whitening, decontamination and alignment against plain Python on small tables with every odd case."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteweave.llm import alignment, decontamination, whitening
from siteweave.llm.bpe import _byte_of

# ---- whitening


def whitened(table, components=8):
    out = {}
    for r in whitening.whiten(table, components=components).collect():
        out.setdefault(r.own.vec_id, []).append(r)
    return out


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(400, 5)) * [3, 1, 0.1, 2, 0.5] + rng.normal(size=5)
    rows = [(i, [float(x) for x in v], "w") for i, v in enumerate(data)]
    odd = [(900, None, "w"), (901, [1.0, None, 0.0, 0.0, 0.0], None), (902, [float("nan")] * 5, "w"), (903, [float("inf")] * 5, "w"), (904, [], "w"), (7, rows[7][1], "again"), (None, rows[8][1], "w"), (905, [0.5], "short")]
    got = whitened(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n string").repartition(7))
    kept = [(i, v + [0.0] * (5 - len(v))) for i, v, _ in rows + [odd[5], odd[6], odd[7]]]
    x = np.floor(1024 * np.array([v for _, v in kept])) + 100000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    want = centred @ vectors / np.sqrt(e)
    mine = np.array([got[i].pop().w for i, _ in kept])
    assert not any(got.values())
    assert np.abs(mine * np.sign((mine * want).sum(0)) - want).max() < 1e-9
    again = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, w string"), components=2).first()
    assert len(again.w) == 2 and len(again.explained) == 2 and again.own.w == "w"


def test_whitening_says_how_exact_it_is(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).normal(size=(150, 4)))]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(object) + 100000
    sums = x.sum(0)
    for r in found:
        assert r.n == 150 and r.deviation == sum((150 * x[r.own.vec_id] - sums) ** 2) and r.identity_error < 1e-10
    total = sum(found[0].explained)
    assert abs(total - 1) < 1e-12 and found[0].explained == sorted(found[0].explained, reverse=True)


def test_whitening_of_flat_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    flat = whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], schema))
    assert all(r.w[0] is not None and r.w[1:] == [None, None] for rows in flat.values() for r in rows)
    for rows in ([(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])]):
        for r in whitening.whiten(spark.createDataFrame(rows, schema)).collect():
            assert set(r.w) == {None} and r.deviation == 0 and r.identity_error is None
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).isEmpty()


def test_triangles_are_stacked_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = spark.range(200).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * k) for k in range(1, 4)]).alias("embedding"))
    assert whitening.whiten(rows.repartition(9)).first().identity_error < 1e-10


def test_jacobi_keeps_small_values():
    rng = np.random.default_rng(2)
    u, v = (np.linalg.qr(rng.normal(size=(7, 7)))[0] for _ in range(2))
    values = 10.0 ** -np.arange(7)
    found, right = whitening.jacobi(u * values @ v.T)
    assert np.abs(found / values - 1).max() < 1e-8 and np.abs(right.T @ right - np.eye(7)).max() < 1e-13


# ---- decontamination

LETTERS = set("abcdefghijklmnopqrstuvwxyz0123456789")


def words_of(text):
    out, now = [], ""
    for c in "".join(x.lower() if x.isascii() else x for x in text or "") + " ":
        if c in LETTERS or ord(c) > 127:
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def plain(docs, items, n=10):
    grams = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            grams[tuple(w[i : i + m])].add(str(item) if item is not None else "null")
    out = []
    for d, text in docs:
        w, hit, found = words_of(text), set(), set()
        for m in {len(g) for g in grams}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in grams:
                    hit |= set(range(i, i + m))
                    found |= grams[tuple(w[i : i + m])]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


ITEM = "Which of the following Numbers, 42 or 7, is the larger one of both über alles?"
ITEMS = [(1, ITEM), (2, "Tiny item"), (10, "tiny ITEM!"), (3, ""), (4, None), (None, "solo"), (5, "?!"), (6, " ".join(f"w{i}" for i in range(25))), (1, "a second text of item one that has more than ten words in all")]
LONG = "word " * 300_000
DOCS = [
    (1, "Before. " + ITEM.upper().replace("ÜBER", "über") + " After it."), (2, "which of the following numbers 42 or 7 is the larger"), (2, "which of the following numbers 42 or 7 is"), (3, None), (4, ""), (5, "..."),
    (6, "x tiny-item y tiny item"), (7, "solo"), (8, "unsolo"), (None, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w2"), (9, LONG + ITEM + LONG), (10, "tiny"), (11, "item"), (12, "following numbers 42 or 7 is the larger one of both üBER"),
]


@pytest.mark.parametrize("limit", [decontamination.LIMIT, 300])
def test_decontamination(spark, limit):
    docs = spark.createDataFrame([(d, t, "o", 1, "s") for d, t in DOCS], "doc_id long, text string, own string, n_hit int, items string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [(r.own.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontamination.find(docs, items, limit=limit).collect()]
    assert sorted(got, key=str) == sorted(plain(DOCS, ITEMS), key=str)


def test_decontamination_removes(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id long, text string, runs int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items).collect() if r.doc_id not in (2, None)}
    assert cut[1] == "Before. ? After it." and cut[3] is None and cut[6] == "x  y " and cut[7] == "" and cut[8] == "unsolo" and cut[5] == "..."
    assert cut[9] == LONG + "?" + LONG
    left = decontamination.decontaminate(docs, items, remove="documents")
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3, 4, 5, 8, 10, 11}
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, items, remove="words")


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS[:3], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.find(docs.limit(0), items).isEmpty()
    assert {r.n_hit for r in decontamination.find(docs, items.limit(0)).collect()} == {0}


def test_equal_hashes_are_verified(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "_mixed", lambda h: h & np.uint64(0))  # every window meets every n-gram
    letters, first = decontamination._contents(pa.array(["alpha beta", "tiny item"]))
    known = decontamination.Slice([b"tiny item"], ["2"])
    assert [m[1] for m in decontamination._marks(letters, first, known, [None, None])] == [0, 2]


# ---- alignment

TEXTS = [
    (1, "The quick brown fox, jumps over 42 lazy dogs."), (2, None), (3, ""), (4, " "), (5, "  two  spaces \n\n and\ttabs   x "), (6, "日本語のテキスト and émigré ﬁ"), (7, "a▁b is not a space"), (1, "The quick brown fox, jumps over 42 lazy dogs."),
    (8, "<|endoftext|> and <s> stay text"), (None, "the the the"), (9, "long " * 30000), (10, "x" * 5000), (11, "\x00 \x1c y"), (12, "don't we'll it's 's"),
]


def one_by_one(texts, by):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.vocabulary_path())
    a.encode_special_tokens = True
    a.no_truncation()
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.piece_path())
    alphabet = _byte_of()
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, counts = [], Counter()
    for key, text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        bx, by_ = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        if b"".join(bx) != raw or b"".join(by_) != raw or not text:
            rows.append((key, 0, 0, [], []))
            continue
        ex, ey = np.cumsum([len(t) for t in bx]).tolist(), np.cumsum([len(t) for t in by_]).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ex) & set(ey)):
            p, q = ex.index(end, i) + 1, ey.index(end, j) + 1
            groups.append((tuple(x[i:p]), tuple(y[j:q])))
            links.append((x[p - 1], y[q - 1], groups[-1]))
            i, j = p, q
        counts.update(links if by == "links" else set(links))
        rows.append((key, len(x), len(y), groups, [n[:2] for n in links]))
    pairs = Counter()
    for (p, q, _), c in counts.items():
        pairs[p, q] += c
    most = defaultdict(int)
    for (_, q), c in pairs.items():
        most[q] = max(most[q], c)
    said = lambda g: ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
    return [(k, na, nb, len(g), len(n), hashlib.sha256(said(g).encode()).hexdigest() if g else "", sum(pairs[x] == most[x[1]] for x in n), sum(pairs[x] for x in n)) for k, na, nb, g, n in rows]


@pytest.mark.parametrize("by", ["links", "documents"])
@pytest.mark.parametrize("block", [alignment.BLOCK, 1])
def test_alignment(spark, monkeypatch, by, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    docs = spark.createDataFrame([(d, t, 1, "g") for d, t in TEXTS], "doc_id long, text string, part int, grp string").repartition(3)
    got = [tuple(r) for r in alignment.align(docs, by=by).collect()]
    assert sorted(got, key=str) == sorted(one_by_one(TEXTS, by), key=str)


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    assert [tuple(r)[1:] for r in alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(0, 0, 0, 0, "", 0, 0)]
    with pytest.raises(ValueError):
        alignment.align(spark.createDataFrame([], "doc_id long, text string"), by="words")


def test_links_end_together():
    a, b = np.array([1, 2, 3]), np.array([3, 1, 2])  # bytes of tokens: 1 + 2 end where 3 does, 3 more where 2 + 1 do
    assert alignment.expand(np.array([2, 0, 1, 0], "<u4").tobytes(), a, b) == [(1, 0)]
    assert alignment.expand(np.array([3, 0, 1, 2, 0, 2, 1], "<u4").tobytes(), a, b) == [(1, 0), (2, 1)]


def test_cuts_at_spaces_change_nothing():
    rng = np.random.default_rng(11)
    pair = alignment.pair_for(alignment.vocabulary_path(), alignment.piece_path())
    parts = [" ", "  ", "\n", "\t", "a", "Zürich", "'s", "12", "!", " ", " ", "日本", "\x1c", "​", "é"]
    for _ in range(2000):
        text = "".join(rng.choice(parts, size=rng.integers(1, 9)))
        words = alignment.cut(text)
        assert " ".join(words) == text
        x, y, _ = pair.encode(words)
        p, q, _ = pair.encode([text])
        assert sum(x, []) == p[0] and sum(y, []) == q[0], repr(text)


def test_decontamination_by_sql(spark):
    import duckdb

    from siteweave.llm import registry

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    columns = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    want = con.execute(f"SELECT {columns} FROM ({registry.ORACLES['op12_decontamination']})").fetchall()
    got = decontamination.op12_decontamination(spark, "/root/testdata/sf0.001").selectExpr(*columns.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r[5] for r in want) and not all(r[5] for r in want)
