"""Null keys, single rows, texts above a megabyte and small limits, through several operators; languages by plain counting."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteweave.llm import alignment, ann, bpe, common, decontamination, langid, packing, sharding, simhash, sstable, suffixdedup, whitening
from siteweave.llm.common import scratch
from siteweave.llm.ids import ids_for, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string"
LONG = "".join(f"a sentence of number {i} about things. " for i in range(42_000))  # above 1.5 MB


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, "a text without a name", None, "s"), (None, None, "en", "s"), (1, LONG, "en", "s"), (2, "a short one", "en", None), (2, "a short one", "en", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def single(spark):
    return spark.createDataFrame([(7, "one text alone", "en", "s")], SCHEMA)


def test_digests_and_ids(spark, odd, single):
    ids = ids_for(vocabulary_path())
    for table in (odd, single):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        want = sorted((k is not None, k or 0, len(ids.encode(t))) for k, t in rows)
        coded = bpe.digest(table, None).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in coded) == want
        stored = sstable.read_tables(sstable.write_tables(table, scratch(spark, "odd-ids"))).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens - 1) for r in stored) == want


def test_packing_of_documents_above_a_segment(odd, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 5000)  # the long text lies in many segments
    ids = ids_for(vocabulary_path())
    texts = {r.doc_id: ids.document(r.text) for r in odd.collect() if r.doc_id is not None}
    pieces = packing.pack(odd).collect()
    filled = Counter()
    for key, whole in texts.items():
        own = sorted((p for p in pieces if p.doc_id == key), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(whole) * (2 if key == 2 else 1)
        assert all(p.ids_crc32 == zlib.crc32(whole[p.start : p.start + p.length].astype("<u4").tobytes()) and p.doc_tokens == len(whole) for p in own)
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= packing.LENGTH


def test_searches_by_text(odd, single):
    for table in (odd, single):
        n = table.count()
        assert simhash.near_duplicates(table).count() == suffixdedup.deduplicate(table).count() == sharding.assign_shards(table, 1000).count() == alignment.align(table).count() == n
    same = {r.component for r in simhash.near_duplicates(odd).filter("doc_id = 2").collect()}
    assert same == {2}
    removed = {r.n_removed for r in suffixdedup.deduplicate(single).collect()}
    assert removed == {0}
    found = decontamination.find(odd, odd.select(F.col("doc_id").alias("item_id"), "text")).collect()
    assert all(r.n_hit == r.n_words for r in found) and max(r.n_words for r in found) == len(LONG.replace(".", " ").split())


def test_one_vector(spark):
    table = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert ann.nearest(table, 5, is_query=F.col("id") % 50 == 0).isEmpty()
    assert whitening.whiten(table).count() == 1


@pytest.mark.parametrize("n", [3, 70])
def test_queries_that_meet_too_few(spark, n):
    """With cells so small that no bucket is shared, every query is compared with all objects."""
    m = np.random.default_rng(n).normal(size=(n, 6))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in ann.nearest(table, 4, is_query=F.col("id") % 2 == 0, cell=1e-6, tables=2, visits=1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, n, 2):
        best = [int(c) for c in np.argsort(-(u @ u[q]), kind="stable") if c != q][:4]
        assert [c for _, c in sorted(got[q])] == best


def test_languages_by_plain_counting(spark):
    """Every prediction again: n-grams counted one by one, weighed and compared with each centroid."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)

    def vector(text):
        raw = text.lower().encode("utf-8", "replace")
        raw = b" " + bytes(b if b > 127 or chr(b).isalpha() else 32 for b in raw) + b" "
        held = Counter()
        for i in range(len(raw) - 2):
            for size in (3, 2, 1):
                gram = int.from_bytes(raw[i : i + size], "big") | ((2, 1, 0)[size - 1] << 24)
                held[(gram * 2654435761 % (1 << 32)) >> 20] += 1
        weighed = {k: math.log1p(n) * float(model.idf[k]) for k, n in held.items()}
        norm = math.sqrt(sum(x * x for x in weighed.values()))
        return {k: x / norm for k, x in weighed.items()}

    rows = langid.predict(docs, model).filter("text IS NOT NULL AND lang_pred <> 'und'").limit(60).collect()
    for r in rows:
        own = vector(r.text)
        cosines = [sum(x * float(c[k]) for k, x in own.items()) for c in model.centroids]
        best = max(cosines)
        assert abs(r.score - best) < 1e-4 and best - max(c for c, name in zip(cosines, model.languages, strict=True) if name == r.lang_pred) < 1e-4


def test_labels_without_bound(spark):
    """A dirty column of labels: as many as the sample has rows are learned, the most frequent first."""
    rows = [(i, f"text number {i} in some tongue", "en" if i % 2 else f"label-{i}", "s") for i in range(120)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), sample=20)
    assert "en" in model.languages and len(set(model.languages)) <= 20


def test_run_keeps_only_what_it_returns(spark, tmp_path):
    before = set(common._written)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert not out.isEmpty() and set(common._written) - before == {out.scratch_path}
