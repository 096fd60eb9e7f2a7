"""Exact top-k search by inner product: the three-phase uniform threshold algorithm over lists of partial scores.

Components are split into lists; an object's score is the sum of its partial scores, and each list is scored by tasks
of its own, block of queries by block of candidates. Phase 1 gathers each list's best entries for each query; their
exact sums give a k-th best score to beat. Phase 2: that bound, spread evenly over the lists, is the cutoff; lists send
all entries at or above it, and an object that no list sends cannot be among the best. What was sent and the cutoffs of
the other lists bound an object's score from above. Phase 3 asks the lists for what is missing of the objects whose
bound still reaches the k-th best known score.

Rows with equal vectors are one object, which keeps its k + 1 smallest ids: no other of them can be among the k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm.common import materialize
from siteweave.llm.vectors import answer, clean_vectors, matrix, objects, seekers

LISTS = 2
#: Objects of a block of candidates and of queries.
CANDIDATES, QUERIES = 4096, 1024
#: Entries that phase 1 gathers from each list, as a multiple of those asked for.
GATHER = 2
ENTRY = "q long, qb long, c long, cb long, list int, s long"


def _blocks(items: DataFrame, size: int, width: int, lists: int, prefix: str) -> DataFrame:
    """(list, <prefix>b, <prefix>ids, <prefix>m): packed blocks of at most ``size`` objects, named by their first id."""
    cuts = np.linspace(0, width, lists + 1).astype(int)
    names = ["list", f"{prefix}b", f"{prefix}ids", f"{prefix}m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            own, m = np.concatenate(ids), np.concatenate(rows)
            for at in range(0, len(own), size):
                part, label = np.ascontiguousarray(m[at : at + size]), own[at : at + size]
                packed = [np.ascontiguousarray(part[:, a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(range(lists), pa.int32()), pa.array([int(label[0])] * lists, pa.int64()), pa.array([label.tobytes()] * lists, pa.binary()), pa.array(packed, pa.binary())], names)

        for batch in batches:
            own, m = matrix(batch, width)
            ids.append(own)
            rows.append(m)
            held += len(own)
            if held >= size:
                yield from flush()
                ids, rows, held = [], [], 0
        if held:
            yield from flush()

    return items.select("id", "v").mapInArrow(run, f"list int, {prefix}b long, {prefix}ids binary, {prefix}m binary")


class Met:
    """A block of queries that meets a block of candidates in one list."""

    def __init__(self, row: dict) -> None:
        self.row = row
        self.q, self.c = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["cids"], np.int64)
        self.a, self.b = np.frombuffer(row["qm"]).reshape(len(self.q), -1), np.frombuffer(row["cm"]).reshape(len(self.c), -1)
        top = max(1.0, np.abs(self.a).max(initial=0)) * max(1.0, np.abs(self.b).max(initial=0)) * max(1, self.a.shape[1])
        self.exact = top < 2**52  # then sums of doubles are exact

    def scores(self) -> np.ndarray:
        return (self.a @ self.b.T).astype(np.int64) if self.exact else self.a.astype(np.int64) @ self.b.astype(np.int64).T

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        kind = np.float64 if self.exact else np.int64
        return np.concatenate([(self.a[i[n : n + 65536]].astype(kind) * self.b[j[n : n + 65536]].astype(kind)).sum(axis=1).astype(np.int64) for n in range(0, max(1, len(i)), 65536)])

    def entries(self, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        full = lambda x, kind: pa.array(np.full(len(i), x, kind))
        return pa.RecordBatch.from_arrays([pa.array(self.q[i]), full(self.row["qb"], np.int64), pa.array(self.c[j]), full(self.row["cb"], np.int64), full(self.row["list"], np.int32), pa.array(s)], ["q", "qb", "c", "cb", "list", "s"])


def _each(made) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield made(Met({name: batch.column(n)[i].as_py() for n, name in enumerate(batch.schema.names)}))

    return run


def top_k(table: DataFrame, k: int, *, is_query: Column, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` best other rows by integer inner product, ties to smaller ids.

    Components become floor(scale * x). ``is_query`` is a condition on the key, named ``id``. Rows with a null key, a
    null or empty vector, or a null or non-finite component take no part. A vector shorter than the longest counts as
    filled with zeros. Fewer than ``k`` candidates give fewer rows; an empty table gives none. Rows that repeat a key
    count as rows of their own, except that no row with a query's key is returned to it. Scores beyond 64 bits wrap.
    """
    keep = k + 1  # a query's own object is among them
    vectors = clean_vectors(table, key, vector).withColumn("v", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double")))
    rows = materialize(vectors, "topk-rows")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    members = materialize(objects(rows, keep), "topk-objects")
    asked = materialize(seekers(rows, is_query, members), "topk-asked")
    candidates = materialize(_blocks(members, CANDIDATES, width, lists, "c"), "topk-candidates")
    wanted = members.join(asked.select(F.col("object").alias("id")).distinct(), "id", "left_semi")
    queries = materialize(_blocks(wanted, QUERIES, width, lists, "q"), "topk-queries")
    # Every block of queries meets every block of candidates of its list.
    pairs = materialize(queries.select("list", "qb").join(candidates.select("list", "cb"), "list"), "topk-pairs")

    def met(extra: DataFrame, on: list[str]) -> DataFrame:
        return pairs.join(extra, on).join(queries, ["list", "qb"]).join(candidates, ["list", "cb"])

    def resolve(known: DataFrame) -> DataFrame:
        """(q, c, score) of objects (q, qb, c, cb, have, s): missing lists are asked for their partial scores."""
        every = F.array(*map(F.lit, range(lists)))
        gaps = known.withColumn("list", F.explode(F.array_except(every, "have")))
        requests = gaps.groupBy("list", "qb", "cb").agg(F.collect_list(F.struct("q", "c")).alias("pairs"))

        def look(m: Met) -> pa.RecordBatch:
            q, c = (np.array([p[n] for p in m.row["pairs"]], np.int64) for n in ("q", "c"))
            qs, cs = np.argsort(m.q), np.argsort(m.c)
            i, j = qs[np.searchsorted(m.q, q, sorter=qs)], cs[np.searchsorted(m.c, c, sorter=cs)]
            return m.entries(i, j, m.at(i, j))

        found = met(requests, ["list", "qb", "cb"]).mapInArrow(_each(look), ENTRY)
        return known.select("q", "c", "s").unionByName(found.select("q", "c", "s")).groupBy("q", "c").agg(F.sum("s").alias("score"))

    def gathered(entries: DataFrame) -> DataFrame:
        return entries.groupBy("q", "qb", "c", "cb").agg(F.collect_list("list").alias("have"), F.sum("s").alias("s"))

    def kth(scores: DataFrame, column: str) -> DataFrame:
        """(q, bar): the keep-th best of ``column``; null where there are fewer."""
        at = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(column)))
        return scores.withColumn("at", at).filter(F.col("at") <= keep).groupBy("q").agg(F.when(F.count("*") >= keep, F.min(column)).alias("bar"))

    def local(m: Met) -> pa.RecordBatch:
        scores, n = m.scores(), min(keep * GATHER, len(m.c))
        best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        i = np.repeat(np.arange(len(m.q)), n)
        return m.entries(i, best.ravel(), scores[i, best.ravel()])

    first = pairs.join(queries, ["list", "qb"]).join(candidates, ["list", "cb"]).mapInArrow(_each(local), ENTRY)
    at = F.row_number().over(Window.partitionBy("q", "list").orderBy(F.desc("s"), "c"))
    sent = materialize(first.withColumn("at", at).filter(F.col("at") <= keep * GATHER).drop("at"), "topk-sent")
    exact1 = materialize(resolve(gathered(sent)), "topk-gathered")
    homes = sent.select("q", "qb").distinct()
    cut = F.ceil(F.col("bar") / F.lit(lists)).cast("long")
    cutoffs = materialize(homes.join(kth(exact1, "score"), "q", "left").select("q", "qb", cut.alias("cut")), "topk-cutoffs")
    by_block = cutoffs.groupBy("qb").agg(F.collect_list(F.struct("q", "cut")).alias("cuts"))  # a block's queries

    def above(m: Met) -> pa.RecordBatch:
        cuts = {c["q"]: c["cut"] for c in m.row["cuts"]}
        lowest = np.iinfo(np.int64).min
        limit = np.array([lowest if cuts[x] is None else cuts[x] for x in m.q.tolist()], np.int64)
        scores = m.scores()
        i, j = np.nonzero(scores >= limit[:, None])
        return m.entries(i, j, scores[i, j])

    second = met(by_block, ["qb"]).mapInArrow(_each(above), ENTRY)
    known = materialize(gathered(second).join(cutoffs.select("q", "cut"), "q"), "topk-known")
    gap = F.lit(lists) - F.size("have")
    whole = known.filter(gap == 0).select("q", "c", F.col("s").alias("score"))
    bar = kth(exact1.unionByName(whole).distinct(), "score").filter("bar IS NOT NULL")
    most = F.col("s") + F.when(gap == 0, 0).otherwise(gap * (F.col("cut") - 1))
    left = known.join(bar, "q", "left").filter(F.col("bar").isNull() | F.col("cut").isNull() | (most >= F.col("bar")))
    scored = resolve(left.select("q", "qb", "c", "cb", "have", "s"))
    best = scored.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("at") <= keep)
    return answer(asked, best.select("q", "c", "score"), members, k)


def op1_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best vectors for every twentieth one, by inner product of 64ths."""
    found = top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20, is_query=F.col("id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")


ORACLE = """
WITH f AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT * FROM f WHERE vec_id % 20 = 0) q JOIN f c ON q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
