"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing with exact reranking.

Vectors of unit length are projected on Gaussian directions, shifted and cut into cells of width ``WIDTH``; a table's
key is the cells of ``HASHES`` projections. A query visits its own bucket and, in each table, perturbed buckets in the
order of their estimated success: the sum of squared distances to the cell borders that a perturbation crosses. Buckets
travel with their vectors, so candidates are reranked exactly where they are found, and tables' candidates are merged.

Rows with equal vectors are one object, which keeps its k + 1 smallest ids: no other of them can be among the k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm.common import materialize, partitions
from siteweave.llm.vectors import answer, clean_vectors, matrix, objects, seekers

TABLES, HASHES, WIDTH, PROBES = 10, 6, 1.5, 56
SEED = 20
#: Queries whose best candidates a task holds before it passes them on.
HELD = 1 << 14
#: Objects of a block where queries are compared with all of them.
ALL = 4096


def probes(place: np.ndarray, count: int) -> np.ndarray:
    """Perturbations of a key, one row each, the most promising first; ``place`` is where in its cell each value lies."""
    k = len(place)
    distance = np.concatenate((place, 1 - place)) ** 2
    order = np.argsort(distance, kind="stable")
    cost, axis, step = distance[order].tolist(), (order % k).tolist(), np.where(order < k, -1, 1).tolist()
    out, heap = [np.zeros(k, np.int64)], [(cost[0], (0,))]
    while heap and len(out) < count:
        total, chosen = heappop(heap)
        if len({axis[i] for i in chosen}) == len(chosen):  # not both borders of a cell
            move = np.zeros(k, np.int64)
            for i in chosen:
                move[axis[i]] = step[i]
            out.append(move)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return np.stack(out)


class Hashing:
    def __init__(self, width: int, tables: int, hashes: int, cell: float) -> None:
        rng = np.random.default_rng(SEED)
        self.tables, self.hashes = tables, hashes
        self.directions = rng.normal(size=(tables, width, hashes)) / cell
        self.shifts = rng.uniform(0, 1, (tables, 1, hashes))
        self.mix = rng.integers(1, 2**62, hashes) * 2 + 1

    def places(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and where in them the values lie."""
        at = unit @ self.directions[table] + self.shifts[table]
        cells = np.floor(at)
        return cells.astype(np.int64), at - cells

    def keys(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.mix).sum(axis=-1)


def _grouped(table: int, keys: np.ndarray, which: np.ndarray, ids: np.ndarray, vectors: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row for each key: its members' ids and vectors, packed."""
    order = np.argsort(keys, kind="stable")
    keys, which = keys[order], which[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    ends = np.append(starts[1:], len(keys))
    groups = [which[a:b] for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), table, np.int32)), pa.array(keys[starts]), pa.array([ids[g].tobytes() for g in groups], pa.binary()), pa.array([vectors[g].tobytes() for g in groups], pa.binary())], names)


def nearest(table: DataFrame, k: int, *, is_query: Column, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, hashes: int = HASHES, cell: float = WIDTH, visits: int = PROBES) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` nearest other rows found, by cosine, ties to smaller ids.

    ``is_query`` is a condition on the key, named ``id``. Rows with a null key, a null, empty or zero vector, or a null
    or non-finite component take no part. Shorter vectors count as filled with zeros. An empty table gives no rows. No
    row with a query's key is returned to it. Scores are exact; neighbours whose buckets no probe visits are missed,
    except that a query which met fewer than ``k`` objects is compared with all of them.
    """
    keep = k + 1  # a query's own object is among them
    nonzero = F.exists("v", lambda x: x != 0)
    rows = materialize(clean_vectors(table, key, vector).filter(nonzero), "ann-rows")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    members = materialize(objects(rows, keep), "ann-objects")
    asked = materialize(seekers(rows, is_query, members), "ann-asked")
    wanted = materialize(members.join(asked.select(F.col("object").alias("id")).distinct(), "id", "left_semi"), "ann-wanted")
    single = table.schema[vector].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"  # either holds the vectors exactly
    hashing = Hashing(width, tables, hashes, cell)

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m = matrix(batch, width)
            u, packed = unit(m), m.astype(kind)
            for t in range(tables):
                yield _grouped(t, hashing.keys(hashing.places(u, t)[0]), np.arange(len(ids)), ids, packed, ["t", "bucket", "cids", "cm"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m = matrix(batch, width)
            u, packed = unit(m), m.astype(kind)
            for t in range(tables):
                cells, place = hashing.places(u, t)
                moves = [probes(p, visits) for p in place]
                keys = hashing.keys(np.concatenate([c + x for c, x in zip(cells, moves, strict=True)])) if len(ids) else np.zeros(0, np.int64)
                yield _grouped(t, keys, np.repeat(np.arange(len(ids)), [len(x) for x in moves]), ids, packed, ["t", "bucket", "qids", "qm"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, float]] = {}

        def flush() -> pa.RecordBatch:
            found = [(q, c, s) for q, own in best.items() for c, s in own.items()]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["q", "c", "score"])

        for batch in batches:
            get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(len(batch)):
                q, c = (np.frombuffer(get[x][i].as_buffer(), np.int64) for x in ("qids", "cids"))
                a, b = (np.frombuffer(get[x][i].as_buffer(), kind).reshape(n, width).astype(np.float64) for x, n in (("qm", len(q)), ("cm", len(c))))
                scores = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1))
                n = min(keep, len(c))
                least = np.partition(scores, len(c) - n, axis=1)[:, len(c) - n]
                for row, x in enumerate(q.tolist()):
                    own = best.setdefault(x, {})
                    floor = min(own.values()) if len(own) >= keep else -2.0
                    among = np.flatnonzero(scores[row] >= least[row])  # with all that tie with the last of the best
                    top = among[np.lexsort((c[among], -scores[row][among]))][:n]
                    for j in top:
                        if scores[row, j] >= floor:
                            own[int(c[j])] = float(scores[row, j])
                    if len(own) > 4 * keep:
                        best[x] = dict(sorted(own.items(), key=lambda e: (-e[1], e[0]))[:keep])
                if len(best) > HELD:
                    yield flush()
        yield flush()

    buckets = members.select("id", "v").mapInArrow(index, "t int, bucket long, cids binary, cm binary")
    calls = wanted.select("id", "v").mapInArrow(visit, "t int, bucket long, qids binary, qm binary")
    found = calls.hint("merge").join(buckets, ["t", "bucket"]).select("qids", "qm", "cids", "cm").mapInArrow(rerank, "q long, c long, score double")
    found = materialize(found.groupBy("q", "c").agg(F.max("score").alias("score")), "ann-found")
    # Queries that met too few objects, as on tiny tables, are compared with all of them.
    enough = found.groupBy("q").count().filter(F.col("count") >= keep).select(F.col("q").alias("id"))
    short = materialize(wanted.join(enough, "id", "left_anti"), "ann-short")
    if not short.isEmpty():
        found = found.unionByName(_against_all(short, members, rerank, width, kind)).groupBy("q", "c").agg(F.max("score").alias("score"))
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("at") <= keep)
    return answer(asked, best.select("q", "c", "score"), members, k)


def _against_all(few: DataFrame, members: DataFrame, rerank, width: int, kind: str) -> DataFrame:
    """(q, c, score): packed blocks of the few queries meet packed blocks of all objects, which are dealt over the tasks.

    The queries' blocks are copied to each of them.
    """
    parts = partitions(few)

    def packed(names: list[str], to: list[int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), ALL):
                    ids, m = matrix(batch.slice(at, ALL), width)
                    for part in [TaskContext.get().partitionId()] if to is None else to:
                        yield _grouped(0, np.full(len(ids), part, np.int64), np.arange(len(ids)), ids, m.astype(kind), names)

        return run

    ask = few.select("id", "v").mapInArrow(packed(["t", "part", "qids", "qm"], list(range(parts))), "t int, part long, qids binary, qm binary").drop("t")
    have = members.select("id", "v").repartition(parts).mapInArrow(packed(["t", "part", "cids", "cm"], None), "t int, part long, cids binary, cm binary").drop("t")
    return ask.hint("merge").join(have, "part").select("qids", "qm", "cids", "cm").mapInArrow(rerank, "q long, c long, score double")


def op6_ann(spark, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth one, by cosine."""
    found = nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 5, is_query=F.col("id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")
