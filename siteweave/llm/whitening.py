"""Whitening of embeddings: one-sided Jacobi SVD of the triangle that a blockwise TSQR leaves of the centred rows.

Vectors are fixed-point integers, so their sums, and what a row deviates from the mean, are exact. Tasks compress their
centred rows to a triangle each, block by block; triangles are stacked and compressed again, FAN at a time, until one is
left, whatever the number of rows. Plane rotations make its columns orthogonal: their lengths are the standard
deviations (times the root of n), and the rotations themselves add up to the components. The covariance is never formed,
so small deviations keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave.llm.common import discard, materialize

#: Rows of a block of the TSQR, and triangles that are stacked at a time.
BLOCK, FAN = 4096, 16
#: Columns count as orthogonal below this cosine. Rounds over all pairs of columns, at most.
ORTHOGONAL, SWEEPS = 1e-15, 60
#: Fixed-point form of the registered query: floor(SCALE * entry) + OFFSET. Entries beyond LARGEST do not fit it.
SCALE, OFFSET, LARGEST = 1024, 100_000, 2.0**52


@dataclass
class Whitening:
    """n rows with sums ``sums``; ``components`` (a column each) by falling ``deviations``; ``trace`` of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    trace: float

    def explained(self) -> list[float | None]:
        return [float(s * s / self.trace) if self.trace > 0 else None for s in self.deviations]

    def usable(self) -> np.ndarray:
        """Components along which rows differ at all; the others have no whitened value."""
        return self.deviations > self.deviations.max(initial=0.0) * len(self.sums) * np.finfo(float).eps


def fixed_point(vector: str, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * entry) + offset, as longs."""
    return F.transform(vector, lambda c: (F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(offset)).cast("long"))


def jacobi(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns), falling, by plane rotations of pairs of columns.

    In each of a sweep's turns every column is in one pair, so that a turn's rotations are independent and done at once.
    A vector's entry of largest size is positive.
    """
    d = triangle.shape[1]
    m = d + d % 2
    u, v = np.zeros((len(triangle), m)), np.eye(m)
    u[:, :d] = triangle
    order = np.arange(m)
    for _ in range(SWEEPS):
        largest = 0.0
        for _ in range(m - 1):
            i, j = order[: m // 2], order[m // 2 :][::-1]
            a, b = u[:, i], u[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            with np.errstate(all="ignore"):
                cosine = np.where((aa > 0) & (bb > 0), np.abs(ab) / np.sqrt(aa) / np.sqrt(bb), 0.0)
                zeta = (bb - aa) / (2 * ab)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where((cosine > ORTHOGONAL) & np.isfinite(t), t, 0.0)
            largest = max(largest, float(cosine.max(initial=0.0)))
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            for w in (u, v):
                left, right = w[:, i], w[:, j]
                w[:, i], w[:, j] = c * left - s * right, s * left + c * right
            order[1:] = np.roll(order[1:], 1)
        if largest <= ORTHOGONAL:
            break
    values, v = np.sqrt((u * u).sum(0))[:d], v[:d, :d]
    falling = np.argsort(-values, kind="stable")
    values, v = values[falling], v[:, falling]
    return values, v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0)


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _added(rows: DataFrame, size: int, kind: str, of) -> np.ndarray:
    """The sum over all rows of what ``of(batch)`` gives, ``size`` numbers: added up in each task, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = of(batch).ravel()
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["place", "part"])

    sums = rows.mapInArrow(run, f"place int, part {kind}").groupBy("place").agg(F.sum("part").alias("part"))
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for place, part in sums.collect():  # a number for each place
        out[place] = part
    return out


def _compress(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _triangle(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows. Each row is n * x - sums, exact, over n."""
    width = len(sums)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            x = _vectors(batch, width)
            for at in range(0, len(x), BLOCK):
                r = _compress(np.concatenate([r, (n * x[at : at + BLOCK] - sums) / n]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["node", "r"])

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = _compress(np.concatenate([np.frombuffer(x["r"]).reshape(-1, width) for x in members]))
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["node", "r"])

    level = materialize(rows.select("x").mapInArrow(local, "node long, r binary"), "whitening-triangles")
    while level.count() > 1:
        above = level.groupBy(F.floor(F.col("node") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("node", "r"))).alias("members"))
        below, level = level, materialize(above.mapInArrow(stacked, "node long, r binary"), "whitening-triangles")
        discard(below)
    r = np.frombuffer(level.first()["r"]).reshape(-1, width)
    discard(level)
    return r


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of ``rows``, whose column ``x`` holds arrays of longs, all of one length and without nulls.

    None for no rows. Read ``rows`` from storage: it is read three times. Sums must stay below 2 ** 62.
    """
    n, width, low, high = rows.agg(F.count("*"), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not n:
        return None
    if n * max(abs(low), abs(high)) >= 1 << 62:
        raise ValueError("entries are too large for exact sums")
    sums = _added(rows, width, "long", lambda batch: _vectors(batch, width).sum(axis=0))
    values, components = jacobi(_triangle(rows, n, sums))
    deviations = values / np.sqrt(n)
    return Whitening(n, sums, components, deviations, float((deviations**2).sum()))


def transform(rows: DataFrame, model: Whitening, components: int) -> DataFrame:
    """``rows`` with ``w`` (array of doubles): centred, projected on the first components, over their deviations.

    A component along which no row deviates gives null. ``rows`` has ``own`` (a struct) and ``x``.
    """
    n, sums, width = model.n, model.sums, len(model.sums)
    k = min(components, width)
    usable = model.usable()[:k]
    directions = model.components[:, :k] / np.where(usable, model.deviations[:k], 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, width)
            parts = [((n * x[at : at + BLOCK] - sums) / n) @ directions for at in range(0, len(x), BLOCK)]
            w = np.concatenate(parts) if parts else np.zeros((0, k))
            flat = pa.array(w.ravel(), mask=np.tile(~usable, len(w)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["own", "x", "w"])

    schema = rows.select("own", "x").schema.add("w", T.ArrayType(T.DoubleType()))
    return rows.select("own", "x").mapInArrow(run, schema)


def identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of ``w``, as stored, minus the identity; null components are left out."""
    k = min(len(whitened.first()["w"]), len(model.sums))
    at = np.flatnonzero(model.usable()[:k])
    if not len(at):
        return None

    def values(batch: pa.RecordBatch) -> np.ndarray:
        return np.nan_to_num(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(-1, k)[:, at]

    rows = whitened.select("w")
    mean = _added(rows, len(at), "double", lambda batch: values(batch).sum(axis=0)) / model.n

    def products(batch: pa.RecordBatch) -> np.ndarray:
        centred = values(batch) - mean
        return centred.T @ centred

    covariance = _added(rows, len(at) ** 2, "double", products).reshape(len(at), -1) / model.n
    return float(np.abs(covariance - np.eye(len(at))).max())


def whiten(table: DataFrame, *, vector: str = "embedding", components: int = 8, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``table`` with n, deviation, w, explained and identity_error: each row's whitened values, a list by component.

    Entries become floor(scale * entry) + offset. The columns of ``table`` come as a struct ``own``, whatever their
    names. Rows take no part whose vector is null or empty, or holds an entry that is null, not finite or beyond 2 ** 52
    once scaled. A vector shorter than the longest counts as filled with zeros. Null and repeated keys are rows like any
    other. ``deviation`` is exact; it is null where it does not fit a long. Vectors that span fewer directions than
    there are components have null in the components that are left; of equal eigenvalues the order is that of the
    rotations. An empty table gives no row.
    """
    fits = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.lit(float(scale)) * c.cast("double")) < LARGEST))
    boxed = table.filter((F.size(vector) > 0) & fits).select(F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("own"), fixed_point(f"`{vector}`", scale, offset).alias("x"))
    rows = materialize(boxed, "whitening-rows")
    short, width = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if short != width:
        rows = materialize(rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(offset).cast("long"), F.lit(width) - F.size("x")))), "whitening-filled")
    model = fit(rows)
    if model is None:
        nothing = {"n": "long", "deviation": "long", "w": "array<double>", "explained": "array<double>", "identity_error": "double"}
        return rows.select("own", *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()])
    whitened = materialize(transform(rows, model, components), "whitening-out")
    error = identity_error(whitened, model)
    off = F.zip_with("x", F.array(*[F.lit(int(s)).cast("long") for s in model.sums]), lambda x, s: F.lit(model.n).cast("long") * x - s)
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda total, d: F.try_add(total, F.try_multiply(d, d)))
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained()[:components]])
    return whitened.select("own", F.lit(model.n).cast("long").alias("n"), deviation.alias("deviation"), "w", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on their first eight components: a row for each vector and component."""
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    flat = found.select("own.vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("w", "explained")).alias("at", "c"))
    return flat.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.w").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
