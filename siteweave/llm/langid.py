"""Language identification by nearest centroids of normalised TF-IDF vectors of character n-grams.

Byte 1- to 3-grams of the lower-cased text are hashed into a vector of fixed size. Weights are dampened counts times
the inverse document frequency. Each language gets several centroids by spherical k-means; a text takes the language
of the centroid with the largest cosine. If that cosine is far below what held-out members of the language reach in
texts of that length, the text is marked as rejected.

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` rows in all, but at least one a language); every
row is classified whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave.llm.common import bucket_of, discard, materialize, top_counts

#: Size of the hashed vectors.
DIMENSIONS = 1 << 12
#: Most labelled rows that the model is fitted on, over all languages.
SAMPLE = 2048
#: Centroids of each language.
CENTROIDS = 4
#: A text is rejected below this share of the cosine that all but the share ``LOW`` of held-out members reach.
REJECT, LOW = 0.5, 0.05
#: Lengths in characters from which a floor of its own holds; shorter texts show too little to be rejected.
LENGTHS = (8, 16, 32, 64, 128, 256, 512, 1024)
#: Held-out members from which a centroid has floors of its own, and the least share of its language's rows.
OWN, LEAST = 32, 0.01
UNDETERMINED = "und"

LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters counts as a space.
_BLANK = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def counts(text: str) -> np.ndarray:
    """Hashed counts of a whole text's 1-, 2- and 3-grams."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_BLANK) + b" ", np.uint8)
    out = np.zeros(DIMENSIONS, np.float32)
    for at in range(0, max(1, len(raw) - 2), 1 << 20):  # a very long text stays in bounded memory
        part = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        three = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        for grams in (three, three >> np.uint32(8) | np.uint32(1 << 24), three >> np.uint32(16) | np.uint32(2 << 24)):
            out += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    return out


def weigh(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(rows) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    """languages[i] is the language of row i of the centroids; floors[i] are the cosines below which it rejects, by length."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray

    def nearest(self, text: str) -> tuple[str, float, bool]:
        cosines = self.centroids @ weigh(counts(text), self.idf)
        i = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[i])))
        return self.languages[i], score, bool(score < self.floors[i, bisect_right(LENGTHS, len(text))])


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit vectors: centroids and each row's own. Starts from rows far from each other."""
    chosen = [int(np.argmax(rows @ rows.mean(axis=0)))]
    nearest = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centroids, own = rows[chosen], None
    for _ in range(rounds):
        now = np.argmax(rows @ centroids.T, axis=1)
        if own is not None and (now == own).all():
            break
        own = now
        sums = np.stack([rows[own == i].sum(axis=0) if (own == i).any() else centroids[i] for i in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids, np.argmax(rows @ centroids.T, axis=1)


def _floors(heads: list[str], vectors: np.ndarray, made: np.ndarray, idf: np.ndarray, centroids: int) -> np.ndarray:
    """Row i, column c: the cosine below which centroid i rejects texts of length class c; class 0 rejects none.

    Rows are cut to each length and compared with centroids of the other half of the rows. A low quantile is taken, so
    a few mislabelled rows move nothing. A length that no row has takes the floor of the length before.
    """
    halves = [np.arange(len(heads)) % 2 == f for f in range(2)]
    others = [cluster(vectors[~own], centroids)[0] if (~own).any() else made for own in halves]
    out = np.zeros((len(made), len(LENGTHS) + 1))
    for c, length in enumerate(LENGTHS, 1):
        cosines, nearest = [], []
        for own, other in zip(halves, others, strict=True):
            cut = [heads[i][:length] for i in np.flatnonzero(own) if len(heads[i]) >= length]
            if cut:
                rows = weigh(np.stack([counts(t) for t in cut]), idf)
                cosines.append((rows @ other.T).max(axis=1))
                nearest.append((rows @ made.T).argmax(axis=1))
        if not cosines:
            out[:, c] = out[:, c - 1]
            continue
        cosine, at = np.concatenate(cosines), np.concatenate(nearest)
        for i in range(len(made)):
            own = cosine[at == i]
            out[i, c] = REJECT * np.quantile(own if len(own) >= OWN else cosine, LOW)
    return out


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", training: Column | None = None, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """Fits centroids on an equal share of labelled rows for each language; None if there is no labelled row.

    The share is ``sample`` over the number of languages, but at least one row. If there are more labels than ``sample``,
    as in a dirty column, the most frequent ones are learned, that many at most; labels of the frequency at which the
    limit falls are all left out, unless there are none above it. ``training`` restricts the rows to learn from. Rows are drawn by a hash of their
    key. Only their vectors, of fixed size, and the first characters of their texts reach the driver.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.filter(training) if training is not None else rows
    labels = materialize(rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")), "langid-labels")
    kept = labels if labels.count() <= sample else top_counts(labels, "n", sample)
    sizes = {r[0]: r[1] for r in kept.collect()}
    if not sizes and not labels.isEmpty():  # all have one frequency: the first by name
        sizes = {r[0]: r[1] for r in labels.orderBy(F.desc("n"), "lang").limit(sample).collect()}
    discard(labels)
    if not sizes:
        return None
    rows = rows.filter(F.col(lang).isin(list(sizes))) if len(sizes) <= 1000 else rows.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in sizes], "lang string")).withColumnRenamed("lang", lang), lang, "left_semi")
    share = max(1, sample // len(sizes))
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(1 << 30))
    # as many draws as give every language its share but for a chance of about one in a hundred million
    wide = share + 6 * share**0.5 + 12
    bounds = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(int(min(1.0, wide / n) * (1 << 30))))])
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") <= bounds[F.col(lang)]).select("draw", F.col(lang).alias("lang"), F.col(text).alias("text"))
    drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))).filter(F.col("place") <= share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            packed = [counts(t).astype("<f4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array([t[: LENGTHS[-1]] for t in texts], pa.string())], ["draw", "lang", "v", "head"])

    found = drawn.select("draw", "lang", "text").mapInArrow(run, "draw long, lang string, v binary, head string").orderBy("draw", "lang", "v").collect()
    taken: dict[str, list] = {}
    for r in found:
        taken.setdefault(r.lang, []).append((np.frombuffer(r.v, "<f4"), r.head))
    every = np.concatenate([np.stack([x for x, _ in v]) for v in taken.values()])
    idf = np.log((1 + len(every)) / (1 + (every > 0).sum(axis=0))).astype(np.float32) + np.float32(0.05)
    languages, parts, floors = [], [], []
    for name in sorted(taken):
        vectors = weigh(np.stack([x for x, _ in taken[name]]), idf)
        made, own = cluster(vectors, centroids)
        held = np.bincount(own, minlength=len(made))
        made = made[held >= min(LEAST * len(vectors), held.max())]  # a few odd rows are no kind of text of the language
        languages += [name] * len(made)
        parts.append(made)
        floors.append(_floors([h for _, h in taken[name]], vectors, made, idf, centroids))
    return Model(languages, idf, np.concatenate(parts).astype(np.float32), np.concatenate(floors))


def predict(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (cosine, 0 to 1) and rejected.

    A null text or one without any letter gives ``und``, score 0 and rejected; so does every text without a model
    (nothing to learn from). Columns of ``docs`` named lang_pred, score or rejected are replaced. One row for each row.
    """
    held = docs.drop("lang_pred", "score", "rejected")
    at = held.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.nearest(t) if model and t and LETTER.search(t) else (UNDETERMINED, 0.0, True) for t in batch.column(at).to_pylist()]
            made = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([bool(o[2]) for o in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "lang_pred", "score", "rejected"])

    made = T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return held.mapInArrow(run, T.StructType([*held.schema.fields, *made.fields]))


def op5_langid(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those not held out. A null doc_id has held_out null, and is not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    model = fit(docs, training=~held_out)
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
