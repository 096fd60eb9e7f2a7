"""Benchmark decontamination: a broadcast hash set of the items' word n-grams, looked up for every window of every text.

Words are runs of ASCII letters and digits, lower-cased, and of anything beyond ASCII. The items' n-grams are made and
told apart by Spark, dealt into slices of bounded size, and a slice at a time is broadcast: sorted 64-bit hashes for the
search, the n-grams themselves to verify what the hashes find. Texts are scanned where they lie and nothing of them is
shuffled. A benchmark that fits one slice, as all that fit LIMIT do, takes one scan; a larger one takes a scan a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave.llm.common import LOWER, UPPER, materialize

#: Words of an n-gram.
WORDS = 10
#: Bytes of n-grams and item names in a slice, on average.
LIMIT = 1 << 25
#: Bytes of text that are scanned at a time, and bytes whose words are hashed at a time.
SCAN, CHUNK = 1 << 22, 1 << 18
BASE, STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xFF51AFD7ED558CCD)
#: By byte: its lower-case form, or 0 if it is in no word.
LETTER = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 0 for b in range(256)], np.uint8)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0..size, and their inverses modulo 2 ** 64."""
    out = []
    for base in (int(BASE), pow(int(BASE), -1, 1 << 64)):
        steps = np.full(size + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


def word_places(letters: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of texts that lie one after another and begin at ``first``."""
    inside = letters != 0
    edge = np.zeros(len(letters) + 1, bool)
    edge[first] = True
    edge[-1] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    return np.flatnonzero(after & (edge | ~before)), np.flatnonzero(before & (edge | ~after))


def word_hashes(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, of its bytes alone."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        size = int(ends[stop - 1] - low)
        powers, inverse = _powers(max(CHUNK, 1 << (size - 1).bit_length()))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(letters[low : low + size].astype(np.uint64) * powers[:size], out=sums[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = _mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def windows(words: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes of all windows of so many words) for each of the lengths; windows may run over texts' ends."""
    now = words
    for n in range(1, max(lengths, default=0) + 1):
        if n > 1:
            if len(now) < 2:
                return
            now = words[: len(now) - 1] + now[1:] * STEP
        if n in lengths:
            yield n, _mixed(now)


def _contents(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the texts one after another, and where each begins; null is empty."""
    raw = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.combine_chunks()
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return LETTER[data], at - at[0]


def _gram(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int, n: int) -> bytes:
    return b" ".join(letters[a:b].tobytes() for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist(), strict=True))


class Slice:
    """A slice of a benchmark's n-grams, as it is broadcast."""

    def __init__(self, grams: list[bytes], items: list[str]) -> None:
        names = sorted(set(items))
        number = {name: i for i, name in enumerate(names)}
        self.names = names
        held: dict[bytes, list[int]] = {}
        for gram, item in zip(grams, items, strict=True):
            held.setdefault(gram, []).append(number[item])
        #: By n-gram: the numbers of its items.
        self.items = held
        by_length: dict[int, list[bytes]] = {}
        for gram in held:
            by_length.setdefault(gram.count(b" ") + 1, []).append(gram)
        self.hashes: dict[int, np.ndarray] = {}
        self.seen: dict[int, np.ndarray] = {}  # filled by each worker for itself
        for n, own in by_length.items():
            letters, first = _contents(pa.array(own, pa.binary()))
            found = dict(windows(word_hashes(letters, *word_places(letters, first[:-1])), [n]))[n]
            self.hashes[n] = np.unique(found[::n])  # each n-gram is a text of n words

    def known(self, n: int, found: np.ndarray) -> np.ndarray:
        """Which of the hashes may be those of n-grams of n words."""
        own, bits = self.hashes[n], max(16, int(len(self.hashes[n]) * 16).bit_length())
        seen = self.seen.get(n)
        if seen is None:
            seen = self.seen[n] = np.zeros(1 << bits, bool)
            seen[(own >> np.uint64(64 - bits)).astype(np.int64)] = True
        maybe = np.flatnonzero(seen[(found >> np.uint64(64 - bits)).astype(np.int64)])
        place = np.minimum(np.searchsorted(own, found[maybe]), len(own) - 1)
        return maybe[own[place] == found[maybe]]


def item_grams(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(gram, item): the distinct n-grams of the items, words joined by spaces; an item of fewer words is one n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, first = _contents(batch.column(1))
            starts, ends = word_places(letters, first[:-1])
            cuts = np.searchsorted(starts, first).tolist()
            for name, a, b in zip(batch.column(0).to_pylist(), cuts[:-1], cuts[1:], strict=True):
                n = min(words, b - a)
                for at in range(a, b - n + 1 if n else a, 1 << 14):
                    grams = [_gram(letters, starts, ends, i, n) for i in range(at, min(at + (1 << 14), b - n + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), pa.array([name] * len(grams), pa.string())], ["gram", "item"])

    named = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, "gram binary, item string").distinct()


def _marks(letters: np.ndarray, first: np.ndarray, known: Slice, earlier: list[list[dict] | None]) -> list[tuple]:
    """For each text: words, hit words, byte spans and word runs that are hit, numbers of items."""
    starts, ends = word_places(letters, first[:-1])
    cuts = np.searchsorted(starts, first)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(cuts))
    change = np.zeros(len(starts) + 1, np.int64)
    items: dict[int, set[int]] = {}
    for n, found in windows(word_hashes(letters, starts, ends), list(known.hashes)):
        for i in known.known(n, found).tolist():
            if text_of[i] != text_of[i + n - 1]:
                continue
            own = known.items.get(_gram(letters, starts, ends, i, n))
            if own:
                change[i] += 1
                change[i + n] -= 1
                items.setdefault(int(text_of[i]), set()).update(own)
    for t, runs in enumerate(earlier):
        for run in runs or ():
            change[cuts[t] + run["start"]] += 1
            change[cuts[t] + run["stop"]] -= 1
    hit = np.cumsum(change[:-1]) > 0
    counted = np.concatenate(([0], np.cumsum(hit)))
    out = []
    for t, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        n_hit = int(counted[b] - counted[a])
        runs: list[tuple[int, int]] = []
        if n_hit:
            flips = np.flatnonzero(np.diff(np.concatenate(([False], hit[a:b], [False]))))
            runs = list(zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True))
        places = [(int(starts[a + x] - first[t]), int(ends[a + y - 1] - first[t])) for x, y in runs]
        out.append((b - a, n_hit, places, runs, items.get(t, ())))
    return out


def _scanned(rows: DataFrame, known, again: bool) -> DataFrame:
    """``rows`` (own, text, and what an earlier scan found) with what this slice adds."""
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    names = ["own", "text", "n_words", "n_hit", "items", "spans", "runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(whole):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SCAN, "right")))
                batch, at = whole.slice(at, stop - at), stop
                letters, first = _contents(batch.column(1))
                earlier = batch.column(6).to_pylist() if again else [None] * len(batch)
                found = _marks(letters, first, known.value, earlier)
                items = [[known.value.names[i] for i in f[4]] for f in found]
                if again:
                    items = [sorted({*old, *new}) for old, new in zip(batch.column(4).to_pylist(), items, strict=True)]
                else:
                    items = [sorted(x) for x in items]
                held = [[{"start": a, "stop": b} for a, b in f[place]] for place in (2, 3) for f in found]
                columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array(items, pa.list_(pa.string()))]
                columns += [pa.array(held[: len(found)], pairs), pa.array(held[len(found) :], pairs)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    spans = T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))
    schema = rows.select("own", "text").schema.add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("spans", spans).add("runs", spans)
    return rows.mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """(own, text, n_words, n_hit, items, spans): what of each text occurs in the benchmark.

    A window is ``words`` consecutive words of an item, or all words of an item that has fewer but not none. A word of a
    text is hit if it lies in any occurrence of a window. ``items`` are the names of the items with occurring windows, as
    text, each once, sorted; ``spans`` the UTF-8 byte ranges from the first to the last word of each run of hit words.
    ``own`` has the columns of ``docs`` as a struct, whatever their names; rows that repeat stay rows of their own.
    Null and empty texts have no words, and texts without words are never hit; items without words, and an empty
    benchmark, hit nothing; a null item_id is the name "null", and items of one name count as one. An empty table
    gives no row. ``limit`` bounds the bytes that are broadcast at a time, to within chance.
    """
    grams = materialize(item_grams(benchmark, item=item, text=item_text, words=words), "decontamination-grams")
    size, count = grams.agg(F.sum(F.octet_length("gram") + F.octet_length("item") + 32), F.count("*")).first()
    slices = max(1, ceil((size or 0) / limit))
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(f"`{text}`").alias("text"))
    for at in range(slices):
        own = grams.filter(F.pmod(F.xxhash64("gram", "item"), F.lit(slices)) == at).toArrow() if count else None
        known = Slice(own["gram"].to_pylist(), own["item"].to_pylist()) if count else Slice([], [])
        if at:
            found = materialize(found, "decontamination-scan")
        found = _scanned(found, docs.sparkSession.sparkContext.broadcast(known), at > 0)
    return found.drop("runs")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "spans", text: str = "text", item: str = "item_id", item_text: str = "text", words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """``docs`` without what occurs in the benchmark: ``remove`` is "spans" (hit runs are cut out) or "documents".

    Columns stay as they are. Null texts stay null. For what counts as an occurrence see ``find``.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be 'spans' or 'documents'")
    found = find(docs, benchmark, text=text, item=item, item_text=item_text, words=words, limit=limit)
    if remove == "documents":
        return found.filter("n_hit = 0").select("own.*")
    raw = F.col("text").cast("binary")
    ends = F.concat(F.col("spans.start"), F.array(F.octet_length("text").cast("long")))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.stop"))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    cleaned = F.when(F.col("n_hit") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    return found.select(*[cleaned.alias(c) if c == text else F.col(f"own.`{c}`") for c in docs.columns])


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    """What of each document occurs in the benchmark."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    found = find(docs.select("doc_id", "text"), benchmark)
    return found.select("own.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LISTED = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_LISTED} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_LISTED} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, m, array_to_string(w[p:p + m - 1], ' ') AS gram
  FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM (SELECT item, w, least(len(w), {WORDS}) AS m FROM i WHERE len(w) > 0))
), places AS (
  SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS gram
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM grams) WHERE len(w) >= m)
), hits AS (SELECT doc_id, p, m, item FROM places JOIN grams USING (m, gram)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
