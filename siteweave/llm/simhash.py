"""SimHash near-duplicates: fingerprints of word shingles, linked by the generalised pigeonhole principle.

The 64 bits of a fingerprint are grouped into partitions, correlated bits together. If two fingerprints differ in at
most ``tau`` bits and partition thresholds sum to ``tau - partitions + 1``, some partition differs by no more than its
own threshold. Each fingerprint gets its own thresholds, from a dynamic program over candidate counts that are
estimated from the halves of each partition; a threshold of -1 skips a partition whose value is too common. Probes
meet the index in an equi-join and candidates are verified on all bits.

Only distinct fingerprints take part, so copies of one text are a single row. A meeting point whose probes times
index entries exceed a bound is not joined: its fingerprints are linked through their one-bit variants, which two
fingerprints share exactly if they differ in at most two bits. That way is exact too and its rows grow with the
number of fingerprints, not with its square.

``similar_texts`` links texts by the similarity of their shingle sets, exactly. Fingerprints of these sets are linked in
the same way first, and the links are verified on the texts. A similarity of 0.8 puts many texts too far apart for two of
64 bits, so for those that are still in different components the same principle is applied to the shingles themselves:
similar sets differ in few members, so one of the first members of each set, in an order common to all, is shared (prefix filter). What meets there
is checked on fingerprints of ``SKETCH`` bits, whose differing bits never outnumber the members that differ, and what
is left is verified on the texts. At each shingle two leaders are compared with the others, round by round, so a crowd of
copies costs rows in proportion to its size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import broadcast_up_to, materialize, partitions, text_bytes, top_counts

BITS = 64
WORDS = 3
TAU = 2
PARTITIONS = 3
#: Probes times index entries at one value of a partition, up to which they are joined.
PAIRS = 4096


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; of none, 0."""
    counts = np.zeros(BITS, np.int64)
    for block in range(0, len(hashes), 1 << 16):  # a very long text stays in bounded memory
        part = hashes[block : block + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a text's shingles of ``words`` words, repeats included. No word at all: 0.

    A text with fewer words is a single shingle. A bit is set if more than half of the shingles' XXH64 values have it.
    """
    tokens = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    return majority(hashes)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp): the fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), text_bytes(text).alias("b")).mapInArrow(run, f"`{key}` {kind}, fp long")


def _words(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return np.asarray(batch.column(column).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)


def group_bits(distinct: DataFrame, parts: int = PARTITIONS) -> list[list[int]]:
    """Splits the 64 bits into groups of nearly equal size, each grown greedily around its most correlated bits.

    The driver gets only sums of bits and of pairs of bits: 64 x 65 numbers, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.float64), 0
        for batch in batches:
            bits = np.unpackbits(_words(batch).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n))], ["at", "n"])

    sums = distinct.select("fp").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for at, n in sums:
        flat[at] = n
    n = max(flat[-1], 1)
    both = flat[:-1].reshape(BITS, BITS) / n
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(np.outer(mean * (1 - mean), mean * (1 - mean)), 1e-12))
    tie = np.abs((both - np.outer(mean, mean)) / spread)
    np.fill_diagonal(tie, 0)
    rest, groups = list(range(BITS)), []
    for left in range(parts, 0, -1):
        size = -(-len(rest) // left)
        first = max(rest, key=lambda b: (round(float(tie[b, rest].sum()), 9), -b))
        group = [first]
        rest.remove(first)
        while len(group) < size:
            nearest = max(rest, key=lambda b: (round(float(tie[b, group].sum()), 9), -b))
            group.append(nearest)
            rest.remove(nearest)
        groups.append(sorted(group))
    return groups


def _pick(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def _halves(groups: list[list[int]]) -> list[list[int]]:
    """Each partition's bits in two parts of at most 12 bits (more partitions than 2 keep this small)."""
    return [bits[i::2][:12] for bits in groups for i in range(2)]


def _histograms(distinct: DataFrame, halves: list[list[int]]) -> list[np.ndarray]:
    """How often each value of each half occurs: at most 2 x partitions x 4096 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << len(h), np.int64) for h in halves]
        for batch in batches:
            fps = _words(batch)
            for c, h in zip(counts, halves, strict=True):
                c += np.bincount(_pick(fps, h).astype(np.int64), minlength=len(c))
        for i, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(c[at])], ["half", "at", "n"])

    out = [np.zeros(1 << len(h)) for h in halves]
    for half, at, n in distinct.select("fp").mapInArrow(run, "half long, at long, n long").groupBy("half", "at").agg(F.sum("n")).collect():
        out[half][at] = n
    return out


def _within(histogram: np.ndarray, most: int) -> np.ndarray:
    """Row v, column t: the share of all fingerprints whose half differs from v in exactly t bits."""
    size = len(histogram)
    total = max(histogram.sum(), 1)
    out = np.zeros((size, most + 1))
    at = np.arange(size)
    for t in range(most + 1):
        for flips in combinations(range(size.bit_length() - 1), t):
            out[:, t] += histogram[at ^ sum(1 << f for f in flips)]
    return out / total


def allocate(costs: np.ndarray, budget: int) -> np.ndarray:
    """Thresholds for each row that sum to ``budget`` at the least total cost.

    ``costs`` has shape (rows, partitions, thresholds), for thresholds -1, 0, 1, ... . The dynamic program runs over
    partitions and over the sum used so far, for all rows at once.
    """
    rows, parts, kinds = costs.shape
    span = budget + parts + 1  # of sums, each threshold counted from -1 on
    best = np.full((rows, span), np.inf)
    best[:, 0] = 0
    taken = np.zeros((parts, rows, span), np.int8)
    for i in range(parts):
        after = np.full((rows, span), np.inf)
        for t in range(min(kinds, span)):
            cost = best[:, : span - t] + costs[:, i, t, None]
            better = cost < after[:, t:]
            after[:, t:][better] = cost[better]
            taken[i][:, t:][better] = t
        best = after
    out = np.empty((rows, parts), np.int64)
    at = np.full(rows, budget + parts)
    for i in range(parts - 1, -1, -1):
        t = taken[i][np.arange(rows), at]
        out[:, i] = t - 1
        at = at - t
    return out


def _entries(distinct: DataFrame, groups: list[list[int]], tau: int) -> DataFrame:
    """(part, value, fp, probe): index entries of every fingerprint, and the probes that its thresholds call for."""
    histograms = _histograms(distinct, _halves(groups))
    near = [_within(h, tau) for h in histograms]
    halves, parts = _halves(groups), len(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _words(batch)
            costs = np.zeros((len(fps), parts, tau + 2))
            for i in range(parts):
                a, b = (near[2 * i + j][_pick(fps, halves[2 * i + j]).astype(np.int64)] for j in range(2))
                exact = np.stack([sum(a[:, s] * b[:, t - s] for s in range(t + 1)) for t in range(tau + 1)], axis=1)
                width = len(groups[i])
                probes = [1, width, width * (width - 1) // 2]
                # each probe costs a row of its own, besides the candidates it meets (in shares of all rows)
                costs[:, i, 1:] = np.cumsum(exact + np.array(probes[: tau + 1]) * 1e-6, axis=1)
            chosen = allocate(costs, tau - parts + 1)
            out: list[tuple[int, np.ndarray, np.ndarray, bool]] = []
            for i, bits in enumerate(groups):
                values = _pick(fps, bits)
                out.append((i, values, fps, False))
                for t in range(tau + 1):
                    own = chosen[:, i] >= t
                    for flips in combinations(range(len(bits)), t) if own.any() else ():
                        out.append((i, values[own] ^ np.uint64(sum(1 << f for f in flips)), fps[own], True))
            for i, values, own, probe in out:
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), pa.array(values.view(np.int64)), pa.array(own.view(np.int64)), pa.array(np.full(len(own), probe))], ["part", "value", "fp", "probe"])

    return distinct.select("fp").mapInArrow(run, "part int, value long, fp long, probe boolean")


def _variant_links(fps: DataFrame) -> DataFrame:
    """Links among fingerprints at two bits or fewer, by shared one-bit variants: 65 rows for each, none of them a pair.

    All that share a variant are tied to the smallest of them, which differs from each in at most two bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate(([0], np.uint64(1) << np.arange(BITS, dtype=np.uint64))).astype(np.uint64)
        for batch in batches:
            own = _words(batch)
            yield pa.RecordBatch.from_arrays([pa.array((own[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(own, len(flips)).view(np.int64))], ["variant", "fp"])

    variants = fps.mapInArrow(run, "variant long, fp long")
    least = variants.groupBy("variant").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return variants.join(least, "variant").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def links(distinct: DataFrame, *, tau: int = TAU, parts: int = PARTITIONS) -> DataFrame:
    """(a, b): enough links between different fingerprints, each of at most ``tau`` bits, to give all components.

    Every pair that meets in a partition of ordinary size is returned. The exact way for values that are too common
    holds for ``tau`` = 2 (or less, after verification).
    """
    if not 0 <= tau <= 2:
        raise ValueError("tau must be 0, 1 or 2")
    groups = group_bits(distinct, parts)
    entries = materialize(_entries(distinct, groups, tau), "simhash-entries")
    sizes = entries.groupBy("part", "value").agg(F.count_if("probe").alias("probes"), F.count_if(~F.col("probe")).alias("held"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    met = sizes.filter("probes > 0 AND held > 0 AND low < high").select("part", "value", (F.col("probes") * F.col("held") > PAIRS).alias("large"))
    tagged = materialize(entries.join(met, ["part", "value"]), "simhash-met")
    small = tagged.filter(~F.col("large"))
    probes = small.filter("probe").select("part", "value", F.col("fp").alias("x"))
    held = small.filter(~F.col("probe")).select("part", "value", F.col("fp").alias("y"))
    verified = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= tau
    found = probes.join(held, ["part", "value"]).filter((F.col("x") != F.col("y")) & verified).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    crowd = tagged.filter("large").select("fp").distinct()
    dense = _variant_links(crowd).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau)
    return found.unionByName(dense).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by alternating large and small stars.

    Every round is a grouping and a join on nodes, written to the shared folder. Nothing is gathered on the driver but
    two sums that tell whether a round changed anything.
    """
    edges = materialize(edges.select("a", "b"), "stars")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = materialize(large, "stars-large")
        down = large.select(F.col("b").alias("n"), F.col("a").alias("s"))  # large links run from smaller a to larger b
        least = down.groupBy("n").agg(F.min("s").alias("m"))
        small = down.join(least, "n").select(F.col("m").alias("a"), F.explode(F.array("n", "s")).alias("b")).filter("a <> b").distinct()
        edges = materialize(small, "stars-small")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, tau: int = TAU, parts: int = PARTITIONS) -> DataFrame:
    """One row for each row of ``docs``: key, fp (signed long), component (smallest key reachable, itself included).

    Null texts count as empty; texts without a word have fingerprint 0 and are linked like any other. Repeated rows
    stay repeated. Rows with a null key take part; a component of such rows alone has the component null. Other
    columns are not read.
    """
    marks = materialize(fingerprints(docs, key=key, text=text, words=words), "simhash-marks")
    classes = materialize(marks.groupBy("fp").agg(F.min(key).alias("least")), "simhash-classes")
    tied = components(links(classes, tau=tau, parts=parts))
    rooted = classes.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return marks.join(rooted.join(smallest, "root").select("fp", "component"), "fp").select(key, "fp", "component")


#: Bits of a wide fingerprint.
SKETCH = 1024
#: Pairs a text that may be left after a round of leaders, up to which they are joined without another round.
CROWD = 2
#: One text in ``EVERY`` (of few texts, more) tells which shingles are common; so many of these are moved back at most.
EVERY, ORDER, COMMON = 16, 1 << 12, 1 << 18
#: Texts that hold a shingle, by that estimate, from which its rows are dealt over ``SALTS`` tasks.
HOT, SALTS = 1 << 12, 32
#: Words whose hashes a worker remembers; it starts anew when full.
CACHE = 1 << 18
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """XXH64 by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


_hash_of = _Hashes()


def _shingles(tokens: list[bytes], words: int) -> np.ndarray:
    if not tokens:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_hash_of.__getitem__, tokens), np.uint64, len(tokens))
    k = min(words, len(tokens))
    n = len(own) - k + 1
    out = own[:n].copy()
    for i in range(1, k):
        out *= FACTOR
        out += own[i : n + i]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text with fewer words is one shingle, without a word none."""
    return _shingles(text.lower().split(), words)


def _name(tokens: list[bytes]) -> int:
    return int.from_bytes(hashlib.md5(b" ".join(tokens)).digest()[:8], "big", signed=True)


def text_name(text: bytes) -> int:
    """The same for texts with the same words in the same order: 64 bits of their MD5."""
    return _name(text.lower().split())


def sketch(members: np.ndarray) -> bytes:
    """Parities of a set's members over ``SKETCH`` cells: each member by which two sets differ flips one bit."""
    cells = np.bincount((members >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH)
    return np.packbits((cells & 1).astype(np.uint8)).tobytes()


def prefix(members: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The first members of a set, in the order of (how common they are, hash), and that number.

    Two sets that reach the similarity share at least that part of the larger one, so one of these is in both prefixes.
    """
    names, n = common
    weight = np.zeros(len(members), np.int64)
    if len(names) and len(members):
        at = np.minimum(np.searchsorted(names, members), len(names) - 1)
        weight = np.where(names[at] == members, n[at], 0)
    first = np.lexsort((members, weight))[: len(members) - math.ceil(similarity * len(members) - 1e-9) + 1]
    return members[first], weight[first]


def _common(given: DataFrame, count: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that several texts of a share of all texts hold, with an estimate of how many texts do.

    They only decide the order of shingles: links are complete under any order, and cheaper if common ones come last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x.as_buffer().to_pybytes(), words).view(np.int64))], ["token"])

    every = min(EVERY, max(1, count // ORDER))
    some = given.select("b").filter(F.pmod(F.xxhash64("b"), F.lit(every)) == 0)
    counted = some.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    top = top_counts(materialize(counted, "similar-common"), "n", COMMON).toArrow()
    tokens, n = (np.asarray(top.column(i).to_numpy(), np.int64) for i in range(2))
    tokens = tokens.view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], n[order] * every


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (part, token, id, size, pos) sorted by token and id: those whose token another id has too.

    One row is held back at a time. Tokens that are dealt over several tasks (part differs) are shared anyway.
    """
    names = ["token", "id", "size", "pos"]
    last: list[np.ndarray] | None = None
    joined = False
    for batch in batches:
        cols = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
        if last is not None:
            cols = [np.concatenate((a, b)) for a, b in zip(last, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.concatenate(([True], (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])))
        part, token, *rest = (c[new] for c in cols)
        as_before = np.concatenate(([joined], token[1:] == token[:-1]))
        keep = as_before | (part != token)
        keep[:-1] |= as_before[1:]
        last, joined = [c[-1:] for c in (part, token, *rest)], bool(as_before[-1])
        out = [c[:-1][keep[:-1]] for c in (token, *rest)]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)
    if last is not None and (joined or last[0][0] != last[1][0]):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in last[1:]], names)


def _meetings(given: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int, similarity: float) -> DataFrame:
    """(token, id, size, pos): the prefix of each set, as far as another text has the shingle in its prefix too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            rows = 0
            for i, value in enumerate(batch.column(0)):
                tokens = value.as_buffer().to_pybytes().lower().split()
                own = _name(tokens)
                if own not in seen and tokens:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen.add(own)
                    members = _shingles(tokens, words)
                    first, weight = prefix(members, common, similarity)
                    first = first.view(np.int64)
                    part = np.where(weight >= HOT, first + 1 + own % SALTS, first)
                    out.append((part, first, np.full(len(first), own), np.full(len(first), len(members), np.int32), np.arange(len(first), dtype=np.int32)))
                    rows += len(first)
                if out and (rows > 1 << 16 or i + 1 == len(batch)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["part", "token", "id", "size", "pos"])
                    out, rows = [], 0

    entries = given.select("b").mapInArrow(run, "part long, token long, id long, size int, pos int")
    dealt = entries.repartition(partitions(given), "part").sortWithinPartitions("token", "id")
    return materialize(dealt.mapInArrow(_shared, "token long, id long, size int, pos int"), "similar-met")


def _verified(pairs: DataFrame, classes: DataFrame, texts_of, words: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose sets reach the similarity: first by fingerprints, then by the texts themselves."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(batch), -1) for i in (2, 3))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            sizes = batch.column(4).to_numpy().astype(np.int64)
            yield batch.select([0, 1]).filter(pa.array(apart <= sizes * (1 - similarity) / (1 + similarity) + 1e-6))

    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, x = None, None
        for batch in batches:
            keep = []
            for a, left, right in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != name:
                    name, x = a, shingle_set(left.as_buffer().to_pybytes(), words)
                y = shingle_set(right.as_buffer().to_pybytes(), words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    bits = classes.select("id", "size", "sketch")
    x, y = (bits.select(F.col("id").alias(n), F.col("size").alias(f"size_{n}"), F.col("sketch").alias(f"sketch_{n}")) for n in "ab")
    checked = pairs.join(x, "a").join(y, "b").select("a", "b", "sketch_a", "sketch_b", (F.col("size_a") + F.col("size_b")).alias("sizes"))
    close = materialize(checked.mapInArrow(near, "a long, b long"), "similar-close")
    texts = texts_of(close.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    x, y = (texts.select(F.col("id").alias(n), F.col("b").alias(f"text_{n}")) for n in "ab")
    whole = close.join(y, "b").join(x, "a").select("a", "b", "text_a", "text_b")
    return whole.mapInArrow(equal, "a long, b long")


def _by_fingerprint(classes: DataFrame, texts_of, words: int, similarity: float) -> DataFrame:
    """(a, b): links between sets whose fingerprints differ in ``TAU`` bits or fewer and that reach the similarity.

    The sets of one fingerprint are compared with one of them, and this one with those of other fingerprints.
    """
    fps = materialize(classes.groupBy("fp").agg(F.min("id").alias("leader")), "similar-fingerprints")
    x, y = (fps.select(F.col("fp").alias(n), F.col("leader").alias(f"leader_{n}")) for n in "ab")
    across = links(fps).join(x, "a").join(y, "b").select(F.least("leader_a", "leader_b").alias("a"), F.greatest("leader_a", "leader_b").alias("b"))
    same = classes.join(fps, "fp").filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    return _verified(across.unionByName(same), classes, texts_of, words, similarity)


def _tied(met: DataFrame, tied: DataFrame, classes: DataFrame, texts_of, count: int, words: int, similarity: float) -> DataFrame:
    """(node, root) over all links between sets that reach the similarity; ``tied`` has those known before.

    In each round every shingle compares two leaders with the other sets that it meets, and is done with these leaders;
    sets that are in one component already need no comparison. Rounds go on while each at least halves the pairs that
    are left, as far as bounds on where the shingle comes in both sets let them be similar; then all of those are compared
    at once. No pair is skipped but by bounds on its similarity or because its sets are linked already.
    """

    def links_of(left: DataFrame, right: DataFrame, differ: Column) -> DataFrame:
        """Verified links (a, b) among rows of ``left`` (id, root, size, pos) and ``right`` that meet at a shingle."""
        other = right.select("token", *[F.col(c).alias(f"{c}_b") for c in ("id", "root", "size", "pos")])
        # similar sets meet, among other places, at the first shingle that they share: nothing before it is in both
        most = F.least(F.col("size") - F.col("pos"), F.col("size_b") - F.col("pos_b"))
        possible = most >= (F.col("size") + F.col("size_b")) * (similarity / (1 + similarity)) - 1e-6
        lengths = F.least("size", "size_b") >= F.greatest("size", "size_b") * similarity - 1e-6
        pairs = left.join(other, "token").filter(differ & lengths & possible)
        pairs = pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()
        return _verified(pairs, classes, texts_of, words, similarity)

    before = None
    while True:
        rows = met.join(tied.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        rows = materialize(rows.select("token", "id", "size", "pos", "root"), "similar-rows")
        # of two similar sets, the one that is not larger has the first shingle that they share this early
        early = F.col("pos") <= F.col("size") * ((1 - similarity) / (1 + similarity)) + 1e-6
        groups = rows.groupBy("token", "root").agg(F.count("*").alias("c"), F.count_if(early).alias("early"), F.min(F.struct("pos", "id")).alias("h"))
        # One leader is the set in which the shingle comes first of all: it has least of its own besides what a crowd shares,
        # so it links most of the crowd. The other is of the smallest component at the shingle, where it meets most that it
        # is not linked with.
        met_by = F.sum("early") * F.sum("c").cast("double") - F.sum(F.col("early").cast("double") * F.col("c"))
        tokens = groups.groupBy("token").agg(met_by.alias("pairs"), F.min("h").alias("first"), F.min(F.struct("c", "h.pos", "h.id")).alias("small")).filter("pairs > 0")
        tokens = materialize(tokens.select("token", F.array("first.id", "small.id").alias("leaders"), "pairs"), "similar-tokens")
        left = tokens.agg(F.sum("pairs")).first()[0]
        if not left:
            return tied
        open_ = rows.join(tokens.select("token", "leaders"), "token")
        last = left <= CROWD * count or (before is not None and left > before / 2)
        if last:
            found = links_of(open_.drop("leaders"), open_.drop("leaders"), F.col("root") < F.col("root_b"))
        else:
            open_ = materialize(open_, "similar-open")
            leads = F.array_contains("leaders", F.col("id"))
            met = open_.filter(~leads).select("token", "id", "size", "pos")
            found = links_of(open_.filter(leads).drop("leaders"), open_.drop("leaders"), F.col("root") != F.col("root_b"))
        tied = components(found.unionByName(tied.select(F.col("root").alias("a"), F.col("node").alias("b")).filter("a <> b")))
        if last:
            return tied
        before = left


def similar_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each row of ``docs``: key, component (smallest key reachable over links, itself included).

    Two texts are linked if they have the same words in the same order, or if the Jaccard similarity of their sets of
    ``words``-word shingles is ``similarity`` or more; components are those of all such links. Words and shingles, and
    texts with the same words, are told apart by 64-bit hashes. Texts null, empty or without a word are copies of one
    another. Repeated rows stay repeated; rows may share a key, or have none: a component of rows with null keys alone
    has the component null. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("key"), text_bytes(text).alias("b"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, bits, fps = [], [], [], []
            for x in batch.column(1):
                tokens = x.as_buffer().to_pybytes().lower().split()
                members = _shingles(tokens, words)
                ids.append(_name(tokens))
                sizes.append(len(members))
                bits.append(sketch(members))
                fps.append(majority(members))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))], ["key", "id", "size", "sketch", "fp"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # rows may share a key, not a text
        for batch in batches:
            yield batch.filter(pa.array([text_name(b.as_buffer().to_pybytes()) == i for i, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)], pa.bool_()))

    marks = materialize(given.mapInArrow(mark, f"key {kind}, id long, size int, sketch binary, fp long"), "similar-marks")
    classes = materialize(marks.groupBy("id").agg(F.min("key").alias("least"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp")), "similar-classes")
    count = classes.count()

    def texts_of(ids: DataFrame) -> DataFrame:
        asked = broadcast_up_to(materialize(classes.select("id", "least").join(ids, "id", "left_semi"), "similar-asked"))
        texts = given.join(asked, F.col("key").eqNullSafe(F.col("least"))).select("id", "b").mapInArrow(own, "id long, b binary").dropDuplicates(["id"])
        return materialize(texts, "similar-texts")

    met = _meetings(given, _common(given, count, words), words, similarity)
    tied = _tied(met, components(_by_fingerprint(classes, texts_of, words, similarity)), classes, texts_of, count, words, similarity)
    named = classes.select("id", "least").join(tied.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    return marks.select("key", "id").join(named.join(smallest, "root").select("id", "component"), "id").select(F.col("key").alias(key), "component")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components that two bits link."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
