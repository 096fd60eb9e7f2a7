"""Removal of repeated byte strings: blockwise suffix sorting with difference-cover sample ranks.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else. Texts are never shuffled as
suffixes. Instead:

1. Every string of ``length`` bytes is assigned to the least of the hashes of its short substrings, so equal strings
   have the same anchor at the same offset. An anchor stands for a run of neighbouring strings, about 75 of them.
2. Anchors are counted. Strings of an anchor that occurs once occur once; all others make up the suffix buckets.
   Equal texts, and equal stretches around one anchor, are a single row with a count.
3. A bucket holds the distinct stretches around one anchor. Tasks sort the suffixes of one block of buckets at a time:
   by their first bytes, and where these tie, by the rank of a difference-cover sample position just behind, which
   comes from prefix doubling over the sample only. Memory depends on the block, not on the input. Neighbours in the
   sorted order that agree in ``length`` bytes are repeats.

A bucket with very many distinct stretches is parted: its strings are dealt by the hash of the bytes that strings of
nearly equal offset share, which equal strings have in common too. Equal parts are one row again. Where very many
different parts still share those bytes (the edge of a very common passage), each of their strings is a group of its own.

Stretches, parts and strings that are counted as equal are told apart by 64-bit XXH3 hashes within one 64-bit anchor
hash (strings by 128 bits); all others are compared byte by byte after sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave.llm.common import discard, materialize, numbered, partitions, text_bytes

LENGTH = 200
#: Bytes of an anchor's substring.
GRAM = 40
#: Period of the difference cover, and the bytes by which suffixes are compared before sample ranks decide.
PERIOD = 32
#: Bytes of one block of buckets.
BLOCK = 1 << 21
#: Distinct stretches of a bucket beyond which it is parted, and the offsets that a part covers.
CROWD, STEP = 2048, 16
#: Bytes that the scan for anchors handles at once.
SCAN = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of ``length`` bytes with one anchor: (hash, anchor, first string, last string).

    The anchor of a string is the leftmost of its substrings of ``gram`` bytes with the least hash, a function of the
    string alone. Strings that start within a run are all those with that anchor.
    """
    strings = len(data) - length + 1
    if strings < 1:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    span = length - gram + 1
    up, down = _powers(min(SCAN, strings) + length, BASE), _powers(min(SCAN, strings) + length, INVERSE)
    hashes, places, firsts = [], [], []
    for at in range(0, strings, SCAN):
        part = data[at : at + SCAN + length - 1]
        n = len(part)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n])))
        x = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        low = (x & ~np.uint64((1 << 20) - 1)) | np.arange(len(x), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        own = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        hashes.append(x[own[starts]])
        places.append(own[starts] + at)
        firsts.append(starts + at)
    h, a, lo = np.concatenate(hashes), np.concatenate(places), np.concatenate(firsts)
    fresh = np.concatenate(([True], a[1:] != a[:-1]))  # a run may go on in the next part
    h, a, lo = h[fresh], a[fresh], lo[fresh]
    return h, a, lo, np.append(lo[1:] - 1, strings - 1)


def cover(period: int) -> np.ndarray:
    """A difference cover: every difference modulo ``period`` is one of two members. Small numbers and multiples of their count."""
    step = int(np.ceil(np.sqrt(period)))
    return np.unique(np.concatenate((np.arange(step), np.arange(0, period, step))))


def _words(data: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
    """The 8 bytes from each place on, as numbers in the order of the bytes."""
    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    return np.ascontiguousarray(view[at + offset]).view(">u8").ravel().astype(np.uint64)


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 on of rows that ``order`` sorts by their keys; equal rows share one."""
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sample_ranks(data: np.ndarray, ends: np.ndarray, length: int, period: int = PERIOD) -> np.ndarray:
    """Rank of each sample position's string of at least ``length`` bytes; 0 elsewhere and beyond the end.

    ``ends`` has the end of the stretch that a place lies in. Strings of ``period`` bytes are ranked first. Two sample
    positions a period apart are both in the sample, so each doubling pairs ranks that are known.
    """
    member = np.zeros(period, bool)
    member[cover(period)] = True
    at = np.flatnonzero(np.resize(member, len(ends)) & (np.arange(len(ends)) < ends))
    words = [_words(data, at, 8 * w) for w in range(period // 8)]
    ranks = np.zeros(len(data) + 2 * length + 4 * period, np.int64)
    ranks[at] = _dense(np.lexsort(words[::-1]), *words)
    reach = period
    while reach < length:
        behind = np.where(at + reach < ends[at], ranks[at + reach], 0)
        pair = ranks[at] << np.int64(32) | behind
        ranks[at] = _dense(np.argsort(pair, kind="stable"), pair)
        reach *= 2
    return ranks


def repeats(stretches: list[bytes], anchor_at: list[int], bucket: list[int], length: int = LENGTH, period: int = PERIOD) -> list[np.ndarray]:
    """For each stretch, which of its strings of ``length`` bytes also occur in another place of its bucket.

    Stretches are laid out so that anchors lie on multiples of the period: strings at one offset from the anchor then
    have the same next sample position, and their ranks there can be compared.
    """
    pad = 8 + period
    starts, at = [], 0
    for s, a in zip(stretches, anchor_at, strict=True):
        at += (-(at + a)) % period
        starts.append(at)
        at += len(s)
    data = np.zeros(at + pad + length, np.uint8)
    ends = np.zeros(at + pad, np.int64)
    suffix, offset, group, owner = [], [], [], []
    for i, (s, b) in enumerate(zip(stretches, starts, strict=True)):
        data[b : b + len(s)] = np.frombuffer(s, np.uint8)
        ends[b : b + len(s)] = b + len(s)
        n = len(s) - length + 1
        suffix.append(np.arange(b, b + n))
        offset.append(anchor_at[i] - np.arange(n))
        group.append(np.full(n, bucket[i]))
        owner.append(n)
    p, d, g = np.concatenate(suffix), np.concatenate(offset), np.concatenate(group)
    ranks = sample_ranks(data, ends, length, period)
    member = np.zeros(2 * period, bool)
    member[cover(period)] = member[cover(period) + period] = True
    skip = np.array([int(np.argmax(member[r : r + period])) for r in range(period)])  # to the next sample position
    behind = ranks[p + skip[p % period]]
    words = [_words(data, p, 8 * w) for w in range(period // 8)]
    label = g.astype(np.int64) * (2 * length) + d + length
    order = np.lexsort((behind, *words[::-1], label))
    x, y = order[:-1], order[1:]
    equal = label[x] == label[y]
    for w in range(length // 8):
        live = np.flatnonzero(equal)
        equal[live] = _words(data, p[x[live]], 8 * w) == _words(data, p[y[live]], 8 * w)
    if length % 8:
        live = np.flatnonzero(equal)
        equal[live] = _words(data, p[x[live]], length - 8) == _words(data, p[y[live]], length - 8)
    twice = np.zeros(len(p), bool)
    twice[x[equal]] = True
    twice[y[equal]] = True
    return np.split(twice, np.cumsum(owner)[:-1])


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def _parts(content: bytes, anchor: int, length: int, step: int = STEP) -> Iterator[tuple[int, int, bytes, int, int]]:
    """Parts of a crowded bucket's stretch: (salt, name, bytes, anchor in them, first string), by offset from the anchor.

    Strings of a part share most bytes; the salt is those bytes' hash with the part's number, which equal strings share.
    """
    strings = len(content) - length + 1
    first = 0
    while first < strings:
        number = (anchor - first) // step
        last = min(strings - 1, anchor - number * step)
        # the part's full range of offsets decides which bytes its strings have in common, not the range held here
        a, b = anchor - number * step, anchor - (number + 1) * step + 1 + length
        salt = xxhash.xxh3_64_intdigest(content[a:b], number) >> 1
        piece, at = content[first : last + length], anchor - first
        yield salt, xxhash.xxh3_64_intdigest(piece, salt ^ at) >> 1, piece, at, first
        first = last + 1


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(h, r, rid, a, lo, hi): each run of strings with its anchor's hash and its own bytes' hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            held, size = [], 0
            for i, value in enumerate(batch.column(1)):
                raw = value.as_buffer().to_pybytes()
                if len(raw) >= length:
                    h, a, lo, hi = anchors(np.frombuffer(raw, np.uint8), length)
                    r = np.fromiter((xxhash.xxh3_64_intdigest(raw[x : y + length], z) for x, y, z in zip(lo.tolist(), hi.tolist(), (a - lo).tolist(), strict=True)), np.uint64, len(h))
                    held.append((h.view(np.int64), r.view(np.int64), np.full(len(h), rids[i]), a, lo, hi))
                    size += len(h)
                if held and (size > 1 << 16 or i + 1 == len(batch)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in zip(zip(*held, strict=True), ("i8", "i8", "i8", "i4", "i4", "i4"), strict=True)], ["h", "r", "rid", "a", "lo", "hi"])
                    held, size = [], 0

    return texts.select("rid", "raw").mapInArrow(run, "h long, r long, rid long, a int, lo int, hi int")


def _sorted_blocks(rows: DataFrame, length: int) -> DataFrame:
    """(h, r, first, last): repeated strings of each row, as ranges counted from its start.

    ``rows``: (h, salt, r, content, a), each (h, r) once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def sort() -> pa.RecordBatch:
            nonlocal held, size
            number: dict[tuple, int] = {}
            buckets = [number.setdefault(x[:2], len(number)) for x in held]
            flags = repeats([x[3] for x in held], [x[4] for x in held], buckets, length)
            h, r, first, last = [], [], [], []
            for x, own in zip(held, flags, strict=True):
                a, b = _runs(own)
                h += [x[0]] * len(a)
                r += [x[2]] * len(a)
                first += a
                last += b
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(r, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["h", "r", "first", "last"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BLOCK and row[:2] != held[-1][:2]:
                    yield sort()
                held.append(row)
                size += len(row[3])
        if held:
            yield sort()

    dealt = rows.select("h", "salt", "r", "content", "a").repartition(partitions(rows), "h", "salt").sortWithinPartitions("h", "salt")
    return dealt.mapInArrow(run, "h long, r long, first int, last int")


def _crowded_ranges(parts: DataFrame, length: int) -> DataFrame:
    """(h, r, first, last) of the crowded buckets' stretches. ``parts``: (h, salt, part, content, a, r, first), stored."""
    names = parts.groupBy("h", "salt", "part").agg(F.count("*").alias("n"), F.min("r").alias("r"))
    groups = materialize(names.groupBy("h", "salt").agg((F.count("*") > CROWD).alias("large")).filter("large"), "dedup-large")
    names = materialize(names, "dedup-parts")
    # each kind of part is sorted once; its strings are repeats if any two stretches hold it
    kinds = parts.join(names.select("h", "part", "r", "n"), ["h", "part", "r"]).join(groups, ["h", "salt"], "left")
    kinds = materialize(kinds.select("h", "salt", F.col("part").alias("r"), "content", "a", "n", F.coalesce("large", F.lit(False)).alias("large")), "dedup-kinds")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, r, value, anchor in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for i in range(len(value) - length + 1):
                    out.append((h, r, i, xxhash.xxh3_128_digest(value[i : i + length], anchor - i + length)))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["h", "r", "i", "x"])

    single = kinds.filter("large AND n = 1").select("h", "r", "content", "a").mapInArrow(strings, "h long, r long, i int, x binary")
    of_others = kinds.filter("large AND n > 1").select("h", "r", "content", "a").mapInArrow(strings, "h long, r long, i int, x binary")
    single, of_others = materialize(single, "dedup-strings"), of_others.select("h", "x")
    twice = single.select("h", "x").unionByName(of_others).groupBy("h", "x").count().filter("count > 1")
    found = _sorted_blocks(kinds.filter("NOT large"), length).unionByName(single.join(materialize(twice.select("h", "x"), "dedup-twice"), ["h", "x"]).select("h", "r", F.col("i").alias("first"), F.col("i").alias("last")))
    whole = kinds.filter("n > 1").select("h", "r", F.lit(0).alias("first"), (F.octet_length("content") - length).alias("last"))
    ranges = materialize(found.unionByName(whole).withColumnRenamed("r", "part").withColumnRenamed("first", "from"), "dedup-part-ranges")
    back = parts.select("h", "part", "r", "first").join(ranges, ["h", "part"])
    return back.select("h", "r", (F.col("first") + F.col("from")).alias("first"), (F.col("first") + F.col("last")).alias("last"))


def deduplicate(docs: DataFrame, *, text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, with n_bytes, n_removed, n_spans, kept_sha256, and the kept text if asked for.

    A null text counts as empty; texts of fewer than ``length`` bytes lose nothing, nor does a table of one short text.
    Rows that repeat a text lose all of it if it has ``length`` bytes. Columns of ``docs`` with the names of results are
    replaced; others may have any name. The kept text drops characters of which bytes were cut away.
    """
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    into, back = numbered([c for c in docs.columns if c != text and c not in results])
    rows = materialize(docs.select(*into, text_bytes(text).alias("raw"), F.monotonically_increasing_id().alias("rid")), "dedup-texts")
    long = rows.filter(F.octet_length("raw") >= length)
    marked = materialize(_anchor_rows(long, length), "dedup-anchors")
    # Anchors that occur once are done with. What joins is read from storage on both sides, so that a very common anchor is
    # dealt over several tasks.
    often = materialize(marked.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "dedup-often")
    live = materialize(marked.join(often, "h"), "dedup-live")
    discard(marked, often)
    stretches = materialize(live.groupBy("h", "r").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "a", "lo", "hi")).alias("at")), "dedup-stretches")
    kinds = materialize(stretches.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", (F.col("n") > CROWD).alias("crowded")), "dedup-mixed")
    asked = stretches.join(kinds, "h").select("h", "r", "crowded", "at.*").groupBy("rid").agg(F.collect_list(F.struct("h", "r", "crowded", "a", "lo", "hi")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "salt", "part", "content", "a", "r", "first"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32()]
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for value, wanted in zip(batch.column(0), batch.column(1), strict=True):
                raw = value.as_buffer().to_pybytes()
                for w in wanted.as_py():
                    content, anchor = raw[w["lo"] : w["hi"] + length], w["a"] - w["lo"]
                    made = _parts(content, anchor, length) if w["crowded"] else [(None, None, content, anchor, 0)]
                    for salt, name, piece, at, first in made:
                        out.append((w["h"], salt, name, piece, at, w["r"], first))
                        size += len(piece)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    pieces = long.select("rid", "raw").join(asked, "rid").select("raw", "asked").mapInArrow(cut, "h long, salt long, part long, content binary, a int, r long, first int")
    if kinds.filter("crowded").isEmpty():
        found = _sorted_blocks(pieces.withColumn("salt", F.lit(0).cast("long")), length)
    else:
        pieces = materialize(pieces, "dedup-pieces")
        found = _sorted_blocks(pieces.filter("part IS NULL").withColumn("salt", F.lit(0).cast("long")), length)
        found = found.unionByName(_crowded_ranges(pieces.filter("part IS NOT NULL"), length))
    whole = stretches.filter("copies > 1").select("h", "r", F.lit(0).alias("first"), F.expr("at.hi - at.lo").alias("last"))
    ranges = materialize(found.unionByName(whole), "dedup-ranges")
    discard(stretches, kinds)
    hits = live.select("h", "r", "rid", "lo").join(ranges, ["h", "r"]).select("rid", (F.col("lo") + F.col("first")).alias("first"), (F.col("lo") + F.col("last") + length).alias("last"))
    per_text = hits.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    kept = [c for c in rows.columns if c not in ("raw", "rid")]
    made_text = "kept"

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, sha, texts = [], [], [], [], []
            for value, given in zip(batch.column(len(kept)), batch.column(len(kept) + 1), strict=True):
                raw = value.as_buffer().to_pybytes()
                n.append(len(raw))
                gone, count, out = 0, 0, raw
                if given.is_valid:
                    edges = np.array([(s["first"], s["last"]) for s in given.as_py()], np.int64)
                    depth = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(depth, edges[:, 0], 1)
                    np.add.at(depth, edges[:, 1], -1)
                    cover_ = np.cumsum(depth[:-1]) > 0
                    gone, count = int(cover_.sum()), len(_runs(cover_)[0])
                    out = np.frombuffer(raw, np.uint8)[~cover_].tobytes()
                removed.append(gone)
                spans.append(count)
                sha.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    texts.append(out.decode("utf-8", "ignore"))
            made = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())] + [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], [*kept, *results, *[made_text] * with_text])

    schema = T.StructType([rows.schema[c] for c in kept]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    schema = schema.add(made_text, "string") if with_text else schema
    out = rows.join(per_text, "rid", "left").select(*kept, "raw", "spans").mapInArrow(drop, schema)
    return out.select(*back, *results, *[F.col(made_text).alias(text)] * with_text)


def op9_suffixdedup(spark, sf_dir: str) -> DataFrame:
    """What repeated strings of 200 bytes cover in all documents."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
