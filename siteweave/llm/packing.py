"""Order-preserving packing of documents into sequences, by dynamic programming with a monotone queue.

Documents, in key order, form one stream of ids for each range of keys. Windows of at most ``length`` ids cover it
without gaps. Cuts lie at document ends, at sentence ends, and, only inside sentences that are very long, in between.
The program minimises padding, plus a penalty for each cut that truncates a document, plus a small cost for each sequence.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siteweave.llm.common import partitions
from siteweave.llm.ids import Ids, ids_for, vocabulary_path

LENGTH = 1024
#: Costs in ids of padding: a cut at a sentence end, a cut inside a sentence, and any sequence.
SENTENCE_CUT, INNER_CUT, SEQUENCE = 2.0, 32.0, 4.0
#: Between cut points at most this many ids.
GAP = 128
#: Ids that one run of the program covers; a stream is cut there, at the cost of one padded sequence at most.
SEGMENT = 1 << 20


def choose_cuts(points: list[int], penalties: list[float], length: int, sequence: float = SEQUENCE) -> list[int]:
    """Window ends, as indices into ``points``, at the least total cost.

    ``points`` rise from 0 to the stream's end, with gaps of at most ``length``; ``penalties`` are those of cutting
    there. A window of n ids is padded by ``length - n``, or not at all if n is a power of two. With g(j) = cost(j) +
    point(j), the cheapest padded window that ends at i starts at the least g within reach, which a queue of rising g
    keeps at its head; windows of power-of-two lengths are a few direct transitions.
    """
    n = len(points)
    cost, start = [0.0] * n, [0] * n
    at = {p: i for i, p in enumerate(points)}
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for i in range(1, n):
        here = points[i]
        while points[queue[0][1]] < here - length:
            queue.popleft()
        g, best = queue[0]
        least = g + length - here
        for p in powers:
            j = at.get(here - p)
            if j is not None and cost[j] < least:
                least, best = cost[j], j
        least += penalties[i] + sequence
        cost[i], start[i] = least, best
        g = least + here
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, i))
    ends, i = [], n - 1
    while i > 0:
        ends.append(i)
        i = start[i]
    return ends[::-1]


def _cut_points(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray, length: int) -> tuple[list[int], list[float]]:
    sentence = np.flatnonzero(closes[ids]) + 1
    natural = np.unique(np.concatenate(([0], sentence, doc_ends)))
    gap = min(GAP, length)
    wide = np.flatnonzero(np.diff(natural) > gap)
    inner = [np.arange(natural[w] + gap, natural[w + 1], gap) for w in wide]
    points = np.unique(np.concatenate([natural, *inner]))
    penalties = np.full(len(points), INNER_CUT)
    penalties[np.searchsorted(points, natural)] = SENTENCE_CUT
    penalties[np.searchsorted(points, doc_ends)] = 0.0
    return points.tolist(), penalties.tolist()


def _pack_segment(parts: list[tuple], closes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """parts: (ids, whether the document ends here). Per piece: part, start in it, length, crc32, window, offset."""
    sizes = np.array([len(p[0]) for p in parts])
    ends = np.cumsum(sizes)
    ids = np.concatenate([p[0] for p in parts])
    closed = ends[np.array([p[1] for p in parts])]
    points, penalties = _cut_points(ids, np.append(closed, ends[-1]), closes, length)
    windows = np.array([0, *(points[i] for i in choose_cuts(points, penalties, length))])
    cuts = np.unique(np.concatenate((windows, ends)))
    begin, stop = cuts[:-1], cuts[1:]
    part = np.searchsorted(ends, begin, "right")
    window = np.searchsorted(windows, begin, "right") - 1
    view = ids.astype("<u4", copy=False)
    crc = np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)), np.int64, len(begin))
    return part, begin - (ends - sizes)[part], stop - begin, crc, window, begin - windows[window], np.diff(windows)[window]


COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document, in key order within ranges of keys.

    Returns ``key``, ``start`` (ids of the document before the piece), ``length``, ``ids_crc32``, ``doc_tokens`` (with
    the end id), ``sequence_id``, ``offset`` (in the sequence) and ``sequence_tokens`` (filled part of the sequence);
    with ``with_ids`` also the piece's ``ids``, packed. A null text is empty: its document is the end id alone.
    Rows that repeat a key stay documents of their own; null keys come first; an empty table gives no row. Sequence ids
    are unique, not consecutive: the range's number and the sequence's within it. Other columns are not read. The program
    runs over ``SEGMENT`` ids at a time: a stream is cut there, and a longer document is packed in as many parts.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Ids = ids_for(path)
        first = TaskContext.get().partitionId() << 40
        parts: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, held, parts
            part, start, size, crc, window, offset, filled = _pack_segment(parts, own.closes, length)
            before = np.array([p[3] for p in parts], np.int64)
            total = np.array([p[4] for p in parts], np.int64)
            keys = pa.array([p[2] for p in parts], type=kind).take(pa.array(part))
            out = [keys, *map(pa.array, (start + before[part], size.astype(np.int64), crc, total[part], first + window, offset.astype(np.int64), filled.astype(np.int64)))]
            if with_ids:
                out.append(pa.array([parts[p][0][a : a + n].astype("<u4").tobytes() for p, a, n in zip(part.tolist(), start.tolist(), size.tolist(), strict=True)], pa.binary()))
            first += int(window[-1]) + 1
            parts, held = [], 0
            return pa.RecordBatch.from_arrays(out, [key, *COLUMNS, *["ids"] * with_ids])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = own.document(value.as_py())
                for at in range(0, len(ids), SEGMENT):
                    piece = ids[at : at + SEGMENT]
                    parts.append((piece, at + SEGMENT >= len(ids), name, at, len(ids)))
                    held += len(piece)
                    if held >= SEGMENT:
                        yield flush()
        if parts:
            yield flush()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in COLUMNS) + ", ids binary" * with_ids
    ordered = docs.select(key, text).repartitionByRange(partitions(docs), key).sortWithinPartitions(key)
    return ordered.mapInArrow(run, schema)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1,024 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
