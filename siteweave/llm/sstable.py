"""Token ids in sorted-string-table shards.

A shard holds documents of one range of keys, in key order. File: blocks; then the sparse index, one entry for each
block; then a Bloom filter of the keys; then a footer of fixed size. In a block each key keeps only what differs
from the key before it; a block is compressed as a whole. A lookup asks the filter, searches the index by halving,
reads one block (or its successors, if a key repeats) and walks it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm.common import materialize, partitions, scratch
from siteweave.llm.ids import ids_for, vocabulary_path

MAGIC = b"IDTABLE1"
BLOCK = 1 << 18
BITS_PER_KEY, HASHES = 10, 7
#: Footer: offsets and sizes of index and filter, documents, ids, width of an id, checksum of index and filter.
FOOTER = struct.Struct("<QIQIQQII8s")


def key_bytes(key: int | None) -> bytes:
    """Bytes that sort as the keys do; null comes first."""
    return b"\x00" if key is None else b"\x01" + ((key + (1 << 63)) & (2**64 - 1)).to_bytes(8, "big")


def key_of(raw: bytes) -> int | None:
    return None if raw == b"\x00" else int.from_bytes(raw[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bit_places(raw: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(raw)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    """Writes one shard to an open file; only the current block, the index and key hashes are held."""

    def __init__(self, sink, width: int) -> None:
        self.sink, self.width, self.at = sink, width, 0
        self.block, self.block_size, self.last, self.first = [], 0, b"", b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.docs = self.ids = self.block_docs = 0
        self.zip = zstandard.ZstdCompressor(level=3)

    def add(self, raw: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            for a, b in zip(raw, self.last):  # noqa: B905
                if a != b:
                    break
                shared += 1
        else:
            self.first = raw
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += [_varint(shared), _varint(len(raw) - shared), raw[shared:], _varint(len(value)), value]
        self.block_size += len(value) + 8
        self.block_docs += 1
        self.docs += 1
        self.ids += len(ids)
        self.last = raw
        self.keys.append(raw)
        if self.block_size >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zip.compress(b"".join(self.block))
            self.index.append((self.first, self.at, len(data), self.block_docs))
            self.sink.write(data)
            self.at += len(data)
            self.block, self.block_size, self.block_docs = [], 0, 0

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QII", at, size, docs) for k, at, size, docs in self.index)
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        filter_ = bytearray((bits + 7) // 8)
        for raw in self.keys:
            for place in _bit_places(raw, bits):
                filter_[place >> 3] |= 1 << (place & 7)
        bloom = struct.pack("<Q", bits) + bytes(filter_)
        self.sink.write(index + bloom)
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.ids, self.width, zlib.crc32(index + bloom), MAGIC))


class Reader:
    """Reads one shard from a seekable file."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        index_at, index_size, bloom_at, bloom_size, self.docs, self.ids, self.width, check, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table of ids")
        tail = source.read_at(index_size + bloom_size, index_at)
        if zlib.crc32(tail) != check:
            raise ValueError("the index or filter is damaged")
        self.blocks, at = [], 0
        while at < index_size:
            n, at = _read_varint(tail, at)
            self.blocks.append((tail[at : at + n], *struct.unpack_from("<QII", tail, at + n)))
            at += n + 16
        (self.bits,) = struct.unpack_from("<Q", tail, bloom_at - index_at)
        self.bloom = tail[bloom_at - index_at + 8 :]
        self.unzip = zstandard.ZstdDecompressor()

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, _ = self.blocks[i]
        data, at, raw = self.unzip.decompress(self.source.read_at(size, at)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            fresh, at = _read_varint(data, at)
            raw = raw[:shared] + data[at : at + fresh]
            n, at = _read_varint(data, at + fresh)
            yield raw, np.frombuffer(data, f"<u{self.width}", n // self.width, at).astype("<u4")
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self._block(i)

    def may_hold(self, raw: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bit_places(raw, self.bits))

    def find(self, raw: bytes) -> list[np.ndarray]:
        """Ids of every document with this key, in the order written."""
        if not self.may_hold(raw):
            return []
        i, found = max(0, bisect_left(self.blocks, raw, key=lambda b: b[0]) - 1), []
        while i < len(self.blocks) and self.blocks[i][0] <= raw:
            found += [ids for own, ids in self._block(i) if own == raw]
            i += 1
        return found


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def write_tables(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Writes ``docs`` as shards under ``folder``, which all executors must share, and returns the manifest.

    Manifest: shard, path, docs, ids, low, high (keys). A null text is the end id alone. Rows that repeat a key are
    all kept; keys are long integers or null. An empty table makes no shard. A task writes under a name of its own and
    renames the finished file, so a lost executor leaves no half shard.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ids_for(path)
        width = 2 if len(own.closes) <= 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        files, top = _open(folder)
        name, made, low, high = f"{top}/part-of-{uuid.uuid4().hex}", None, None, None
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if made is None:
                    files.create_dir(top, recursive=True)
                    sink = files.open_output_stream(name)
                    made, low = Writer(sink, width), k
                high = k
                made.add(key_bytes(k), own.document(value.as_py()))
        if made is not None:
            made.close()
            sink.close()
            final = f"{top}/ids-{shard:06d}.table"
            files.move(name, final)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([f"{folder}/ids-{shard:06d}.table"]), pa.array([made.docs]), pa.array([made.ids]), pa.array([low], pa.int64()), pa.array([high], pa.int64())], ["shard", "path", "docs", "ids", "low", "high"])

    ordered = docs.select(F.col(key).cast("long").alias("key"), text).repartitionByRange(partitions(docs), "key").sortWithinPartitions("key")
    return materialize(ordered.mapInArrow(run, "shard long, path string, docs long, ids long, low long, high long"), "id-tables")


def read_tables(manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Reads the shards back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids if asked for."""
    placed = manifest.withColumn("base", F.sum("ids").over(Window.orderBy("shard")) - F.col("ids"))  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, name = _open(file)
                with files.open_input_file(name) as source:
                    keys, starts, sizes, sums, packed, held = [], [], [], [], [], 0
                    for raw, ids in Reader(source):
                        keys.append(key_of(raw))
                        starts.append(base)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids))
                        packed += [ids.tobytes()] * with_ids
                        base += len(ids)
                        held += len(ids)
                        if held > 1 << 20:
                            yield made(keys, starts, sizes, sums, packed)
                            keys, starts, sizes, sums, packed, held = [], [], [], [], [], 0
                    yield made(keys, starts, sizes, sums, packed)

    def made(keys, starts, sizes, sums, packed) -> pa.RecordBatch:
        out = [pa.array(x, pa.int64()) for x in (keys, starts, sizes, sums)] + [pa.array(packed, pa.binary())] * with_ids
        return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    spread = placed.select("path", "base").repartition(partitions(manifest), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def lookup(manifest: DataFrame, keys: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the asked keys, by binary search in the shards whose range holds them.

    Keys meet shards in a join on ranges of keys; each pair of shard and keys is one group of reads.
    """
    asked = keys.select(F.col(key).cast("long").alias("doc_id")).distinct()
    inside = (F.col("doc_id") >= F.col("low")) & (F.col("doc_id") <= F.col("high")) | F.col("doc_id").isNull() & F.col("low").isNull()
    pairs = asked.join(F.broadcast(manifest.select("path", "low", "high")), inside).select("path", "doc_id")  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, reader = None, None, None
        for batch in batches:
            found: list[tuple[int | None, bytes]] = []
            for path, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != name:
                    files, at = _open(path)
                    name, source = path, files.open_input_file(at)
                    reader = Reader(source)
                found += [(k, ids.tobytes()) for ids in reader.find(key_bytes(k))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["doc_id", "ids"])

    return pairs.repartition("path").sortWithinPartitions("path", "doc_id").mapInArrow(run, "doc_id long, ids binary")


def op10_sstable(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to sorted-string tables and read back: doc_id, start, n_tokens, ids_crc32."""
    return read_tables(write_tables(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "id-files")))
