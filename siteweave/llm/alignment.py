"""Cross-tokenizer alignment: groups of ids of two vocabularies that cover the same bytes, by a dictionary of groups.

Each text is cut by both tokenizers; where tokens of both end at one byte, a group ends. Most groups occur again and
again, so tasks intern them, block of texts by block, and Spark brings the blocks' dictionaries together: links are
expanded once for each distinct group and multiplied by how often it occurs, or by how many documents have it. What the
counts say of a group goes back to the blocks by a join on the group, and to the texts by the places that blocks gave them.

Texts are cut at single spaces between other characters first. Tokens of neither side reach over such a place (the model
is checked for that), so that a word is encoded and aligned once for each block of texts it occurs in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import discard, materialize
from siteweave.llm.ids import ids_for, vocabulary_path

#: Words of the texts of a block. A text is never parted over blocks.
BLOCK = 1 << 20
#: Columns of a text's facts.
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_CUT = regex.compile(r"(?<=\S) (?=\S)")
_ODD = regex.compile(r"\s | \s|^ | $")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Missing(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        return at


def cut(text: str) -> list[str]:
    """The parts of a text between single spaces that have other characters than white space on both sides."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class Pair:
    """The two tokenizers, with the bytes of their tokens. ``a`` gets a space and the text, ``b`` adds the space itself."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.a = ids_for(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        size = max(self.a.fast.n_vocab, *self.a.special.values()) + 1
        self.a_length = np.zeros(size, np.int64)
        for token in self.a.fast.token_byte_values():
            self.a_length[self.a.fast.encode_single_token(token)] = len(token)
        #: Whether no piece reaches over a space that follows another character.
        self.parted = not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_control(i))

    def words(self, text: str) -> list[str]:
        return cut(text) if self.parted else [text]

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of each word on both sides, and whether the tokens' bytes are those of a space and the word."""
        a = [self.a._plain(" " + w) for w in words]
        b = self.b.encode(words, num_threads=1)
        raw = [b" " + w.encode() for w in words]
        names, decode = self.b_bytes, self.a.fast.decode_bytes
        return a, b, np.array([b"".join([names[i] for i in y]) == r and decode(x) == r for x, y, r in zip(a, b, raw, strict=True)], bool)


@lru_cache(maxsize=2)
def pair_for(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum())), sizes


def _firsts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def group_ends(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the byte offsets where tokens of both sides end: the tokens before each of them, on either side."""
    a, b = np.cumsum(a_lengths), np.cumsum(b_lengths)
    both = np.intersect1d(a, b)
    return np.searchsorted(a, both, "right"), np.searchsorted(b, both, "right")


def pack_groups(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> pa.Array:
    """Each group as bytes: how many ids of the first side it has, these, and those of the second, 32 bits each."""
    na, nb = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
    first = _firsts(1 + na + nb)
    out = np.empty(first[-1], "<u4")
    out[first[:-1]] = na
    out[np.arange(len(a)) + np.repeat(first[:-1] + 1 - (a_ends - na), na)] = a
    out[np.arange(len(b)) + np.repeat(first[:-1] + 1 + na - (b_ends - nb), nb)] = b
    return pa.Array.from_buffers(pa.large_binary(), len(na), [None, pa.py_buffer((first * 4).astype(np.int64)), pa.py_buffer(out)])


def unpack_group(key: bytes) -> tuple[list[int], list[int]]:
    ids = np.frombuffer(key, "<u4").tolist()
    return ids[1 : 1 + ids[0]], ids[1 + ids[0] :]


def expand(key: bytes, a_length: np.ndarray, b_length: np.ndarray) -> list[tuple[int, int]]:
    """The links of a group: pairs of an id of either side whose tokens end at one byte."""
    a, b = unpack_group(key)
    ends: dict[int, list[int]] = {}
    for i, end in zip(b, accumulate(b_length[b].tolist()), strict=True):
        ends.setdefault(end, []).append(i)
    return [(i, j) for i, end in zip(a, accumulate(a_length[a].tolist()), strict=True) for j in ends.get(end, ())]


class Block:
    """Texts that are encoded together: their distinct words, and those words' distinct groups."""

    def __init__(self, pair: Pair) -> None:
        self.pair, self.words, self.keys, self.held = pair, Missing(), [], 0
        self.texts: list[np.ndarray] = []

    def add(self, key: object, text: str | None) -> None:
        parts = self.pair.words(text) if text else []
        self.keys.append(key)
        self.texts.append(np.fromiter(map(self.words.__getitem__, parts), np.uint32, len(parts)))
        self.held += len(parts) + 16

    def close(self) -> tuple[pa.Array, np.ndarray, np.ndarray, list[tuple]]:
        """(groups, how often each occurs, in how many texts) and for each text (key, counts, digest, groups, their counts)."""
        pair, words = self.pair, list(self.words)
        a_ids, b_ids, good = pair.encode(words)
        (a, na), (b, nb) = _flat([x if g else [] for x, g in zip(a_ids, good, strict=True)]), _flat([x if g else [] for x, g in zip(b_ids, good, strict=True)])
        a_ends, b_ends = group_ends(pair.a_length[a], pair.b_length[b])
        coded = pack_groups(a, b, a_ends, b_ends).dictionary_encode()
        groups, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        first = np.searchsorted(a_ends, _firsts(na), "right")  # groups before each word
        sides = [unpack_group(k) for k in groups.to_pylist()]
        shown = [",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in sides]
        links = np.fromiter((len(expand(k, pair.a_length, pair.b_length)) for k in groups.to_pylist()), np.int64, len(groups))
        listed = at.tolist()
        said = [";".join([shown[g] for g in listed[x:y]]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        per_word = np.stack([na, nb, np.diff(first), np.diff(np.concatenate(([0], np.cumsum(links[at])))[first])]) if words else np.zeros((4, 0), np.int64)
        often, spread, rows = np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64), []
        for key, text in zip(self.keys, self.texts, strict=True):
            if not len(text) or not good[text].all():
                rows.append((key, np.zeros(4, np.int64), "", np.zeros(0, np.uint32), np.zeros(0, np.uint32)))
                continue
            size = first[text + 1] - first[text]
            begin = _firsts(size)
            own, count = np.unique(at[np.arange(begin[-1]) + np.repeat(first[text] - begin[:-1], size)], return_counts=True)
            often[own] += count
            spread[own] += 1
            digest = hashlib.sha256(";".join([said[w] for w in text.tolist()]).encode()).hexdigest()
            rows.append((key, per_word[:, text].sum(axis=1), digest, own.astype(np.uint32), count.astype(np.uint32)))
        return groups, often, spread, rows


def _interned(docs: DataFrame, key: str, text: str, a_path: str, b_path: str) -> DataFrame:
    """Rows of two kinds: (block, at, group, often, spread) and (block, key, counts, digest, packed places, packed counts)."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["part", "block", "at", "grp", "often", "spread", "key", *COUNTS, "digest", "places", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block, typed = Block(pair_for(a_path, b_path)), pa.null()

        def flush() -> Iterator[pa.RecordBatch]:
            groups, often, spread, rows = block.close()
            used = np.flatnonzero(often)
            n, m = len(used), len(rows)
            null = lambda size, t: pa.nulls(size, t)
            full = lambda size, v, t: pa.array(np.full(size, v), t)
            yield pa.RecordBatch.from_arrays([full(n, 0, pa.int32()), full(n, number, pa.int64()), pa.array(used.astype(np.int32)), groups.take(pa.array(used)).cast(pa.binary()), pa.array(often[used]), pa.array(spread[used]), null(n, typed), *[null(n, pa.int64())] * 4, null(n, pa.string()), *[null(n, pa.binary())] * 2], names)
            counts = np.array([r[1] for r in rows], np.int64).reshape(m, 4)
            yield pa.RecordBatch.from_arrays(
                [full(m, 1, pa.int32()), full(m, number, pa.int64()), null(m, pa.int32()), null(m, pa.binary()), *[null(m, pa.int64())] * 2, pa.array([r[0] for r in rows], typed), *map(pa.array, counts.T.copy()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3].tobytes() for r in rows], pa.binary()), pa.array([r[4].tobytes() for r in rows], pa.binary())],
                names,
            )

        for batch in batches:
            typed = batch.schema.field(0).type
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(name, value.as_py())
                if block.held >= BLOCK:
                    yield from flush()
                    block, number = Block(block.pair), number + 1
        if block.keys:
            yield from flush()

    schema = f"part int, block long, at int, grp binary, often long, spread long, key {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", digest string, places binary, times binary"
    return docs.select(key, text).mapInArrow(run, schema)


def _linked(groups: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(grp, a, b, times, n): the links of each distinct group, and how many of its own links are this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_for(a_path, b_path)
        for batch in batches:
            found = [expand(k, pair.a_length, pair.b_length) for k in batch.column(0).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            ids = np.array([x for links in found for x in links], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), batch.column(1).take(pa.array(row))], ["grp", "a", "b", "times"])

    return groups.mapInArrow(run, "grp binary, a int, b int, times long").groupBy("grp", "a", "b").agg(F.min("times").alias("times"), F.count("*").alias("n"))


def link_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links of the corpus hold a pair of ids, and whether no pair of its ``b`` has more."""
    counted = links.groupBy("a", "b").agg(F.sum(F.col("times") * F.col("n")).alias("count"))
    most = counted.groupBy("b").agg(F.max("count").alias("most"))
    return counted.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, *, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, by: str = "links") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each text.

    The first tokenizer gets a space and the text, special tokens being plain text; the second adds the space. A pair's
    count is how many links of all texts hold it or, with ``by="documents"``, how many documents have the groups that
    hold it, added up by group. ``n_best`` are the text's links whose pair no other pair of its second id exceeds, ties
    included; ``count_sum`` adds up its links' counts. Texts that are null or empty, or whose tokens do not give back
    their bytes on either side, have no tokens: zeros and an empty digest. Rows that repeat a key stay rows of their own;
    null keys are kept; an empty table gives no row. Other columns are not read.
    """
    if by not in ("links", "documents"):
        raise ValueError("by must be 'links' or 'documents'")
    a_path, b_path = a_path or vocabulary_path(), b_path or piece_path()
    rows = materialize(_interned(docs, key, text, a_path, b_path), "alignment-blocks", partition_by=["part"])
    entries = rows.filter("part = 0").select("block", "at", "grp", "often", "spread")
    groups = entries.groupBy("grp").agg(F.sum("often" if by == "links" else "spread").alias("times"))
    links = materialize(_linked(groups, a_path, b_path), "alignment-links")
    pairs = materialize(link_counts(links), "alignment-pairs")
    valued = links.join(pairs, ["a", "b"]).groupBy("grp").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("n")).alias("count_sum"))
    valued = materialize(valued, "alignment-values")
    told = materialize(entries.select("block", "at", "grp").join(valued, "grp").select("block", "at", "n_best", "count_sum"), "alignment-told")
    discard(links, pairs, valued)
    return _texts(rows.filter("part = 1"), told).withColumnRenamed("key", key)


def _texts(texts: DataFrame, told: DataFrame) -> DataFrame:
    """Adds up what a block's groups are worth by the places of each text: the block's values come first, then its texts."""
    kind = texts.schema["key"].dataType
    facts = ["key", *COUNTS, "digest", "places", "times"]
    none = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in facts]
    values = told.select("block", F.lit(0).alias("part"), F.col("at"), "n_best", "count_sum", *none)
    own = texts.select("block", F.lit(1).alias("part"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), *facts)
    ordered = values.unionByName(own).repartition("block").sortWithinPartitions("block", "part", "at")
    names = ["key", *COUNTS, "groups_sha256", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, worth = None, [], []
        table = np.zeros((0, 2), np.int64)
        for batch in batches:
            owner, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(owner) | np.diff(part)) + 1
            for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
                if x == y:
                    continue
                piece = batch.slice(x, y - x)
                if block != owner[x]:
                    block, at, worth, table = owner[x], [], [], np.zeros((0, 2), np.int64)
                if part[x] == 0:
                    at.append(piece.column(2).to_numpy())
                    worth.append(np.stack([piece.column(3).to_numpy(), piece.column(4).to_numpy()], axis=1))
                    continue
                if at:
                    places = np.concatenate(at)
                    table = np.zeros((int(places.max()) + 1, 2), np.int64)
                    table[places] = np.concatenate(worth)
                    at, worth = [], []
                sums = np.zeros((len(piece), 2), np.int64)
                packed = zip(piece.column(11).to_pylist(), piece.column(12).to_pylist(), strict=True)
                for i, (own_places, times) in enumerate(packed):
                    if own_places:
                        sums[i] = (table[np.frombuffer(own_places, np.uint32)] * np.frombuffer(times, np.uint32).astype(np.int64)[:, None]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in range(5, 11)], pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy())], names)

    schema = f"key {kind.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, n_best long, count_sum long"
    return ordered.mapInArrow(run, schema)


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """Groups and links of all documents under both vocabularies."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
