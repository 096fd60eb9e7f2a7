"""Byte-level BPE: encoding and decoding with a minimal acyclic transducer of frequent words.

The corpus is counted once; its most frequent pre-tokens (their number is bounded by a parameter) are merged to ids
and compiled into a minimal acyclic automaton. States with equal futures are one, so suffixes are shared. Each arc
carries how many smaller words it skips, so the outputs along a path add up to a word's rank, which points at its ids. The
compiled arrays are one file that Spark hands to every executor and each Python worker maps into memory. Words that
the automaton lacks are merged exactly by the vocabulary's ranks.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm.common import materialize, top_counts

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most words that the automaton holds.
LEXICON = 1 << 16
#: Entries of each generation of a worker's own caches.
CACHE = 1 << 18


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizers file of a byte-level BPE: ids, merge ranks and special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_of()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.ids = ids
        self.first = [ids[bytes([b])] for b in range(256)]
        #: Rank of each pair of ids that is merged, and what each rank makes of it.
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks[ids[left], ids[right]] = rank
            self.made.append(ids[left + right])

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank is merged, leftmost first, until no pair has a rank."""
        parts = [self.first[b] for b in word]
        if len(parts) > 256:
            return self._merge_long(parts)
        get, never = self.ranks.get, len(self.made)
        ranks = [get(pair, never) for pair in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (rank := min(ranks)) < never:
            at = ranks.index(rank)
            parts[at] = self.made[rank]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), never)
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), never)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """As merge(), with a heap over neighbours, for very long pre-tokens."""
        from heapq import heapify, heappop, heappush

        n, get = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        live: list[int | None] = list(parts)
        heap = [(found, i, parts[i], parts[i + 1]) for i in range(n - 1) if (found := get((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        while heap:
            rank, i, a, b = heappop(heap)
            j = after[i]
            if live[i] != a or j < 0 or live[j] != b:
                continue
            live[i], live[j] = self.made[rank], None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (found := get((live[i], live[k]))) is not None:
                    heappush(heap, (found, i, live[i], live[k]))
            if (h := before[i]) >= 0 and (found := get((live[h], live[i]))) is not None:
                heappush(heap, (found, h, live[h], live[i]))
        return [x for x in live if x is not None]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def build_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Compiles words and their ids into one blob.

    Words are added in byte order; once a state can get no more arcs it is replaced by an equal one if there is one,
    which keeps the automaton minimal throughout. Arcs are looked up by state and byte in an open table, so a step
    costs the same in every state. Layout: 5 counts; key (plus one; 0 is free), target and skipped words of each slot of
    the table; end of each word's ids; the ids; whether a state ends a word.
    """
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []
    count_of: list[int] = []

    def freeze(node: list) -> int:
        final, arcs = node
        signature = (final, *arcs)
        if (known := register.get(signature)) is None:
            known = register[signature] = len(arcs_of)
            arcs_of.append(signature)
            count_of.append(int(final) + sum(count_of[t] for _, t in arcs))
        return known

    path: list[list] = [[False, []]]
    last = b""
    ordered = sorted(words)
    for word in ordered:
        same = len(os.path.commonprefix([last, word]))
        for depth in range(len(path) - 1, same, -1):
            path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        last = word
    for depth in range(len(path) - 1, 0, -1):
        path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
    root = freeze(path[0])
    ends = [final for final, *_ in arcs_of]
    size = 1 << max(4, (2 * sum(len(a) - 1 for a in arcs_of)).bit_length())
    keys, target, skip = [0] * size, [0] * size, [0] * size
    for state, (final, *arcs) in enumerate(arcs_of):
        passed = int(final)
        for b, t in arcs:
            at = _slot(state << 8 | b, size)
            while keys[at]:
                at = (at + 1) & (size - 1)
            keys[at], target[at], skip[at] = (state << 8 | b) + 1, t, passed
            passed += count_of[t]
    stops = np.cumsum([len(words[w]) for w in ordered]) if ordered else np.zeros(0)
    ids = [i for w in ordered for i in words[w]]
    arrays = [np.array(keys, "<u4"), np.array(target, "<u4"), np.array(skip, "<u4"), stops.astype("<u4"), np.array(ids, "<u4"), np.array(ends, "u1")]
    return struct.pack("<5I", root, len(ends), size, len(ordered), len(ids)) + b"".join(a.tobytes() for a in arrays)


def _slot(key: int, size: int) -> int:
    return key * 0x9E3779B1 >> 8 & size - 1


class Lexicon:
    """A compiled lexicon over any buffer; lookups follow arcs and add up their outputs."""

    def __init__(self, buffer: bytes | mmap.mmap) -> None:
        self.root, states, slots, words, ids = struct.unpack_from("<5I", buffer)
        at = struct.calcsize("<5I")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(buffer, kind, n, at)
            at += out.nbytes
            return out

        self.keys, self.target, self.skip, self.stops, self.ids, self.final = (
            memoryview(take(*x)) for x in (("<u4", slots), ("<u4", slots), ("<u4", slots), ("<u4", words), ("<u4", ids), ("u1", states))
        )
        self.buffer = buffer

    def find(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian unsigned 32-bit integers."""
        state, rank, keys = self.root, 0, self.keys
        mask = len(keys) - 1
        for b in word:
            key = state << 8 | b
            at = key * 0x9E3779B1 >> 8 & mask  # as _slot()
            while (held := keys[at]) != key + 1:
                if not held:
                    return None
                at = (at + 1) & mask
            rank += self.skip[at]
            state = self.target[at]
        if not self.final[state]:
            return None
        return self.ids[self.stops[rank - 1] if rank else 0 : self.stops[rank]].tobytes()


#: Where a single space that stands between white space is no place to cut a text: runs of white space stay whole.
UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: A run of letters and one of signs, as two pre-tokens; anything else is split by the pattern. Letters of the Latin blocks.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\\[-`{-~]*)")


class Cache(dict):
    """Two generations of at most ``CACHE`` entries: what is still in use when the younger one is full, survives."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Coder:
    """Encodes and decodes for one worker.

    Texts are cut at single spaces. What stands between them is looked up with the space ahead of it; if it is new it is
    split into pre-tokens, which come from a cache of their own, the lexicon, or merges.
    """

    def __init__(self, words: Vocabulary, lexicon: Lexicon | None) -> None:
        self.words, self.lexicon = words, lexicon
        self.pieces, self.tokens = Cache(self._piece), Cache(self._token)
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(words.special, key=len, reverse=True)) + ")") if words.special else None
        sizes = np.array([len(b) for b in words.bytes_of], np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.flat = np.frombuffer(b"".join(words.bytes_of), np.uint8)

    def _token(self, piece: str) -> bytes:
        word = piece.encode()
        found = self.lexicon.find(word) if self.lexicon else None
        return np.array(self.words.merge(word), "<u4").tobytes() if found is None else found

    def _piece(self, piece: str) -> bytes:
        if plain := PLAIN.fullmatch(piece):
            letters, signs = plain.groups()
            found = self.tokens[" " + letters]
            return found + self.tokens[signs] if signs else found
        return self._ids(" " + piece)

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.pattern.findall(text)))

    def _plain(self, text: str) -> bytes:
        if UNSAFE.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        return self._ids(first) + b"".join(map(self.pieces.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """All ids of a text, packed. Strings of special tokens become their ids."""
        if self.split and any(s in text for s in self.words.special):
            return b"".join(struct.pack("<I", self.words.special[part]) if part in self.words.special else self._plain(part) for part in self.split.split(text))
        return self._plain(text)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        out = []
        for at in range(0, len(ids), 1 << 20):  # a very long text stays in bounded memory
            part = ids[at : at + (1 << 20)]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            out.append(self.flat[np.repeat(self.starts[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, lexicon_name: str | None) -> Coder:
    """This worker's coder; the lexicon is mapped from the file that Spark has delivered."""
    key = path, lexicon_name or ""
    if key not in _coders:
        lexicon = None
        if lexicon_name:
            with open(SparkFiles.get(lexicon_name), "rb") as f:
                lexicon = Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        _coders.clear()
        _coders[key] = Coder(vocabulary(path), lexicon)
    return _coders[key]


def count_words(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(word, n): every pre-token of all texts. Each worker adds up its own before Spark shuffles them.

    What stands between single spaces is counted first, and split by the pattern once for each kind of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, counts, spaced = regex.compile(PATTERN), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            for piece, n in spaced.items():
                if plain := PLAIN.fullmatch(piece):
                    letters, signs = plain.groups()
                    counts[" " + letters] += n
                    if signs:
                        counts[signs] += n
                else:
                    for word in pattern.findall(" " + piece):
                        counts[word] += n
            out = pa.RecordBatch.from_arrays([pa.array([w.encode() for w in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            spaced.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                body = value.as_py() or ""
                if UNSAFE.search(body):
                    counts.update(pattern.findall(body))
                else:
                    first, *rest = body.split(" ")
                    counts.update(pattern.findall(first))
                    spaced.update(rest)
                if len(counts) + len(spaced) > CACHE:
                    yield flush()
        yield flush()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_lexicon(docs: DataFrame, *, text: str = "text", size: int = LEXICON, path: str | None = None, longest: int = 64) -> str:
    """Counts all texts, compiles the ``size`` most frequent words of 2 to ``longest`` bytes and hands the file to Spark.

    Returns the file's name for ``coder``. The driver gets a histogram of counts, then those words: at most ``size`` x
    ``longest`` bytes. Counts where the histogram is cut decide, so there may be somewhat fewer than ``size``.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path()
    words = vocabulary(path)
    counted = count_words(docs, text=text).filter((F.octet_length("word") > 1) & (F.octet_length("word") <= longest))
    top = top_counts(materialize(counted, "bpe-words"), "n", size).select("word").collect()
    blob = build_lexicon({bytes(r.word): words.merge(bytes(r.word)) for r in top})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    with tempfile.TemporaryDirectory() as folder:  # only to hand it over: addFile copies it and serves every executor
        with open(os.path.join(folder, name), "wb") as f:
            f.write(blob)
        _add_file(spark, os.path.join(folder, name))
    return name


def _add_file(spark: SparkSession, file: str) -> None:
    """Spark serves the file from the driver's copy, so that copy lives as long as the session."""
    keep = os.path.join(SparkFiles.getRootDirectory(), os.path.basename(file))
    if not os.path.exists(keep):
        with open(file, "rb") as a, open(keep, "wb") as b:
            b.write(a.read())
    spark.sparkContext.addFile(keep)


def encode(docs: DataFrame, lexicon_name: str | None, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): each whole text's ids as packed little-endian unsigned 32-bit integers; a null text is empty."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, lexicon_name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.encode(x.as_py() or "") for x in batch.column(1)], pa.binary())], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, *, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text) from ``encode``'s rows; special tokens are written out. Broken UTF-8 becomes U+FFFD."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, None)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x.as_py() or b"") for x in batch.column(1)], pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string")


def digest(docs: DataFrame, lexicon_name: str | None, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encodes, decodes and hashes in one pass over the texts: (key, n_tokens, ids_sha256, decoded_sha256)."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, lexicon_name)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for value in batch.column(1):
                packed = own.encode(value.as_py() or "")
                n.append(len(packed) // 4)
                ids_hash.append(hashlib.sha256(packed).hexdigest())
                text_hash.append(hashlib.sha256(own.decode(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts they decode to, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(docs, fit_lexicon(docs))
