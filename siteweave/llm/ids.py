"""Token ids of whole texts by a public vocabulary file, packed for storage and checksums."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

from siteweave.llm.bpe import PATTERN, _byte_of, vocabulary_path

__all__ = ["Ids", "ids_for", "vocabulary_path"]

#: The id that closes each document.
END = 0


class Ids:
    """Ids of a byte-level BPE file, equal to those of the tokenizers library, made by tiktoken's faster merges."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_of()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        size = max([*ranks.values(), *self.special.values()]) + 1
        #: By id: whether a sentence or line ends with it.
        self.closes = np.zeros(size, bool)
        for token, i in ranks.items():
            self.closes[i] = token[-1:] in (b".", b"!", b"?") or b"\n" in token

    def _plain(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # the pattern engine gives up on some very long runs; the panic is not an Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                raise
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(self.path)
            slow.encode_special_tokens = True
            return slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> np.ndarray:
        """A text's ids; strings of special tokens become their ids; null is empty."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.split and any(s in text for s in self.special):
            found: list[int] = []
            for part in self.split.split(text):
                found += [self.special[part]] if part in self.special else self._plain(part)
            return np.array(found, np.uint32)
        return np.array(self._plain(text), np.uint32)

    def document(self, text: str | None) -> np.ndarray:
        """A document's ids with the end id."""
        return np.append(self.encode(text), np.uint32(END))


@lru_cache(maxsize=2)
def ids_for(path: str) -> Ids:
    return Ids(path)
