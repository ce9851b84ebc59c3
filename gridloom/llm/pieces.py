"""Memoised sub-word pieces: the library encodes each distinct word once a worker."""

from __future__ import annotations

import os
import sys
from array import array
from itertools import filterfalse

import numpy as np

from gridloom.llm.common import MEMO_ENTRIES, MEMOS, focus

#: Punctuation that both tokenizers split from a letter before it and keep together in one run.
TAIL = b".,*$#%&!|;:?"
#: Second bytes of the small letters of Latin-1, behind 0xC3.
LATIN1_LETTERS = frozenset(range(0xA0, 0xC0)) - {0xB7}


def letters_end(word: bytes) -> bool:
    """Whether a word ends in a-z, A-Z or a small letter of Latin-1."""
    last = word[-1:]
    return last.isalpha() or (len(word) > 1 and word[-2] == 0xC3 and word[-1] in LATIN1_LETTERS)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


class Memo(dict):
    """Chunk of text -> what ``measure`` makes of its ids.

    A chunk is text that the tokenizer never joins to its neighbours. A chunk that ends in a run
    of ``TAIL`` after a letter is combined from the two parts, which the pre-tokenizer separates.
    Two generations bound the memory: a full memo becomes the old one, from which chunks that come
    again return. ``many`` may measure a list of chunks at once.
    """

    def __init__(self, path: str, measure, many=None, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.path, self.measure, self.many, self.entries = path, measure, many, entries
        self.old: dict = {}
        self._tokenizer = None

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            self._tokenizer = load(self.path)
        return self._tokenizer

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        super().clear()
        self.old = {}

    def _turn(self) -> None:
        if len(self) >= self.entries:
            old = dict(self)
            self.clear()
            self.old = old

    def __missing__(self, chunk: bytes):
        value = self.old.get(chunk)
        if value is None:
            base = chunk.rstrip(TAIL)
            if len(base) < len(chunk) and base and letters_end(base):
                value = self[base] + self[chunk[len(base) :]]
            else:
                value = self.measure(self.ids(chunk.decode("utf-8")))
        self[chunk] = value
        return value

    def _unknown(self, chunks: set[bytes]):
        # a set's difference with such a dict would walk through all of the dict
        return filterfalse(self.__contains__, filterfalse(self.old.__contains__, chunks))

    def learn(self, chunks: set[bytes]) -> None:
        """Encode the unknown ones among ``chunks`` in few calls to the library."""
        self._turn()
        fresh = set()
        for chunk in self._unknown(chunks):
            base = chunk.rstrip(TAIL)
            fresh.add(base if base and letters_end(base) else chunk)
        fresh = list(self._unknown(fresh))
        if self.many is not None:
            self.update(zip(fresh, self.many(self.tokenizer, fresh)))
        else:
            self.update(zip(fresh, measure_each(self.tokenizer, fresh, self.measure)))


def measure_each(tokenizer, chunks: list[bytes], measure) -> list:
    return [measure(x.ids) for x in tokenizer.encode_batch_fast([c.decode("utf-8") for c in chunks], add_special_tokens=False)]


def memo_for(name: str, path: str, make) -> Memo:
    """The worker's memo of an operator and a tokenizer file; other memos are emptied."""
    key = f"{name}:{path}"
    focus(key)
    if key not in MEMOS:
        MEMOS[key] = make()
    return MEMOS[key]


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()
