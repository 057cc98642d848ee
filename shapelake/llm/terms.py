"""Terms of whole texts as places in their bytes, packed into machine words: numpy passes, no Python object a term.

A term is a run of bytes of a class that holds every byte from 0x80 on, so that runs of bytes are runs of characters.
A term of up to 16 bytes is exactly its bytes in one or two little-endian uint64 words, zeros after its end; longer
terms are told apart by their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .hashed import mixed, text_bytes
from .substring import BASES

#: What a byte becomes in a term: A-Z lower-cased, 0 where no term goes on.
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:0x80] = 0
_LETTERS[0x61:0x7B] = _LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS = _LETTERS
ALPHANUMERIC = _LETTERS.copy()
ALPHANUMERIC[0x30:0x3A] = np.arange(0x30, 0x3A)

#: Bytes that two words hold.
SHORT = 16


class Terms:
    """The terms of a string column, in order: ``data`` (folded bytes, zeros at the end), and per term its first byte
    in ``start``, its bytes in ``length`` and its row in ``row``. Null texts have none."""

    def __init__(self, column: pa.Array, kind: np.ndarray):
        raw, ends = text_bytes(column)
        inside = np.zeros(len(raw) + 1, bool)
        folded = kind[raw]
        inside[:-1] = folded != 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[ends] = True
        before = np.concatenate([[False], inside[:-1]])
        self.start = np.flatnonzero(inside & (~before | edge))
        stop = np.flatnonzero(before & (~inside | edge))
        self.length = stop - self.start
        self.row = np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(self.start, ends)))
        pad = max(SHORT, 1 << int(self.length.max() - 1).bit_length()) if len(self.length) else SHORT
        self.data = np.concatenate([folded, np.zeros(pad, np.uint8)])

    def word(self, which: np.ndarray, skip: int = 0) -> np.ndarray:
        """Eight bytes of the terms ``which`` from byte ``skip`` on as a uint64, bytes past a term's end as zeros."""
        whole = np.ndarray((len(self.data) - 7,), "<u8", self.data, 0, (1,))[np.minimum(self.start[which] + skip, len(self.data) - 8)]
        left = np.clip(self.length[which] - skip, 0, 8).astype(np.uint64) * np.uint64(8)
        return np.where(left == 64, whole, whole & ((np.uint64(1) << (left % np.uint64(64))) - np.uint64(1)))

    def strings(self, which: np.ndarray) -> pa.Array:
        """The terms ``which`` as a string column."""
        size = self.length[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(self.start[which] - ends[:-1], size)
        return pa.Array.from_buffers(pa.string(), len(which), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(self.data[at].tobytes())])

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by uint64 words, the least significant word first: a radix sort by digits of 16 bits.

    Digits that all rows share take no pass.
    """
    order = np.arange(len(words[0]))
    for word in words:
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


class Vocabulary:
    """Terms with the numbers 0, 1, ..., found among the terms of texts exactly."""

    def __init__(self, terms: list[bytes]):
        padded = np.frombuffer(b"".join(t[:SHORT].ljust(SHORT, b"\0") for t in terms), "<u8").reshape(-1, 2)
        short = np.flatnonzero([len(t) <= SHORT for t in terms])
        self.long = {t: i for i, t in enumerate(terms) if len(t) > SHORT}
        self.lengths = np.unique([len(t) for t in self.long]) if self.long else np.zeros(0, np.int64)
        for self.seed in range(64):  # two of 2^20 terms share a key once in 2^25 times
            key = self.keys(padded[short, 0], padded[short, 1])
            if len(np.unique(key)) == len(key):
                break
        else:
            raise ValueError("the terms of a vocabulary must be different")
        order = np.argsort(key)
        self.key, self.number, self.words = key[order], short[order], padded[short[order]]

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(a * np.uint64(BASES[0]) + mixed(b + np.uint64(self.seed)))

    def numbers(self, terms: Terms) -> np.ndarray:
        """The number of each term, -1 for one that the vocabulary doesn't have."""
        out = np.full(len(terms.start), -1, np.int64)
        short = np.flatnonzero(terms.length <= SHORT)
        if len(short) and len(self.key):
            a = terms.word(short)
            b = np.zeros(len(short), np.uint64)
            two = np.flatnonzero(terms.length[short] > 8)
            b[two] = terms.word(short[two], 8)
            at = np.minimum(np.searchsorted(self.key, self.keys(a, b)), len(self.key) - 1)
            same = (self.words[at, 0] == a) & (self.words[at, 1] == b)
            out[short[same]] = self.number[at[same]]
        for i in np.flatnonzero((terms.length > SHORT) & np.isin(terms.length, self.lengths)):
            out[i] = self.long.get(terms.bytes_of(i), -1)
        return out
