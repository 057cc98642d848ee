"""Word hashes straight from a string column's bytes: numpy passes over the buffer, no Python object a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .substring import BASES

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte, the same for A-Z and a-z.
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64, n or more of them."""
    if len(_powers.get(base, ())) < n:
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.multiply.accumulate(x)
    return _powers[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits of which each depends on all bits of the uint64 x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(BASES[1])
        return x ^ (x >> np.uint64(29))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def folded_words(data: np.ndarray, ends: np.ndarray, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word (between ASCII blanks, A-Z lower-cased) of texts given by ``text_bytes``."""
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    starts = np.flatnonzero(~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]])))
    stops = np.flatnonzero(~blank & (edge[1:] | np.concatenate([blank[1:], [True]]))) + 1
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # words of about ``block`` bytes at a time
        b = max(a + 1, int(np.searchsorted(stops, starts[a] + block, side="right")))
        at, size = starts[a], int(stops[b - 1] - starts[a])
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data[at : at + size]] * powers(pow(BASES[0], -1, 1 << 64), size)[:size], dtype=np.uint64)])
            out[a:b] = (total[stops[a:b] - at] - total[starts[a:b] - at]) * powers(BASES[0], size)[starts[a:b] - at]
        a = b
    return mixed(out), starts
