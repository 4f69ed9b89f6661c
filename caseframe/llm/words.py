"""Words of many texts at once, as arrays over the bytes of an Arrow column."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first bytes of eight.
_FIRST = np.array([2**(8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word from which it is hashed as a whole.
LONG = 512


class Words(NamedTuple):
    data: np.ndarray    # bytes of all texts, one after the other
    texts: np.ndarray   # where each text starts, and the end
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    first: np.ndarray   # number of the first word of each text, and the number of words


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split(column: pa.Array, lower: bool = False) -> Words:
    """Words between spaces and 0x09 to 0x0D; nulls are empty. `lower` changes A-Z only."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]] if raw else np.zeros(0, np.uint8)
    texts = ends - ends[0]
    visible = ~_SPACE[data]
    begins = visible.copy()
    begins[1:] &= ~visible[:-1]
    cuts = texts[:-1][texts[:-1] < len(data)]
    begins[cuts] = visible[cuts]
    closes = visible.copy()
    closes[:-1] &= ~visible[1:]
    lasts = texts[1:][texts[1:] > 0] - 1
    closes[lasts] = visible[lasts]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return Words(_LOWER[data] if lower else data, texts, starts, stops,
                 np.searchsorted(starts, texts))


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, the same wherever the word stands.

    Eight bytes at a time go through a step that is not linear in them, so no kind of words
    collides more often than by chance; words of more than LONG bytes go through BLAKE2.
    """
    rows, at, left = np.arange(len(words.starts)), words.starts, words.ends - words.starts
    found = mixed(left.astype(np.uint64) * _BASE + _BASE)
    for row in np.flatnonzero(left > LONG):
        digest = hashlib.blake2b(words.data[words.starts[row]:words.ends[row]], digest_size=8)
        found[row] = int.from_bytes(digest.digest(), "little")
    padded = np.concatenate((words.data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(words.data) + 1, "<u8", padded, strides=(1,))
    on = left <= LONG
    while on.any():
        rows, at, left = rows[on], at[on], left[on]
        piece = eight[at] & _FIRST[np.minimum(left, 8)]
        found[rows] = mixed((found[rows] ^ piece) * _BASE)
        at, left = at + 8, left - 8
        on = left > 0
    return found
