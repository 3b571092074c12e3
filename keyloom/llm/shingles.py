"""Word shingles as 64-bit hashes, in numpy over whole batches. Words are runs of non-white-space, A-Z lower-cased.

Words are hashed where they lie in a batch's bytes: prefix sums of byte values times powers give the hash of any run of bytes,
so no word becomes a Python object.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

#: Words of a shingle.
WIDTH = 5
#: Odd multipliers of the hash mixer (the finaliser of splitmix64); fixed values.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Odd base of the polynomial hash of words, modulo 2^64.
BASE = 0xD1342543DE82EF95
#: Bytes that are hashed at a time, about.
SEGMENT = 1 << 18


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values, another for each seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


#: A value for each byte, the same for a letter's two cases; and whether it is white space.
VALUES = mixed(np.arange(256, dtype=np.uint64), 11)
VALUES[ord("A") : ord("Z") + 1] = VALUES[ord("a") : ord("z") + 1]
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(n, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 2**64)))


@cache
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(2 * SEGMENT)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column's texts in a row, and where each text starts and the last one ends; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if places is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(places, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)), at - at[0]


def _segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _usual_powers() if len(data) <= 2 * SEGMENT else _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start], 12)


def batch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts in a row, and where each text's begin (and the last one's end)."""
    data, texts = text_bytes(column)
    solid = ~WHITE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = texts[(texts > 0) & (texts < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes, low = [np.zeros(0, np.uint64)], 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(end, start[low] + SEGMENT, "right")))
        a, b = start[low], end[high - 1]
        hashes.append(_segment_hashes(data[a:b], start[low:high] - a, end[low:high] - a))
        low = high
    return np.concatenate(hashes), np.searchsorted(start, texts)


def word_hashes(text: str | None) -> np.ndarray:
    return batch_words(pa.array([text], pa.string()))[0]


def rolled(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of each run of `width` words."""
    out = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        out = out * STEP + h[i : len(h) - width + 1 + i]
    return mixed(out, width)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x if new.all() else x[new]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of 5-word shingles; the whole sequence is one if it has fewer words; empty without words."""
    h, at = batch_words(column)
    runs = rolled(h) if len(h) >= WIDTH else h[:0]
    return [_distinct(runs[a : b - WIDTH + 1] if b - a >= WIDTH else rolled(h[a:b], b - a) if b > a else h[:0]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()))[0]
