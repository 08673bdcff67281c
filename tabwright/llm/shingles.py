"""Hashes of words and of five-word shingles, computed over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
_VALUE = (_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[_LOWER]
_BASE = int(_RNG.integers(1, 1 << 62)) * 8 + 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, at least n of them."""
    if len(_powers.get(base, ())) < n:
        table = np.full(max(n, PIECE), base & (1 << 64) - 1, np.uint64)
        table[0] = 1
        _powers[base] = np.cumprod(table, dtype=np.uint64)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(texts: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of consecutive texts: first index, offsets from 0, bytes; a run has several texts only within ``most_bytes``."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1)
        yield first, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


def word_bounds(offsets: np.ndarray, data: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end; ``outside`` says which bytes are in no word."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~outside[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A to Z in lower case; memory is bounded but for single words over 1 MB."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
        low, high = int(starts[first]), int(ends[last - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUE[data[low:high]] * powers(_BASE, high - low)[: high - low], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (sums[e] - sums[s]) * powers(_INVERSE, high - low)[s]
        first = last
    return mix(out)


def shingle_sets(texts: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted 64-bit hashes of its distinct shingles of ``words`` words.

    Words are runs of bytes that aren't white space, with A to Z in lower case. Of a text with fewer words, the whole
    sequence is the one shingle; a text without words has none.
    """
    for _, offsets, data in text_slices(texts):
        starts, ends = word_bounds(offsets, data)
        hashed = word_hashes(data, starts, ends)
        bounds = np.searchsorted(starts, offsets)
        rows = max(0, len(hashed) - words + 1)
        joined = np.zeros(rows, np.uint64)
        for t in range(words):
            joined += hashed[t : t + rows] * _PLACE[t]
        joined = mix(joined)
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if high - low >= words:
                ordered = np.sort(joined[low : high - words + 1])
                keep = np.ones(len(ordered), bool)
                np.not_equal(ordered[1:], ordered[:-1], out=keep[1:])
                yield ordered[keep]
            elif high > low:
                few = hashed[low:high] * _PLACE[: high - low]
                yield mix(few.sum(keepdims=True, dtype=np.uint64) + _PLACE[32 + high - low : 33 + high - low])
            else:
                yield np.empty(0, np.uint64)
