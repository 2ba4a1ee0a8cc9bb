"""Word shingles of whole texts as 64-bit hashes, computed on Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_U = np.uint64
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = _U(0x9E3779B97F4A7C15)
_P_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64's finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_BYTE_LOWER = _BYTE[_LOWER]
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        for key, base in (("p", _P), ("q", _P_INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["q"]


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of rows of about CHUNK_BYTES; null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        j = min(j, len(texts))
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a chunk, and the words' counts by row."""
    n = len(raw)
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    solid = ~_WS[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    p, q = _power_table(max(n, CHUNK_BYTES) + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_LOWER[raw] * p[:n], out=total[1:])
    words = mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, offsets)
    return words, np.diff(bounds)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of `width` words.

    A row with fewer words has one shingle, its whole sequence; a row without words has none.
    """
    for _, raw, offsets in text_chunks(texts):
        words, counts = word_hashes(raw, offsets)
        at = 0
        if len(words) >= width:
            joined = np.zeros(len(words) - width + 1, dtype=np.uint64)
            for k in range(width):
                joined = mix(joined * _U(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k] + _U(k + 1))
        for c in counts:
            c = int(c)
            if c >= width:
                yield np.unique(joined[at : at + c - width + 1])
            elif c:
                h = np.full(1, 0x5851F42D4C957F2D + c, dtype=np.uint64)
                for w in words[at : at + c]:
                    h = mix(h * _U(0x9E3779B97F4A7C15) + w)
                yield h
            else:
                yield np.zeros(0, np.uint64)
            at += c
