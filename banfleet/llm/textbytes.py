"""Many texts as one array of UTF-8 bytes, and their words as arrays."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from banfleet.llm.workers import worker_cache

#: Bytes that are looked at together: small enough for the processor's caches.
CHUNK = 1 << 20


class Texts(NamedTuple):
    first: int  # row of the batch
    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # where each text starts, and the end


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Texts]:
    """Consecutive texts of an Arrow column of strings or binaries, some ``limit`` bytes at a time.

    A null text has no bytes. A text over the limit comes alone and whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(ends, ends[row] + limit, "right")) - 1
        last = min(n, max(last, row + 1))
        yield Texts(row, flat[ends[row] : ends[last]], ends[row : last + 1] - ends[row])
        row = last


def per_text(values: np.ndarray, starts: np.ndarray, combine=np.add) -> np.ndarray:
    """``combine`` over each text's stretch of values; 0 for a text without any."""
    out = np.zeros(len(starts) - 1, values.dtype if combine is not np.add else np.int64)
    full = starts[:-1] < starts[1:]
    if full.any():
        out[full] = combine.reduceat(values, starts[:-1][full], dtype=out.dtype)
    return out


class Words(NamedTuple):
    begin: np.ndarray  # first byte
    end: np.ndarray  # one past the last
    starts: np.ndarray  # each text's first word, and the number of words
    hashes: np.ndarray  # 64 bits


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mixers() -> tuple[np.ndarray, int, int]:
    """64 random bits per byte value, an odd base and its inverse modulo 2^64."""
    draw = np.random.default_rng(20240229)
    base = int(draw.integers(1, 1 << 62)) * 2 + 1
    return draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), base, pow(base, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    _, base, inverse = worker_cache("mixers", _mixers)
    out = []
    for x in (base, inverse):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of bytes; equal stretches have equal hashes wherever they are.

    Stretches are given by ascending begin and end; long data is worked on a part at a time, and so is
    a long stretch, whose hash is that of its parts' hashes.
    """
    if len(data) <= CHUNK:
        return _span_hashes(data, begin, end)
    out, long = np.empty(len(begin), np.uint64), end - begin > CHUNK
    for i in np.flatnonzero(long).tolist():
        cuts = np.append(np.arange(begin[i], end[i], CHUNK), end[i])
        parts = span_hashes(data, cuts[:-1], cuts[1:]).view(np.uint8)
        out[i] = span_hashes(parts, np.array([0]), np.array([len(parts)]))[0]
    short, i = np.flatnonzero(~long), 0
    begin, end = begin[short], end[short]
    while i < len(short):
        j = int(np.searchsorted(end, begin[i] + CHUNK, "right"))
        out[short[i:j]] = _span_hashes(data[begin[i] : end[j - 1]], begin[i:j] - begin[i], end[i:j] - begin[i])
        i = j
    return out


def _span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    mix, _, _ = worker_cache("mixers", _mixers)
    size = 1 << max(20, int(len(data)).bit_length())
    power, inverse = worker_cache(("powers", size), lambda: _powers(size))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix[data] * power[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def words(data: np.ndarray, starts: np.ndarray) -> Words:
    """Words between ASCII white space; hashes of their bytes."""
    inside = ~SPACE[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        before[starts[:-1][starts[:-1] < len(data)]] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
        cuts = starts[1:-1]
        after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(begin, end, np.searchsorted(begin, starts), span_hashes(data, begin, end))
