"""Words and their 64-bit hashes, read straight from Arrow's UTF-8 buffers with array operations.

All texts of a slice stay one byte array: no Python object is made per word. A word's hash is a
polynomial over its bytes, taken as a difference of running sums, so the cost is a few array
operations per byte whatever the lengths. Working memory is bounded by ``SLICE`` bytes of text
times a small factor (or one text, if it is longer than that).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def spread(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BYTE = spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for slices of usual size only."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE + 1), base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if n <= 4 * SLICE:
            _powers[base] = known
    return known[:n]


#: Byte tables: A-Z folded to a-z, white space \x20 \x09-\x0D, and ASCII letters, digits and all other bytes from 0x80.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each, at least one text each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) for ranges of texts."""
    raw, off = utf8(texts)
    for i, j in slices(off, limit):
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]


def spans(keep: np.ndarray, off: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of kept bytes, and the number of runs in each text.

    Runs end at the border of a text and, if given, where ``cut[i]`` parts byte i from the byte before.
    """
    n = len(keep)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    part = np.zeros(n + 1, bool) if cut is None else np.append(cut, False)
    part[off] = True
    begin = keep.copy()
    begin[1:] &= ~keep[:-1] | part[1:n]
    close = keep.copy()
    close[:-1] &= ~keep[1:] | part[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    value = _BYTE[raw]
    value *= _power(_BASE, len(raw))
    np.cumsum(value, out=total[1:])
    h = (total[ends] - total[starts]) * _power(_INVERSE, len(raw))[starts]
    return spread(h + (ends - starts).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))


def words(raw: np.ndarray, off: np.ndarray, inside: np.ndarray = NOT_SPACE, fold: np.ndarray = FOLD):
    """(starts, ends, words per text, hashes) of the maximal runs of ``inside`` bytes."""
    starts, ends, counts = spans(inside[raw], off)
    return starts, ends, counts, span_hashes(fold[raw], starts, ends)


_STEP = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(64)]


def shingles(h: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of ``width`` consecutive words from each word on, and the number of shingles per text.

    A text of fewer words, but not none, is one shingle of all its words.
    """
    n = len(h)
    per_text = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    if not n:
        return np.zeros(0, np.uint64), per_text
    first = np.cumsum(counts) - counts
    total = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        total[: n - k] += h[k:] * _STEP[k + 1]
    total += np.uint64(width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    for d in short:
        a, c = first[d], int(counts[d])
        value = 0
        for k in range(c):
            value = (value + int(h[a + k]) * int(_STEP[k + 1])) & _M
        total[a] = (value + c) & _M
    at = np.repeat(first - (np.cumsum(per_text) - per_text), per_text) + np.arange(per_text.sum())
    return spread(total[at]), per_text


def per_text(values: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """The slice of ``values`` of each text in turn."""
    ends = np.cumsum(counts)
    for a, b in zip(ends - counts, ends, strict=True):
        yield values[a:b]
