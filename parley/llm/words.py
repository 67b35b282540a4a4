"""Words of texts as arrays: positions, 64-bit hashes and shingles, a few MB at a time.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; letters A-Z are
folded to lower case. Hashes are polynomials over table values modulo 2**64,
taken from running sums, then mixed; no Python loop goes over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 20
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, one after another
    offsets: np.ndarray  # where each text begins, and the end
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text, "")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    bufs = text.buffers()
    if not len(text) or bufs[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    off = np.frombuffer(bufs[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    return np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]], off - off[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, _CHUNK + 1024), base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; spans are in order and do not overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + _CHUNK, "right")))
        part = data[lo : end[j - 1]]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * up[: len(part)], out=sums[1:])
        s = start[i:j] - lo
        out[i:j] = (sums[end[i:j] - lo] - sums[s]) * down[s]
        i = j
    return mix(out + (end - start).astype(np.uint64))


def words(text: pa.Array, fold: bool = True) -> Words:
    data, off = raw(text)
    if fold:
        data = LOWER[data]
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, off, start, end, span_hashes(data, start, end), np.searchsorted(start, off))


_STEP = [int(x) | 1 for x in mix(np.arange(101, 133, dtype=np.uint64))]


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each text, and where each text's begin.

    A text with fewer words gives one shingle of all its words, none when empty.
    """
    count = np.diff(first)
    total = len(hashes)
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(runs)])
    out = np.empty(begin[-1], np.uint64)
    if total >= k:
        sums = np.zeros(total - k + 1, np.uint64)
        for j in range(k):
            sums += hashes[j : total - k + 1 + j] * np.uint64(_STEP[j % 32])
        left = np.repeat(first[1:], count) - np.arange(total)
        keep = left[: total - k + 1] >= k
        out[np.repeat(count >= k, runs)] = sums[keep]
    for d in np.flatnonzero((count > 0) & (count < k)):
        h = hashes[first[d] : first[d + 1]]
        steps = np.array([_STEP[j % 32] for j in range(len(h))], np.uint64)
        out[begin[d]] = (h * steps).sum(dtype=np.uint64) + np.uint64(len(h))
    return mix(out), begin


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of about ``limit`` bytes of text at most."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < batch.num_rows:
            done = size[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(i, j - i)
            i = j
