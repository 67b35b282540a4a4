"""Periodic runs of words, found through string synchronising sets; texts with their repeats collapsed.

A run is a stretch of words with smallest period ``q``, at least ``2 q`` words
long, that no neighbouring word extends. All runs are found, scale by scale:

1. Periods below ``3 * BASE`` are the highly periodic regions of the lowest scale.
   They are detected apart, by comparing the words with themselves ``q`` places on.
2. At scale ``t`` (``BASE``, and twice as much each time) every window of ``t``
   words has a hash. Windows inside a known run of period ``t / 3`` or less are
   highly periodic and are set aside. A position synchronises when the smallest
   hash of the windows that begin in the next ``t`` places, both ends included,
   stands at one of these ends: equal contexts of ``2 t`` words decide alike, and
   only highly periodic stretches go without a position for ``t`` places.
3. Two positions with equal contexts, ``3 t`` to ``6 t`` places apart, propose their
   distance as a period. Equal contexts that are not highly periodic are more than
   ``t / 3`` apart, so that each has few partners within reach.
4. A run without such a pair is made of two highly periodic regions of one period
   ``d`` that touch, the second out of step. Each such pair proposes the distances
   that bring them into step.
5. A proposal is extended to both sides by binary search over prefix hashes. Every
   run is then compared word by word; where a hash was wrong it is extended so.
   Of proposals with equal bounds the smallest period is the run's.

The texts of a slice (about 1 MB) are searched together, parted by words that
occur nowhere else, the long ones first, so that high scales look at these alone.
Memory is some ten numbers a word of a slice, and of a single long text.

Defined cases: a null or empty text has no words and no runs; repeated rows each
have theirs; a null id is an empty id; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import SPACE, _powers, mix, raw, slices

BASE = 4
LEAST = 12  # words of a run that is reported
_LOW = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_ids(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of every word, index of each text's first word, the words by number)."""
    data, off = raw(text)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1 : len(data)]
    at = np.flatnonzero(start)
    size = np.add.reduceat(inside, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = pa.py_buffer(data[inside].tobytes())
    all_words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.tobytes()), flat])
    coded = all_words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(at, off), coded.dictionary


class Line:
    """Words as numbers, with hashes of all their stretches."""

    def __init__(self, ids: np.ndarray):
        self.ids, n = ids, len(ids)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64) + np.uint64(0x5EED)) * up[:n], out=self.sums[1:])

    def hashes(self, at: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[at + size] - self.sums[at]) * self.down[at])

    def windows(self, size: int, n: int) -> np.ndarray:
        """Hashes of all windows of ``size`` words among the first ``n``."""
        return mix((self.sums[size : n + 1] - self.sums[: n + 1 - size]) * self.down[: n + 1 - size])

    def extend(self, at: np.ndarray, p: np.ndarray, reach: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the stretches around ``at`` in which words ``p`` apart agree; none is longer than ``reach``."""
        left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        step = 1 << max(reach, 1).bit_length()
        while step:
            more = right + step
            fits = at + p + more <= n
            i = np.flatnonzero(fits)
            same = self.hashes(at[i], more[i]) == self.hashes(at[i] + p[i], more[i])
            right[i[same]] = more[i[same]]
            more = left + step
            i = np.flatnonzero(at >= more)
            same = self.hashes(at[i] - more[i], more[i]) == self.hashes(at[i] + p[i] - more[i], more[i])
            left[i[same]] = more[i[same]]
            step >>= 1
        return at - left, at + p + right

    def checked(self, b: int, e: int, p: int, at: int) -> tuple[int, int]:
        """The bounds, compared word by word; they are found anew where a hash was wrong."""
        x = self.ids
        if (x[b : e - p] == x[b + p : e]).all():
            return b, e
        differ = np.flatnonzero(x[b : e - p] != x[b + p : e]) + b
        low, high = differ[differ < at], differ[differ >= at]
        return int(low[-1]) + 1 if len(low) else b, int(high[0]) + p if len(high) else e


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minima of all windows of ``size``, a power of two."""
    step = 1
    while step < size:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x


def _out_of_step(line: Line, runs: np.ndarray, low: int, high: int):
    """Proposals (position, period) of touching regions with one period ``d <= low / 9``."""
    rows = runs[(runs[:, 2] * 9 <= low) & (runs[:, 1] - runs[:, 0] >= 6 * runs[:, 2])]
    rows = rows[np.lexsort((rows[:, 0], rows[:, 2]))]
    a, b = rows[:-1], rows[1:]
    touch = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1]) & (b[:, 0] > a[:, 1] - a[:, 2])
    at, period = [], []
    for (x, y, d), (x2, y2, _) in zip(a[touch].tolist(), b[touch].tolist()):
        same = np.flatnonzero(line.hashes(np.arange(x, x + d), d) == line.hashes(np.array([x2]), d))
        for i in same.tolist():
            p = np.arange((x2 - x - i) % d, min(high, (y2 - x) // 2 + 1), d)
            p = p[p >= low]
            at += np.maximum(x, x2 - p).tolist()
            period += p.tolist()
    return np.array(at, np.int64), np.array(period, np.int64)


def find_runs(ids: np.ndarray, longest: int | None = None, still=None) -> np.ndarray:
    """All runs of a line of words: rows of (start, end, period).

    ``still(size)`` is the length of the head of the line that holds all texts of
    at least ``size`` words; ``longest`` is the size of the longest text.
    """
    n = len(ids)
    longest = n if longest is None else longest
    still = still or (lambda size: n)
    line = Line(ids)
    found = [np.zeros((0, 3), np.int64)]
    for q in range(1, min(3 * BASE, longest // 2 + 1)):
        m = still(2 * q)
        same = np.zeros(max(m - q, 0) + 2, np.int8)
        same[1:-1] = ids[: m - q] == ids[q:m] if m > q else 0
        turn = np.diff(same)
        b, e = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        keep = e - b >= q
        found.append(np.stack([b[keep], e[keep] + q, np.full(keep.sum(), q)], 1))
    runs = _primitive(np.concatenate(found))
    t = BASE
    while 6 * t <= longest:
        n = still(6 * t)
        low, high = 3 * t, 6 * t
        at, period = _out_of_step(line, runs, low, high)
        positions = _synchronising(line, runs, t, n)
        context = line.hashes(positions, 2 * t)
        order = np.argsort(context, kind="stable")
        c, s = context[order], positions[order]
        pairs = [(at, period)]
        lag, i = 1, np.arange(len(s))
        while True:
            i = i[i + lag < len(s)]
            near = (c[i] == c[i + lag]) & (s[i + lag] - s[i] < high)
            i = i[near]
            if not len(i):
                break
            p = s[i + lag] - s[i]
            pairs.append((s[i][p >= low], p[p >= low]))
            lag += 1
        at, period = (np.concatenate(x) for x in zip(*pairs))
        b, e = line.extend(at, period, longest, n)
        keep = e - b >= 2 * period
        new, first = np.unique(np.stack([b, e, period], 1)[keep], axis=0, return_index=True)
        for k, a in enumerate(at[keep][first].tolist()):
            new[k, :2] = line.checked(*new[k].tolist(), a)
        new = new[new[:, 1] - new[:, 0] >= 2 * new[:, 2]]
        runs = _primitive(np.concatenate([runs, new]))
        t *= 2
    return runs


def _primitive(runs: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period, by start."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    return runs[first]


def _synchronising(line: Line, runs: np.ndarray, t: int, n: int) -> np.ndarray:
    """The synchronising positions of scale ``t`` among the first ``n`` words."""
    if n < 2 * t:
        return np.zeros(0, np.int64)
    names = line.windows(t, n)
    mark = np.zeros(len(names) + 1, np.int64)
    deep = runs[(runs[:, 2] * 3 <= t) & (runs[:, 1] - runs[:, 0] >= t) & (runs[:, 0] < len(names))]
    np.add.at(mark, deep[:, 0], 1)
    np.add.at(mark, np.minimum(deep[:, 1] - t + 1, len(names)), -1)
    free = np.where(np.cumsum(mark[:-1]) > 0, _LOW, names)
    last = len(names) - t
    least = np.minimum(_sliding_min(free, t)[:last], free[t:])
    hit = (least != _LOW) & ((least == free[:last]) | (least == free[t:]))
    return np.flatnonzero(hit)


FOUND = "doc_id {}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _collapse(batches, reread, least: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in slices(batches, "text"):
        ids, first, names = word_ids(batch.column("text"))
        count = np.diff(first)
        if reread is not None and len(ids):
            ids = ids[reread(batch.column("doc_id"), first)]
        # one line of all texts, the longest first, each followed by a word of its own
        order = np.argsort(-count, kind="stable")
        sizes = count[order]
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        place = np.repeat(begin[:-1] - first[:-1][order], sizes)
        source = np.arange(len(ids)) if len(order) == 1 else np.concatenate([np.arange(first[i], first[i + 1]) for i in order])
        line = np.empty(begin[-1], np.int64)
        line[begin[1:] - 1] = len(names) + np.arange(len(order))
        line[source + place] = ids[source]
        upto = lambda size, sizes=sizes, begin=begin: int(begin[np.searchsorted(-sizes, -size, "right")])
        runs = find_runs(line, int(sizes[0]) if len(sizes) else 0, upto)
        runs = runs[runs[:, 1] - runs[:, 0] >= least]
        gone = np.zeros(len(line) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 1], -1)
        stays = np.cumsum(gone[:-1]) == 0
        owner = np.searchsorted(begin, runs[:, 0], "right") - 1
        runs = np.stack([runs[:, 0] - begin[owner], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
        doc = order[owner]
        by = np.lexsort((runs[:, 2], runs[:, 0], doc))
        doc, runs = doc[by], runs[by]
        stays[begin[1:] - 1] = False
        kept = np.concatenate([[0], np.cumsum(stays)])[begin]
        lists = pa.LargeListArray.from_arrays(pa.array(kept), names.take(pa.array(line[stays])))
        text = pc.binary_join(lists, pa.scalar(b" ", names.type))
        at = np.searchsorted(doc, np.arange(len(order) + 1)).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], ["start", "length", "period"])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(count, pa.int64()), pa.ListArray.from_arrays(at, rows, type=kind), text.take(pa.array(back)).cast(pa.large_string()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def collapse_runs(docs: DataFrame, reread=None, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the runs of at least ``least`` words of every text, by start and period.

    ``collapsed`` is the text without the words of a run after its first period,
    joined by one space. ``reread(doc ids, first words)`` may name, for each place
    of a slice, the word that is read there.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _collapse(b, reread, least), FOUND.format(dict(rows.dtypes)["doc_id"]))


def plant_repeats(doc_ids: pa.Array, first: np.ndarray) -> np.ndarray:
    """For every tenth text by its id's checksum, the words from one place on as repeats of a few."""
    at = np.arange(first[-1])
    for i, doc in enumerate(doc_ids.to_pylist()):
        h = zlib.crc32(b"" if doc is None else str(doc).encode())
        n = int(first[i + 1] - first[i])
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[first[i] + a : first[i + 1]] = first[i] + a + np.arange(n - a) % p
    return at


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and checksums of all runs and of the collapsed text, a row a document."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best: Column = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    rows = found.select("*", best.alias("_best"))
    length, start, period = F.col("_best.length"), -F.col("_best.col2"), -F.col("_best.col3")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * _best.length div -_best.col3").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
