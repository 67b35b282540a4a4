"""Best-fit packing of token sequences, online and with bounded space.

Pieces arrive one at a time and go into the open sequence with the least free
space that still holds them. Open sequences are kept by free space, and a bitset
(one integer) marks which amounts of free space occur, so the best fit is the
lowest set bit at or above the piece's length. At most ``open_bins`` sequences
are open: when one more is needed, the fullest closes.

Plan: every input task tokenizes its texts and packs its own pieces. What is
still open at its end is given back and packed once more in groups of about
``GROUP_PIECES`` pieces, on lengths only, so the loss does not grow with the
number of tasks. Nothing but lengths and checksums leaves the first pass.

Defined cases: a null text counts as empty (one piece that holds the end token);
texts longer than a sequence are cut, whole sequences first; repeated rows are
packed each, a null id is an id like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import token_table
from .words import slices

CAPACITY = 4096
OPEN_BINS = 64
GROUP_PIECES = 100_000


class BestFit:
    """Open sequences of one stream of pieces."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free: dict[int, list[int]] = defaultdict(list)  # free space -> open sequences
        self.mask = 0  # bit f is set when some open sequence has f free places
        self.used: dict[int, int] = {}  # open sequence -> places taken
        self.made = 0
        self.closed: list[int] = []

    def _take(self, space: int) -> int:
        bins = self.free[space]
        b = bins.pop()
        if not bins:
            self.mask ^= 1 << space
            del self.free[space]
        return b

    def put(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of the next piece."""
        fits = self.mask >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            b = self._take(space)
        else:
            if len(self.used) >= self.open_bins:
                fullest = self._take((self.mask & -self.mask).bit_length() - 1)
                del self.used[fullest]
                self.closed.append(fullest)
            b, space = self.made, self.capacity
            self.made += 1
            self.used[b] = 0
        at = self.used[b]
        left = space - length
        if left:
            self.used[b] = at + length
            self.mask |= 1 << left
            self.free[left].append(b)
        else:  # full
            del self.used[b]
            self.closed.append(b)
        return b, at


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, placed boolean"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, open_bins: int):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    table, fit = token_table(path, end_id), BestFit(capacity, open_bins)
    waiting: list[tuple] = []  # pieces whose sequence is still open

    def rows(ready: list[tuple], placed: bool) -> pa.RecordBatch:
        cols = list(zip(*ready)) or [[]] * 7
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
        arrays.append(pa.array([placed] * len(ready), pa.bool_()))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "placed"])

    for batch in slices(batches, "text"):
        coded, bounds = table.ids(batch.column("text"))
        for doc_id, lo, hi in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            for piece, at_id in enumerate(range(lo, hi, capacity)):
                own = coded[at_id : min(at_id + capacity, hi)]
                length, start = len(own), at_id - lo
                b, at = fit.put(length)
                waiting.append((doc_id, piece, start, length, zlib.crc32(own.astype("<u4").tobytes()), (part << 33) + b, at))
        still = {(part << 33) + b for b in fit.used}
        ready = [w for w in waiting if w[5] not in still]
        waiting = [w for w in waiting if w[5] in still]
        yield rows(ready, True)
    yield rows(waiting, False)


def _again(frame: pd.DataFrame, capacity: int, open_bins: int) -> pd.DataFrame:
    frame = frame.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable")
    fit = BestFit(capacity, open_bins)
    places = [fit.put(int(n)) for n in frame["length"]]
    group = int(frame["_group"].iloc[0])
    frame["sequence_id"] = [-1 - ((group << 33) + b) for b, _ in places]
    frame["offset"] = [at for _, at in places]
    return frame.drop(columns=["_group"])


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int = 1,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``docs`` needs ``doc_id`` and ``text``. Sequences of the second pass have
    negative numbers.
    """
    def first(batches):
        return _pieces(batches, tokenizer_path, end_id, capacity, open_bins)

    def second(frame):
        return _again(frame, capacity, open_bins)

    done = cut_lineage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(first, PIECES))
    left = done.where("not placed").drop("placed")
    groups = left.count() // group_pieces + 1
    deal = F.pmod(F.xxhash64("doc_id", "piece", "start", "sequence_id"), F.lit(groups))
    schema = PIECES.replace(", placed boolean", "")
    packed = left.withColumn("_group", deal).groupBy("_group").applyInPandas(second, schema)
    return done.where("placed").drop("placed").unionByName(packed)
