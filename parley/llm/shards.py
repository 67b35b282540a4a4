"""Shards by a permutation of row numbers.

Rows are numbered in the order of their key. A Feistel network permutes the
numbers of ``b`` bits, the least that hold the row count; values at or above the
count are permuted again (cycle walking), so the numbers of the rows themselves
are permuted. The permuted number gives shard (remainder) and slot (quotient):
shard sizes differ by one row at most, any row's place can be computed from its
number, and any place's row from the inverse.

Defined cases: a null text has size 1; null keys come last; repeated rows get a
number each; an empty table gives an empty result; columns named like the
results are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number_rows, text_of
from .words import mix

ROUNDS = 6


class Permutation:
    """A permutation of ``0 .. n - 1`` that depends on the seed alone."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n, self.rounds = n, rounds
        self.bits = max(2, (n - 1).bit_length()) if n else 2
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(seed % (1 << 32)) * np.uint64(1 << 16))

    def _round(self, half: np.ndarray, i: int, width: int) -> np.ndarray:
        return mix(half + self.keys[i]) & np.uint64((1 << width) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        """Unequal halves trade places each round; their widths trade with them."""
        left, right = self.bits // 2, self.bits - self.bits // 2
        if not back:
            for i in range(self.rounds):
                a, b = x >> np.uint64(right), x & np.uint64((1 << right) - 1)
                x = (b << np.uint64(left)) | (a ^ self._round(b, i, left))
                left, right = right, left
            return x
        if self.rounds % 2:
            left, right = right, left
        for i in reversed(range(self.rounds)):
            left, right = right, left
            b, c = x >> np.uint64(left), x & np.uint64((1 << left) - 1)
            x = ((c ^ self._round(b, i, left)) << np.uint64(right)) | b
        return x

    def _walk(self, x, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x).astype(np.uint64), back)
        out = np.flatnonzero(x >= np.uint64(self.n))
        while len(out):
            x[out] = self._once(x[out], back)
            out = out[x[out] >= np.uint64(self.n)]
        return x.astype(np.int64)

    def place(self, x) -> np.ndarray:
        return self._walk(x, False)

    def row(self, x) -> np.ndarray:
        return self._walk(x, True)


def locate(row_number, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers, with nothing but the row count."""
    at = Permutation(n, seed).place(row_number)
    return at % shards, at // shards


def row_at(shard, slot, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """Row number at a place; the inverse of ``locate``."""
    return Permutation(n, seed).row(np.asarray(slot) * shards + np.asarray(shard))


def shard_rows(df: DataFrame, order: list, shards: int = 16, seed: int = 0) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows numbered by ascending keys, nulls last."""
    keys = [f"_o{i}" for i in range(len(order))]
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")])
    rows = df.select(kept.alias("kept"), *[o.alias(k) for o, k in zip(order, keys)])
    rows = number_rows(rows, *[F.col(k).asc_nulls_last() for k in keys], name="_number")
    n = rows.count()
    permutation = Permutation(n, seed)

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permutation.place(number.to_numpy()))

    rows = rows.withColumn("_place", place("_number"))
    shard = (F.col("_place") % shards).cast("int")
    return rows.select("kept.*", shard.alias("shard"), F.expr(f"_place div {shards}").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of all documents."""
    rows = docs.select(
        "doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32")
    )
    placed = shard_rows(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
