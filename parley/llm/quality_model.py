"""Quality classifier: hashed word n-grams, logistic regression, follow the regularised leader.

A text's features are its word unigrams and bigrams, and the unigrams and
bigrams of its words' shapes (runs of upper case, lower case, digits and each
sign; a word that repeats the one before it has a shape of its own), hashed to
``DIMENSIONS`` cells. A cell's value is the square root of its share of the
text's n-grams of that family. Scores are logistic functions of sparse dot
products, so a text is scored where it is read.

Training takes the labelled documents, about ``MAX_TRAIN`` of them chosen by a
hash of their id when there are more, in one stream of updates in hash order: an
online learner that sees each once. That bound is a parameter; features are
computed where the texts are, and only they reach the learner.

Defined cases: a null text is empty and scores by the bias alone; a null label
or id is not learned from; repeated labels and documents are separate samples;
without samples every score is 0.5; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder
from .words import LOWER, Words, mix, shingles, slices, span_hashes, words

BITS = 18
DIMENSIONS = 1 << BITS
MAX_TRAIN = 20_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-6
THRESHOLD = 0.7
_UPPER, _LOWER, _DIGIT, _HIGH = 1, 2, 3, 4
_CODE = np.arange(256, dtype=np.uint8)
_CODE[65:91], _CODE[97:123], _CODE[48:58], _CODE[128:] = _UPPER, _LOWER, _DIGIT, _HIGH


def shapes(w: Words) -> np.ndarray:
    """Hash of each word's shape."""
    code = _CODE[w.data]
    lead = np.flatnonzero(w.data[:-1] == 0xC3) if len(code) else np.zeros(0, np.int64)
    code[lead] = code[lead + 1] = np.where(w.data[lead + 1] < 0x9F, _UPPER, _LOWER)  # accented letters
    keep = np.ones(len(code), bool)
    keep[1:] = code[1:] != code[:-1]
    keep[w.start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return span_hashes(code[keep], at[w.start], at[w.end])


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document, cell, value) of all nonzero cells, and the number of documents."""
    w = words(text, fold=False)
    folded = span_hashes(LOWER[w.data], w.start, w.end)
    shape = shapes(w)
    again = np.zeros(len(folded), bool)
    again[1:] = folded[1:] == folded[:-1]
    again[w.first[:-1][w.first[:-1] < len(folded)]] = False
    shape = np.where(again, mix(shape), shape)
    n = len(w.first) - 1
    docs, cells, values = [], [], []
    for family, (h, k) in enumerate(((folded, 1), (folded, 2), (shape, 1), (shape, 2))):
        grams, begin = shingles(h, w.first, k)
        size = np.diff(begin)
        doc = np.repeat(np.arange(n), size)
        cell = mix(grams + np.uint64(family)) >> np.uint64(64 - BITS)
        key, times = np.unique((doc.astype(np.uint64) << np.uint64(BITS)) | cell, return_counts=True)
        doc = (key >> np.uint64(BITS)).astype(np.int64)
        docs.append(doc)
        cells.append((key & np.uint64(DIMENSIONS - 1)).astype(np.int64))
        values.append(np.sqrt(times / size[doc]))
    return np.concatenate(docs), np.concatenate(cells), np.concatenate(values), n


SAMPLES = "y int, rank long, cells binary, x binary"


def _samples(batches: Iterator[pa.RecordBatch]):
    for b in slices(batches, "text"):
        doc, cell, value, n = features(b.column("text"))
        order = np.argsort(doc, kind="stable")
        cell, value = cell[order].astype(np.int32), value[order].astype(np.float32)
        at = np.searchsorted(doc[order], np.arange(n + 1))
        own = [(cell[i:j].tobytes(), value[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
        cols = [b.column("y"), b.column("rank"), *(pa.array(c, pa.binary()) for c in zip(*own))]
        yield pa.RecordBatch.from_arrays(cols, ["y", "rank", "cells", "x"])


class Leader:
    """Per-coordinate updates of the regularised leader for logistic loss; the last cell is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, i) -> np.ndarray:
        z = self.z[i]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, cells: np.ndarray, x: np.ndarray, y: int) -> None:
        i, x = np.append(cells, DIMENSIONS), np.append(x, 1.0)
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        step = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        # families may meet in a cell
        np.add.at(self.z, i, g - step * w)
        np.add.at(self.n, i, g * g)


def _learn(batches: Iterator[pa.RecordBatch]):
    leader = Leader()
    for b in batches:
        for y, cells, x in zip(*(b.column(c).to_pylist() for c in ("y", "cells", "x"))):
            leader.learn(np.frombuffer(cells, np.int32), np.frombuffer(x, np.float32), y)
    w = leader.weights(np.arange(DIMENSIONS + 1)).astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights from ``labels`` (``doc_id, y``) of the documents; of fixed size."""
    labels = labels.where("doc_id is not null and y is not null").select("doc_id", F.col("y").cast("int").alias("y"))
    rank = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 1)
    labels = labels.withColumn("rank", rank)
    share = min(1.0, max_train / max(1, labels.count()))
    chosen = labels.where(F.col("rank") <= min(int(share * 2**63), 2**63 - 1))
    # about max_train rows of three numbers
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("text", "y", "rank").mapInArrow(_samples, SAMPLES)
    out = rows.repartition(1).sortWithinPartitions("rank", "y", "cells").mapInArrow(_learn, "w binary").collect()
    return np.frombuffer(out[0]["w"], np.float32) if out else np.zeros(DIMENSIONS + 1, np.float32)


def score_column(docs: DataFrame, weights: np.ndarray) -> Column:
    """Score of the column ``text``."""
    w = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out = []
        batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(text, type=pa.string())], ["text"])
        for b in slices([batch], "text"):
            doc, cell, value, n = features(b.column("text"))
            dot = np.bincount(doc, w.value[cell] * value, n) + w.value[DIMENSIONS]
            out.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(F.coalesce(F.col("text").cast("string"), F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, mod: int = 4, out: int = 2, max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, held_out, score, predicted``; rows held out by a checksum of their ids are not learned from."""
    learn = labels.where(remainder("doc_id", mod) != out).select("doc_id", F.col("quality").alias("y"))
    weights = train(docs, learn, max_train)
    scored = docs.select("doc_id", (remainder("doc_id", mod) == out).alias("held_out"), score_column(docs, weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents predicted good, all columns."""
    learn = labels.where(remainder("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("y"))
    weights = train(docs, learn, max_train)
    return docs.where(score_column(docs, weights) >= THRESHOLD)
