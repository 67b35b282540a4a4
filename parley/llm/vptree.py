"""Nearest neighbours by vantage-point trees, one a shard.

A node holds a vantage point; the other points of its subtree are split at the
median of their distances to it, and each half keeps its range of distances. By
the triangle inequality a half cannot hold anything nearer than the distance
from the query to that range. A half is left out when that bound times
``factor`` exceeds the query's ``k``-th distance so far: factor 1 is exact
search, a larger one prunes more.

Rows are dealt to shards of about ``SHARD_ROWS`` by a hash of their id, queries
go to every shard in blocks of about ``QUERY_ROWS``; a task holds one shard and
one block. Each block's best ``k`` of every shard are reduced to the best ``k``.

Defined cases: null or zero vectors, and those with null or non-finite
components, take no part; vectors of other lengths are other spaces; equal
vectors and repeated ids are separate rows, ties go to the smaller id; only the
query's own row is left out; rows without an id take no part; long vectors only
cost their components; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 64
SHARD_ROWS = 20_000
QUERY_ROWS = 5_000
TOGETHER = 256  # queries that walk a tree together


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``q`` to all of ``x``, summed in the order of the components."""
    out = np.zeros((len(q), len(x)))
    for a, b in zip(q.T, x.T):
        d = a[:, None] - b[None, :]
        out += d * d
    return np.sqrt(out)


class Tree:
    """A vantage-point tree over rows of ``x``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.x, self.leaf = x, leaf
        rng = np.random.Generator(np.random.PCG64(seed))
        self.nodes: list[tuple] = []  # (rows,) or (vantage row, [(node, least, most), ...])
        todo = [(np.arange(len(x)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][1][side][0] = at
            if len(rows) <= leaf:
                self.nodes.append((rows,))
                continue
            pick = int(rng.integers(len(rows)))
            vantage, rest = rows[pick], np.delete(rows, pick)
            d = distances(x[rest], x[[vantage]])[:, 0]
            order = np.argsort(d, kind="stable")
            half = len(rest) // 2
            parts = (order[:half], order[half:])
            self.nodes.append((vantage, [[-1, d[p].min(), d[p].max()] for p in parts]))
            todo += [(rest[p], at, i) for i, p in enumerate(parts)]

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float = 1.0):
        """(distances, rows) of each query's ``k`` nearest, by (distance, id); ``own`` is the query's row or -1."""
        best = np.full((len(q), k), np.inf)
        rows = np.full((len(q), k), -1)
        for s in range(0, len(q), TOGETHER):
            self._walk(q[s : s + TOGETHER], own[s : s + TOGETHER], ids, best[s : s + TOGETHER], rows[s : s + TOGETHER], factor)
        return best, rows

    def _offer(self, who, d, cand, own, ids, best, rows):
        """Put candidates (a row each of ``d``) into the lists of ``who``."""
        d = np.where(cand[None, :] == own[who][:, None], np.inf, d)
        go = (d <= best[who][:, -1:]).any(1) & np.isfinite(d).any(1)
        who, d = who[go], d[go]
        if not len(who):
            return
        alld = np.concatenate([best[who], d], 1)
        allr = np.concatenate([rows[who], np.broadcast_to(cand, d.shape)], 1)
        allr = np.where(np.isfinite(alld), allr, -1)
        key = np.where(allr < 0, np.iinfo(np.int64).max, ids[allr])
        order = np.lexsort((allr, key, alld), axis=-1)[:, : best.shape[1]]
        best[who] = np.take_along_axis(alld, order, 1)
        rows[who] = np.take_along_axis(allr, order, 1)

    def _walk(self, q, own, ids, best, rows, factor):
        stack = [(0, np.arange(len(q)), np.zeros(len(q)))] if self.nodes else []
        while stack:
            at, who, bound = stack.pop()
            go = bound * factor <= best[who][:, -1]
            who = who[go]
            if not len(who):
                continue
            node = self.nodes[at]
            cand = node[0] if len(node) == 1 else np.array([node[0]])
            if not len(cand):
                continue
            d = distances(q[who], self.x[cand])
            self._offer(who, d, cand, own, ids, best, rows)
            if len(node) == 2:
                d = d[:, 0]
                near = [np.maximum(np.maximum(least - d, d - most), 0) for _, least, most in node[1]]
                first = int(near[1].sum() < near[0].sum())
                for side in (1 - first, first):  # the nearer half is walked first
                    stack.append((node[1][side][0], who, near[side]))


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    x = F.transform(v, lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(x, lambda e: e != 0), F.lit(False))


FOUND = "_q long, query_id long, vec_id long, _r long, score double"


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["v"].to_numpy()).astype(np.float64)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, leaf: int = LEAF,
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows of ``vec_id, embedding`` to each query row."""
    rows = vectors.select(
        F.monotonically_increasing_id().alias("_r"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").alias("v"), is_query.alias("_is"),
    ).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_is").alias("q")).first()
    shards, blocks = max(1, -(-n["n"] // shard_rows)), max(1, -(-n["q"] // query_rows))
    dealt = F.pmod(F.xxhash64("vec_id", "_r"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", "_r", F.lit(1)), F.lit(blocks)).cast("int")
    dim = F.size("v").alias("_dim")
    points = rows.select("_r", "vec_id", "v", dim, dealt.alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    queries = rows.where("_is").select("_r", "vec_id", "v", dim, block.alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"))

    def search(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        names = ["_q", "query_id", "vec_id", "_r", "score"]
        if not len(p) or not len(q):
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in names})
        p = p.sort_values(["vec_id", "_r"])
        ids, own = p["vec_id"].to_numpy(), p["_r"].to_numpy()
        at = pd.Series(np.arange(len(p)), index=own)
        self_row = at.reindex(q["_r"].to_numpy(), fill_value=-1).to_numpy()
        d, r = Tree(_matrix(p), leaf).search(_matrix(q), self_row, ids, k, factor)
        i, j = np.nonzero(r >= 0)
        hit = r[i, j]
        cols = (q["_r"].to_numpy()[i], q["vec_id"].to_numpy()[i], ids[hit], own[hit], d[i, j])
        return pd.DataFrame(dict(zip(names, cols)))

    keys = ["_dim", "_shard", "_block"]
    found = points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("_q").orderBy("score", "vec_id", "_r"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
