"""Near copies among vectors by an inverted multi-index; class ids and numbers of links.

1. Equal vectors are one class with a count, so that copies are compared once.
2. Unit vectors are cut into halves. Each half has a codebook of its own, fitted by
   k-means on about ``FIT`` classes chosen by a hash; every class is indexed. A cell
   is a pair of nearest codewords, one of each half: the grid is their product.
3. A vector further from a codeword than from its own by some margin (the distance
   to the plane between both) is at least so far from all vectors of that codeword.
   Cells are visited in order of the sum of both halves' squared margins, as a
   multi-sequence traversal of the two sorted lists, up to a bound.
4. The bound is set by the target recall: fitted vectors get partners exactly at the
   threshold in random directions, the hardest links there are, and the bound is
   the quantile of the sums at which their cells are reached.
5. Codewords of the second half are put in order and cut into ranges; a range of
   cells of one first codeword is a group of about ``ROWS`` vectors. A vector goes to
   its own group, and to every group where it visits a cell of a higher number.
   Groups above ``ROWS`` vectors or visitors are cut into blocks that meet in tasks
   of their own. Inside a task, cells are compared by matrix products in tiles.
6. Each task returns sums of links by class and, in place of pairs, the links of a
   spanning forest; star contraction makes classes of linked classes.

Cosines within ``CLOSE`` of the threshold are computed again from the vectors as given.

Defined cases: vectors that are null, empty or zero or hold null or non-finite
components link with nothing; vectors of other lengths are other spaces; a null id
links like any other and is a component only of null ids; rows that repeat a
vector are links of each other, whatever their ids; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components
from .vptree import usable

FIT = 20_000  # classes that the codebooks and the bound are fitted on
CELL = 512  # classes a cell is meant to hold
MOST_CODES = 512  # codewords of a half at most: the table of groups stays below 2 ** 18 rows
ROWS = 20_000  # vectors of a group, and visitors that meet them in one task
TILE = 1024
CLOSE = 1e-9
ROUNDS = 12


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def stacked(vectors, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _squares(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1), 0)


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` codewords by k-means, in order of their main direction."""
    rng = np.random.Generator(np.random.PCG64(seed))
    codes = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = _squares(x, codes).argmin(1)
        n = np.bincount(own, minlength=k)
        for j in range(x.shape[1]):
            codes[:, j] = np.where(n > 0, np.bincount(own, x[:, j], k) / np.maximum(n, 1), codes[:, j])
    codes = np.unique(codes, axis=0)  # codewords that fell together are one
    main = np.linalg.svd(codes - codes.mean(0), full_matrices=False)[2][0] if len(codes) > 1 else np.zeros(x.shape[1])
    return codes[np.argsort(codes @ main, kind="stable")]


class Grid(NamedTuple):
    first: np.ndarray  # codewords of both halves
    second: np.ndarray
    width: int  # second codewords of a group
    bound: float  # largest sum of squared margins of a visited cell

    @classmethod
    def fit(cls, x: np.ndarray, classes: int, threshold: float, recall: float) -> Grid:
        k = int(min(MOST_CODES, max(1, np.ceil(np.sqrt(classes / CELL))), len(x)))
        half = (x.shape[1] + 1) // 2
        grid = cls(codebook(x[:, :half], k, 1), codebook(x[:, half:], k, 2) if x.shape[1] > half else np.zeros((1, 0)), 1, 0.0)
        cells = len(grid.first) * len(grid.second)
        grid = grid._replace(width=int(np.clip(ROWS * cells // max(classes, 1), 1, len(grid.second))))
        rng = np.random.Generator(np.random.PCG64(3))
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        away /= np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-12)
        partner = threshold * x + np.sqrt(max(1 - threshold * threshold, 0)) * away
        (a, ma), (b, mb) = grid.margins(x)
        (pa, _), (pb, _) = grid.margins(partner)
        rows = np.arange(len(x))
        return grid._replace(bound=float(np.quantile(ma[rows, pa] ** 2 + mb[rows, pb] ** 2, recall)))

    def margins(self, x: np.ndarray):
        """For both halves: each row's codeword, and its margins to all codewords."""
        half, out = self.first.shape[1], []
        for part, codes in ((x[:, :half], self.first), (x[:, half:], self.second)):
            d = _squares(part, codes)
            own = d.argmin(1)
            gap = np.sqrt(_squares(codes, codes))
            np.fill_diagonal(gap, 1)
            out.append((own, np.maximum(d - d[np.arange(len(d)), own][:, None], 0) / (2 * np.maximum(gap[own], 1e-12))))
        return out

    def visit(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own cell of every row, rows, cells they visit), nearest cells first.

        Both lists of codewords are sorted by margin. The front of a row is, for each
        place of the first list, the next place of the second; the least sum of the
        front is the next cell. A place joins the front once the one before it has.
        """
        (a, ma), (b, mb) = self.margins(x)
        oa, ob = np.argsort(ma, 1, kind="stable"), np.argsort(mb, 1, kind="stable")
        sa, sb = np.take_along_axis(ma, oa, 1) ** 2, np.take_along_axis(mb, ob, 1) ** 2
        n, k1, k2 = len(x), sa.shape[1], sb.shape[1]
        sb = np.concatenate([sb, np.full((n, 1), np.inf)], 1)
        at = np.zeros((n, k1), np.int64)
        live, rows, cells = np.arange(n), [], []
        step = 0
        while len(live):
            step += 1
            w = min(k1, step)
            nxt = at[live, :w]
            front = sa[live, :w] + np.take_along_axis(sb[live], nxt, 1)
            pick = front.argmin(1)
            near = front[np.arange(len(live)), pick] <= self.bound
            live, pick = live[near], pick[near]
            rows.append(live)
            cells.append(oa[live, pick] * k2 + ob[live, at[live, pick]])
            at[live, pick] += 1
        return a * k2 + b, np.concatenate(rows or [live]), np.concatenate(cells or [live])

    def group(self, cell: np.ndarray) -> np.ndarray:
        k2 = len(self.second)
        return cell // k2 * -(-k2 // self.width) + cell % k2 // self.width


PLACED = "key long, m long, dim int, v array<{}>, grp int, cell int, seen array<int>"


def _place(frames, grid: Grid, dim: int):
    """Rows of every class: in its own group (``seen`` is null), and where it visits cells of a higher number."""
    for whole in frames:
        for s in range(0, len(whole), TILE):
            f = whole.iloc[s : s + TILE]
            own, rows, cells = grid.visit(unit(stacked(f["v"].to_numpy(), dim)))
            up = cells > own[rows]
            rows, cells = rows[up], cells[up]
            home = f.assign(grp=grid.group(own).astype(np.int32), cell=own.astype(np.int32), seen=None)
            groups = grid.group(cells)
            order = np.lexsort((cells, groups, rows))
            rows, cells, groups = rows[order], cells[order], groups[order]
            # its own group is searched whole
            other = groups != grid.group(own)[rows]
            rows, cells, groups = rows[other], cells[other], groups[other]
            cut = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (groups[1:] != groups[:-1]))) if len(rows) else np.zeros(0, np.int64)
            away = f.iloc[rows[cut]].assign(grp=groups[cut].astype(np.int32), cell=own[rows[cut]].astype(np.int32))
            away["seen"] = pd.Series([c.astype(np.int32) for c in np.split(cells, cut[1:])] if len(cut) else [], index=away.index, dtype=object)
            yield pd.concat([home, away])[["key", "m", "dim", "v", "grp", "cell", "seen"]] if len(away) else home[["key", "m", "dim", "v", "grp", "cell", "seen"]]


class Forest:
    """Components of numbered nodes under links that come in pieces."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            differ = a != b
            i, j = i[differ], j[differ]
            np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
            while (root[root] != root).any():
                root[:] = root[root]


FOUND = "key long, links long, root long"


def _meet(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the vectors of a group's block and its visitors, and among the block's own."""
    frame = frame.sort_values(["_part", "cell", "key"], kind="stable")
    given = frame["v"].to_numpy()
    x = unit(stacked(given, len(given[0])))
    m, cell, key = frame["m"].to_numpy(), frame["cell"].to_numpy(), frame["key"].to_numpy()
    part = frame["_part"].to_numpy()  # 0: the block, 1: visitors of some cells, 2: other blocks of the group
    links, forest = np.zeros(len(x), np.int64), Forest(len(x))
    home = int((part == 0).sum())

    def compare(i: np.ndarray, j: np.ndarray, among: bool) -> None:
        for s in range(0, len(i), TILE):
            for t in range(s if among else 0, len(j), TILE):
                a, b = i[s : s + TILE], j[t : t + TILE]
                c = x[a] @ x[b].T
                hit = c >= threshold
                for p, q in np.argwhere(np.abs(c - threshold) < CLOSE).tolist():
                    u, w = np.asarray(given[a[p]], float), np.asarray(given[b[q]], float)
                    hit[p, q] = (u * w).sum() / (np.sqrt((u * u).sum()) * np.sqrt((w * w).sum())) >= threshold
                if among and s == t:
                    hit &= np.arange(len(a))[:, None] < np.arange(len(b))
                p, q = np.nonzero(hit)
                np.add.at(links, a[p], m[b[q]])
                np.add.at(links, b[q], m[a[p]])
                forest.join(a[p], b[q])

    block = np.arange(home)
    if home and frame["_turn"].iloc[0] == 0:
        compare(block, block, True)
    others = np.flatnonzero(part == 2)
    if len(others):
        compare(others, block, False)
    guests = np.flatnonzero(part == 1)
    if len(guests) and home:
        seen = frame["seen"].to_numpy()[guests]
        size = np.array([len(s) for s in seen])
        who, where = np.repeat(guests, size), np.concatenate(seen)
        order = np.argsort(where, kind="stable")
        who, where = who[order], where[order]
        head = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        for a, b in zip(head, np.append(head[1:], len(where))):
            lo, hi = np.searchsorted(cell[:home], [where[a], where[a] + 1])
            compare(who[a:b], np.arange(lo, hi), False)
    keep = (links > 0) | (forest.root != np.arange(len(x)))
    return pd.DataFrame({"key": key[keep], "links": links[keep], "root": key[forest.root[keep]]})


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``.

    Links are pairs with a cosine of at least ``threshold``; all that are returned
    are true, and about ``recall`` of those at the threshold, more above it, are found.
    """
    digest = F.struct(F.xxhash64("v").alias("one"), F.xxhash64(F.lit(1), "v").alias("two"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.withColumn("h", F.when(usable(F.col("v")), digest))
    element = dict(vectors.select(F.get("embedding", F.lit(0)).alias("e")).dtypes)["e"]
    classes = cut_lineage(
        rows.where("h is not null").groupBy("v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("m"))
        .select(F.monotonically_increasing_id().alias("key"), "low", "m", digest.alias("h"), F.size("v").alias("dim"), "v")
    )
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    n, dim = total["n"], total["dim"] or 1
    share = F.pmod(F.xxhash64(F.col("h.one"), F.lit(7)), F.lit(1 << 30)) < min(1.0, FIT / max(n, 1)) * (1 << 30)
    sample = [r["v"] for r in classes.where(share).select("v").collect()]  # about FIT rows, whatever the table
    results = classes.select("key", "low", "m", "h")
    none = results.select("h", (F.col("m") - 1).alias("n_links"), F.col("low").alias("component_id"))
    if sample:
        grid = Grid.fit(unit(stacked(sample, dim)), n, threshold, recall)
        placed = cut_lineage(
            classes.select("key", "m", "dim", "v").mapInPandas(lambda f: _place(f, grid, dim), PLACED.format(element))
        )
        found = cut_lineage(_meetings(placed, threshold))
        edges = found.where("key != root").select(F.col("key").alias("a"), F.col("root").alias("b"))
        linked = components(edges).toDF("key", "class")
        links = found.groupBy("key").agg(F.sum("links").alias("links"))
        results = results.join(links, "key", "left").join(linked, "key", "left").withColumn("class", F.coalesce("class", "key"))
        results = cut_lineage(results)
        lowest = results.groupBy("class").agg(F.min("low").alias("component_id"))
        none = results.join(lowest, "class").select("h", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "h").join(none, "h", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def _meetings(placed: DataFrame, threshold: float) -> DataFrame:
    """Every block of every group with its visitors, in tasks of bounded size."""
    home = F.col("seen").isNull()
    sizes = placed.groupBy("dim", "grp").agg(
        F.greatest(F.ceil(F.count_if(home) / ROWS), F.lit(1)).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.count_if(~home) / ROWS), F.lit(1)).cast("int").alias("turns"),
    )
    few = F.broadcast(sizes)  # at most MOST_CODES ** 2 rows of four numbers for each length of vectors
    rows = placed.join(few, ["dim", "grp"])
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    turn = F.pmod(F.xxhash64("key", F.lit(1)), F.col("turns")).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda part, b, t: F.struct(F.lit(part).alias("_part"), b.alias("_block"), t.alias("_turn"))
    own = F.transform(span("turns"), lambda t: place(0, block, t))
    later = F.filter(F.transform(span("blocks"), lambda b: place(2, b, F.lit(0))), lambda p: p["_block"] > block)
    guest = F.transform(span("blocks"), lambda b: place(1, b, turn))
    tasks = rows.withColumn("_p", F.explode(F.when(home, F.concat(own, later)).otherwise(guest)))
    tasks = tasks.select("key", "m", "dim", "v", "grp", "cell", "seen", "_p.*")
    return tasks.groupBy("dim", "grp", "_block", "_turn").applyInPandas(lambda f: _meet(f, threshold), FOUND)
