import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import vptree

ROWS = "vec_id long, embedding array<float>, label int"


def _brute(vectors, k=10):
    use = [(i, v) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for j, (i, v) in enumerate(use):
        if i % 100 == 0:
            d = []
            for m, (c, w) in enumerate(use):
                if m != j and len(w) == len(v):
                    d.append((float(vptree.distances(np.array([v], np.float32).astype(float), np.array([w], np.float32).astype(float))[0, 0]), c))
            out += [(i, r + 1, c, s) for r, (s, c) in enumerate(sorted(d)[:k])]
    return sorted(out)


def _found(spark, vectors, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], ROWS)
    rows = vptree.nearest(df, F.col("vec_id") % 100 == 0, **kw).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows)


def test_exact_with_ties_shards_and_blocks(spark):
    rng = np.random.default_rng(0)
    common = [0.5] * 8
    vectors = [(i, common if i % 3 == 0 else rng.integers(0, 3, 8).tolist()) for i in range(700)]
    vectors = [(i, [float(x) for x in v]) for i, v in vectors]
    assert _found(spark, vectors, leaf=8, shard_rows=150, query_rows=3) == _brute(vectors)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [1.0, 2.5]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (200, [0.0, 1.0, 0.0]), (8, [3.0, 3.0])]
    assert _found(spark, vectors) == _brute(vectors)
    assert _found(spark, [(0, [1.0])]) == []
    assert vptree.nearest(spark.createDataFrame([], ROWS), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("factor,least", [(1.0, 1.0), (1.5, 0.9)])
def test_recall(spark, factor, least):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["vec_id"] for r in rows])
    tree = vptree.Tree(x)
    q = np.flatnonzero(ids % 100 == 0)
    _, got = tree.search(x[q], q, ids, 10, factor)
    d = vptree.distances(x[q], x)
    d[np.arange(len(q)), q] = np.inf
    want = np.argsort(d, 1, kind="stable")[:, :10]
    hits = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, want)])
    assert hits >= least
