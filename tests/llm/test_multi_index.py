import numpy as np
import pytest

from parley.llm import multi_index
from parley.llm.multi_index import Grid, near_vectors

ROWS = "vec_id long, embedding array<float>, label int"


def _brute(vectors, threshold=0.95):
    """(vec_id, n_links, component_id, kept) from all pairs."""
    fine = [bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in vectors]
    links = {i: [] for i in range(len(vectors))}
    for dim in {len(v) for (_, v), ok in zip(vectors, fine) if ok}:
        at = [i for i, ok in enumerate(fine) if ok and len(vectors[i][1]) == dim]
        x = np.array([np.float32(vectors[i][1]) for i in at], float)
        c = (x @ x.T) / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1))
        for a, b in np.argwhere(c >= threshold).tolist():
            if a != b:
                links[at[a]].append(at[b])
    out = []
    for i, (vec, _) in enumerate(vectors):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [vectors[j][0] for j in seen if vectors[j][0] is not None]
        low = min(ids, default=None)
        out.append((vec, len(links[i]), low, vec == low))
    return sorted(out, key=repr)


def _found(spark, vectors, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], ROWS)
    return sorted(map(tuple, near_vectors(df, **kw).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def _clusters(rng, n, dim=16):
    """Loners, near copies of several degrees, chains and one vector that a third of all rows have."""
    out = []
    common = rng.normal(size=dim)
    while len(out) < n:
        kind, base = rng.random(), rng.normal(size=dim)
        if kind < 0.4:
            out.append(base)
        elif kind < 0.6:
            out += [common] * 3
        else:
            spread = rng.choice([0.02, 0.1, 0.2])
            for _ in range(rng.integers(2, 12)):
                out.append(base + spread * rng.normal(size=dim))
    return [(i, [float(x) for x in v]) for i, v in enumerate(out)]


def test_small_cells_blocks_and_turns(spark, monkeypatch):
    for name, value in (("CELL", 8), ("ROWS", 20), ("TILE", 7)):
        monkeypatch.setattr(multi_index, name, value)
    vectors = _clusters(np.random.default_rng(1), 500)
    assert _found(spark, vectors, recall=1.0) == _brute(vectors)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (0, [1.0, 2.0]), (1, [2.0, 4.0]), (1, [2.0, 4.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
        (None, [1.0, 2.1]), (8, [1.0, 2.0, 0.0]), (9, [3.0, -1.0]), (None, None), (10, [7.0]), (11, [-7.0]), (12, [1e-30, 2e-30]),
    ]
    assert _found(spark, vectors) == _brute(vectors)
    assert near_vectors(spark.createDataFrame([], ROWS)).count() == 0
    assert _found(spark, [(2, None)]) == [(2, 0, 2, True)]


def test_at_the_threshold(spark):
    # cosines of exactly 0.6 and 0.8, and one just below
    vectors = [(0, [1.0, 0.0]), (1, [3.0, 4.0]), (2, [4.0, -3.0]), (3, [2.9999, 4.0])]
    assert _found(spark, vectors, threshold=0.6) == _brute(vectors, 0.6)


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5, 6), (2, [1.0, 0.1], 5, 6)], "vec_id long, embedding array<double>, key int, n_links int")
    assert sorted(map(tuple, near_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_traversal_takes_the_nearest_cells_first():
    rng = np.random.default_rng(2)
    x = multi_index.unit(rng.normal(size=(400, 8)))
    grid = Grid.fit(x, 400 * multi_index.CELL // 16, 0.9, 0.99)
    own, rows, cells = grid.visit(x)
    (a, ma), (b, mb) = grid.margins(x)
    k2 = len(grid.second)
    for i in range(0, 400, 37):
        sums = (ma[i][:, None] ** 2 + mb[i][None, :] ** 2).ravel()
        got = cells[rows == i]
        assert set(got) == set(np.flatnonzero(sums <= grid.bound)) and (np.diff(sums[got]) >= 0).all()
        assert got[0] == own[i] == a[i] * k2 + b[i]


@pytest.mark.parametrize("recall,least", [(0.999, 0.99), (0.9, 0.9)])
def test_recall(spark, monkeypatch, recall, least):
    monkeypatch.setattr(multi_index, "CELL", 16)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], float)
    rng = np.random.default_rng(5)
    more = x[:500] + rng.normal(size=(500, 64)) * 0.036 * np.sqrt((x[:500] ** 2).sum(1, keepdims=True))
    vectors = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, more]))]
    want = {r[0]: r[1] for r in _brute(vectors)}
    got = {r[0]: r[1] for r in _found(spark, vectors, recall=recall)}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= least * sum(want.values()) > 500
