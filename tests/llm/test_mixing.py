import math
from collections import defaultdict

from pyspark.sql import functions as F

from parley.llm import mixing


def _targets(sizes, weights=(1, 2, 3), cap=3.0):
    """Share, stop at the caps, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = float(sum(sizes.values())), {}, set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def _check(rows):
    sizes, taken, longest, targets = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        targets[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    want = _targets(sizes)
    for s in sizes:
        assert math.isclose(targets[s], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6
        ratio = want[s] / sizes[s] if sizes[s] else 0
        assert all(r["copies"] in (math.floor(ratio + 1e-12), math.floor(ratio) + 1) for r in rows if r["source"] == s)


def test_targets_and_sums(documents):
    rows = [(i, "w " * (i % 40 + 1), f"s{i % 5}" if i % 3 else "hot") for i in range(600)]
    rows += [(1000 + i, "w " * 3, "small") for i in range(3)]
    _check(mixing.mix_documents(documents(rows), keep=("doc_id", "source")).collect())


def test_ranges_and_partitions_do_not_matter(spark, documents, monkeypatch):
    docs = documents([(i, "w " * (i % 17 + 1), "a" if i % 2 else "b") for i in range(500)])
    one = mixing.mix_documents(docs).select("doc_id", "taken").collect()
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    many = mixing.mix_documents(docs.repartition(7)).select("doc_id", "taken").collect()
    assert sorted(one) == sorted(many)


def test_heavier_documents_come_first(documents):
    docs = documents([(i, "w " * 10, "a" if i < 2000 else "b") for i in range(4000)])
    heavy = F.when(F.col("doc_id") % 2 == 0, 10.0).otherwise(1.0)
    rows = mixing.mix_sources(docs, size=mixing.word_count(F.col("text")), weight=heavy, weights=(1, 3)).collect()
    part = [r for r in rows if r["doc_id"] < 2000]  # about half of source a
    even = sum(r["copies"] for r in part if r["doc_id"] % 2 == 0)
    odd = sum(r["copies"] for r in part if r["doc_id"] % 2)
    assert even > 3 * odd > 0


def test_edges(messy, nothing):
    rows = mixing.mix_documents(messy, keep=("doc_id", "source", "size")).collect()
    assert len(rows) == messy.count()
    _check(rows)
    assert mixing.mix_documents(nothing).count() == 0
