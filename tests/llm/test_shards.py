import zlib
from collections import defaultdict

import numpy as np
import pytest

from parley.llm import shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 1000, 4097])
def test_permutation_and_inverse(n):
    for seed in (0, 9):
        p = shards.Permutation(n, seed)
        at = p.place(np.arange(n))
        assert sorted(at.tolist()) == list(range(n))
        assert np.array_equal(p.row(at), np.arange(n))
    if n > 60:
        assert not np.array_equal(shards.Permutation(n, 0).place(np.arange(n)), shards.Permutation(n, 9).place(np.arange(n)))


def test_places_can_be_computed(documents):
    docs = documents([(i * 3, f"t{i}") for i in range(333)])
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in shards.shard_documents(docs, 16, seed=4).collect()}
    shard, slot = shards.locate(np.arange(333), 333, 16, seed=4)
    assert got == {i * 3: (shard[i], slot[i]) for i in range(333)}
    assert np.array_equal(shards.row_at(shard, slot, 333, 16, seed=4), np.arange(333))


def _check(docs, rows, n=16):
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    counts = [len(by[s]) for s in range(n)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_shards_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = shards.shard_documents(docs).collect()
    _check(docs.collect(), one)
    assert sorted(one) == sorted(shards.shard_documents(docs.repartition(5)).collect())


def test_other_columns_are_kept(documents):
    from pyspark.sql import functions as F

    docs = documents([(i, f"t{i}") for i in range(20)])
    out = shards.shard_rows(docs, [F.col("doc_id")], 3)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert sorted(out.select(*docs.columns).collect()) == sorted(docs.collect())


def test_edges(messy, nothing):
    _check(messy.collect(), shards.shard_documents(messy).collect())
    assert shards.shard_documents(nothing).count() == 0
