import zlib

import numpy as np
from pyspark.sql import functions as F

from parley.llm import quality_model as qm


def test_scores_match_dense_products(documents):
    import pyarrow as pa

    texts = ["Some words, some WORDS", "", "a a a a", "é É!! 12", "Some words"] * 2
    weights = np.random.default_rng(0).normal(size=qm.DIMENSIONS + 1).astype(np.float32)
    docs = documents(list(enumerate(texts)))
    got = [r["s"] for r in docs.select("doc_id", qm.score_column(docs, weights).alias("s")).orderBy("doc_id").collect()]
    doc, cell, value, n = qm.features(pa.array(texts))
    dense = np.zeros((n, qm.DIMENSIONS))
    np.add.at(dense, (doc, cell), value)
    want = 1 / (1 + np.exp(-(dense @ weights[:-1] + weights[-1])))
    assert np.allclose(got, want, atol=1e-6)
    assert np.allclose((value**2)[doc == 0].sum(), 4)  # each family has length 1


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = qm.score_documents(docs, labels).join(labels, "doc_id").where("held_out")
    rows = out.select("score", "predicted", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.98
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.96


def test_labels_of_held_out_rows_do_not_matter(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ([tuple(r) for r in qm.score_documents(docs, x).orderBy("doc_id").collect()] for x in (labels, flipped))
    assert a == b
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) and r[3] == int(r[2] >= 0.7) for r in a)


def test_bounded_sample(documents, spark):
    docs = documents([(i, "fine words here" if i % 2 else "BAD!! STUFF!! HERE!!") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, y int")
    w = qm.train(docs, labels, max_train=100)
    rows = docs.select("doc_id", qm.score_column(docs, w).alias("s")).collect()
    assert min(r["s"] for r in rows if r["doc_id"] % 2) > max(r["s"] for r in rows if r["doc_id"] % 2 == 0)


def test_edges(messy, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (7, 0), (99, 1)], "doc_id long, quality int")
    rows = qm.score_documents(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    none = labels.limit(0)
    assert {r["score"] for r in qm.score_documents(messy, none).collect()} == {0.5}
    assert qm.score_documents(nothing, labels).count() == 0
    kept = qm.keep_good(messy, labels)
    assert kept.columns == messy.columns
