import hashlib
import re

import pytest
from pyspark.sql import functions as F

from parley.llm import fingerprint as fp


def _set(text, k=5):
    ws = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if w]
    return {tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1))} if ws else set()


def _near(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _check(rows, got, exact=True):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ), reverse=True)
    by = {r["doc_id"]: r for r in got}
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = by[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if exact:
            assert r["near_edited"] == pytest.approx(_near(_set(text), _set(edited)))
            assert r["near_next"] == pytest.approx(_near(_set(text), _set(after)))


@pytest.mark.parametrize("parts", [1, 6])
def test_short_texts_are_exact(documents, parts):
    rows = [(i * 7 % 101, " ".join(f"é{(i * j) % 13}" for j in range(i % 30))) for i in range(101)]
    got = fp.compare_edited(documents(rows).repartition(parts)).collect()
    assert len(got) == 101
    _check(rows, got)


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = fp.compare_edited(docs).collect()
    _check(rows, got, exact=False)
    by, prints = dict(rows), {}
    for r in got:
        assert prints.setdefault(by[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    order = sorted(by, reverse=True)
    errors = []
    for i, d in enumerate(order):
        text, after = by[d], by[order[(i + 1) % len(order)]]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        errors.append(abs(next(r for r in got if r["doc_id"] == d)["near_edited"] - _near(_set(text), _set(edited))))
    assert sum(errors) / len(errors) < 0.04 and max(errors) < 0.2


def test_sketches_merge_and_estimate(spark):
    a, b = [" ".join(f"w{i}" for i in range(lo, hi)) for lo, hi in ((0, 4000), (1000, 9000))]
    df = spark.createDataFrame([(0, a), (1, b)], "g int, t string")
    rows = fp.with_sketch(df, "t", "s").select("g", "s")
    whole = fp.merge_groups(rows.withColumn("g", F.lit(0)), ["g"], "s").first()["s"]
    x, y = (r["s"] for r in rows.orderBy("g").collect())
    assert whole == sorted(set(x) | set(y))[: fp.K]
    one = spark.createDataFrame([(x, y)], "x array<long>, y array<long>")
    r = one.select(
        fp.merge(F.col("x"), F.col("y")).alias("m"), fp.resemblance(F.col("x"), F.col("y")).alias("r"),
        fp.containment(F.col("x"), F.col("y")).alias("c"), fp.distinct_count(F.col("x")).alias("n"),
    ).first()
    assert r["m"] == whole
    assert abs(r["r"] - 2996 / 8996) < 0.15 and abs(r["c"] - 2996 / 3996) < 0.25 and abs(r["n"] / 3996 - 1) < 0.3


def test_edges(messy, nothing, documents):
    rows = fp.compare_edited(messy).collect()
    assert len(rows) == messy.count()
    assert len({r["fingerprint"] for r in rows if r["n_chars"] == 0}) == 1
    assert fp.compare_edited(nothing).count() == 0
    one = fp.compare_edited(documents([(5, "a b c d e f g")])).collect()
    _check([(5, "a b c d e f g")], one)
