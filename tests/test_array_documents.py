from pyspark.sql import functions as F

from parley.plans import catalog_files as cf


def test_array_documents_are_bounded_and_lines_go_on(spark):
    n = 10 * cf.PER_DOCUMENT
    rows = spark.range(n).select(F.col("id").alias("entry_index"), F.col("id").cast("string").alias("j"))
    docs = cf._array_documents(rows).select("doc", "first", F.from_json("value", "array<long>").alias("v")).collect()
    assert max(len(d["v"]) for d in docs) <= cf.PER_DOCUMENT and len(docs) == 12
    got = {(d["doc"], d["first"] + i): x for d in docs for i, x in enumerate(d["v"])}
    assert got == {(x % 4, x // 4): x for x in range(n)}
