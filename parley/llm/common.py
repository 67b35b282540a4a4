"""Helpers of the operators: columns, written steps, row numbers, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_of(name: str = "text") -> Column:
    """The column as a text; a null is an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(name: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % n


def number_rows(df: DataFrame, *order: Column, name: str = "row_number") -> DataFrame:
    """Dense numbers from 0 in the given order, in column ``name``.

    Rows are dealt by ranges of the order and sorted there; each range then
    needs only the counts of the ranges before it, one row a range. A last key
    separates equal rows, so that no range is bound to hold all of them.
    """
    n = partitions(df.sparkSession)
    kept = df.columns
    tie = F.monotonically_increasing_id()
    dealt = (
        df.withColumn("_tie", tie)
        .repartitionByRange(n, *order, F.col("_tie"))
        .sortWithinPartitions(*order, F.col("_tie"))
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_at", 33))
    )
    rows = cut_lineage(dealt.drop("_tie"))
    parts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    here = F.col("_at") - F.shiftleft(F.col("_range"), 33)
    return rows.join(F.broadcast(before), "_range").select(*[F.col(f"`{c}`") for c in kept], (F.col("_base") + here).alias(name))


ROWS_A_TASK = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for all nodes of ``edges``.

    Alternating star contraction: each round links every neighbour of a node to
    the smallest one, first the larger neighbours, then the smaller. Only minima
    and joins on narrow rows, written once a round; no list of a node's
    neighbours is built. It ends when a round leaves the links as they were.
    Tasks hold about ``ROWS_A_TASK`` links, so short rounds do not pay for many
    empty ones.
    """
    links = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    mark, tasks = None, None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            break
        mark, tasks = tuple(now), 1 + now[0] // ROWS_A_TASK
        few = lambda df: df.coalesce(tasks)  # noqa: B023, E731
        # the smaller neighbours of a node are what its own links name; a root has none
        low = few(links.groupBy("u").agg(F.min("v").alias("m"))).withColumnRenamed("u", "v")
        large = few(links.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("x"), F.least("v", "m").alias("y")).where("x > y")
        links = cut_lineage(few(small.union(least.select("u", "m")).toDF("u", "v").distinct()))
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
