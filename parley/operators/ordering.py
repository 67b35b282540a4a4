"""Dense positions and running totals without a one-partition window over data."""

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _range_bucket(df: DataFrame, key: str, buckets: int) -> Column:
    """Bucket number of an integer key from its quantiles.

    The bounds become literals, so the same row falls in the same bucket in
    every pass, whatever the partitioning, and a window per bucket sorts only
    its share of the rows. A row finds its bucket by two short scans, one over
    every n-th bound and one between two of them.
    """
    bounds = df.agg(
        F.percentile_approx(
            key, [i / buckets for i in range(1, buckets)] or [0.5], 10 * buckets
        ).alias("q")
    ).first()["q"] or []
    bounds = sorted(set(bounds))
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    literal = lambda xs: F.from_json(F.lit(json.dumps(xs)), "array<bigint>")
    below = lambda edges: F.size(F.filter(edges, lambda e: e < F.col(key)))
    coarse = below(literal(bounds[step - 1 :: step]))
    return coarse * step + below(F.slice(literal(bounds), coarse * step + 1, step))


def _before(parts: DataFrame, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier buckets; one row per bucket goes through the window."""
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_bucket", F.coalesce(F.sum(value).over(upto), F.lit(0)).alias(name))


def running_total(df: DataFrame, key: str, value: str, name: str, buckets: int | None = None) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``key`` (keys are unique)."""
    rows = df.withColumn("_bucket", _range_bucket(df, key, buckets or _default_buckets(df)))
    totals = rows.groupBy("_bucket").agg(F.sum(value).alias("_total"))
    inside = Window.partitionBy("_bucket").orderBy(key).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(_before(totals, "_total", "_base")), "_bucket")  # one row per bucket
        .withColumn(name, F.col("_base") + F.col("_in"))
        .drop("_bucket", "_in", "_base")
    )


def dense_index(df: DataFrame, key: str, then=(), name: str = "entry_index", buckets: int | None = None) -> DataFrame:
    """0-based dense position in the order ``key, *then``."""
    rows = df.withColumn("_bucket", _range_bucket(df, key, buckets or _default_buckets(df)))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_bucket").orderBy(key, *then)
    return (
        rows.withColumn("_rank", F.row_number().over(order))
        .join(F.broadcast(_before(counts, "_n", "_base")), "_bucket")  # one row per bucket
        .withColumn(name, F.col("_base") + F.col("_rank") - 1)
        .drop("_bucket", "_rank", "_base")
    )


def _default_buckets(df: DataFrame) -> int:
    """As many buckets as shuffle partitions, which a user sizes to the data."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
