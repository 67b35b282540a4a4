"""Mixing sources to target weights by weighted sampling without replacement.

Native: DataFrame expressions, joins and windows only.

Every document gets an Efraimidis-Spirakis key ``-ln(u) / weight`` from a hash
``u`` of its id, so that a heavier document tends to come first. A source whose
target is ``r`` times its size is taken whole ``floor(r)`` times; the rest comes
from its documents in key order up to the budget that is left. The document on
the border is taken when that brings the sum nearer to the target.

Plan: one pass over the texts gives a narrow row a document, written once. The
order inside a source is cut into ranges of about ``RANGE_ROWS`` documents by
the key's rank among exponential keys, so a source with a third of all rows is
many tasks; running sums inside a range are added to sums of whole ranges.

Defined cases: a null text has size 0; a null source is a source, last in
order; documents of size 0 follow their source and add nothing; repeated rows
are separate documents; a null or non-positive weight counts as the smallest
weight; an empty table gives an empty result. Columns named like the results
are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_of

RANGE_ROWS = 10_000
LEAST_WEIGHT = 1e-6
RESULTS = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Number of words of a text."""
    blank = F.translate(text, "\t\n\x0b\f\r", "     ")
    return F.regexp_count(blank, F.lit("[^ ]+")).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of characters that are not punctuation or symbols, from a table of the common ones."""
    n = F.length(text)
    plain = F.length(F.translate(text, "!#$%&*|<>{}[]\\^~_=+/@0123456789", ""))
    return F.when(n > 0, plain / n).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """``source, source_size`` -> also ``target``.

    Sources in order, null last, get ``weights`` in turn. All sizes together are
    shared by weight; no target exceeds ``cap`` times its source's size, and what
    is left over goes to the others by weight until none is above. That fixed
    point is reached in one step: with sources sorted by cap over weight, the
    capped ones are a prefix. The level that a source and all later ones reach
    with all before it capped rises along that prefix and falls after it, so its
    maximum is the level. Windows here run over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("_w", F.element_at(table, (F.row_number().over(order) - 1) % len(weights) + 1))
    rows = rows.withColumn("_cap", F.col("source_size") * float(cap)).withColumn("_r", F.col("_cap") / F.col("_w"))
    whole = Window.partitionBy()
    upto = Window.orderBy("_r", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_all", F.sum("source_size").over(whole))
    rows = rows.withColumn("_capped", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
    rows = rows.withColumn("_left", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
    rows = rows.withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_left"))
    level = F.max("_level").over(whole)
    return rows.select("source", "source_size", F.least(F.col("_cap"), level * F.col("_w")).alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    size: Column,
    weight: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    cap: float = 3.0,
    seed: int = 17,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Columns ``keep`` with ``size, source_size, target, copies, taken``.

    ``copies`` is how often the mix holds the document, ``taken`` is ``copies``
    times its size. Reruns agree, whatever the partitioning.
    """
    spark = docs.sparkSession
    name = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(f"#{seed}"))
    draw = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")  # 52 bits
    unit = (draw.cast("double") + 0.5) / float(1 << 52)
    heavy = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(LEAST_WEIGHT))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep if c not in RESULTS]).alias("_kept"),
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        size.alias("size"), unit.alias("_u"), heavy.alias("_weight"), draw.alias("_draw"),
    )
    rows = cut_lineage(rows.withColumn("_key", -F.log("_u") / F.col("_weight")).withColumn("_tie", F.monotonically_increasing_id()))
    sources = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"), F.avg("_weight").alias("_mean")
    )
    sources = cut_lineage(sources)
    plan = source_targets(sources.select("source", "source_size"), weights, cap).alias("t").join(
        sources.drop("source_size").alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.select(
        F.col("t.source").alias("_source"), "source_size", "target", "_n", "_mean",
        F.floor(ratio).alias("_epochs"),
    ).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    plan = cut_lineage(plan)  # one row a source; its size on disk decides how it is joined
    ranges = F.ceil(F.col("_n") / RANGE_ROWS)
    rank = 1 - F.exp(-F.col("_key") * F.col("_mean"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_range", F.least(F.floor(rank * ranges), ranges - 1).cast("long")
    )
    sums = rows.groupBy("_source", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        F.col("_source").alias("_bs"), F.col("_range").alias("_br"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "_draw", "_id", "size", "_tie").rowsBetween(
        Window.unboundedPreceding, -1
    )
    rows = rows.join(base, F.col("_source").eqNullSafe(F.col("_bs")) & (F.col("_range") == F.col("_br")))
    done = F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    chosen = (F.col("size") > 0) & (done + F.col("size") / 2 <= F.col("_rest"))
    rows = rows.withColumn("copies", (F.col("_epochs") + F.when(chosen, 1).otherwise(0)).cast("int"))
    return rows.select(
        "_kept.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``mix_sources`` of documents by words, heavier when they hold less punctuation."""
    text = text_of()
    return mix_sources(docs, size=word_count(text), weight=quality_weight(text), **options)

