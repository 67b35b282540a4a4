"""Bottom-k sketches of word shingles: resemblance, containment, distinct counts.

Native: DataFrame expressions and windows only.

A sketch holds the ``k`` smallest distinct 63-bit hashes of a text's shingles in
order. The sketch of a union is the ``k`` smallest of both sketches, so sketches
of parts merge in any order. The share of a union's smallest hashes that both
sides hold estimates resemblance; up to ``k`` shingles it is exact.

Defined cases: a null text is empty and has an empty sketch; a text of fewer
words than a shingle gives one shingle; two empty sketches resemble each other
fully, an empty and another one not at all; equal texts have equal sketches;
repeated rows have a sketch each; rows of one id follow by their texts; a null id comes
last; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, text_of

K = 128
SHINGLE = 5
SPAN = float(1 << 63)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, however often they are used."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_sketch(df: DataFrame, text_col: str, name: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Add the sketch of a text column that has no nulls."""
    words = F.array_remove(F.split(F.lower(F.col(text_col)), r"[\x20\x09-\x0D]+"), "")
    df = once(df, _hashes=F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col("_hashes")
    heads = F.slice(h, 1, F.greatest(F.size(h) - (shingle - 1), F.least(F.size(h), F.lit(1))))
    runs = F.transform(
        heads,
        lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, shingle)]), 1),
    )
    return once(df, **{name: F.slice(F.sort_array(F.array_distinct(runs)), 1, k)}).drop("_hashes")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of both sides' texts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the two shingle sets."""
    low = merge(a, b, k)
    both = F.size(F.array_intersect(low, F.array_intersect(a, b)))
    return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(both / F.size(low))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * SPAN / F.element_at(a, k))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first side's shingles that the second side holds too."""
    whole = distinct_count(merge(a, b, k), k)
    shared = resemblance(a, b, k) * whole
    n = distinct_count(a, k)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(shared / n, F.lit(1.0)))


def merge_groups(df: DataFrame, keys: list[str], sketch: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per group; a hot group is reduced over salts first."""
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))
    rows = df.select(*keys, salt.alias("_salt"), F.explode(sketch).alias("_h"))
    for own in ([*keys, "_salt"], keys):
        rows = rows.groupBy(*own, "_h").count().drop("count")
        rank = F.row_number().over(Window.partitionBy(*own).orderBy("_h"))
        rows = rows.withColumn("_rank", rank).where(f"_rank <= {k}").drop("_rank")
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def as_text(a: Column) -> Column:
    """A sketch as one string, 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str, carried: dict[str, str]) -> DataFrame:
    """Add columns of the next row by descending id; the last row's next is the first one.

    Rows go to ranges of ids, cut at quantiles, one shuffle for all columns. The
    rows of each range's first id travel to the range before it too, so that its
    last row finds its next; they are dropped afterwards. A null id comes last;
    rows of one id are in the order of the carried columns. Rows of a single id
    stay in one range.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    ids = docs.select(F.col(id_col).alias("i"))
    cuts = ids.agg(F.percentile_approx("i", [j / n for j in range(1, n)] or [0.5], 10 * n).alias("q")).first()["q"]
    edges = sorted(set(cuts or []))
    step = max(1, int(len(edges) ** 0.5))
    whole = lambda xs: F.from_json(F.lit(json.dumps(xs)), "array<bigint>")

    def range_of(i: Column) -> Column:
        """Number of edges below the id, found in two short scans."""
        coarse = F.size(F.filter(whole(edges[step - 1 :: step]), lambda e: e < i))
        fine = F.size(F.filter(F.slice(whole(edges), coarse * step + 1, step), lambda e: e < i))
        return F.when(i.isNull(), F.lit(-1)).otherwise(coarse * step + fine)

    heads = ids.groupBy(range_of(F.col("i")).alias("r")).agg(F.max("i").alias("i")).collect()  # one row a range
    heads = sorted(((h["r"], h["i"]) for h in heads), reverse=True)
    guests = [(heads[j][1], heads[j - 1][0]) for j in range(len(heads))]  # the first range's go to the last
    own = docs.withColumn("_range", range_of(F.col(id_col))).withColumn("_guest", F.lit(0))
    small = spark.createDataFrame(guests, "_head bigint, _range int")
    extra = docs.join(F.broadcast(small), F.col(id_col).eqNullSafe(F.col("_head"))).drop("_head").withColumn("_guest", F.lit(1))
    line = Window.partitionBy("_range").orderBy("_guest", F.col(id_col).desc_nulls_last(), *carried)
    both = own.unionByName(extra)
    return both.select(
        "*", *[F.lead(c).over(line).alias(name) for c, name in carried.items()]
    ).where("_guest = 0").drop("_range", "_guest")


def compare_edited(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Sketches of all texts and of texts whose second half comes from the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The last ``n_chars div 2`` code points give way to
    the first as many (or all) of the next document by descending id.
    """
    rows = docs.select(F.col("doc_id"), text_of().alias("_t"))
    rows = with_sketch(rows, "_t", "_s", k, shingle)
    rows = with_next(rows, "doc_id", {"_t": "_next", "_s": "_next_s"})
    n = F.length("_t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("_t", F.lit(1), n - half), F.substring("_next", F.lit(1), half))
    rows = once(rows.withColumn("n_chars", n), _edited=edited).drop("_t", "_next")
    rows = with_sketch(rows, "_edited", "_e", k, shingle)
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(F.col("_s")).alias("fingerprint"), as_text(F.col("_e")).alias("edited_fingerprint"),
        resemblance(F.col("_s"), F.col("_e"), k).alias("near_edited"),
        resemblance(F.col("_s"), F.col("_next_s"), k).alias("near_next"),
    )
