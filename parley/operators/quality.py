"""The composite quality report: four scores of up to 25 points each."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.constants import QUOTE_PATTERN, STRUCTURE_FLAG_CODES
from . import entries as en

# --- fixed values: report texts ---------------------------------------------------
GRADES = ((90, "Excellent"), (70, "Good"), (50, "Fair"), (30, "Needs Attention"))
STATUSES = ((23, "Excellent"), (18, "Good"), (13, "Fair"), (7, "Needs Attention"))
LOWEST_GRADE = "Significant Issues"
SPECTRUM = (
    (0.2, "Heavy Narrative"), (0.4, "Narrative-Leaning"), (0.6, "Balanced"),
    (0.8, "Dialogue-Leaning"),
)
SPECTRUM_TOP = "Heavy Dialogue"
RATIO_BINS = (
    ("0-20%", 0.0, 0.2), ("20-40%", 0.2, 0.4), ("40-60%", 0.4, 0.6),
    ("60-80%", 0.6, 0.8), ("80-100%", 0.8, 1.01),
)


def _clamp(value: Column, top: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(value, F.lit(float(top))))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _bands(score: Column, bands, rest: str) -> Column:
    out = None
    for bound, name in bands:
        out = F.when(score >= bound, name) if out is None else out.when(score >= bound, name)
    return out.otherwise(rest)


def grade(score: Column) -> Column:
    return _bands(score, GRADES, LOWEST_GRADE)


def subscore_status(score: Column) -> Column:
    return _bands(score, STATUSES, LOWEST_GRADE)


# --- response quality -------------------------------------------------------------------


def extreme_ratio() -> Column:
    """User/assistant word ratio outside 0.1..5, or one side without words."""
    u, a = F.col("user_words"), F.col("asst_words")
    ratio = F.try_divide(u, a)  # also where the optimizer takes it first
    return (u == 0) | (a == 0) | F.coalesce((ratio < 0.1) | (ratio > 5.0), F.lit(False))


def response_quality(features: DataFrame, answer_words: DataFrame) -> DataFrame:
    """One row. The median is exact; its state is one counter per distinct
    word count, not one value per message."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    base = features.agg(
        s("asst_n").alias("n"),
        _share(s("asst_words"), s("asst_n")).alias("avg_response_length"),
        s("short_n").alias("short_response_count"),
        s("empty_n").alias("empty_response_count"),
        s("placeholder_n").alias("placeholder_count"),
        _share(s("user_words"), s("user_n")).alias("avg_user_length"),
    )
    middle = answer_words.agg(
        F.coalesce(F.percentile("words", 0.5), F.lit(0.0)).alias("median_response_length")
    )
    avg, n = F.col("avg_response_length"), F.col("n")
    ratio = F.when(avg > 0, F.col("avg_user_length") / avg).otherwise(F.lit(0.0))
    points = (
        F.when((ratio >= 0.2) & (ratio <= 2.0), 5.0)
        .when((ratio >= 0.1) & (ratio <= 5.0), 3.0)
        .otherwise(0.0)
    )
    filler = _share(F.col("empty_response_count"), n) + _share(F.col("placeholder_count"), n)
    score = (
        F.lit(15.0) * F.least(avg / 300.0, F.lit(1.0))
        + F.lit(5.0) * (F.lit(1.0) - F.least(filler, F.lit(1.0)))
        + points
        - F.lit(5.0) * _share(F.col("short_response_count"), n)
    )
    return base.crossJoin(middle).select(
        F.when(n > 0, _clamp(score, 25)).otherwise(0.0).alias("score"),
        "avg_response_length",
        "median_response_length",
        "short_response_count",
        "empty_response_count",
        "placeholder_count",
        ratio.alias("user_assistant_length_ratio"),
    )


def response_flags(features: DataFrame) -> DataFrame:
    bad = (F.col("short_n") > 0) | (F.col("empty_n") > 0) | (F.col("placeholder_n") > 0) | extreme_ratio()
    return features.where(bad)


# --- diversity ----------------------------------------------------------------------------


def usable_tags(features: DataFrame, active_tags: DataFrame | None) -> DataFrame:
    """Exploded ``(entry_index, tag)``, limited to active registry tags if given."""
    rows = features.select("entry_index", F.explode("tags").alias("tag"))
    if active_tags is None:
        return rows
    return rows.join(active_tags.select("tag"), "tag", "left_semi")


def tag_entropy(tag_uses: DataFrame) -> DataFrame:
    """One row: entropy of ``(tag, uses)`` over its maximum, 0 for one tag."""
    total = tag_uses.agg(F.sum("uses").alias("total"), F.count(F.lit(1)).alias("n_tags"))
    p = F.col("uses") / F.col("total")
    spread = tag_uses.crossJoin(F.broadcast(total)).agg(
        F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("h"), F.max("n_tags").alias("n_tags")
    )
    return spread.select(
        F.when(F.col("n_tags") > 1, F.col("h") / F.log2("n_tags")).otherwise(0.0).alias("tag_entropy")
    )


def diversity(features: DataFrame, duplicate_entries: DataFrame, *, active_tags: DataFrame | None = None) -> DataFrame:
    """One row. ``duplicate_entries`` has one ``entry_index`` per entry that is
    in any near-duplicate pair; ``active_tags`` has ``tag`` and ``category``."""
    n = F.col("total_entries")
    base = features.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_distinct("prompt_key").alias("unique_system_prompts"),
    )
    used = usable_tags(features, active_tags)
    tagged = used.agg(F.count_distinct("entry_index").alias("tagged_entries"))
    uses = used.groupBy("tag").agg(F.count(F.lit(1)).alias("uses"))
    entropy = tag_entropy(uses)
    dup = duplicate_entries.agg(F.count_distinct("entry_index").alias("duplicate_entries"))
    if active_tags is None:
        categories = features.sparkSession.range(1).select(
            F.lit(0).cast("long").alias("category_count")
        )
        unresolved = features.sparkSession.range(1).select(
            F.lit(0).cast("long").alias("unresolved_entries")
        )
    else:
        categories = uses.join(active_tags, "tag").agg(F.count_distinct("category").alias("category_count"))
        unresolved = (
            features.select("entry_index", F.explode("tags").alias("tag"))
            .join(active_tags.select("tag"), "tag", "left_anti")
            .agg(F.count_distinct("entry_index").alias("unresolved_entries"))
        )
    row = base.crossJoin(tagged).crossJoin(entropy).crossJoin(dup).crossJoin(categories).crossJoin(unresolved)
    coverage = _share(F.col("tagged_entries"), n)
    dup_rate = _share(F.col("duplicate_entries"), n)
    one = F.lit(1.0)
    score = (
        F.lit(8.0) * F.least(F.col("unique_system_prompts") / F.least(n, F.lit(10)), one)
        + F.lit(6.0) * coverage
        + F.lit(5.0) * F.col("tag_entropy")
        + F.lit(3.0) * F.least(F.col("category_count") / 4.0, one)
        + F.lit(3.0) * (one - F.least(dup_rate / 0.25, one))
        - F.lit(2.0) * F.least(_share(F.col("unresolved_entries"), n), one)
    )
    return row.select(
        F.when(n > 0, _clamp(score, 25)).otherwise(0.0).alias("score"),
        "total_entries",
        "unique_system_prompts",
        _share(F.col("unique_system_prompts"), n).alias("system_prompt_diversity_ratio"),
        (coverage * 100).alias("tag_coverage_percent"),
        "tag_entropy",
        "category_count",
        "duplicate_entries",
        "unresolved_entries",
    )


# --- structure ------------------------------------------------------------------------------


def structure_rows(analyzed: DataFrame) -> DataFrame:
    """Per-entry inputs of the structure score, from analyzed entries."""
    flagged = F.exists("diagnostics", lambda d: d["code"].isin(*STRUCTURE_FLAG_CODES))
    return analyzed.select(
        "entry_index",
        en.entry_id().alias("entry_id"),
        "is_valid",
        flagged.alias("flagged"),
        en.exchanges().alias("exchanges"),
        F.length(tx.strip(en.system_prompt())).alias("prompt_chars"),
    )


def structure(rows: DataFrame) -> DataFrame:
    """One row from ``(is_valid, exchanges, prompt_chars)``."""
    n = F.count(F.lit(1))
    ex, chars = F.col("exchanges"), F.col("prompt_chars")
    agg = rows.agg(
        n.alias("n"),
        F.count_if(~F.col("is_valid")).alias("invalid_entry_count"),
        _share(F.coalesce(F.sum("exchanges"), F.lit(0)), n).alias("avg_exchange_count"),
        F.count_if(ex <= 1).alias("bucket_1"),
        F.count_if(ex == 2).alias("bucket_2"),
        F.count_if(ex.between(3, 7)).alias("bucket_3_7"),
        F.count_if(ex >= 8).alias("bucket_8"),
        F.count_if((chars > 0) & (chars < 50)).alias("short_system_prompt_count"),
        F.count_if(chars == 0).alias("missing_system_prompt_count"),
    )
    n = F.col("n")
    passed = _share(n - F.col("invalid_entry_count"), n)
    optimal = _share(F.col("bucket_3_7"), n)
    present = n - F.col("missing_system_prompt_count")
    adequate = present - F.col("short_system_prompt_count")
    score = (
        F.lit(10.0) * passed
        + F.lit(8.0) * optimal
        + F.lit(3.0) * _share(present, n)
        + F.lit(4.0) * _share(adequate, n)
    )
    return agg.select(
        F.when(n > 0, _clamp(score, 25)).otherwise(0.0).alias("score"),
        (passed * 100).alias("validation_pass_rate"),
        "invalid_entry_count",
        "avg_exchange_count",
        "bucket_1", "bucket_2", "bucket_3_7", "bucket_8",
        (optimal * 100).alias("in_optimal_range_percent"),
        "short_system_prompt_count",
        "missing_system_prompt_count",
    )


# --- metadata ----------------------------------------------------------------------------------


def metadata_integrity(features: DataFrame, *, mapped_uuids: DataFrame | None = None,
                       sidecar: DataFrame | None = None, active_tags: DataFrame | None = None) -> DataFrame:
    """One row. ``mapped_uuids`` is the sidecar's mapping rows (``entry_uuid``),
    joined semi so its size does not matter; ``sidecar`` is at most one row of
    ``(entry_count, dataset_uuid)``."""
    spark = features.sparkSession
    base = features.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce("native", F.lit(False))).alias("native_n"),
        F.when(F.min("dataset_uuid") == F.max("dataset_uuid"), F.min("dataset_uuid")).alias("dataset_uuid"),
    )
    tagged = usable_tags(features, active_tags).agg(F.count_distinct("entry_index").alias("tagged_n"))
    if mapped_uuids is None:
        mapped = spark.range(1).select(F.lit(0).cast("long").alias("mapped_n"), F.lit(False).alias("mappings_apply"))
    else:
        hit = features.where(F.col("entry_uuid").isNotNull()).join(
            mapped_uuids.select("entry_uuid"), "entry_uuid", "left_semi"
        )
        mapped = hit.agg(F.count_distinct("entry_uuid").alias("mapped_n")).crossJoin(
            mapped_uuids.agg((F.count(F.lit(1)) > 0).alias("mappings_apply"))
        )
    if sidecar is None:
        side = spark.range(1).select(
            F.lit(False).alias("sidecar_present"), F.lit(None).cast("long").alias("entry_count"),
            F.lit(None).cast("string").alias("side_uuid"),
        )
    else:
        side = sidecar.agg(  # several documents of one dataset carry the same header
            (F.count(F.lit(1)) > 0).alias("sidecar_present"),
            F.max("entry_count").cast("long").alias("entry_count"),
            F.max("dataset_uuid").alias("side_uuid"),
        )
    row = base.crossJoin(tagged).crossJoin(mapped).crossJoin(side)
    n = F.col("n")
    current = (
        F.col("sidecar_present")
        & F.coalesce(F.col("entry_count") == n, F.lit(False))
        & (F.col("dataset_uuid").isNull() | F.col("dataset_uuid").eqNullSafe(F.col("side_uuid")))
    )
    native, tag_share = _share(F.col("native_n"), n), _share(F.col("tagged_n"), n)
    mapping = F.when(F.col("mappings_apply"), _share(F.col("mapped_n"), n)).otherwise(1.0)
    score = (
        F.lit(8.0) * native
        + F.lit(7.0) * tag_share
        + F.lit(5.0) * mapping
        + F.when(F.col("sidecar_present"), 2.0).otherwise(0.0)
        + F.when(current, 3.0).otherwise(0.0)
    )
    return row.select(
        F.when(n > 0, _clamp(score, 25)).otherwise(0.0).alias("score"),
        (native * 100).alias("native_stamp_percent"),
        (tag_share * 100).alias("tagged_entry_percent"),
        F.when(n > 0, mapping * 100).otherwise(0.0).alias("character_mapping_percent"),
        "sidecar_present",
        current.alias("sidecar_current"),
    )


# --- narrative ------------------------------------------------------------------------------------


def dialogue_ratio() -> Column:
    """Quoted characters over stripped assistant text, capped at 1."""
    def ratio(text):
        length = F.length(tx.strip(text))
        quoted = F.aggregate(
            F.regexp_extract_all(text, F.lit(QUOTE_PATTERN), F.lit(1)),
            F.lit(0).cast("long"),
            lambda acc, q: acc + F.length(q),
        )
        escaped = F.floor((F.length(text) - F.length(F.replace(text, F.lit('\\"'), F.lit("")))) / 2)
        used = tx.bind(quoted, lambda n: F.when((n == 0) & (escaped > 0), escaped * 2).otherwise(n))
        return F.when(length == 0, F.lit(0.0)).otherwise(F.least(used / length, F.lit(1.0)))

    return tx.bind(F.array_join(en.role_contents("assistant"), "\n"), ratio)


def dialogue_ratios(entries: DataFrame) -> DataFrame:
    return entries.select("entry_index", en.entry_id().alias("entry_id"), dialogue_ratio().alias("ratio"))


def narrative_insight(ratios: DataFrame) -> DataFrame:
    mean = ratios.agg(F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("dialogue_ratio"))
    label = None
    for bound, name in SPECTRUM:
        cond = F.col("dialogue_ratio") < bound
        label = F.when(cond, name) if label is None else label.when(cond, name)
    return mean.withColumn("spectrum_label", label.otherwise(SPECTRUM_TOP))


def dialogue_histogram(ratios: DataFrame) -> DataFrame:
    """Five bins, empty ones kept: one row of counters turned into five."""
    r = F.col("ratio")
    counts = ratios.agg(
        F.array(
            *[
                F.struct(F.lit(label).alias("density"), F.count_if((r >= lo) & (r < hi)).alias("entries"))
                for label, lo, hi in RATIO_BINS
            ]
        ).alias("bins")
    )
    return counts.select(F.inline("bins"))


# --- composite ---------------------------------------------------------------------------------------

DIMENSIONS = ("response_quality", "diversity", "structure", "metadata_integrity")


def quality_report(response: DataFrame, divers: DataFrame, struct: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row: composite score, grade and the four reports as structs."""
    parts = dict(zip(DIMENSIONS, (response, divers, struct, metadata)))
    row = None
    for name, df in parts.items():
        one = df.select(F.struct("*").alias(name))
        row = one if row is None else row.crossJoin(one)
    total = sum(F.round(F.col(f"{name}.score"), 2) for name in DIMENSIONS)
    score = _clamp(total, 100)
    return row.select(score.alias("composite_score"), grade(score).alias("grade"), *DIMENSIONS)


def recommendations(report: DataFrame, limit: int = 5) -> DataFrame:
    """Advice for a weak report: sub-scores under 18, lowest first; the lowest
    three when none is; nothing from a composite of 70 on."""
    tips = {
        "response_quality": "Lengthen short assistant responses",
        "diversity": "Vary prompts, tag entries and review near duplicates",
        "structure": "Fix invalid entries and aim for 3-7 exchanges",
        "metadata_integrity": "Tag entries and refresh their stamps",
    }
    rows = report.where(F.col("composite_score") < 70).select(
        F.posexplode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("dimension"),
                        F.col(f"{name}.score").alias("score"),
                        F.lit(tips[name]).alias("action"),
                    )
                    for name in DIMENSIONS
                ]
            )
        ).alias("pos", "r"),
        F.least(*[F.col(f"{name}.score") for name in DIMENSIONS]).alias("lowest"),
    )
    # four rows in all: ordering them is not a scale concern
    low = rows.where((F.col("lowest") >= 18) | (F.col("r.score") < 18))
    return (
        low.orderBy("r.score", "pos")
        .select("r.dimension", "r.score", "r.action", "lowest", "pos")
        .withColumn("rank", F.expr("row_number() over (order by score, pos)"))
        .where(F.when(F.col("lowest") >= 18, F.col("rank") <= 3).otherwise(F.col("rank") <= limit))
        .select("rank", "dimension", "score", "action")
    )


def flagged_entries(features: DataFrame, structure_in: DataFrame, duplicate_entries: DataFrame, *,
                    active_tags: DataFrame | None = None, mapped_uuids: DataFrame | None = None) -> DataFrame:
    """Long table ``(dimension, reason, entry_index)``, one row per finding."""
    tagged = lambda dim, reason, df: df.select(
        F.lit(dim).alias("dimension"), F.lit(reason).alias("reason"), "entry_index"
    )
    out = [
        tagged("response_quality", "weak_response", response_flags(features)),
        tagged("diversity", "near_duplicate", duplicate_entries.select("entry_index").distinct()),
        tagged("structure", "invalid", structure_in.where(~F.col("is_valid"))),
        tagged("structure", "short_prompt", structure_in.where(F.col("prompt_chars").between(1, 49))),
        tagged("structure", "missing_prompt", structure_in.where(F.col("prompt_chars") == 0)),
        tagged("structure", "diagnostic", structure_in.where("flagged")),
        tagged("metadata_integrity", "not_native", features.where(~F.coalesce("native", F.lit(False)))),
    ]
    if active_tags is None:
        out.append(tagged("metadata_integrity", "untagged", features.where(F.size("tags") == 0)))
    else:
        used = usable_tags(features, active_tags).select("entry_index").distinct()
        out.append(tagged("metadata_integrity", "untagged", features.join(used, "entry_index", "left_anti")))
        unresolved = (
            features.select("entry_index", F.explode("tags").alias("tag"))
            .join(active_tags.select("tag"), "tag", "left_anti")
            .select("entry_index")
            .distinct()
        )
        out.append(tagged("diversity", "unresolved_tag", unresolved))
    if mapped_uuids is not None:
        # without any mapping the dimension does not apply
        some = mapped_uuids.agg((F.count(F.lit(1)) > 0).alias("_some")).where("_some")
        unmapped = features.join(mapped_uuids.select("entry_uuid"), "entry_uuid", "left_anti")
        out.append(tagged("metadata_integrity", "unmapped", unmapped.crossJoin(F.broadcast(some))))
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return rows
