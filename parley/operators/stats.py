"""Dataset statistics and the small tables the insight pages show."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import entries as en
from .features import prompt_key, short_key


def _ratio(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _percent_text(percent):
    """One decimal, ties to even on the binary value."""
    return F.concat(F.format_number(percent, 1), F.lit("%"))


def dataset_stats(features: DataFrame) -> DataFrame:
    """One row of totals and averages; zeros for an empty dataset."""
    total = F.count(F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    s = lambda c: zero(F.sum(c))
    return features.agg(
        total.alias("total"),
        s("exchanges").alias("total_exchanges"),
        _ratio(s("exchanges"), total).alias("avg_exchanges"),
        F.count_if(F.col("exchanges") == 1).alias("single_turn"),
        F.count_if(F.col("exchanges") > 1).alias("multi_turn"),
        _ratio(s("user_chars"), s("user_n")).alias("avg_user_len"),
        _ratio(s("asst_chars"), s("asst_n")).alias("avg_asst_len"),
        _ratio(s("text_chars"), total).alias("avg_entry_len"),
        zero(F.min("asst_min_chars")).alias("min_asst_len"),
        zero(F.max("asst_max_chars")).alias("max_asst_len"),
    )


def validity_counts(analyzed: DataFrame) -> DataFrame:
    return analyzed.agg(
        F.count_if("is_valid").alias("valid_count"),
        F.count_if(~F.col("is_valid")).alias("invalid_count"),
    )


def exchange_distribution(features: DataFrame) -> DataFrame:
    return features.groupBy("exchanges").agg(F.count(F.lit(1)).alias("entries"))


def exchange_depth_rows(features: DataFrame) -> DataFrame:
    """The distribution with 8 and more folded into one row."""
    depth = F.least(F.col("exchanges"), F.lit(8))
    counts = features.groupBy(depth.alias("depth")).agg(F.count(F.lit(1)).alias("entries"))
    return counts.select(
        F.when(F.col("depth") == 8, "8+").otherwise(F.col("depth").cast("string")).alias("exchange_count"),
        "entries",
        F.when(F.col("depth").between(3, 7), "Optimal 3-7").otherwise("Review").alias("range"),
    )


def response_length_distribution(answer_words: DataFrame) -> DataFrame:
    return answer_words.groupBy("words").agg(F.count(F.lit(1)).alias("messages"))


def split_candidates(features: DataFrame, exchanges: int = 8) -> DataFrame:
    return features.where(F.col("exchanges") >= exchanges)


# --- tags ---------------------------------------------------------------------------


def tag_rows(entries: DataFrame) -> DataFrame:
    """One row per tag occurrence of entries whose tag list is all text."""
    return entries.select("entry_index", F.posexplode(en.clean_tags()).alias("pos", "tag"))


def tag_counts(entries: DataFrame) -> DataFrame:
    return tag_rows(entries).groupBy("tag").agg(F.count(F.lit(1)).alias("uses"))


def tag_category_counts(entries: DataFrame, categories: DataFrame) -> DataFrame:
    """Occurrences per category; tags are counted first, so the join sees one
    row per distinct tag. ``categories`` has ``tag`` and ``category``."""
    return (
        tag_counts(entries)
        .join(categories.select("tag", "category"), "tag", "left")
        .groupBy(F.coalesce("category", F.lit("Unknown")).alias("category"))
        .agg(F.sum("uses").alias("uses"))
    )


def tag_totals(entries: DataFrame) -> DataFrame:
    untagged = entries.agg(F.count_if(F.size(en.clean_tags()) == 0).alias("untagged_count"))
    unique = tag_counts(entries).agg(F.count(F.lit(1)).alias("unique_tags"))
    return untagged.crossJoin(unique)


def top_tags(entries: DataFrame, k: int = 5) -> DataFrame:
    """Most used tags, each counted once per entry, with their share of the
    tagged entries; ties go to the tag that appears first."""
    named = F.filter(F.transform("tags", tx.strip), lambda t: t.isNotNull() & (t != ""))
    per_entry = entries.select("entry_index", F.array_distinct(named).alias("ts")).where(F.size("ts") > 0)
    tagged = per_entry.agg(F.count(F.lit(1)).alias("tagged"))
    ranked = (
        per_entry.select("entry_index", F.posexplode("ts").alias("pos", "tag"))
        .groupBy("tag")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.min(F.struct("entry_index", "pos")).alias("first_at"),
        )
        .orderBy(F.desc("entries"), "first_at")
        .limit(k)
    )
    return ranked.crossJoin(F.broadcast(tagged)).select(
        "tag",
        "entries",
        _percent_text(F.col("entries") / F.col("tagged") * 100).alias("share"),
    )


# --- prompts and narrative ---------------------------------------------------------------


def prompt_concentration(features: DataFrame) -> DataFrame:
    return (
        features.where(F.col("prompt_key").isNotNull())
        .groupBy("prompt_key")
        .agg(F.count(F.lit(1)).alias("entries"))
        .select(short_key("prompt_key").alias("prompt_key"), "entries")
    )


def truncate_text(col, limit: int = 100):
    clean = tx.collapse(col)
    cut = F.concat(F.rtrim(F.substring(clean, 1, limit - 1)), F.lit("..."))
    return F.when(F.length(clean) <= limit, clean).otherwise(cut)


def prompt_rows(turns: DataFrame, features: DataFrame) -> DataFrame:
    """Prompt text, entries and share per distinct prompt; ``dominant`` marks a
    prompt used by more than four fifths of the entries."""
    prompts = turns.where((F.col("turn_index") == 0) & (F.col("role") == "system")).select(
        "entry_index",
        prompt_key(F.col("content")).alias("prompt_key"),
        truncate_text(F.col("content")).alias("prompt"),
    )
    total = features.agg(F.count(F.lit(1)).alias("total"))
    return (
        prompts.where(F.col("prompt_key").isNotNull())
        .groupBy("prompt_key")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.min(F.struct("entry_index", "prompt")).getField("prompt").alias("prompt"),
        )
        .crossJoin(F.broadcast(total))
        .select(
            short_key("prompt_key").alias("prompt_key"),
            "prompt",
            "entries",
            _percent_text(F.col("entries") / F.col("total") * 100).alias("share"),
            (F.col("entries") / F.col("total") > 0.8).alias("dominant"),
        )
    )
