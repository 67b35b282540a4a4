"""Prompt compilation for a table of generation configs.

``configs`` has one row per prompt to build; ``mappings`` and ``chunks`` are the
template registry. All configs are compiled in one join and one aggregate.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

VARIABLES = (
    "additional_instructions", "content_instructions", "custom_system_prompt",
    "entry_count", "exchange_count", "output_delivery_mode", "style",
    "system_prompt_mode", "template_id", "tone",
)
CONDITIONS = ("system_prompt_mode", "output_delivery_mode", "style", "tone")


def config_errors() -> Column:
    blank = lambda name: tx.is_blank(F.col(name))
    return F.array_compact(
        F.array(
            F.when(F.col("entry_count") < 1, "entry_count"),
            F.when(F.col("exchange_count") < 1, "exchange_count"),
            F.when(blank("content_instructions"), "content_instructions"),
            F.when((F.col("system_prompt_mode") == "custom") & blank("custom_system_prompt"), "custom_system_prompt"),
        )
    )


def _variable(name: str) -> Column:
    return tx.strip(F.coalesce(F.col(name).cast("string"), F.lit("")))


def compile_prompts(configs: DataFrame, mappings: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(config_id, prompt, errors)`` per config.

    A chunk is used when it is active and its condition is absent or equal to
    the config's value. Chunks are ordered by (sort_order, id), placeholders are
    replaced in name order, and parts are separated by a blank line.
    """
    extra = _variable("additional_instructions") != ""
    conditions = F.create_map(
        *[x for c in CONDITIONS for x in (F.lit(c), _variable(c))],
        F.lit("has_additional_instructions"), F.when(extra, "true").otherwise(""),
    )
    cfg = configs.withColumn("errors", config_errors()).withColumn("_cond", conditions)
    live = chunks.where("is_active").select(F.col("slug").alias("chunk_slug"), "chunk_text")
    parts = mappings.join(live, "chunk_slug")
    joined = cfg.where(F.size("errors") == 0).join(parts, "template_id").where(
        F.col("condition_key").isNull()
        | F.coalesce(F.element_at("_cond", F.col("condition_key")) == F.col("condition_value"), F.lit(False))
    )
    text = F.col("chunk_text")
    for name in VARIABLES:
        text = F.replace(text, F.lit("{{ " + name + " }}"), _variable(name))
    missing = F.col("is_required") & (F.coalesce("chunk_text", F.lit("")) == "")
    built = joined.groupBy("config_id").agg(
        F.sort_array(F.collect_list(F.struct("sort_order", "id", F.coalesce(text, F.lit("")).alias("t")))).alias("ps"),
        F.count_if(missing).alias("missing"),
    )
    return cfg.select("config_id", "errors").join(built, "config_id", "left").select(
        "config_id",
        F.when(
            (F.size("errors") == 0) & (F.coalesce("missing", F.lit(1)) == 0),
            F.array_join(F.transform("ps", lambda p: p["t"]), "\n\n"),
        ).alias("prompt"),
        F.when(F.size("errors") > 0, F.col("errors"))
        .when(F.col("ps").isNull(), F.array(F.lit("no chunks")))
        .when(F.col("missing") > 0, F.array(F.lit("required chunk without text")))
        .otherwise(F.array().cast("array<string>"))
        .alias("errors"),
    )
