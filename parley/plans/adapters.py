"""Entries and registries derived from the given tables.

The recipes are plain expressions on ids, written the same way in the SQL that
checks them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import entries as en
from ..operators.normalize import tag_display_name

# --- fixed values: adapter texts ---------------------------------------------------
PROMPT = "You are a caring assistant who answers every question fully."
REFUSAL_PREFIX = "As an AI language model, "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark, sf_dir) -> DataFrame:
    """Flat turns ``(entry_index, turn_index, role, content)``."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("entry_index"), F.col("turn").cast("int").alias("turn_index"),
        "role", F.col("text").alias("content"),
    )


def entries(spark, sf_dir) -> DataFrame:
    return en.turns_to_entries(table(spark, sf_dir, "conversations"))


def entries_sys(spark, sf_dir) -> DataFrame:
    """Entries that all start with a system prompt."""
    return en.turns_to_entries(table(spark, sf_dir, "conversations"), system_prompt_text=PROMPT)


def damage(rows: DataFrame) -> DataFrame:
    """Deterministic faults by ``entry_index % 7``."""
    k = F.col("entry_index") % 7

    def broken(m, i):
        role, text = m["role"], m["content"]
        new_role = (
            F.when(k == 1, F.upper(role))
            .when((k == 2) & (role == "user"), "human")
            .when((k == 2) & (role == "assistant"), "gpt")
            .when((k == 4) & (role == "assistant"), "Emma")
            .otherwise(role)
        )
        new_text = (
            F.when(k == 3, F.concat(F.lit("  "), text, F.lit(" \n")))
            .when((k == 5) & (i == 2), "")
            .when((k == 6) & (role == "assistant"), F.concat(F.lit(REFUSAL_PREFIX), text))
            .otherwise(text)
        )
        return en.with_fields(m, role=new_role, content=new_text)

    return rows.withColumn("messages", F.transform("messages", broken))


def entries_dirty(spark, sf_dir) -> DataFrame:
    return damage(entries_sys(spark, sf_dir))


def with_part_tags(rows: DataFrame, spark, sf_dir) -> DataFrame:
    """Tags from the part whose key is the entry number modulo the part count;
    every fifth entry stays untagged."""
    part = table(spark, sf_dir, "part")
    size = part.agg(F.count(F.lit(1)).alias("_parts"))
    keyed = rows.crossJoin(F.broadcast(size)).withColumn("_key", F.col("entry_index") % F.col("_parts"))
    named = part.select(
        F.col("p_partkey").alias("_key"), F.array("p_type", "p_brand", "p_name").alias("_tags")
    )
    return (
        keyed.join(named, "_key", "left")
        .withColumn("tags", F.when(F.col("entry_index") % 5 == 0, en.empty_strings()).otherwise(F.col("_tags")))
        .drop("_key", "_parts", "_tags")
    )


def entries_tagged(spark, sf_dir) -> DataFrame:
    return with_part_tags(entries_sys(spark, sf_dir), spark, sf_dir)


def with_slug_tags(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tags", F.array_distinct(F.transform("tags", tx.slug)))


def documents_as_texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_index"), "text")


# --- records as JSON text ---------------------------------------------------------------


def records(spark, sf_dir) -> DataFrame:
    """``(entry_index, source, record)``: JSON text of dirty entries, with one
    kind of fault per ``entry_index % 10``."""
    rows = with_part_tags(entries_dirty(spark, sf_dir), spark, sf_dir)
    turns = F.transform(
        "messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value"))
    )
    rows = (
        rows.withColumn("text", en.entry_json())
        .withColumn("body", F.substr("text", F.lit(2), F.length("text") - 2))
        .withColumn("head", F.substring_index("body", ',"tags":', 1))
        .withColumn("share", F.to_json(F.struct(turns.alias("conversations"))))
    )
    text, messages = F.col("text"), F.col("head")
    share = F.substr("share", F.lit(2))
    k = F.col("entry_index") % 10
    wrap = lambda *parts: F.concat(F.lit("{"), *parts, F.lit("}"))
    record = (
        F.when(k == 0, wrap(messages))
        .when(k == 1, wrap(messages, F.lit(',"tags":"x"')))
        .when(k == 2, wrap(messages, F.lit(',"tags":[1,"a",""," b "]')))
        .when(k == 3, F.lit('{"messages":"none","tags":[]}'))
        .when(k == 4, F.lit('{"tags":["a"],"extra":1,"id":7}'))
        .when(k == 5, F.lit("17"))
        .when(k == 6, wrap(messages, F.lit(',"tags":[],"zeta":{"a":[1]},"alpha":null')))
        .when(k == 7, F.concat(F.lit('{"tags":["s"],"origin":"web",'), share))
        .when(k == 8, F.concat(F.lit("{"), messages))
        .otherwise(text)
    )
    return en.once(rows, record=record).select("entry_index", F.lit("table").alias("source"), "record")


def sharegpt_records(spark, sf_dir) -> DataFrame:
    """Every dirty entry as a ShareGPT record, field names varying."""
    rows = entries_dirty(spark, sf_dir)
    pick = lambda a, b: F.to_json(
        F.struct(F.transform("messages", lambda m: F.struct(m["role"].alias(a), m["content"].alias(b))).alias("conversations"))
    )
    k = F.col("entry_index") % 3
    record = F.when(k == 0, pick("from", "value")).when(k == 1, pick("role", "content")).otherwise(pick("speaker", "text"))
    return en.once(rows, record=record).select("entry_index", F.lit("table").alias("source"), "record")


# --- registry ------------------------------------------------------------------------


def categories(spark, sf_dir) -> DataFrame:
    """Three categories, as many rows as the part table has tag columns."""
    row = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    items = F.array(
        *[
            F.struct(F.lit(s).alias("slug"), F.lit(n).alias("name"), F.lit(i).alias("sort_order"), F.lit(True).alias("is_active"))
            for i, (s, n) in enumerate((("kind", "Kind"), ("brand", "Brand"), ("name", "Name")))
        ]
    )
    return row.select(F.inline(items))


def slug_universe(spark, sf_dir) -> DataFrame:
    """Distinct tag slugs of the part table with their category."""
    part = table(spark, sf_dir, "part")
    pairs = F.array(
        F.struct(tx.slug(F.col("p_type")).alias("slug"), F.lit("kind").alias("category_slug")),
        F.struct(tx.slug(F.col("p_brand")).alias("slug"), F.lit("brand").alias("category_slug")),
        F.struct(tx.slug(F.col("p_name")).alias("slug"), F.lit("name").alias("category_slug")),
    )
    # a slug that occurs in two columns belongs to the first category by name
    return part.select(F.inline(pairs)).groupBy("slug").agg(F.min("category_slug").alias("category_slug"))


def _third():
    """Fixed third of the slugs: 0 active, 1 archived, 2 not in the registry."""
    return F.ascii(F.right("slug", F.lit(1))) % 3


def tags(spark, sf_dir) -> DataFrame:
    rows = slug_universe(spark, sf_dir).where(_third() != 2)
    live = _third() == 0
    return rows.select(
        "slug",
        tag_display_name(F.col("slug")).alias("name"),
        F.when(live, F.col("category_slug")).alias("category_slug"),
        F.lit(0).alias("sort_order"),
        F.lit(True).alias("is_active"),
        F.lit(False).alias("is_builtin"),
        F.when(live, "active").otherwise("archived").alias("status"),
    )


def lifecycle(spark, sf_dir) -> DataFrame:
    """Alias rows brand_k -> brand_{k+1} for k in 1..5, for brands that exist,
    and a delete row for unknown slugs of even length that end in ``e``."""
    universe = slug_universe(spark, sf_dir)
    number = F.regexp_extract("slug", r"^brand_(\d)$", 1)
    alias = universe.where(number.isin("1", "2", "3", "4", "5")).select(
        number.cast("long").alias("id"), F.lit("rename").alias("action"), F.col("slug").alias("old_slug"),
        F.concat(F.lit("brand_"), (number.cast("int") + 1).cast("string")).alias("new_slug"),
        F.lit("{}").alias("metadata_json"),
    )
    gone = universe.where((_third() == 2) & F.col("slug").endswith("e") & (F.length("slug") % 2 == 0)).select(
        F.lit(100).cast("long").alias("id"), F.lit("delete").alias("action"), F.col("slug").alias("old_slug"),
        F.lit(None).cast("string").alias("new_slug"), F.lit("{}").alias("metadata_json"),
    )
    return alias.unionByName(gone)


def characters(spark, sf_dir) -> DataFrame:
    """One character per second word of the part names, and Emma; the others
    with four letters are inactive."""
    words = table(spark, sf_dir, "part").select(
        F.explode(F.array(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("Emma"))).alias("w")
    ).distinct()
    return words.select(
        tx.slug(F.col("w")).alias("slug"), F.col("w").alias("display_name"),
        F.lit(None).cast("string").alias("description"),
        ((F.length("w") != 4) | (F.col("w") == "Emma")).alias("is_active"),
    )


def uuid_of(index):
    """Stable test identity of an entry."""
    return F.concat(F.lit("conv-"), index.cast("string"))


def with_uuids(rows: DataFrame) -> DataFrame:
    meta = F.struct(
        F.lit(1).alias("version"), (F.col("entry_index") % 4 != 0).alias("native"),
        F.lit("2024-01-01T00:00:00Z").alias("validated_at"), uuid_of(F.col("entry_index")).alias("entry_uuid"),
        F.lit("dataset-1").alias("dataset_uuid"),
    ).cast(en.META_TYPE)
    return rows.withColumn("meta", meta)


def mappings(spark, sf_dir) -> DataFrame:
    """Emma speaks the assistant turns of damage 4."""
    rows = entries_sys(spark, sf_dir).where(F.col("entry_index") % 7 == 4).select(
        "entry_index", F.posexplode("messages").alias("turn_index", "m")
    )
    return rows.where(F.col("m.role") == "assistant").select(
        uuid_of(F.col("entry_index")).alias("entry_uuid"), "turn_index", F.lit("emma").alias("character_slug"),
        F.lit("assistant").alias("training_role"), F.lit("Emma").alias("source_role_label"),
    )
