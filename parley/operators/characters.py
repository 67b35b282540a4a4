"""Characters behind custom role names, and their turn mappings.

Frames:
    characters  slug, display_name, description, is_active
    mappings    entry_uuid, turn_index, character_slug, training_role,
                source_role_label        unique by (entry_uuid, turn_index)

Characters are few; mappings grow with the entries and are only ever joined by
keys, never collected.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.roles import standard_role
from . import entries as en
from .formats import custom_role_pattern, custom_role_turns
from .multisearch import find_needles
from .normalize import ensure_entry_uuid, tag_display_name

TRAINING_ROLES = ("user", "assistant")
MAPPING_COLUMNS = (
    "entry_uuid", "turn_index", "character_slug", "training_role", "source_role_label",
)


def character_candidates(entries: DataFrame, *, preview_chars: int = 140) -> DataFrame:
    """Custom role labels with counts, the suggested role and a preview.

    Turn locations stay in ``custom_role_turns``; here only counts and the first
    location are aggregated, so a label on a third of all turns is a number.
    """
    turns = custom_role_turns(entries).withColumn("slug", tx.slug(F.col("label"))).where(F.col("slug") != "")
    found = turns.groupBy("label", "slug").agg(
        F.count_distinct("entry_id").alias("entries"),
        F.count(F.lit(1)).alias("occurrences"),
        F.min(F.struct("entry_index", "turn_index")).alias("first_at"),
    )
    suggested = custom_role_pattern(custom_role_turns(entries)).withColumnRenamed("role", "suggested_role")
    first = found.select("label", "first_at.entry_index", "first_at.turn_index")
    texts = entries.select("entry_index", "messages").join(first, "entry_index").select(
        "label", tx.strip(F.get("messages", F.col("turn_index"))["content"]).alias("preview")
    )
    preview = (
        F.when(F.coalesce("preview", F.lit("")) == "", "Blank turn")
        .when(F.length("preview") <= preview_chars, F.col("preview"))
        .otherwise(F.substring("preview", 1, preview_chars))
    )
    return (
        found.join(suggested, "label", "left")
        .join(texts, "label", "left")
        .select(
            "label", F.col("slug").alias("suggested_slug"),
            tag_display_name(F.col("slug")).alias("suggested_name"),
            F.coalesce("suggested_role", F.lit("user")).alias("default_role"),
            "suggested_role", "entries", "occurrences", preview.alias("preview"),
        )
    )


def known_character_roles(characters: DataFrame, mappings: DataFrame) -> DataFrame:
    """``(key, character_slug, training_role)`` for labels and display names
    that stand for exactly one active character in exactly one role."""
    live = characters.where("is_active").select(F.col("slug").alias("character_slug"), "display_name")
    # distinct labels before the join: mappings grow with the data, labels do not
    labels = (
        mappings.where(F.col("training_role").isin(*TRAINING_ROLES))
        .select("character_slug", "training_role", "source_role_label")
        .distinct()
        .join(live, "character_slug")
    )
    keys = labels.select(
        "character_slug", "training_role",
        F.explode(F.array("source_role_label", "display_name")).alias("name"),
    ).select("character_slug", "training_role", tx.casefold(tx.strip(F.col("name"))).alias("key"))
    return (
        keys.where(F.coalesce("key", F.lit("")) != "")
        .groupBy("key")
        .agg(
            F.min("character_slug").alias("character_slug"),
            F.min("training_role").alias("training_role"),
            (F.count_distinct("character_slug") + F.count_distinct("training_role")).alias("n"),
        )
        .where(F.col("n") == 2)
        .drop("n")
    )


def _rewrite(entries: DataFrame, rules: DataFrame, fold: bool):
    """Rewrite roles by ``rules(key, character_slug, training_role)``.

    Returns ``(entries, mapping rows)``. Turns with a custom label are joined
    with the rules by key and come back as a map of their entry's own turns; the
    optimizer broadcasts whichever side is small.
    """
    name = lambda m: F.coalesce(m["role"], F.get_json_object(m["other"], "$.role"))
    key_of = lambda label: tx.casefold(tx.strip(label)) if fold else tx.strip(label)
    custom = lambda m: m["is_obj"] & ((standard_role(m["role"]).isNull() & m["role"].isNotNull()) if fold else name(m).isNotNull())
    identified = ensure_entry_uuid(entries)
    turns = identified.select("source", "entry_index", F.posexplode("messages").alias("pos", "m")).where(custom(F.col("m")))
    found = (
        turns.select("source", "entry_index", "pos", key_of(name(F.col("m"))).alias("key"))
        .join(rules, "key")
        .groupBy(F.col("source").alias("_source"), F.col("entry_index").alias("_index"))
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("pos", F.struct("character_slug", "training_role")))
            ).alias("_by_pos")
        )
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("entry_index") == F.col("_index"))
    noted = identified.join(found, same, "left").withColumn(
        "_hits", F.transform("messages", lambda m, i: F.element_at("_by_pos", i))
    )
    touched = F.exists("_hits", lambda h: h.isNotNull())
    out = noted.withColumn(
        "messages",
        F.when(
            touched,
            F.transform(
                F.arrays_zip("messages", "_hits"),
                lambda z: en.with_fields(
                    z["messages"], role=F.coalesce(z["_hits"]["training_role"], z["messages"]["role"])
                ),
            ).cast(en.MESSAGES_TYPE),
        ).otherwise(F.col("messages")),
    )
    rows = (
        noted.select(
            F.col("meta.entry_uuid").alias("entry_uuid"),
            F.posexplode(F.arrays_zip("messages", "_hits")).alias("turn_index", "z"),
        )
        .where(F.col("z._hits").isNotNull())
        .select(
            "entry_uuid", "turn_index",
            F.col("z._hits.character_slug").alias("character_slug"),
            F.col("z._hits.training_role").alias("training_role"),
            tx.strip(name(F.col("z.messages"))).alias("source_role_label"),
        )
    )
    return out.select(*entries.columns), rows


def normalize_known_characters(entries: DataFrame, characters: DataFrame, mappings: DataFrame):
    """Replace role names of known characters. ``(entries, mapping rows)``."""
    return normalize_character_roles(entries, known_character_roles(characters, mappings))


def normalize_character_roles(entries: DataFrame, rules: DataFrame):
    """The same by ``known_character_roles`` that were worked out before, once for a whole stream."""
    return _rewrite(entries, rules, fold=True)


def mapping_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_distinct("entry_uuid").alias("changed_entries"), F.count(F.lit(1)).alias("changed_turns")
    )


def apply_character_mapping(entries: DataFrame, characters: DataFrame, roles: dict):
    """Apply a chosen ``{label: user|assistant}`` to matching turns.

    Returns ``(entries, mapping rows, characters)``, the last with a new
    character for every label whose slug is not there yet.
    """
    bad = [k for k, v in roles.items() if not k.strip() or v not in TRAINING_ROLES]
    if not roles or bad:
        raise ValueError(f"invalid role mapping: {bad}")
    spark = entries.sparkSession
    rules = (
        spark.createDataFrame([(k.strip(), v) for k, v in roles.items()], "key string, training_role string")
        .withColumn("character_slug", tx.slug(F.col("key")))
        .where(F.col("character_slug") != "")
    )
    out, rows = _rewrite(entries, rules.select("key", "character_slug", "training_role"), fold=False)
    new = (
        rules.select(F.col("character_slug").alias("slug"))
        .distinct()
        .join(characters.select("slug"), "slug", "left_anti")
        .select(
            "slug", tag_display_name(F.col("slug")).alias("display_name"),
            F.lit(None).cast("string").alias("description"), F.lit(True).alias("is_active"),
        )
    )
    return out, rows, characters.unionByName(new)


def _active_only(rows: DataFrame, characters: DataFrame) -> DataFrame:
    live = characters.where("is_active").select(F.col("slug").alias("character_slug"))
    return rows.join(live, "character_slug", "left_semi").select(*MAPPING_COLUMNS)


def replace_mappings(mappings: DataFrame, new_rows: DataFrame, characters: DataFrame) -> DataFrame:
    """New rows replace all turns of the entries they mention."""
    kept = mappings.join(new_rows.select("entry_uuid").distinct(), "entry_uuid", "left_anti")
    return kept.select(*MAPPING_COLUMNS).unionByName(_active_only(new_rows, characters))


def upsert_mappings(mappings: DataFrame, new_rows: DataFrame, characters: DataFrame) -> DataFrame:
    """New rows replace the same (entry, turn); of repeats the last ``seq`` wins."""
    key = ["entry_uuid", "turn_index"]
    rest = [c for c in MAPPING_COLUMNS if c not in key]
    order = F.col("seq") if "seq" in new_rows.columns else F.struct(*rest)
    live = new_rows.join(
        characters.where("is_active").select(F.col("slug").alias("character_slug")), "character_slug", "left_semi"
    )
    last = live.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
    kept = mappings.join(last.select(*key), key, "left_anti")
    return kept.select(*MAPPING_COLUMNS).unionByName(last.select(*MAPPING_COLUMNS))


def character_usage_counts(characters: DataFrame, mappings: DataFrame) -> DataFrame:
    """Distinct entries per active character, zeros kept."""
    uses = mappings.groupBy("character_slug").agg(F.count_distinct("entry_uuid").alias("n"))
    return (
        characters.where("is_active")
        .join(uses.withColumnRenamed("character_slug", "slug"), "slug", "left")
        .select("slug", F.coalesce("n", F.lit(0)).alias("entries"))
    )


def turn_display_names(turns: DataFrame, characters: DataFrame, mappings: DataFrame, *,
                       user_name: str = "User", assistant_name: str = "Assistant") -> DataFrame:
    """Display name per turn of ``(entry_uuid, turn_index, role)``: the mapped
    character, else the default of the role, else the role label."""
    named = mappings.select("entry_uuid", "turn_index", F.col("character_slug").alias("slug")).join(
        characters.select("slug", "display_name"), "slug"
    )
    role = tx.strip(F.coalesce("role", F.lit("")))
    low = F.lower(role)
    label = (
        F.when(low == "user", user_name)
        .when(low == "assistant", assistant_name)
        .when(low == "system", "System")
        .when(role == "", "?")
        .otherwise(role)
    )
    return turns.join(named.drop("slug"), ["entry_uuid", "turn_index"], "left").withColumn(
        "display_name", F.coalesce("display_name", label)
    )


def entries_for_character(mappings: DataFrame, slug: str) -> DataFrame:
    return mappings.where(F.col("character_slug") == slug).select("entry_uuid").distinct()


def deactivate_characters(characters: DataFrame, mappings: DataFrame, slugs):
    """``(characters, mappings)`` without the turns of the given characters."""
    hit = F.col("slug").isin(*slugs)
    return (
        characters.withColumn("is_active", F.when(hit, False).otherwise(F.col("is_active"))),
        mappings.where(~F.col("character_slug").isin(*slugs)),
    )


def surviving_mappings(mappings: DataFrame, entries: DataFrame):
    """``(kept, dropped ids)`` after entries were merged or deleted."""
    ids = entries.select(en.entry_uuid().alias("entry_uuid")).where(F.col("entry_uuid").isNotNull())
    return (
        mappings.join(ids, "entry_uuid", "left_semi"),
        mappings.join(ids, "entry_uuid", "left_anti").select("entry_uuid").distinct(),
    )


def inactive_references(entries: DataFrame, characters: DataFrame) -> DataFrame:
    """Entries whose first message names an inactive character.

    The names become an automaton that reads each first message once; what leaves
    the scan is one row per entry and name.
    """
    names = (
        characters.where(~F.col("is_active"))
        .select(tx.casefold(tx.strip(F.col("display_name"))).alias("needle"), "display_name")
        .where(F.coalesce("needle", F.lit("")) != "")
    )
    first = F.get("messages", F.lit(0))
    text = F.when(first["is_obj"], tx.casefold(first["content"]))
    rows = en.once(entries, _text=text).select("entry_index", en.entry_uuid().alias("entry_uuid"), "_text").where(
        F.col("entry_uuid").isNotNull() & F.col("_text").isNotNull()
    )
    found = find_needles(rows, names, text="_text").join(names, "needle").select(
        "entry_index", "entry_uuid", F.col("display_name").alias("character")
    )
    return found.withColumn("code", F.lit("character.inactive_reference_in_prompt"))


def character_coverage(entries: DataFrame, characters: DataFrame, mappings: DataFrame):
    """``(totals, rows)``: mapped and unmapped entries; turns per character."""
    live = characters.where("is_active").select(F.col("slug").alias("character_slug"), "display_name")
    ids = entries.select(en.entry_uuid().alias("entry_uuid")).where(F.col("entry_uuid").isNotNull()).distinct()
    used = mappings.join(live, "character_slug").join(ids, "entry_uuid", "left_semi")
    per_entry = used.groupBy("entry_uuid").agg(F.count(F.lit(1)).alias("turns"))
    totals = per_entry.agg(F.count(F.lit(1)).alias("mapped_entries")).crossJoin(
        ids.agg(F.count(F.lit(1)).alias("_n"))
    ).select("mapped_entries", (F.col("_n") - F.col("mapped_entries")).alias("unmapped_entries"))
    rows = used.groupBy("display_name").agg(F.count(F.lit(1)).alias("mapped_turns"))
    return totals, rows
