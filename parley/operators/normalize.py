"""Role, content, tag and identity normalization. Projections only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.constants import UPPERCASE_TAG_WORDS
from ..functions.roles import expected_role, standard_role
from .entries import (
    MESSAGES_TYPE,
    META_TYPE,
    empty_messages,
    empty_strings,
    entry_uuid,
    message,
    with_fields,
)


def _repositioned(m: Column, i: Column) -> Column:
    """Role after positional repair: only a spelling of the expected role changes."""
    std = standard_role(m["role"])
    return F.when(m["is_obj"] & (std == expected_role(i)), std).otherwise(m["role"])


def _trimmed(m: Column) -> Column:
    return F.when(m["is_obj"], tx.strip(m["content"])).otherwise(m["content"])


def normalized_messages(col: Column) -> Column:
    return F.transform(
        col, lambda m, i: with_fields(m, role=_repositioned(m, i), content=_trimmed(m))
    )


def positional_messages(col: Column) -> Column:
    return F.transform(col, lambda m, i: with_fields(m, role=_repositioned(m, i)))


def trimmed_messages(col: Column) -> Column:
    return F.transform(col, lambda m: with_fields(m, content=_trimmed(m)))


def changed_between(before: Column, after: Column, field: str) -> Column:
    """How many messages differ in one field between two aligned lists."""
    pairs = F.arrays_zip(before.alias("a"), after.alias("b"))
    return F.coalesce(
        F.size(F.filter(pairs, lambda p: ~p["a"][field].eqNullSafe(p["b"][field]))),
        F.lit(0),
    )


def normalize_roles(entries: DataFrame) -> DataFrame:
    """Positional role repair, with ``roles_normalized`` per entry."""
    out = entries.withColumn("_m", positional_messages(F.col("messages")))
    return _finish_messages(out, {"roles_normalized": "role"})


def trim_content(entries: DataFrame) -> DataFrame:
    """Strip message text, with ``contents_trimmed`` per entry."""
    out = entries.withColumn("_m", trimmed_messages(F.col("messages")))
    return _finish_messages(out, {"contents_trimmed": "content"})


def _finish_messages(df: DataFrame, counters: dict) -> DataFrame:
    for name, field in counters.items():
        df = df.withColumn(
            name,
            F.when(F.col("messages").isNull(), 0).otherwise(
                changed_between(F.col("messages"), F.col("_m"), field)
            ),
        )
    return df.withColumn("messages", F.col("_m")).drop("_m")


def _without_key(name: str) -> Column:
    return F.map_filter("extras", lambda k, _: k != name)


def normalize_baseline(entries: DataFrame) -> DataFrame:
    """The always-safe pass: roles, trimmed content, cleaned tag list.

    The pass is idempotent, so one projection is its own fixpoint. Counter
    columns: ``roles_normalized, contents_trimmed, tags_changed,
    tags_added, structural_changed, dropped_tags, changed``.
    """
    tags, stripped, clean = F.col("tags"), F.col("_s"), F.col("_c")
    not_list = tags.isNull() & F.map_contains_key("extras", F.lit("tags"))
    rows = entries.withColumn("_s", F.transform(tags, tx.strip)).withColumn(
        "_c", F.array_distinct(F.filter("_s", lambda t: t.isNotNull() & (t != "")))
    )
    bad = F.size(F.filter(stripped, lambda t: t.isNull() | (t == "")))
    # a kept tag counts as changed when its first occurrence was padded
    padded = F.size(
        F.filter(
            F.arrays_zip(tags.alias("t"), stripped.alias("s")),
            lambda z: F.coalesce((z["s"] != "") & (z["t"] != z["s"]), F.lit(False)),
        )
    )
    repeats = F.size(tags) - bad - F.size(clean)
    padded_repeats = _later_changed(F.arrays_zip(tags.alias("t"), stripped.alias("s")), stripped)
    dropped = F.array_compact(
        F.transform(
            tags,
            lambda t, i: F.when(t.isNull(), F.get("tags_raw", i)).when(F.get(stripped, i) == "", t),
        )
    )
    obj = F.col("is_object")
    out = (
        rows.withColumn("_m", normalized_messages(F.col("messages")))
        .withColumn("_t", F.when(obj, F.coalesce(clean, empty_strings())).otherwise(tags))
        .withColumn(
            "tags_changed",
            F.when(~obj, 0)
            .when(tags.isNotNull(), bad + repeats + padded - padded_repeats)
            .otherwise(not_list.cast("int")),
        )
        .withColumn("tags_added", (obj & tags.isNull() & ~not_list).cast("int"))
        .withColumn("structural_changed", obj & tags.isNull())
        .withColumn("dropped_tags", F.coalesce(dropped, empty_strings()))
    )
    out = _finish_messages(out, {"roles_normalized": "role", "contents_trimmed": "content"})
    return (
        out.withColumn(
            "changed",
            (F.col("roles_normalized") + F.col("contents_trimmed") > 0)
            | ~F.col("_t").eqNullSafe(F.col("tags")),
        )
        .withColumn("tags", F.col("_t"))
        .withColumn("tags_raw", F.lit(None).cast("array<string>"))
        .withColumn("extras", F.when(obj, _without_key("tags")).otherwise(F.col("extras")))
        .drop("_t", "_s", "_c")
    )


def _later_changed(pairs: Column, keys: Column) -> Column:
    """Changed items that repeat an earlier key; the repeat itself is counted
    elsewhere, so these are taken off again."""
    flags = F.transform(
        pairs,
        lambda z, i: (z["s"] != "") & (z["t"] != z["s"]) & (F.array_position(keys, z["s"]) < i + 1),
    )
    return F.size(F.filter(flags, lambda x: F.coalesce(x, F.lit(False))))


def tag_slugs(tags: Column) -> Column:
    """First-wins distinct slugs, empties dropped."""
    return F.array_distinct(F.filter(F.transform(tags, tx.slug), lambda s: s != ""))


def tag_display_name(slug: Column) -> Column:
    return tx.display_name(slug, UPPERCASE_TAG_WORDS)


def normalize_tags(entries: DataFrame) -> DataFrame:
    """Tag lists as slugs; counters ``slug_changed_tags``, ``slug_dropped``,
    ``slug_added`` and flag ``slug_changed``."""
    tags, slugs, obj = F.col("tags"), F.col("_s"), F.col("is_object")
    rows = entries.withColumn("_s", F.transform(tags, tx.slug)).withColumn(
        "_c", F.array_distinct(F.filter("_s", lambda x: x != ""))
    )
    pairs = F.arrays_zip(F.transform(tags, lambda t: F.coalesce(t, F.lit(""))).alias("t"), slugs.alias("s"))
    empties = F.size(F.filter(slugs, lambda x: x == ""))
    repeats = F.size(tags) - empties - F.size("_c")
    rewritten = F.size(F.filter(pairs, lambda z: (z["s"] != "") & (z["t"] != z["s"]))) - _later_changed(pairs, slugs)
    return (
        rows.withColumn("_t", F.when(obj, F.coalesce("_c", empty_strings())).otherwise(tags))
        .withColumn("slug_changed_tags", F.when(tags.isNull(), 0).otherwise(empties + repeats + rewritten))
        .withColumn("slug_dropped", F.when(tags.isNull(), 0).otherwise(empties))
        .withColumn("slug_added", (obj & tags.isNull()).cast("int"))
        .withColumn("slug_changed", ~F.col("_t").eqNullSafe(tags))
        .withColumn("tags", F.col("_t"))
        .withColumn("tags_raw", F.lit(None).cast("array<string>"))
        .withColumn("extras", F.when(obj, _without_key("tags")).otherwise(F.col("extras")))
        .drop("_t", "_s", "_c")
    )


def tag_normalization_summary(normalized: DataFrame) -> DataFrame:
    """One-row counters of ``normalize_tags`` output."""
    distinct = normalized.select(F.explode("tags").alias("t")).agg(
        F.count_distinct("t").alias("normalized_slugs")
    )
    return normalized.agg(
        F.count_if("slug_changed").alias("changed_entries"),
        F.sum("slug_changed_tags").alias("changed_tags"),
        F.sum("slug_added").alias("tag_metadata_added"),
        F.sum("slug_dropped").alias("dropped_tags"),
    ).crossJoin(distinct)


def normalize_entries(entries: DataFrame) -> DataFrame:
    """Slug tags, then positional roles and trimmed content."""
    tagged = normalize_tags(entries).withColumn("_m", normalized_messages(F.col("messages")))
    out = _finish_messages(tagged, {"roles_normalized": "role", "contents_trimmed": "content"})
    return out.withColumn(
        "changed",
        F.col("slug_changed") | (F.col("roles_normalized") + F.col("contents_trimmed") > 0),
    )


# --- identities -------------------------------------------------------------------


def derived_uuid(*parts: Column) -> Column:
    """UUID-shaped text from a hash: the same row gets the same id on a retry."""
    h = F.sha2(F.concat_ws("\u0001", *parts), 256)
    cut = lambda start, n: F.substring(h, start, n)
    return F.concat_ws(
        "-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)),
        F.concat(F.lit("a"), cut(18, 3)), cut(21, 12),
    )


def _content_key() -> Column:
    return F.sha2(F.to_json(F.struct("messages", "tags")), 256)


def _meta(**overrides) -> Column:
    fields = ("version", "native", "validated_at", "entry_uuid", "dataset_uuid")
    return F.struct(
        *[overrides.get(f, F.col(f"meta.{f}")).alias(f) for f in fields]
    ).cast(META_TYPE)


def ensure_entry_uuid(entries: DataFrame, *, dataset: str = "") -> DataFrame:
    """Give every entry without a stored identity one derived from its content."""
    fresh = derived_uuid(
        F.lit(dataset), F.col("source"), F.col("entry_index").cast("string"), _content_key()
    )
    return entries.withColumn(
        "meta",
        F.when(F.col("is_object"), _meta(entry_uuid=F.coalesce(entry_uuid(), fresh))).otherwise(F.col("meta")),
    )


def dataset_uuid(entries: DataFrame) -> DataFrame:
    """One row: the only non-blank dataset UUID in use, else NULL."""
    value = F.col("meta.dataset_uuid")
    ids = entries.select(F.when(value != "", value).alias("u"))
    # min = max is "exactly one value" without collecting the values
    return ids.agg(
        F.when(F.min("u") == F.max("u"), F.min("u")).alias("dataset_uuid")
    )


def is_native_dataset(entries: DataFrame) -> DataFrame:
    """One row: non-empty, every entry native, one shared dataset UUID."""
    value = F.col("meta.dataset_uuid")
    u = F.when(value != "", value)
    return entries.agg(
        (
            (F.count(F.lit(1)) > 0)
            & F.coalesce(F.bool_and(F.coalesce(F.col("meta.native"), F.lit(False))), F.lit(False))
            & F.coalesce(F.min(u) == F.max(u), F.lit(False))
        ).alias("is_native")
    )


def stamp_entries(entries: DataFrame, *, dataset: str | None = None, version: int = 1) -> DataFrame:
    """Overwrite the identity block of every entry before a save.

    The dataset id is the argument, else the one shared id, else one derived
    from the entries' ids; it arrives as a one-row broadcast.
    """
    identified = ensure_entry_uuid(entries, dataset=dataset or "")
    if dataset is not None:
        chosen = F.lit(dataset)
        rows = identified
    else:
        value = F.col("meta.dataset_uuid")
        u = F.when(value != "", value)
        one = identified.agg(
            F.coalesce(
                F.when(F.min(u) == F.max(u), F.min(u)),
                derived_uuid(F.count(F.lit(1)).cast("string"), F.min("meta.entry_uuid"), F.max("meta.entry_uuid")),
            ).alias("_dataset_uuid")
        )
        rows = identified.crossJoin(F.broadcast(one))
        chosen = F.col("_dataset_uuid")
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.withColumn(
        "meta",
        F.when(
            F.col("is_object"),
            _meta(version=F.lit(version), native=F.lit(True), validated_at=now, dataset_uuid=chosen),
        ),
    ).drop("_dataset_uuid")


# --- message edits ------------------------------------------------------------------


def set_system_prompt(messages: Column, prompt: Column) -> Column:
    """Replace the content of a leading system message, or insert one."""
    first = F.get(messages, F.lit(0))
    leads = F.coalesce(first["is_obj"] & (first["role"] == "system"), F.lit(False))
    rest = F.when(leads, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(
        F.coalesce(messages, empty_messages())
    )
    head = F.when(leads, with_fields(first, content=prompt)).otherwise(
        message(F.lit("system"), prompt)
    )
    return F.concat(F.array(head), rest).cast(MESSAGES_TYPE)


def scaffold_turns(messages: Column) -> Column:
    """Insert blank partner turns so that every run alternates and is even.

    A run ends at a system message, a non-object, or a role that is not a
    string; those stand alone. Turns with an unknown role name keep their place
    and count towards the run's length without changing whose turn is due.
    """
    blank = lambda role: F.array(message(F.lit(role), F.lit("")))
    none = empty_messages()

    def state(out, due, odd):
        return F.struct(out.alias("out"), due.alias("due"), odd.alias("odd"))

    def padding(acc):
        return (
            F.when(acc["odd"] & (acc["due"] == "user"), blank("user"))
            .when(acc["odd"], blank("assistant"))
            .otherwise(none)
        )

    def step(acc, m):
        std = F.when(m["is_obj"], standard_role(m["role"]))
        is_turn = std.isin("user", "assistant")
        kept = F.array(with_fields(m, role=F.coalesce(std, m["role"])))
        late = is_turn & (std != acc["due"])
        filler = F.when(late & (std == "user"), blank("assistant")).when(late, blank("user")).otherwise(none)
        ends = ~m["is_obj"] | m["role"].isNull() | (std == "system")
        return (
            F.when(ends, state(F.concat(acc["out"], padding(acc), kept), F.lit("user"), F.lit(False)))
            .when(
                is_turn,
                state(
                    F.concat(acc["out"], filler, kept),
                    F.when(std == "user", "assistant").otherwise("user"),
                    F.when(late, acc["odd"]).otherwise(~acc["odd"]),
                ),
            )
            .otherwise(state(F.concat(acc["out"], kept), acc["due"], ~acc["odd"]))
        )

    return F.aggregate(
        F.coalesce(messages, none),
        state(none, F.lit("user"), F.lit(False)),
        step,
        lambda acc: F.concat(acc["out"], padding(acc)),
    )
