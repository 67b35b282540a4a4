"""Bulk edits as pure functions from entries to entries.

Each returns new frames; rejected rows come back as a second frame with their
reasons instead of an exception. Wide rows are moved at most once: decisions
are made on ids and then applied with a join or a projection.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import entries as en
from . import normalize as no
from . import validate as va
from .ordering import dense_index


# --- merge -------------------------------------------------------------------------


def conversation_key() -> Column:
    """Hash of the user and assistant turns; system, tags and metadata are left
    out. Entries without such turns share one key."""
    turns = F.transform(
        F.filter(
            en.messages_or_empty(), lambda m: m["is_obj"] & m["role"].isin("user", "assistant")
        ),
        lambda m: F.struct(
            F.coalesce(m["content"], F.get_json_object(m["other"], "$.content"), F.lit("")).alias("content"),
            m["role"].alias("role"),
        ),
    )
    return F.sha2(F.to_json(turns), 256)


def union_sources(frames) -> DataFrame:
    """Stack datasets in the given order, keeping their own positions."""
    out = None
    for number, frame in enumerate(frames):
        part = frame.select(*en.ENTRY_COLUMNS).withColumn("file_order", F.lit(number))
        out = part if out is None else out.unionByName(part)
    return out


def merge_dedupe(stacked: DataFrame, *, salt: int = 64) -> DataFrame:
    """First occurrence of every conversation, with the tags of the later ones.

    ``stacked`` has ``file_order`` and ``entry_index``, which give the order.
    Only keys, positions and tag lists are aggregated: first per (key, salt),
    where a tag keeps its earliest place, then per key. A key that a third of
    all rows share is thereby reduced in ``salt`` tasks before it meets in one,
    and what meets there is distinct tags, not rows. Survivors are then picked
    by a join on their position.
    """
    keyed = stacked.withColumn("key", conversation_key())
    place = F.struct("file_order", "entry_index")
    spread = F.pmod(F.xxhash64("file_order", "entry_index"), F.lit(salt)).alias("slot")
    partial = (
        keyed.select("key", spread, place.alias("place"))
        .groupBy("key", "slot")
        .agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    )
    firsts = partial.groupBy("key").agg(F.min("place").alias("place"), F.sum("n").alias("copies"))
    tag_places = (
        keyed.select("key", place.alias("place"), F.posexplode("tags").alias("pos", "tag"))
        .groupBy("key", "tag")
        .agg(F.min(F.struct("place", "pos")).alias("at"))
    )
    union_tags = tag_places.groupBy("key").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("at", "tag"))), lambda x: x["tag"]
        ).alias("all_tags")
    )
    chosen = firsts.select("key", "copies", "place.file_order", "place.entry_index")
    survivors = keyed.join(chosen, ["key", "file_order", "entry_index"]).join(union_tags, "key", "left")
    repeated = F.col("copies") > 1
    return survivors.withColumn(
        "tags",
        F.when(repeated, F.coalesce("all_tags", en.empty_strings())).otherwise(F.col("tags")),
    ).drop("all_tags", "key")


def renumber(merged: DataFrame) -> DataFrame:
    """Dense ``entry_index`` in the order of the merge, by dataset, then by position.

    Positions are numbered on narrow rows and joined back to the entries.
    """
    sizes = merged.groupBy("file_order").agg(F.max("entry_index").alias("_last"))
    upto = Window.orderBy("file_order").rowsBetween(Window.unboundedPreceding, -1)  # one row per dataset
    before = sizes.select("file_order", F.coalesce(F.sum(F.col("_last") + 1).over(upto), F.lit(0)).alias("_first"))
    places = merged.select("file_order", "entry_index").join(before, "file_order").withColumn("_place", F.col("_first") + F.col("entry_index"))
    numbers = dense_index(places, "_place", name="_new").select("file_order", "entry_index", "_new")
    out = merged.join(numbers, ["file_order", "entry_index"])
    return out.withColumn("entry_index", F.col("_new")).drop("_new")


def merge_datasets(frames) -> DataFrame:
    """The datasets in the given order as one: first occurrences, densely numbered, with ``copies``."""
    return renumber(merge_dedupe(union_sources(frames))).drop("file_order")


def merge_counts(merged: DataFrame) -> DataFrame:
    """``total_loaded`` and ``duplicates_removed`` from the copy counts."""
    return merged.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_loaded"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
    )


def shuffle_entries(entries: DataFrame, seed: int = 0) -> DataFrame:
    """Reproducible permutation: order by a seeded hash of the identity."""
    return entries.orderBy(F.xxhash64(en.entry_id(), F.lit(seed)), "entry_index")


# --- selection-based edits ------------------------------------------------------------


def _selected(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries plus a ``selected`` flag from ``ids(entry_id)``."""
    marks = ids.select(F.col("entry_id").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    return (
        entries.withColumn("_id", en.entry_id())
        .join(marks, "_id", "left")
        .withColumn("selected", F.coalesce("_hit", F.lit(False)))
        .drop("_id", "_hit")
    )


def unknown_ids(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids that no entry has."""
    known = entries.select(en.entry_id().alias("entry_id"))
    return ids.select("entry_id").distinct().join(known, "entry_id", "left_anti")


def delete_entries(entries: DataFrame, ids: DataFrame) -> DataFrame:
    keyed = entries.withColumn("_id", en.entry_id())
    return keyed.join(ids.select(F.col("entry_id").alias("_id")), "_id", "left_anti").drop("_id")


def _on_selected(entries: DataFrame, ids: DataFrame | None, column: str, value: Column) -> DataFrame:
    if ids is None:
        return entries.withColumn(column, value)
    flagged = _selected(entries, ids)
    return flagged.withColumn(column, F.when(F.col("selected"), value).otherwise(F.col(column))).drop("selected")


def _text_array(tags) -> Column:
    return F.array(*[F.lit(t) for t in tags]).cast("array<string>")


def set_tags(entries: DataFrame, tags, ids: DataFrame | None = None) -> DataFrame:
    return _on_selected(entries, ids, "tags", F.array_distinct(_text_array(tags)))


def replace_tags(entries: DataFrame, tags, ids: DataFrame | None = None) -> DataFrame:
    """Set the tag list of the selected entries, as slugs."""
    return _on_selected(entries, ids, "tags", no.tag_slugs(_text_array(tags)))


def clear_tags(entries: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    return _on_selected(entries, ids, "tags", en.empty_strings())


def add_tags(entries: DataFrame, tags, ids: DataFrame | None = None) -> DataFrame:
    return _on_selected(entries, ids, "tags", F.array_union(en.clean_tags(), _text_array(tags)))


def remove_tags(entries: DataFrame, tags, ids: DataFrame | None = None) -> DataFrame:
    return _on_selected(entries, ids, "tags", F.array_except(en.clean_tags(), _text_array(tags)))


def replace_system_prompt(entries: DataFrame, prompt: str, ids: DataFrame | None = None) -> DataFrame:
    return _on_selected(
        entries, ids, "messages", no.set_system_prompt(F.col("messages"), F.lit(prompt))
    )


def duplicate_entries(entries: DataFrame, ids: DataFrame, mappings: DataFrame | None = None):
    """Copies of the selected entries after the last one, with fresh ids.

    Returns ``(entries, mappings)``; turn mappings are copied along.
    """
    picked = entries.withColumn("_id", en.entry_id()).join(
        ids.select(F.col("entry_id").alias("_id")).distinct(), "_id", "left_semi"
    )
    size = entries.agg((F.max("entry_index") + 1).alias("_size"))
    fresh = no.derived_uuid(F.lit("copy"), F.col("_id"), F.col("entry_index").cast("string"))
    copies = (
        dense_index(picked, "entry_index", name="_pos")
        .crossJoin(F.broadcast(size))
        .withColumn(
            "meta",
            F.struct(
                F.lit(1).alias("version"), F.lit(False).alias("native"),
                F.lit(None).cast("string").alias("validated_at"),
                fresh.alias("entry_uuid"), F.lit(None).cast("string").alias("dataset_uuid"),
            ).cast(en.META_TYPE),
        )
        .withColumn("entry_index", F.col("_size") + F.col("_pos"))
    )
    out = entries.unionByName(copies.select(*entries.columns))
    if mappings is None:
        return out, None
    renamed = copies.select(F.col("_id").alias("entry_uuid"), F.col("meta.entry_uuid").alias("_new"))
    copied = mappings.join(renamed, "entry_uuid").withColumn("entry_uuid", F.col("_new")).drop("_new")
    return out, mappings.unionByName(copied.select(*mappings.columns))


# --- split and join -----------------------------------------------------------------------


def _non_system() -> Column:
    return F.filter(
        en.messages_or_empty(), lambda m: m["is_obj"] & ~m["role"].eqNullSafe("system")
    )


def _first_system() -> Column:
    found = F.filter(en.messages_or_empty(), lambda m: m["is_obj"] & m["role"].eqNullSafe("system"))
    return F.coalesce(F.get(found, F.lit(0)), en.message(F.lit("system"), F.lit("")))


def split_entries(entries: DataFrame, requests: DataFrame, mappings: DataFrame | None = None):
    """Cut entries at exchange boundaries.

    ``requests`` is ``(entry_id, split_points ARRAY<INT>)``. Returns
    ``(entries, rejects, mappings)``. A segment keeps the first system message
    and the tags, gets a derived id and drops other keys; all segments of an
    entry must be valid or the entry stays as it is.
    """
    keyed = entries.withColumn("entry_id", en.entry_id())
    # repeated requests for an entry are one, with the points of all
    asked = requests.groupBy("entry_id").agg(F.array_distinct(F.flatten(F.collect_set("split_points"))).alias("split_points"))
    todo = keyed.join(asked, "entry_id")
    unknown = unknown_ids(entries, requests).select("entry_id", F.lit("no such entry").alias("reason"))
    points = F.sort_array(F.array_distinct("split_points"))
    work = (
        todo.withColumn("turns", _non_system())
        .withColumn("n_ex", (F.size("turns") / 2).cast("int"))
        .withColumn("points", points)
    )
    bad_shape = (F.size("turns") < 4) | (F.size("turns") % 2 != 0)
    bad_points = (F.size("points") == 0) | F.exists("points", lambda p: (p <= 0) | (p >= F.col("n_ex")))
    reason = F.when(bad_shape, "needs two complete exchanges").when(bad_points, "invalid split point")
    work = work.withColumn("reason", reason)
    bounds = F.concat(F.array(F.lit(0)), F.transform("points", lambda p: p * 2), F.array(F.size("turns")))
    segments = (
        work.where(F.col("reason").isNull())
        .withColumn("bounds", bounds.cast("array<int>"))
        .withColumn("system", _first_system())
        .select(
            "entry_id", "entry_index", "source", "tags", "system", "turns", "bounds",
            F.posexplode(F.slice("bounds", F.lit(1), F.size("bounds") - 1)).alias("segment", "start"),
        )
        .withColumn("stop", F.element_at("bounds", F.col("segment") + 2))
    )
    fresh = no.derived_uuid(F.lit("split"), F.col("entry_id"), F.col("segment").cast("string"))
    new_meta = F.struct(
        F.lit(1).alias("version"), F.lit(False).alias("native"),
        F.lit(None).cast("string").alias("validated_at"), fresh.alias("entry_uuid"),
        F.lit(None).cast("string").alias("dataset_uuid"),
    ).cast(en.META_TYPE)
    built = segments.select(
        "entry_id", "segment", "start", "stop",
        *en.entry_columns(
            F.col("entry_index"),
            F.concat(F.array("system"), F.slice("turns", F.col("start") + 1, F.col("stop") - F.col("start"))),
            tags=F.col("tags"), source=F.col("source"), meta=new_meta,
        ),
    )
    checked = va.analyze_chatml(built)
    verdict = checked.groupBy("entry_id").agg(F.bool_and("is_valid").alias("ok"))
    good = verdict.where("ok").select("entry_id")
    done = checked.join(good, "entry_id", "left_semi")
    rejects = work.where(F.col("reason").isNotNull()).select("entry_id", "reason").unionByName(
        verdict.where(~F.col("ok")).select("entry_id", F.lit("segment is not valid").alias("reason"))
    ).unionByName(unknown)
    rest = keyed.join(good, "entry_id", "left_anti").select(*en.ENTRY_COLUMNS).withColumn("segment", F.lit(0))
    stacked = rest.unionByName(done.select(*en.ENTRY_COLUMNS, "segment"))
    out = (
        dense_index(stacked, "entry_index", ("segment",), name="_pos")
        .withColumn("entry_index", F.col("_pos"))
        .drop("_pos", "segment")
    )
    if mappings is None:
        return out, rejects, None
    ranges = done.select(
        F.col("entry_id").alias("entry_uuid"), "start", "stop", F.col("meta.entry_uuid").alias("_new")
    )
    moved = (
        mappings.join(ranges, "entry_uuid")
        .where((F.col("turn_index") > F.col("start")) & (F.col("turn_index") <= F.col("stop")))
        .withColumn("turn_index", F.col("turn_index") - F.col("start"))
        .withColumn("entry_uuid", F.col("_new"))
    )
    kept = mappings.join(good.withColumnRenamed("entry_id", "entry_uuid"), "entry_uuid", "left_anti")
    return out, rejects, kept.unionByName(moved.select(*mappings.columns))


def join_entries(entries: DataFrame, groups: DataFrame, mappings: DataFrame | None = None):
    """Chain entries into one conversation per group.

    ``groups`` is ``(group_id, entry_id, seq)``; repeats of an id within a group
    count once, at their first ``seq``. Returns ``(entries, report, mappings)``
    where the report has one row per group: members, whether the system prompts
    differ, and a reason when the group was left alone.
    """
    wanted = groups.groupBy("group_id", "entry_id").agg(F.min("seq").alias("seq"))
    keyed = entries.withColumn("entry_id", en.entry_id())
    last = keyed.groupBy("entry_id").agg(F.max("entry_index").alias("entry_index"))
    found = wanted.join(last, "entry_id", "left")
    shape = found.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if(F.col("entry_index").isNull()).alias("unknown"),
        F.min("entry_index").alias("at"),
    )
    fit = shape.where((F.col("members") >= 2) & (F.col("unknown") == 0))
    parts = (
        found.join(fit.select("group_id", "at"), "group_id")
        .join(
            keyed.select(
                "entry_id", "entry_index", "source", en.clean_tags().alias("tags"),
                _non_system().alias("turns"), _first_system().alias("system"),
            ),
            ["entry_id", "entry_index"],
        )
        .select(
            "group_id", "at", "entry_id",
            F.struct("seq", "entry_id", "source", "system", "turns", "tags").alias("p"),
        )
    )
    chained = parts.groupBy("group_id", "at").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    head = F.get("ps", F.lit(0))
    fresh = no.derived_uuid(F.lit("join"), F.array_join(F.transform("ps", lambda p: p["entry_id"]), "|"))
    new_meta = F.struct(
        F.lit(1).alias("version"), F.lit(False).alias("native"),
        F.lit(None).cast("string").alias("validated_at"), fresh.alias("entry_uuid"),
        F.lit(None).cast("string").alias("dataset_uuid"),
    ).cast(en.META_TYPE)
    joined = chained.select(
        "group_id",
        F.exists("ps", lambda p: ~p["system"]["content"].eqNullSafe(head["system"]["content"])).alias("prompts_differ"),
        F.transform("ps", lambda p: F.struct(p["entry_id"].alias("entry_id"), F.size(p["turns"]).alias("n"))).alias("sizes"),
        *en.entry_columns(
            F.col("at"),
            F.concat(F.array(head["system"]), F.flatten(F.transform("ps", lambda p: p["turns"]))),
            tags=F.array_distinct(F.flatten(F.transform("ps", lambda p: p["tags"]))),
            source=head["source"], meta=new_meta,
        ),
    )
    checked = va.analyze_chatml(joined)
    done = checked.where("is_valid")
    gone = wanted.join(done.select("group_id"), "group_id", "left_semi").select("entry_id")
    rest = keyed.join(gone, "entry_id", "left_anti").select(*en.ENTRY_COLUMNS)
    stacked = rest.unionByName(done.select(*en.ENTRY_COLUMNS))
    out = (
        dense_index(stacked, "entry_index", name="_pos")
        .withColumn("entry_index", F.col("_pos"))
        .drop("_pos")
    )
    report = shape.join(checked.select("group_id", "prompts_differ", "is_valid"), "group_id", "left").select(
        "group_id", "members", F.coalesce("prompts_differ", F.lit(False)).alias("prompts_differ"),
        F.when(F.col("members") < 2, "needs two entries")
        .when(F.col("unknown") > 0, "unknown entry")
        .when(~F.col("is_valid"), "joined entry is not valid")
        .alias("reason"),
    )
    if mappings is None:
        return out, report, None
    offsets = done.select(
        F.col("meta.entry_uuid").alias("_new"), F.posexplode("sizes").alias("k", "s"), "sizes"
    ).select(
        "_new", F.col("s.entry_id").alias("entry_uuid"), F.col("s.n").alias("n"),
        F.aggregate(F.slice("sizes", F.lit(1), F.col("k")), F.lit(0), lambda acc, s: acc + s["n"]).alias("offset"),
    )
    moved = (
        mappings.join(offsets, "entry_uuid")
        .where(F.col("turn_index").between(1, F.col("n")))
        .withColumn("turn_index", (F.col("turn_index") + F.col("offset")).cast("int"))
        .withColumn("entry_uuid", F.col("_new"))
    )
    kept = mappings.join(gone.withColumnRenamed("entry_id", "entry_uuid"), "entry_uuid", "left_anti")
    return out, report, kept.unionByName(moved.select(*mappings.columns))


# --- keyed patches ----------------------------------------------------------------------------


def upsert_entries(entries: DataFrame, patch: DataFrame):
    """Replace entries by id and append those without a match.

    ``patch`` has entry columns and ``entry_id`` (NULL for a new entry). Of
    several rows for one id the one with the largest ``entry_index`` counts, then
    the one whose content sorts last. Roles
    are repaired by position and the result must be valid; otherwise the row is
    rejected and the old entry stays. Returns ``(entries, rejects)``.
    """
    latest = F.row_number().over(Window.partitionBy("entry_id").orderBy(F.desc("entry_index"), F.desc(F.to_json(F.struct("messages", "tags")))))
    named = patch.where(F.col("entry_id").isNotNull()).withColumn("_n", latest).where("_n = 1").drop("_n")
    patch = named.unionByName(patch.where(F.col("entry_id").isNull()))
    fixed = patch.withColumn("messages", no.normalized_messages(F.col("messages")))
    checked = va.analyze_chatml(fixed)
    rejects = checked.where(~F.col("is_valid")).select(
        "entry_id",
        F.transform(
            F.filter("diagnostics", lambda d: d["severity"] == "error"), lambda d: d["message"]
        ).alias("errors"),
    )
    good = checked.where("is_valid").select("entry_id", "messages", "tags", "tags_raw", "meta", "extras", "source")
    side = good.where(F.col("entry_id").isNotNull()).select(
        "entry_id", *[F.col(c).alias(f"_{c}") for c in ("messages", "tags", "tags_raw", "meta", "extras")],
        F.lit(True).alias("_hit"),
    )
    keyed = entries.withColumn("entry_id", en.entry_id()).join(side, "entry_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    updated = keyed.select(
        "entry_index", "source", "is_object",
        *[
            F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
            for c in ("messages", "tags", "tags_raw")
        ],
        F.when(hit, F.coalesce("_meta", "meta")).otherwise(F.col("meta")).alias("meta"),
        F.when(hit, F.col("_extras")).otherwise(F.col("extras")).alias("extras"),
    )
    known = entries.select(en.entry_id().alias("entry_id"))
    added = good.where(F.col("entry_id").isNull()).unionByName(
        good.where(F.col("entry_id").isNotNull()).join(known, "entry_id", "left_anti")
    )
    size = entries.agg(F.coalesce(F.max("entry_index") + 1, F.lit(0)).alias("_size"))
    # order new rows by content: a patch table has no order of its own
    placed = dense_index(
        added.withColumn("_h", F.xxhash64(F.to_json(F.struct("messages", "tags")))), "_h", name="_pos"
    ).crossJoin(F.broadcast(size))
    new_rows = placed.select(
        (F.col("_size") + F.col("_pos")).alias("entry_index"), "source", F.lit(True).alias("is_object"),
        "messages", "tags", "tags_raw", "meta", "extras",
    )
    return updated.unionByName(new_rows), rejects
