"""Merge a sidecar into the registry, and pick the part a dataset uses.

Both sides are dimension tables keyed by slug, so a merge is a full outer join
with a CASE per rule. Every rule that leaves something out yields a report row
``(kind, subject, outcome, reason)``.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import TAXONOMY
from .normalize import tag_display_name
from .tags import archive_state, state_rows

REPORT = ("kind", "subject", "outcome", "reason")


def _report(df: DataFrame, kind: str, subject, outcome, reason) -> DataFrame:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        F.lit(kind).alias("kind"), subject.alias("subject"),
        as_col(outcome).alias("outcome"), as_col(reason).alias("reason"),
    )


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def uuid_matches(dataset: DataFrame, entries_uuid: DataFrame) -> DataFrame:
    """Sidecar rows whose dataset id agrees with the entries' shared id; an
    unknown id on the entries' side agrees with all."""
    return dataset.crossJoin(
        F.broadcast(entries_uuid.select(F.col("dataset_uuid").alias("_have")))
    ).where(F.col("_have").isNull() | (F.col("_have") == F.col("dataset_uuid"))).drop("_have")


def merge_categories(categories: DataFrame, incoming: DataFrame, tags_in: DataFrame):
    """Existing categories stay; foreign built-ins are skipped, unless a sidecar
    tag needs one. ``(categories, report)``."""
    builtin = [name.lower() for name in TAXONOMY]
    inc = incoming.select(
        "slug", F.col("name").alias("in_name"), F.col("sort_order").alias("in_order"),
        F.col("is_active").alias("in_active"), F.col("is_builtin").alias("in_builtin"),
    )
    needed = tags_in.where(F.coalesce("category_slug", F.lit("")) != "").select(
        F.col("category_slug").alias("slug"), F.lit(True).alias("needed")
    ).distinct()
    old = categories.select("slug", "name", "sort_order", "is_active", F.lit(True).alias("here"))
    both = old.join(inc, "slug", "full").join(needed, "slug", "full")
    new = F.col("here").isNull()
    foreign = F.coalesce(F.col("in_builtin") & ~F.col("slug").isin(*builtin), F.lit(False))
    created = new & (F.coalesce("needed", F.lit(False)) | ~foreign)
    out = both.where(~new | created).select(
        "slug",
        F.coalesce("name", "in_name", tag_display_name(F.col("slug"))).alias("name"),
        F.coalesce("sort_order", "in_order", F.lit(0)).alias("sort_order"),
        F.coalesce("is_active", "in_active", F.lit(True)).alias("is_active"),
    )
    report = _report(both.where(created), "category", F.col("slug"), "created", "new").unionByName(
        _report(both.where(new & foreign), "category", F.col("slug"), "warning", "foreign built-in")
    ).unionByName(
        _report(both.where(~new & (F.col("name") != F.col("in_name"))), "category", F.col("slug"), "warning", "name differs")
    )
    return out, report


def merge_tags(tags: DataFrame, incoming: DataFrame, lifecycle: DataFrame):
    """``(tags, report)`` by the status and category of both sides."""
    inc = _prefixed(
        incoming.select("slug", "name", "category_slug", "sort_order", "status", "is_active", "is_builtin"), "in_"
    ).withColumnRenamed("in_slug", "slug")
    origin = archive_state(tags, lifecycle).select("slug", "archive_origin")
    both = (
        tags.withColumn("here", F.lit(True))
        .join(inc.withColumn("there", F.lit(True)), "slug", "full")
        .join(origin, "slug", "left")
    )
    here, there = F.coalesce("here", F.lit(False)), F.coalesce("there", F.lit(False))
    no_category = (F.col("in_status") == "active") & (F.coalesce("in_category_slug", F.lit("")) == "")
    same_place = F.col("category_slug").eqNullSafe(F.col("in_category_slug"))
    outcome = (
        F.when(~there, "kept")
        .when(no_category, "conflict")
        .when(~here, "created")
        .when((F.col("status") == F.col("in_status")) & same_place, "same")
        .when((F.col("status") == "active") & (F.col("in_status") == "active"), "conflict")
        .when(
            (F.col("status") == "archived") & (F.col("in_status") == "active")
            & (F.col("archive_origin") == "imported"),
            "promoted",
        )
        .otherwise("conflict")
    )
    judged = both.withColumn("outcome", outcome)
    take = F.col("outcome").isin("created", "promoted")
    out = judged.where(here | (F.col("outcome") == "created")).select(
        *[
            c if c == "slug" else F.when(take, F.col(f"in_{c}")).otherwise(F.col(c)).alias(c)
            for c in tags.columns
        ]
    )
    reason = (
        F.when(F.col("outcome") != "conflict", "ok")
        .when(no_category, "active without category")
        .when((F.col("status") == "active") & (F.col("in_status") == "active"), "other category")
        .otherwise("other status")
    )
    report = _report(
        judged.where(F.col("outcome").isin("created", "promoted", "conflict")), "tag", F.col("slug"),
        F.col("outcome"), reason,
    )
    return out, report


def merge_aliases(lifecycle: DataFrame, incoming: DataFrame, tags: DataFrame):
    """Aliases whose target exists and that are not there yet."""
    inc = incoming.select("old_slug", "new_slug", "action", "metadata_json")
    targets = tags.select(F.col("slug").alias("new_slug"), F.col("name").alias("new_display_name"),
                          F.col("category_slug").alias("new_category_slug"))
    with_target = inc.join(targets, "new_slug")
    missing = inc.join(tags.select(F.col("slug").alias("new_slug")), "new_slug", "left_anti")
    have = lifecycle.select("action", "old_slug", "new_slug", F.coalesce("metadata_json", F.lit("{}")).alias("metadata_json"))
    fresh = with_target.join(have, ["action", "old_slug", "new_slug", "metadata_json"], "left_anti").dropDuplicates(
        ["action", "old_slug", "new_slug", "metadata_json"]
    )
    top = lifecycle.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = fresh.crossJoin(F.broadcast(top)).withColumn(
        "id", F.col("_top") + 1 + F.monotonically_increasing_id()
    ).drop("_top")
    report = _report(fresh, "alias", F.col("old_slug"), "created", "new").unionByName(
        _report(
            missing, "alias", F.col("old_slug"), "warning",
            F.when(F.coalesce("new_slug", F.lit("")) == "", "no target").otherwise("target does not exist"),
        )
    )
    return lifecycle.unionByName(rows, allowMissingColumns=True), report


def merge_keyed(existing: DataFrame, incoming: DataFrame, kind: str, *, warn: bool):
    """Rows with a new slug are added; present ones stay as they are."""
    cols = existing.columns
    new = incoming.select(*cols).join(existing.select("slug"), "slug", "left_anti").select(*cols)
    report = _report(new, kind, F.col("slug"), "created", "new")
    if warn:
        clash = incoming.join(existing.select("slug"), "slug", "left_semi")
        report = report.unionByName(_report(clash, kind, F.col("slug"), "warning", "already exists"))
    return existing.unionByName(new), report


def merge_mappings(mappings: DataFrame, incoming: DataFrame, characters: DataFrame, entry_uuids: DataFrame | None = None):
    """Incoming mappings replace all turns of their entries."""
    cols = mappings.columns
    inc = incoming.select(*cols)
    reports = []
    if entry_uuids is not None:
        ids = entry_uuids.select("entry_uuid")
        absent = inc.join(ids, "entry_uuid", "left_anti").select("entry_uuid").distinct()
        reports.append(_report(absent, "mapping", F.col("entry_uuid"), "warning", "entry is not loaded"))
        inc = inc.join(ids, "entry_uuid", "left_semi")
    known = characters.select(F.col("slug").alias("character_slug"))
    orphans = inc.join(known, "character_slug", "left_anti")
    reports.append(
        _report(orphans, "mapping", F.concat_ws("#", "entry_uuid", F.col("turn_index").cast("string")), "warning",
                "character does not exist")
    )
    good = inc.join(known, "character_slug", "left_semi").select(*cols)
    kept = mappings.join(inc.select("entry_uuid").distinct(), "entry_uuid", "left_anti").select(*cols)
    reports.append(_report(good.select("entry_uuid").distinct(), "mapping", F.col("entry_uuid"), "created", "new"))
    return kept.unionByName(good), reduce(DataFrame.unionByName, reports)


def imported_states(incoming: DataFrame, report: DataFrame) -> DataFrame:
    """``(slug, action, metadata_json)`` of the tags that an import created or promoted, by their status there."""
    taken = report.where((F.col("kind") == "tag") & F.col("outcome").isin("created", "promoted")).select(F.col("subject").alias("slug"))
    text = F.coalesce("metadata_json", F.lit("{}")) if "metadata_json" in incoming.columns else F.lit("{}")
    rows = incoming.select("slug", "status", text.alias("metadata_json")).dropDuplicates(["slug"]).join(taken, "slug", "left_semi")
    origin = F.coalesce(F.get_json_object("metadata_json", "$.archive_origin"), F.lit("imported"))
    action = (
        F.when(F.col("status") == "active", "assign_category")
        .when(F.col("status") == "hidden", "hide")
        .when((F.col("status") == "archived") & (origin == "imported"), "import_archived")
        .when(F.col("status") == "archived", "archive")
    )
    return rows.select("slug", action.alias("action"), "metadata_json").where(F.col("action").isNotNull())


def import_registry(registry: dict, sidecar: dict, *, entries_uuid: DataFrame | None = None,
                    entry_uuids: DataFrame | None = None):
    """Merge one sidecar's frames into the registry frames.

    ``registry`` and ``sidecar`` map names (categories, tags, lifecycle or
    aliases, characters, system_prompts, mappings) to frames. With
    ``entries_uuid`` a sidecar of another dataset contributes nothing: every
    incoming frame is semi-joined with the accepted sources.
    """
    reports = []
    side = dict(sidecar)
    if entries_uuid is not None:
        accepted = uuid_matches(side["dataset"], entries_uuid).select("source")
        refused = side["dataset"].join(accepted, "source", "left_anti")
        reports.append(_report(refused, "sidecar", F.col("source"), "error", "dataset id differs"))
        side = {k: df.join(accepted, "source", "left_semi") for k, df in side.items()}
    out = {}
    out["categories"], r = merge_categories(registry["categories"], side["categories"], side["tags"])
    reports.append(r)
    out["tags"], r = merge_tags(registry["tags"], side["tags"], registry["lifecycle"])
    reports.append(r)
    out["lifecycle"], aliases = merge_aliases(registry["lifecycle"], side["aliases"], out["tags"])
    out["lifecycle"] = state_rows(out["lifecycle"], imported_states(side["tags"], r))
    reports.append(aliases)
    out["characters"], r = merge_keyed(registry["characters"], side["characters"], "character", warn=False)
    reports.append(r)
    out["system_prompts"], r = merge_keyed(registry["system_prompts"], side["system_prompts"], "system_prompt", warn=True)
    reports.append(r)
    out["mappings"], r = merge_mappings(registry["mappings"], side["mappings"], out["characters"], entry_uuids)
    reports.append(r)
    return out, reduce(DataFrame.unionByName, reports)


def export_registry(registry: dict, usage: DataFrame, entry_uuids: DataFrame) -> dict:
    """The part of the registry that a dataset uses.

    ``usage`` is ``(slug, entries)`` by canonical slug.
    """
    used = usage.select("slug")
    tags = registry["tags"].join(used, "slug", "left_semi")
    cats = registry["categories"].join(
        tags.select(F.col("category_slug").alias("slug")), "slug", "left_semi"
    )
    life = registry["lifecycle"].where(F.col("action").isin("rename", "merge"))
    aliases = (
        life.join(used.withColumnRenamed("slug", "old_slug"), "old_slug", "left_semi")
        .unionByName(life.join(used.withColumnRenamed("slug", "new_slug"), "new_slug", "left_semi").select(*life.columns))
        .dropDuplicates(["id"])
    )
    mappings = registry["mappings"].join(entry_uuids.select("entry_uuid"), "entry_uuid", "left_semi")
    chars = registry["characters"].join(
        mappings.select(F.col("character_slug").alias("slug")), "slug", "left_semi"
    )
    return {
        "categories": cats,
        "tags": tags,
        "aliases": aliases,
        "characters": chars,
        "mappings": mappings,
        "system_prompts": registry["system_prompts"].where("is_active"),
    }
