"""Tag registry: resolution, alias chains, adoption, lifecycle and reports.

Registry frames are keyed by slug:
    categories  slug, name, sort_order, is_active
    tags        slug, name, category_slug, sort_order, is_active, is_builtin,
                status
    lifecycle   id, action, old_slug, new_slug, ... , metadata_json

Registry work happens on distinct slugs, never on entries; entries meet the
result in one join whose strategy is left to the optimizer.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.constants import (
    ALIAS_ACTIONS,
    CURRENT_ACTIONS,
    RETIRED_ACTIONS,
    TAXONOMY,
)
from ..session import cut_lineage
from . import entries as en
from .normalize import tag_display_name


def active_tags(tags: DataFrame, categories: DataFrame) -> DataFrame:
    """Active tags of active categories with their category name and order."""
    live = categories.where("is_active").select(
        F.col("slug").alias("category_slug"),
        F.col("name").alias("category"),
        F.col("sort_order").alias("category_order"),
    )
    return (
        tags.where((F.col("status") == "active") & F.col("is_active"))
        .join(live, "category_slug")
        .select("slug", "name", "category_slug", "category", "category_order", "sort_order")
    )


def tags_with_category(tags: DataFrame, categories: DataFrame) -> DataFrame:
    """Every tag, with its category where it has one."""
    return tags.join(
        categories.select(F.col("slug").alias("category_slug"), F.col("name").alias("category")),
        "category_slug",
        "left",
    )


def latest_metadata(lifecycle: DataFrame) -> DataFrame:
    """Newest current-state row per slug."""
    current = lifecycle.where(F.col("action").isin(*CURRENT_ACTIONS))
    return current.groupBy("old_slug").agg(
        F.max_by(F.struct("id", "action", "metadata_json"), "id").alias("m")
    ).select(F.col("old_slug").alias("slug"), "m.id", "m.action", "m.metadata_json")


def alias_edges(lifecycle: DataFrame) -> DataFrame:
    """Newest rename or merge per slug, with the target as a slug."""
    rows = lifecycle.where(
        F.col("action").isin(*ALIAS_ACTIONS) & F.col("new_slug").isNotNull() & (F.col("new_slug") != "")
    )
    return (
        rows.groupBy("old_slug")
        .agg(F.max_by(F.struct("new_slug", "action"), "id").alias("e"))
        .select(F.col("old_slug").alias("slug"), tx.slug(F.col("e.new_slug")).alias("target"), "e.action")
    )


def alias_targets(lifecycle: DataFrame, active: DataFrame) -> DataFrame:
    """``(slug, target, action)`` of every alias whose chain reaches an active tag.

    The walk runs over the alias table alone, by doubling: each round replaces a
    slug's pointer by the pointer of its target, so a chain of n renames takes
    log2(n) rounds. A pointer that reached an active tag stays; one that leads
    nowhere is dropped. What still moves after as many rounds as the table's size
    allows is a cycle and never arrives. It needs no entries, so one walk serves a whole stream.
    """
    ends = active.select(F.col("slug").alias("target"), F.lit(True).alias("hit"))
    edges = alias_edges(lifecycle).where(F.col("target") != "").join(ends, "target", "left")
    at = cut_lineage(edges.select("slug", "target", "action", F.coalesce("hit", F.lit(False)).alias("done")))
    for _ in range(at.count().bit_length() + 1):
        open_ = at.where(~F.col("done"))
        if open_.isEmpty():
            break
        nxt = at.select(F.col("slug").alias("target"), F.col("target").alias("to"), F.col("action").alias("by"), F.col("done").alias("there"))
        moved = open_.join(nxt, "target").select("slug", F.col("to").alias("target"), F.col("by").alias("action"), F.col("there").alias("done"))
        at = cut_lineage(at.where("done").unionByName(moved))
    return at.where("done").select("slug", "target", "action")


def resolve_aliases(slugs: DataFrame, lifecycle: DataFrame, active: DataFrame) -> DataFrame:
    """``(slug, target, action)`` for slugs whose alias chain reaches an active tag."""
    return slugs.select("slug").join(alias_targets(lifecycle, active), "slug")


def resolve_tags(
    raw_tags: DataFrame, tags: DataFrame, categories: DataFrame, lifecycle: DataFrame, targets: DataFrame | None = None
) -> DataFrame:
    """Lifecycle resolution of distinct raw tag values (column ``tag``).

    Precedence: active, alias_mapped, archived / hidden, retired, unknown.
    ``targets`` are the registry's ``alias_targets``, walked here when not given.
    """
    used = raw_tags.select("tag").distinct().withColumn("slug", tx.slug(F.col("tag")))
    slugs = used.select("slug").where(F.col("slug") != "").distinct()
    active = active_tags(tags, categories).select("slug")
    if targets is None:
        targets = alias_targets(lifecycle, active)
    alias = slugs.join(targets, "slug").select(
        "slug", F.col("target").alias("alias_target"), F.col("action").alias("alias_action")
    )
    status = tags.select("slug", F.col("status").alias("tag_status"))
    retired_rows = lifecycle.where(F.col("action").isin(*RETIRED_ACTIONS)).select(
        F.col("old_slug").alias("slug"), tx.slug(F.coalesce("new_slug", F.lit(""))).alias("to")
    )
    live = active.select(F.col("slug").alias("to"), F.lit(True).alias("live"))
    retired = (
        retired_rows.join(live, "to", "left")
        .where((F.col("to") == "") | F.col("live").isNull())
        .select("slug")
        .distinct()
        .withColumn("is_retired", F.lit(True))
    )
    facts = (
        slugs.join(active.withColumn("is_live", F.lit(True)), "slug", "left")
        .join(alias, "slug", "left")
        .join(status, "slug", "left")
        .join(retired, "slug", "left")
    )
    kind = (
        F.when(F.col("slug") == "", "unknown")
        .when(F.col("is_live"), "active")
        .when(F.col("alias_target").isNotNull(), "alias_mapped")
        .when(F.col("tag_status").isin("uncategorized", "archived"), "archived")
        .when(F.col("tag_status") == "hidden", "hidden")
        .when(F.col("is_retired"), "retired")
        .otherwise("unknown")
    )
    out = used.join(facts, "slug", "left").withColumn("result_type", kind)
    blank = F.col("slug") == ""
    r = F.col("result_type")
    return out.select(
        "tag",
        "slug",
        F.when(r == "alias_mapped", F.col("alias_target")).otherwise(F.col("slug")).alias("resolved_slug"),
        "result_type",
        (F.coalesce((r == "alias_mapped") & (F.col("alias_target") != F.col("slug")), F.lit(False))).alias("rewrite"),
        ((r == "unknown") & ~blank).alias("create_archived"),
        (blank | r.isin("archived", "hidden", "retired")).alias("skip"),
        F.when(blank, "invalid_tag")
        .when(r == "active", "active_tag")
        .when(r == "alias_mapped", F.col("alias_action"))
        .when(r.isin("archived", "hidden"), F.concat(F.lit("existing_"), F.col("tag_status")))
        .when(r == "retired", "retired_history")
        .otherwise("unknown_tag")
        .alias("reason"),
    )


def raw_tags(entries: DataFrame) -> DataFrame:
    """Distinct tag values of entries whose tag list is all text."""
    return entries.select(F.explode(en.clean_tags()).alias("tag")).distinct()


def canonicalize_aliases(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rewrite alias slugs in entries; repeats go only where something changed.

    Only tags that have a rewrite leave their entry, with its position; they come
    back as a map of that entry's own tags. The optimizer broadcasts whichever
    side is small, the answer is the same.
    """
    rewrites = resolved.where("rewrite").select("tag", "resolved_slug")
    tags = en.clean_tags()
    found = (
        entries.select("source", "entry_index", F.explode(F.array_distinct(tags)).alias("tag"))
        .join(rewrites, "tag")
        .groupBy(F.col("source").alias("_source"), F.col("entry_index").alias("_index"))
        .agg(F.map_from_entries(F.collect_list(F.struct("tag", "resolved_slug"))).alias("_map"))
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("entry_index") == F.col("_index"))
    mapped = F.transform(tags, lambda t: F.coalesce(F.element_at("_map", t), t))
    hits = F.filter(tags, lambda t: F.map_contains_key("_map", t))
    return (
        entries.join(found, same, "left")
        .withColumn("rewrite_count", F.when(F.col("_map").isNull(), 0).otherwise(F.size(hits)))
        .withColumn("tags", F.when(F.col("_map").isNull(), F.col("tags")).otherwise(F.array_distinct(mapped)))
        .drop("_source", "_index", "_map")
    )


def unknown_tags(entries: DataFrame, tags: DataFrame) -> DataFrame:
    """Used slugs that the registry does not know."""
    used = raw_tags(entries).select(tx.slug(F.col("tag")).alias("slug")).where(F.col("slug") != "").distinct()
    return used.join(tags.select("slug"), "slug", "left_anti")


def adopt_unknown_tags(entries: DataFrame, tags: DataFrame, categories: DataFrame, lifecycle: DataFrame):
    """Archive every used slug that resolves to unknown.

    Returns ``(tags, lifecycle, counts)``.
    """
    # one row per distinct tag, read three times below
    resolved = cut_lineage(resolve_tags(raw_tags(entries), tags, categories, lifecycle))
    new = resolved.where("create_archived").select("slug").distinct()
    known = resolved.where(F.col("slug") != "").select("slug", "result_type").distinct()
    new_tags = new.select(
        "slug",
        tag_display_name(F.col("slug")).alias("name"),
        F.lit(None).cast("string").alias("category_slug"),
        F.lit(0).alias("sort_order"),
        F.lit(True).alias("is_active"),
        F.lit(False).alias("is_builtin"),
        F.lit("archived").alias("status"),
    )
    top = lifecycle.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    # ids only have to be unique and newer than the existing ones
    new_rows = new.crossJoin(F.broadcast(top)).select(
        (F.col("_top") + 1 + F.monotonically_increasing_id()).alias("id"),
        F.lit("import_archived").alias("action"),
        F.col("slug").alias("old_slug"),
        F.lit(None).cast("string").alias("new_slug"),
        F.lit('{"archive_origin":"imported","archive_reason":"unknown_import","visible_badge":"Imported"}').alias("metadata_json"),
    )
    counts = known.agg(
        F.count_if(F.col("result_type") == "unknown").alias("created"),
        F.count_if(F.col("result_type").isin("active", "alias_mapped")).alias("existing"),
        F.count_if(F.col("result_type").isin("archived", "hidden", "retired")).alias("skipped"),
    )
    return (
        tags.unionByName(new_tags, allowMissingColumns=True),
        lifecycle.unionByName(new_rows, allowMissingColumns=True),
        counts,
    )


def archive_state(tags: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Visible archived tags with origin, reason and badge: the newest metadata,
    else defaults that depend on whether the tag has a category."""
    meta = latest_metadata(lifecycle).select("slug", "metadata_json")
    field = lambda name: F.get_json_object("metadata_json", f"$.{name}")
    foreign = F.col("category_slug").isNull()
    return (
        tags.where(F.col("status").isin("archived", "uncategorized"))
        .join(meta, "slug", "left")
        .select(
            "slug", "name", "category_slug",
            F.coalesce(field("archive_origin"), F.when(foreign, "imported").otherwise("deleted")).alias("archive_origin"),
            F.coalesce(field("archive_reason"), F.when(foreign, "unknown_import").otherwise("user_soft_delete")).alias("archive_reason"),
            F.coalesce(field("visible_badge"), F.when(foreign, "Imported").otherwise("Deleted")).alias("visible_badge"),
        )
    )


def registry_snapshot(tags: DataFrame, categories: DataFrame, lifecycle: DataFrame):
    """``(active, archived)``: ordered active tags with their labels, and the
    visible archived tags."""
    active = active_tags(tags, categories).withColumn(
        "label", F.concat_ws(" / ", "category", "name")
    )
    return active, archive_state(tags, lifecycle)


def pending_tag_positions(entries: DataFrame, tags: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """``(slug, name, entry_index)``: every use of an imported archived tag that is still in an entry."""
    imported = archive_state(tags, lifecycle).where(F.col("archive_origin") == "imported").select("slug", "name")
    uses = entries.select("entry_index", F.explode(en.clean_tags()).alias("tag"))
    return uses.select("entry_index", tx.slug(F.col("tag")).alias("slug")).join(imported, "slug").select("slug", "name", "entry_index")


def pending_tag_trust(entries: DataFrame, tags: DataFrame, lifecycle: DataFrame, sidecar: dict | None = None) -> DataFrame:
    """Imported archived tags still in use: uses, number of entries, and the sidecar's hint.

    The positions are rows of ``pending_tag_positions``, not a list in a cell. With
    ``sidecar`` frames (tags, categories) a tag that it knows has its status and
    category there, and ``resolution`` is ``sidecar_hint``, else ``no_hint``.
    """
    uses = pending_tag_positions(entries, tags, lifecycle).groupBy("slug", "name").agg(
        F.count(F.lit(1)).alias("uses"), F.count_distinct("entry_index").alias("entries")
    )
    if sidecar is None:
        return uses
    cats = sidecar["categories"].select(F.col("slug").alias("sidecar_category_slug"), F.col("name").alias("sidecar_category_name")).dropDuplicates(["sidecar_category_slug"])
    hints = sidecar["tags"].select(
        "slug", F.col("category_slug").alias("sidecar_category_slug"), F.col("status").alias("sidecar_status"), F.lit(True).alias("_hint")
    ).dropDuplicates(["slug"])
    return uses.join(hints, "slug", "left").join(cats, "sidecar_category_slug", "left").select(
        "slug", "name", "uses", "entries", "sidecar_category_slug", "sidecar_category_name", "sidecar_status",
        F.when(F.col("_hint"), "sidecar_hint").otherwise("no_hint").alias("resolution"),
    )


def tag_usage_counts(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entries per canonical slug, each entry once.

    The slug list is made distinct inside the row, so the count is a plain
    partial aggregate; only entries whose aliases fold together need a distinct.
    """
    rows = (
        entries.select("entry_index", F.explode(F.array_distinct(en.clean_tags())).alias("tag"))
        .join(resolved.select("tag", "resolved_slug"), "tag")
        .where(F.col("resolved_slug") != "")
    )
    return rows.groupBy("resolved_slug").agg(F.count_distinct("entry_index").alias("entries")).withColumnRenamed("resolved_slug", "slug")


def duplicate_slugs(tags: DataFrame) -> DataFrame:
    return tags.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


# --- lifecycle edits ------------------------------------------------------------------


def rename_check(tags: DataFrame, categories: DataFrame, lifecycle: DataFrame, requests: DataFrame) -> DataFrame:
    """Validate ``requests(slug, new_name, new_category_slug)``.

    Adds ``new_slug`` and ``reason`` (NULL when allowed). An empty category
    keeps the present one, so a move and a rename are the same request.
    """
    own = tags.select(
        "slug", "category_slug", "is_builtin", (F.col("is_active") & (F.col("status") == "active")).alias("live")
    )
    taken = tags.select(F.col("slug").alias("new_slug"), F.lit(True).alias("taken"))
    reserved = alias_edges(lifecycle).select(F.col("slug").alias("new_slug"), F.lit(True).alias("reserved"))
    live_cat = categories.where("is_active").select(F.col("slug").alias("target_category"), F.lit(True).alias("cat_ok"))
    r = (
        requests.join(own, "slug", "left")
        .withColumn("new_slug", tx.slug(F.col("new_name")))
        .withColumn("target_category", F.coalesce("new_category_slug", "category_slug"))
        .join(taken, "new_slug", "left")
        .join(reserved, "new_slug", "left")
        .join(live_cat, "target_category", "left")
    )
    differs = F.col("new_slug") != F.col("slug")
    reason = (
        F.when(F.col("live").isNull(), "unknown tag")
        .when(~F.col("live"), "tag is not active")
        .when(F.col("is_builtin"), "built-in tag")
        .when(F.col("new_slug") == "", "empty name")
        .when(F.col("cat_ok").isNull(), "category is not active")
        .when(differs & F.col("taken"), "slug exists")
        .when(differs & F.col("reserved"), "slug is an alias")
    )
    return r.select("slug", "new_slug", "new_name", "target_category", reason.alias("reason"))


def rename_tags(entries: DataFrame, tags: DataFrame, lifecycle: DataFrame, checked: DataFrame):
    """Apply allowed renames and moves. Returns ``(entries, tags, lifecycle)``."""
    ok = checked.where(F.col("reason").isNull())
    edits = ok.select("slug", "new_slug", "new_name", "target_category")
    new_tags = (
        tags.join(edits, "slug", "left")
        .withColumn("name", F.coalesce("new_name", "name"))
        .withColumn("category_slug", F.coalesce("target_category", "category_slug"))
        .withColumn("slug", F.coalesce("new_slug", "slug"))
        .select(*tags.columns)
    )
    moved = edits.where(F.col("slug") != F.col("new_slug"))
    top = lifecycle.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = moved.crossJoin(F.broadcast(top)).select(
        (F.col("_top") + 1 + F.monotonically_increasing_id()).alias("id"),
        F.lit("rename").alias("action"),
        F.col("slug").alias("old_slug"),
        "new_slug",
        F.col("new_name").alias("new_display_name"),
    )
    resolved = moved.select(F.col("slug").alias("tag"), F.col("new_slug").alias("resolved_slug"), F.lit(True).alias("rewrite"))
    new_entries = canonicalize_aliases(entries, resolved).drop("rewrite_count")
    return new_entries, new_tags, lifecycle.unionByName(rows, allowMissingColumns=True)


def delete_tags(entries: DataFrame, tags: DataFrame, lifecycle: DataFrame, slugs):
    """Archive tags and take them out of every entry."""
    gone = F.array(*[F.lit(s) for s in slugs])
    new_entries = entries.withColumn("tags", F.filter("tags", lambda t: ~F.array_contains(gone, t)))
    hit = F.col("slug").isin(*slugs)
    new_tags = tags.withColumn("status", F.when(hit, "archived").otherwise(F.col("status")))
    top = lifecycle.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = tags.where(hit).crossJoin(F.broadcast(top)).select(
        (F.col("_top") + 1 + F.monotonically_increasing_id()).alias("id"),
        F.lit("archive").alias("action"),
        F.col("slug").alias("old_slug"),
        F.lit('{"archive_origin":"deleted","archive_reason":"user_soft_delete","visible_badge":"Deleted"}').alias("metadata_json"),
    )
    return new_entries, new_tags, lifecycle.unionByName(rows, allowMissingColumns=True)


def assign_archived_tags(tags: DataFrame, categories: DataFrame, lifecycle: DataFrame, requests: DataFrame):
    """Give imported archived tags a category and make them active.

    ``requests(slug, category_slug)``. All or nothing: with any fault the tags
    come back unchanged. Returns ``(tags, errors)``. New tags follow the present
    ones of their category in slug order.
    """
    state = archive_state(tags, lifecycle).select("slug", "archive_origin")
    cats = categories.where("is_active").select(F.col("slug").alias("to_category"), F.lit(True).alias("cat_ok"))
    req = requests.select("slug", F.col("category_slug").alias("to_category"))
    checked = req.join(state, "slug", "left").join(cats, "to_category", "left").withColumn(
        "reason",
        F.when(F.col("archive_origin").isNull(), "not an archived tag")
        .when(F.col("archive_origin") != "imported", "not an imported tag")
        .when(F.col("cat_ok").isNull(), "category is not active"),
    )
    errors = checked.where(F.col("reason").isNotNull()).select("slug", "reason")
    clean = errors.agg((F.count(F.lit(1)) == 0).alias("_clean"))
    last = tags.groupBy(F.col("category_slug").alias("to_category")).agg(F.max("sort_order").alias("_last"))
    placed = (
        checked.join(last, "to_category", "left")
        .withColumn("_n", F.expr("row_number() over (partition by to_category order by slug)"))
        .crossJoin(F.broadcast(clean))
        .where("_clean")
        .select("slug", "to_category", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("int").alias("_order"))
    )
    hit = F.col("to_category").isNotNull()
    out = (
        tags.join(placed, "slug", "left")
        .withColumn("status", F.when(hit, "active").otherwise(F.col("status")))
        .withColumn("is_active", F.when(hit, True).otherwise(F.col("is_active")))
        .withColumn("category_slug", F.coalesce("to_category", "category_slug"))
        .withColumn("sort_order", F.coalesce("_order", "sort_order"))
        .select(*tags.columns)
    )
    return out, errors


def state_rows(lifecycle: DataFrame, changed: DataFrame) -> DataFrame:
    """``lifecycle`` with a current-state row for each of ``changed(slug, action, metadata_json)``.

    Ids only have to be unique and newer than the present ones.
    """
    top = lifecycle.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = changed.crossJoin(F.broadcast(top)).select(
        (F.col("_top") + 1 + F.monotonically_increasing_id()).alias("id"), "action", F.col("slug").alias("old_slug"),
        F.col("slug").alias("new_slug"), "metadata_json",
    )
    return lifecycle.unionByName(rows, allowMissingColumns=True)


def assigned_rows(before: DataFrame, after: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """``lifecycle`` with a row for each tag that became active or changed its category between two states of the tags."""
    old = before.select("slug", F.col("status").alias("_status"), F.col("category_slug").alias("_category"))
    moved = after.where("status = 'active'").join(old, "slug").where(
        (F.col("_status") != "active") | ~F.col("_category").eqNullSafe(F.col("category_slug"))
    )
    return state_rows(lifecycle, moved.select(
        "slug", F.lit("assign_category").alias("action"), F.to_json(F.struct(F.col("category_slug").alias("assigned_category_slug"))).alias("metadata_json")
    ))


def default_taxonomy(spark) -> DataFrame:
    """The built-in categories and tags, in order."""
    rows = [
        (category, ci, tag, ti)
        for ci, (category, names) in enumerate(TAXONOMY.items())
        for ti, tag in enumerate(names)
    ]
    return spark.createDataFrame(rows, "category string, category_order int, tag string, tag_order int")
