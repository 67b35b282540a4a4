"""Queries: tag registry, characters, prompts."""

from pyspark.sql import functions as F

from ..operators import characters as ch
from ..operators import entries as en
from ..operators import normalize as no
from ..operators import prompts as pr
from ..operators import tags as tg
from . import adapters as ad
from . import catalog_mutate  # noqa: F401  (defines shared SQL)
from . import load
from .base import CTES, NEEDS, display, lit, query, slug, sql, std_role, strip
from .catalog_entries import _fingerprint
from .catalog_validate import FULL


def _registry(spark, sf):
    return ad.tags(spark, sf), ad.categories(spark, sf), ad.lifecycle(spark, sf)


def _resolved(spark, sf):
    return tg.resolve_tags(tg.raw_tags(ad.entries_tagged(spark, sf)), *_registry(spark, sf))


@query("active_tags", sql("SELECT slug, name, category_slug FROM reg WHERE status = 'active'", "reg"))
def active_tags(spark, sf):
    tags, cats, _ = _registry(spark, sf)
    return tg.active_tags(tags, cats).select("slug", "name", "category_slug")


@query("tags_with_category", sql(
    "SELECT slug, CASE category_slug WHEN 'kind' THEN 'Kind' WHEN 'brand' THEN 'Brand' WHEN 'name' THEN 'Name' END AS category FROM reg", "reg"))
def tags_with_category(spark, sf):
    tags, cats, _ = _registry(spark, sf)
    return tg.tags_with_category(tags, cats).select("slug", "category")


@query("resolve_tags", sql("SELECT tag, slug, resolved AS resolved_slug, kind AS result_type FROM resolved", "resolved"))
def resolve_tags(spark, sf):
    return _resolved(spark, sf).select("tag", "slug", "resolved_slug", "result_type")


@query("resolve_aliases", sql("SELECT slug, target FROM chain", "chain"))
def resolve_aliases(spark, sf):
    """Alias chains of all slugs of the part table."""
    tags, cats, life = _registry(spark, sf)
    out = tg.resolve_aliases(ad.slug_universe(spark, sf), life, tg.active_tags(tags, cats).select("slug"))
    return out.select("slug", "target")


@query("canonicalize_aliases", sql(
    "SELECT i.e AS entry_index, coalesce(string_agg(CASE WHEN r.kind = 'alias_mapped' THEN r.resolved ELSE t.tag END, ',' ORDER BY t.pos), '') AS tags, "
    "count(*) FILTER (r.kind = 'alias_mapped') AS rewrite_count FROM ids i LEFT JOIN tagrows t ON t.e = i.e LEFT JOIN resolved r ON r.tag = t.tag GROUP BY i.e", "ids", "resolved"))
def canonicalize_aliases(spark, sf):
    out = tg.canonicalize_aliases(ad.entries_tagged(spark, sf), _resolved(spark, sf))
    return out.select("entry_index", F.array_join("tags", ",").alias("tags"), "rewrite_count")


@query("save_repaired", sql(
    f"SELECT r.entry_index, r.changed, r.fingerprint, coalesce(CASE WHEN r.changed THEN g.renamed ELSE g.tags END, '') AS tags FROM "
    f"(SELECT e AS entry_index, count(*) FILTER ({FULL} AND ((std = want AND r <> want) OR c <> cut)) > 0 AS changed, "
    f"md5(string_agg(CASE WHEN {FULL} AND std = want THEN want ELSE r END || chr(1) || CASE WHEN {FULL} THEN cut ELSE c END, chr(2) ORDER BY i)) AS fingerprint "
    "FROM noted GROUP BY e) r LEFT JOIN (SELECT t.e, string_agg(t.tag, ',' ORDER BY t.pos) AS tags, "
    "string_agg(CASE WHEN v.kind = 'alias_mapped' THEN v.resolved ELSE t.tag END, ',' ORDER BY t.pos) AS renamed "
    "FROM tagrows t JOIN resolved v ON v.tag = t.tag GROUP BY t.e) g ON g.e = r.entry_index", "noted", "resolved"))
def save_repaired(spark, sf):
    """Repaired entries with positional roles and current slugs."""
    rows = ad.with_part_tags(ad.entries_dirty(spark, sf), spark, sf)
    out = load.save_repaired(rows, _resolved(spark, sf))
    return out.select("entry_index", "changed", _fingerprint().alias("fingerprint"), F.array_join("tags", ",").alias("tags"))


@query("unknown_tags", sql(
    f"SELECT DISTINCT {slug('tag')} AS slug FROM tagrows WHERE {slug('tag')} NOT IN (SELECT slug FROM reg)", "tagrows", "reg"))
def unknown_tags(spark, sf):
    return tg.unknown_tags(ad.entries_tagged(spark, sf), ad.tags(spark, sf))


@query("adopt_unknown_tags", sql(
    "SELECT slug, name, status FROM reg UNION ALL "
    f"SELECT DISTINCT slug, {display('slug')}, 'archived' FROM resolved WHERE kind = 'unknown'", "reg", "resolved"))
def adopt_unknown_tags(spark, sf):
    tags, _, _ = tg.adopt_unknown_tags(ad.entries_tagged(spark, sf), *_registry(spark, sf))
    return tags.select("slug", "name", "status")


@query("adopt_counts", sql(
    "SELECT count(DISTINCT slug) FILTER (kind = 'unknown') AS created, count(DISTINCT slug) FILTER (kind IN ('active', 'alias_mapped')) AS existing, "
    "count(DISTINCT slug) FILTER (kind IN ('archived', 'retired')) AS skipped FROM resolved", "resolved"))
def adopt_counts(spark, sf):
    return tg.adopt_unknown_tags(ad.entries_tagged(spark, sf), *_registry(spark, sf))[2]


@query("latest_metadata", sql(
    "SELECT slug, 'delete' AS action FROM third WHERE k = 2 AND slug LIKE '%e' AND length(slug) % 2 = 0", "third"))
def latest_metadata(spark, sf):
    return tg.latest_metadata(ad.lifecycle(spark, sf)).select("slug", "action")


@query("registry_snapshot", sql(
    "SELECT slug, CASE category_slug WHEN 'kind' THEN 'Kind / ' WHEN 'brand' THEN 'Brand / ' ELSE 'Name / ' END || name AS label FROM reg WHERE status = 'active'", "reg"))
def registry_snapshot(spark, sf):
    return tg.registry_snapshot(*_registry(spark, sf))[0].select("slug", "label")


@query("archived_tags", sql(
    "SELECT slug, 'imported' AS archive_origin, 'Imported' AS visible_badge FROM reg WHERE status = 'archived'", "reg"))
def archived_tags(spark, sf):
    tags, cats, life = _registry(spark, sf)
    return tg.registry_snapshot(tags, cats, life)[1].select("slug", "archive_origin", "visible_badge")


@query("pending_tag_trust", sql(
    f"SELECT r.slug, r.name, count(*) AS uses, count(DISTINCT t.e) AS entries FROM (SELECT e, {slug('tag')} AS s FROM tagrows) t "
    "JOIN reg r ON r.slug = t.s AND r.status = 'archived' GROUP BY r.slug, r.name", "tagrows", "reg"))
def pending_tag_trust(spark, sf):
    tags, _, life = _registry(spark, sf)
    return tg.pending_tag_trust(ad.entries_tagged(spark, sf), tags, life)


@query("tag_usage_counts", sql(
    "SELECT r.resolved AS slug, count(DISTINCT t.e) AS entries FROM tagrows t JOIN resolved r ON r.tag = t.tag GROUP BY 1", "resolved"))
def tag_usage_counts(spark, sf):
    return tg.tag_usage_counts(ad.entries_tagged(spark, sf), _resolved(spark, sf))


@query("duplicate_slugs", sql(
    f"SELECT slug, count(*) AS n FROM (SELECT {slug('p_type')} AS slug FROM part UNION ALL SELECT {slug('p_brand')} FROM part) GROUP BY slug HAVING count(*) > 1"))
def duplicate_slugs(spark, sf):
    """Every slug that the part table would register more than once."""
    from ..functions import text as tx

    part = ad.table(spark, sf, "part")
    rows = part.select(F.explode(F.array(tx.slug(F.col("p_type")), tx.slug(F.col("p_brand")))).alias("slug"))
    return tg.duplicate_slugs(rows)


# --- lifecycle edits ------------------------------------------------------------------------------

# every registry tag asks for the name "<slug> x" in the same category
CTES["asked"] = (
    f"SELECT slug, slug || '_x' AS new_slug, CASE WHEN status <> 'active' THEN 'tag is not active' END AS reason FROM reg"
)
NEEDS["asked"] = ("reg",)


def _requests(spark, sf):
    return ad.tags(spark, sf).select(
        "slug", F.concat("slug", F.lit(" x")).alias("new_name"), F.lit(None).cast("string").alias("new_category_slug")
    )


@query("rename_check", sql("SELECT slug, new_slug, reason FROM asked", "asked"))
def rename_check(spark, sf):
    tags, cats, life = _registry(spark, sf)
    return tg.rename_check(tags, cats, life, _requests(spark, sf)).select("slug", "new_slug", "reason")


@query("rename_tags", sql(
    f"SELECT i.e AS entry_index, coalesce(string_agg(CASE WHEN r.slug IS NOT NULL THEN s || '_x' ELSE s END, ',' ORDER BY pos), '') AS tags "
    f"FROM ids i LEFT JOIN (SELECT e, pos, {slug('tag')} AS s FROM tagrows) t ON t.e = i.e LEFT JOIN reg r ON r.slug = t.s AND r.status = 'active' GROUP BY i.e", "ids", "tagrows", "reg"))
def rename_tags(spark, sf):
    tags, cats, life = _registry(spark, sf)
    checked = tg.rename_check(tags, cats, life, _requests(spark, sf))
    rows = no.normalize_tags(ad.entries_tagged(spark, sf)).select(*en.ENTRY_COLUMNS)
    out, _, _ = tg.rename_tags(rows, tags, life, checked)
    return out.select("entry_index", F.array_join("tags", ",").alias("tags"))


@query("delete_tags", sql(
    f"SELECT i.e AS entry_index, coalesce(string_agg(s, ',' ORDER BY pos) FILTER (s NOT IN ('economy', 'brand_3')), '') AS tags FROM ids i "
    f"LEFT JOIN (SELECT e, pos, {slug('tag')} AS s FROM tagrows) t ON t.e = i.e GROUP BY i.e", "ids", "tagrows"))
def delete_tags(spark, sf):
    tags, _, life = _registry(spark, sf)
    rows = no.normalize_tags(ad.entries_tagged(spark, sf)).select(*en.ENTRY_COLUMNS)
    out, _, _ = tg.delete_tags(rows, tags, life, ["economy", "brand_3"])
    return out.select("entry_index", F.array_join("tags", ",").alias("tags"))


@query("assign_archived_tags", sql(
    "SELECT slug, 'active' AS status, coalesce(category_slug, 'kind') AS category_slug, CASE WHEN status = 'archived' THEN row_number() OVER (PARTITION BY status ORDER BY slug) ELSE 0 END AS sort_order FROM reg",
    "reg"))
def assign_archived_tags(spark, sf):
    tags, cats, life = _registry(spark, sf)
    asked = tags.where("status = 'archived'").select("slug", F.lit("kind").alias("category_slug"))
    out, _ = tg.assign_archived_tags(tags, cats, life, asked)
    return out.select("slug", "status", "category_slug", "sort_order")


@query("default_taxonomy_use", sql(
    f"SELECT CASE WHEN {slug('event_type')} IN ('feedback', 'draft', 'invalid') THEN 'known' ELSE 'Unknown' END AS category, count(*) AS uses FROM events GROUP BY 1"))
def default_taxonomy_use(spark, sf):
    """Event types looked up in the built-in taxonomy."""
    from ..functions import text as tx

    known = tg.default_taxonomy(spark).select(F.col("tag").alias("slug"), F.lit("known").alias("category"))
    rows = ad.table(spark, sf, "events").select(tx.slug(F.col("event_type")).alias("slug"))
    return (
        rows.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).join(known, "slug", "left")
        .groupBy(F.coalesce("category", F.lit("Unknown")).alias("category")).agg(F.sum("n").alias("uses"))
    )


# --- characters -----------------------------------------------------------------------------------------

CTES["people"] = (
    f"SELECT DISTINCT {slug('w')} AS slug, w AS name, length(w) <> 4 OR w = 'Emma' AS live FROM (SELECT split_part(p_name, ' ', 2) AS w FROM part UNION ALL SELECT 'Emma' FROM part)"
)
CTES["maps"] = "SELECT 'conv-' || e AS u, e, i, 'emma' AS slug FROM tsys WHERE e % 7 = 4 AND r = 'assistant'"
NEEDS["maps"] = ("tsys",)


def _dirty_ids(spark, sf):
    return ad.with_uuids(ad.entries_dirty(spark, sf))


@query("character_candidates", sql(
    f"SELECT 'Emma' AS label, 'emma' AS suggested_slug, 'Emma' AS suggested_name, count(DISTINCT e) AS entries, count(*) AS occurrences, "
    f"left(first({strip('c')} ORDER BY e, i), 140) AS preview FROM dirty WHERE r = 'Emma'", "dirty"))
def character_candidates(spark, sf):
    out = ch.character_candidates(ad.entries_dirty(spark, sf))
    return out.select("label", "suggested_slug", "suggested_name", "entries", "occurrences", "preview")


@query("known_character_roles", sql(
    "SELECT DISTINCT 'emma' AS key, 'emma' AS character_slug, 'assistant' AS training_role FROM maps", "maps"))
def known_character_roles(spark, sf):
    return ch.known_character_roles(ad.characters(spark, sf), ad.mappings(spark, sf))


@query("normalize_known_characters", sql(
    "SELECT e AS entry_index, string_agg(CASE WHEN r = 'Emma' THEN 'assistant' ELSE r END, ',' ORDER BY i) AS roles FROM dirty GROUP BY e", "dirty"))
def normalize_known_characters(spark, sf):
    rows, _ = ch.normalize_known_characters(_dirty_ids(spark, sf), ad.characters(spark, sf), ad.mappings(spark, sf))
    return rows.select("entry_index", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query("known_character_counts", sql(
    "SELECT count(DISTINCT e) AS changed_entries, count(*) AS changed_turns FROM maps", "maps"))
def known_character_counts(spark, sf):
    _, rows = ch.normalize_known_characters(_dirty_ids(spark, sf), ad.characters(spark, sf), ad.mappings(spark, sf))
    return ch.mapping_counts(rows)


@query("apply_character_mapping", sql(
    "SELECT u AS entry_uuid, i AS turn_index, slug AS character_slug, 'assistant' AS training_role, 'Emma' AS source_role_label FROM maps", "maps"))
def apply_character_mapping(spark, sf):
    _, rows, _ = ch.apply_character_mapping(_dirty_ids(spark, sf), ad.characters(spark, sf), {"Emma": "assistant"})
    return rows


NEW_ROWS = "e % 2 = 0"


def _new_rows(spark, sf):
    """Plate speaks the first mapped turn of every even entry instead."""
    odd = F.pmod(F.regexp_extract("entry_uuid", r"(\d+)$", 1).cast("long"), F.lit(2)) == 0
    return (
        ad.mappings(spark, sf).where(odd & (F.col("turn_index") == 2)).withColumn("character_slug", F.lit("plate"))
    )


@query("replace_mappings", sql(
    "SELECT u AS entry_uuid, i AS turn_index, slug AS character_slug FROM maps WHERE e NOT IN (SELECT e FROM maps WHERE e % 2 = 0 AND i = 2) UNION ALL "
    "SELECT u, i, 'plate' FROM maps WHERE e % 2 = 0 AND i = 2", "maps"))
def replace_mappings(spark, sf):
    out = ch.replace_mappings(ad.mappings(spark, sf), _new_rows(spark, sf), ad.characters(spark, sf))
    return out.select("entry_uuid", "turn_index", "character_slug")


@query("upsert_mappings", sql(
    "SELECT u AS entry_uuid, i AS turn_index, CASE WHEN e % 2 = 0 AND i = 2 THEN 'plate' ELSE slug END AS character_slug FROM maps", "maps"))
def upsert_mappings(spark, sf):
    out = ch.upsert_mappings(ad.mappings(spark, sf), _new_rows(spark, sf), ad.characters(spark, sf))
    return out.select("entry_uuid", "turn_index", "character_slug")


@query("character_usage_counts", sql(
    "SELECT p.slug, count(DISTINCT m.e) AS entries FROM people p LEFT JOIN maps m ON m.slug = p.slug WHERE p.live GROUP BY p.slug", "people", "maps"))
def character_usage_counts(spark, sf):
    return ch.character_usage_counts(ad.characters(spark, sf), ad.mappings(spark, sf))


@query("turn_display_names", sql(
    "SELECT d.e AS entry_index, d.i AS turn_index, CASE WHEN m.e IS NOT NULL THEN 'Emma' WHEN lower(d.r) = 'user' THEN 'You' WHEN lower(d.r) = 'assistant' THEN 'AI' "
    "WHEN lower(d.r) = 'system' THEN 'System' ELSE d.r END AS display_name FROM dirty d LEFT JOIN maps m ON m.e = d.e AND m.i = d.i", "dirty", "maps"))
def turn_display_names(spark, sf):
    t = en.entries_to_turns(_dirty_ids(spark, sf)).withColumn("entry_uuid", ad.uuid_of(F.col("entry_index")))
    out = ch.turn_display_names(t, ad.characters(spark, sf), ad.mappings(spark, sf), user_name="You", assistant_name="AI")
    return out.select("entry_index", "turn_index", "display_name")


@query("entries_for_character", sql("SELECT DISTINCT u AS entry_uuid FROM maps", "maps"))
def entries_for_character(spark, sf):
    return ch.entries_for_character(ad.mappings(spark, sf), "emma")


@query("deactivate_characters", sql(
    "SELECT slug, live AND slug <> 'emma' AS is_active, 0 AS mapped_turns FROM people", "people"))
def deactivate_characters(spark, sf):
    chars, maps = ch.deactivate_characters(ad.characters(spark, sf), ad.mappings(spark, sf), ["emma"])
    left = maps.groupBy(F.col("character_slug").alias("slug")).agg(F.count(F.lit(1)).alias("n"))
    return chars.join(left, "slug", "left").select("slug", "is_active", F.coalesce("n", F.lit(0)).alias("mapped_turns"))


@query("inactive_character_references", sql(
    "SELECT t.e AS entry_index, p.name AS character FROM tsys t JOIN people p ON NOT p.live AND contains(lower(t.c), lower(p.name)) WHERE t.i = 0", "tsys", "people"))
def inactive_character_references(spark, sf):
    return ch.inactive_references(_dirty_ids(spark, sf), ad.characters(spark, sf)).select("entry_index", "character")


@query("character_coverage", sql(
    "SELECT 'Emma' AS display_name, (SELECT count(*) FROM maps) AS mapped_turns, (SELECT count(DISTINCT e) FROM maps) AS mapped_entries, "
    "(SELECT count(*) FROM ids) - (SELECT count(DISTINCT e) FROM maps) AS unmapped_entries FROM maps LIMIT 1", "ids", "maps"))
def character_coverage(spark, sf):
    totals, rows = ch.character_coverage(_dirty_ids(spark, sf), ad.characters(spark, sf), ad.mappings(spark, sf))
    return rows.crossJoin(totals)


@query("surviving_mappings", sql(
    "SELECT u AS entry_uuid, i AS turn_index FROM maps WHERE e % 3 <> 1", "maps"))
def surviving_mappings(spark, sf):
    rows = ad.with_uuids(ad.entries(spark, sf)).where(F.col("entry_index") % 3 != 1)
    return ch.surviving_mappings(ad.mappings(spark, sf), rows)[0].select("entry_uuid", "turn_index")


# --- prompt compilation ---------------------------------------------------------------------------------


def _configs(spark, sf):
    """One config per supplier; texts come from the supplier and its nation."""
    s = ad.table(spark, sf, "supplier").join(ad.table(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
    k = F.col("s_suppkey") % 3
    return s.select(
        F.col("s_suppkey").alias("config_id"), F.lit("scenario").alias("template_id"), (k + 1).alias("entry_count"),
        F.when(F.col("s_suppkey") % 5 == 4, 0).otherwise(3).alias("exchange_count"),
        F.concat(F.lit("Talk about "), "s_name").alias("content_instructions"),
        F.when(k == 0, "auto").otherwise("custom").alias("system_prompt_mode"),
        F.when(k == 2, F.col("n_name")).alias("custom_system_prompt"), F.lit("formal").alias("style"),
        F.lit("neutral").alias("tone"), F.lit("paste").alias("output_delivery_mode"),
        F.lit(None).cast("string").alias("additional_instructions"),
    )


def _templates(spark, sf):
    row = ad.table(spark, sf, "region").agg(F.count(F.lit(1)).alias("n"))
    chunk = lambda s, t, live: F.struct(F.lit(s).alias("slug"), F.lit(t).alias("chunk_text"), F.lit(live).alias("is_active"))
    chunks = row.select(F.inline(F.array(
        chunk("intro", "Write {{ entry_count }} entries.", True),
        chunk("topic", "{{ content_instructions }} in a {{ style }} way", True),
        chunk("prompt", "Use: {{ custom_system_prompt }}", True),
        chunk("old", "unused", False),
    )))
    link = lambda i, s, o, k, v: F.struct(
        F.lit(i).alias("id"), F.lit("scenario").alias("template_id"), F.lit(s).alias("chunk_slug"), F.lit(o).alias("sort_order"),
        F.lit(True).alias("is_required"), F.lit(k).cast("string").alias("condition_key"), F.lit(v).cast("string").alias("condition_value"),
    )
    links = row.select(F.inline(F.array(
        link(1, "topic", 2, None, None), link(2, "intro", 1, None, None), link(3, "old", 3, None, None),
        link(4, "prompt", 2, "system_prompt_mode", "custom"),
    )))
    return links, chunks


@query("compile_prompts", sql(
    "SELECT s_suppkey AS config_id, CASE WHEN s_suppkey % 5 = 4 OR s_suppkey % 3 = 1 THEN NULL ELSE 'Write ' || (s_suppkey % 3 + 1) || ' entries.' || chr(10) || chr(10) || "
    "'Talk about ' || s_name || ' in a formal way' || CASE WHEN s_suppkey % 3 = 2 THEN chr(10) || chr(10) || 'Use: ' || n_name ELSE '' END END AS prompt, "
    "CASE WHEN s_suppkey % 5 = 4 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 3 = 1 THEN 1 ELSE 0 END AS errors FROM supplier JOIN nation ON s_nationkey = n_nationkey"))
def compile_prompts(spark, sf):
    out = pr.compile_prompts(_configs(spark, sf), *_templates(spark, sf))
    return out.select("config_id", "prompt", F.size("errors").alias("errors"))
