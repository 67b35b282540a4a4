"""Queries: merge, bulk edits, split, join, upsert."""

from pyspark.sql import functions as F

from ..operators import entries as en
from ..operators import mutate as mu
from . import adapters as ad
from . import load
from .base import CTES, NEEDS, query, slug, sql
from .catalog_entries import _fingerprint

TEXT_OF = "md5(string_agg(r || chr(1) || c, chr(2) ORDER BY i))"
CTES["whole"] = f"SELECT e, count(*) AS n, {TEXT_OF} AS fp FROM tsys GROUP BY e"
NEEDS["whole"] = ("tsys",)
CTES["tagtext"] = "SELECT i.e, coalesce(string_agg(tag, ',' ORDER BY pos), '') AS tags FROM ids i LEFT JOIN tagrows t ON t.e = i.e GROUP BY i.e"
NEEDS["tagtext"] = ("ids", "tagrows")


def _id_frame(df, cond):
    return df.where(cond).select(en.entry_id().alias("entry_id"))


def _ids(spark, sf, cond):
    """Ids of the conversations that satisfy a condition on ``e``."""
    rows = ad.table(spark, sf, "conversations").select(F.col("conv_id").alias("e")).distinct()
    return rows.where(cond).select(F.concat(F.lit("entry_index:"), F.col("e").cast("string")).alias("entry_id"))


def _tags_text():
    return F.array_join("tags", ",").alias("tags")


def _merge_input(spark, sf):
    """The tagged entries, then every third one again with other tags."""
    first = ad.entries_tagged(spark, sf)
    again = first.where(F.col("entry_index") % 3 == 0).withColumn(
        "tags", F.array(F.lit("again"), F.concat(F.lit("t"), (F.col("entry_index") % 2).cast("string")))
    )
    return mu.union_sources([first, again])


# conversations with the same user and assistant turns are one
CTES["dialog"] = (
    "SELECT e, coalesce(md5(string_agg(r || chr(1) || c, chr(2) ORDER BY i) FILTER (r IN ('user', 'assistant'))), '') AS k FROM tsys GROUP BY e"
)
CTES["copies"] = (
    "SELECT 0 AS f, d.e, d.k, t.tags FROM dialog d JOIN tagtext t ON t.e = d.e UNION ALL "
    "SELECT 1, e, k, 'again,t' || e % 2 FROM dialog WHERE e % 3 = 0"
)
NEEDS.update({"dialog": ("tsys",), "copies": ("dialog", "tagtext")})


@query("merge_dedupe", sql(
    "SELECT k.file_order, k.e AS entry_index, coalesce(CASE WHEN n > 1 THEN u.tags ELSE k.tags END, '') AS tags, n AS copies FROM "
    "(SELECT k, first(f ORDER BY f, e) AS file_order, first(e ORDER BY f, e) AS e, first(tags ORDER BY f, e) AS tags, count(*) AS n FROM copies GROUP BY k) k "
    "LEFT JOIN (SELECT k, string_agg(tag, ',' ORDER BY f, e, p) AS tags FROM (SELECT k, tag, f, e, p FROM (SELECT k, f, e, unnest(string_split(tags, ',')) AS tag, "
    "generate_subscripts(string_split(tags, ','), 1) AS p FROM copies WHERE tags <> '') QUALIFY row_number() OVER (PARTITION BY k, tag ORDER BY f, e, p) = 1) GROUP BY k) u "
    "ON u.k = k.k", "copies"))
def merge_dedupe(spark, sf):
    return mu.merge_dedupe(_merge_input(spark, sf)).select("file_order", "entry_index", _tags_text(), "copies")


@query("merge_datasets", sql(
    "SELECT row_number() OVER (ORDER BY f, e) - 1 AS entry_index, e AS old_index, n AS copies FROM "
    "(SELECT k, first(f ORDER BY f, e) AS f, first(e ORDER BY f, e) AS e, count(*) AS n FROM merged_copies GROUP BY k)",
    "copies", merged_copies="SELECT 1 - f AS f, e, k FROM copies"))
def merge_datasets(spark, sf):
    """The copies first, then all entries, as one densely numbered dataset."""
    stacked = _merge_input(spark, sf)
    marked = stacked.withColumn("source", F.col("entry_index").cast("string"))
    parts = [marked.where(f"file_order = {n}").select(*en.ENTRY_COLUMNS) for n in (1, 0)]
    return mu.merge_datasets(parts).select("entry_index", F.col("source").cast("long").alias("old_index"), "copies")


@query("merge_counts", sql(
    "SELECT count(*) AS total_loaded, count(*) - count(DISTINCT k) AS duplicates_removed FROM copies", "copies"))
def merge_counts(spark, sf):
    return mu.merge_counts(mu.merge_dedupe(_merge_input(spark, sf)))


@query("save_merged", sql(
    "SELECT count(*) AS entries, 1 AS dataset_ids, (SELECT count(*) FROM tsys WHERE e % 7 = 4 AND r = 'assistant' AND e IN (SELECT e FROM firsts)) AS kept_mappings, "
    "(SELECT count(DISTINCT e) FROM tsys WHERE e % 7 = 4 AND r = 'assistant' AND e NOT IN (SELECT e FROM firsts)) AS dropped_entries FROM firsts",
    "copies", "tsys", firsts="SELECT k, first(e ORDER BY f, e) AS e FROM copies GROUP BY k"))
def save_merged(spark, sf):
    """Two datasets saved as one: merged, normalized, current tags, surviving mappings, stamped."""
    stacked = ad.with_uuids(_merge_input(spark, sf))
    frames = [stacked.where(f"file_order = {n}").select(*en.ENTRY_COLUMNS) for n in (0, 1)]
    kept = {n: getattr(ad, n)(spark, sf) for n in ("tags", "categories", "lifecycle", "mappings")}
    stamped, maps, dropped = load.save_merged(frames, kept, "merged-1")
    counts = stamped.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("meta.dataset_uuid").alias("dataset_ids"))
    return counts.crossJoin(maps.agg(F.count(F.lit(1)).alias("kept_mappings"))).crossJoin(
        dropped.agg(F.count(F.lit(1)).alias("dropped_entries"))
    )


@query("delete_entries", sql("SELECT e AS entry_index FROM ids WHERE e % 3 <> 1", "ids"))
def delete_entries(spark, sf):
    return mu.delete_entries(ad.entries(spark, sf), _ids(spark, sf, F.col("e") % 3 == 1)).select("entry_index")


@query("unknown_ids", sql("SELECT 'entry_index:' || doc_id AS entry_id FROM labels WHERE doc_id NOT IN (SELECT e FROM ids)", "ids"))
def unknown_ids(spark, sf):
    asked = ad.table(spark, sf, "labels").select(
        F.concat(F.lit("entry_index:"), F.col("doc_id").cast("string")).alias("entry_id")
    )
    return mu.unknown_ids(ad.entries(spark, sf), asked)


EVEN = "e % 2 = 0"


@query("replace_tags", sql(
    f"SELECT e AS entry_index, CASE WHEN {EVEN} THEN 'new_tag,x' ELSE tags END AS tags FROM tagtext", "tagtext"))
def replace_tags(spark, sf):
    ids = _ids(spark, sf, F.col("e") % 2 == 0)
    return mu.replace_tags(ad.entries_tagged(spark, sf), ["New Tag", "x", "new-tag"], ids).select("entry_index", _tags_text())


@query("clear_tags", sql(
    f"SELECT e AS entry_index, CASE WHEN {EVEN} THEN '' ELSE tags END AS tags FROM tagtext", "tagtext"))
def clear_tags(spark, sf):
    ids = _ids(spark, sf, F.col("e") % 2 == 0)
    return mu.clear_tags(ad.entries_tagged(spark, sf), ids).select("entry_index", _tags_text())


@query("add_tags", sql(
    "SELECT e AS entry_index, CASE WHEN tags = '' THEN 'ECONOMY,extra' WHEN contains(tags, 'ECONOMY') THEN tags || ',extra' "
    "ELSE tags || ',ECONOMY,extra' END AS tags FROM tagtext", "tagtext"))
def add_tags(spark, sf):
    return mu.add_tags(ad.entries_tagged(spark, sf), ["ECONOMY", "extra"]).select("entry_index", _tags_text())


@query("remove_tags", sql(
    "SELECT i.e AS entry_index, coalesce(string_agg(tag, ',' ORDER BY pos) FILTER (tag NOT IN ('ECONOMY', 'SMALL')), '') AS tags "
    "FROM ids i LEFT JOIN tagrows t ON t.e = i.e GROUP BY i.e", "ids", "tagrows"))
def remove_tags(spark, sf):
    return mu.remove_tags(ad.entries_tagged(spark, sf), ["ECONOMY", "SMALL"]).select("entry_index", _tags_text())


@query("set_tags", sql("SELECT e AS entry_index, 'b,a' AS tags FROM ids", "ids"))
def set_tags(spark, sf):
    return mu.set_tags(ad.entries_tagged(spark, sf), ["b", "a", "b"]).select("entry_index", _tags_text())


@query("replace_system_prompt", sql(
    f"SELECT e AS entry_index, max(CASE WHEN i = 0 THEN CASE WHEN {EVEN} THEN 'Fresh prompt' ELSE c END END) AS prompt FROM tsys GROUP BY e", "tsys"))
def replace_system_prompt(spark, sf):
    rows = mu.replace_system_prompt(ad.entries_sys(spark, sf), "Fresh prompt", _ids(spark, sf, F.col("e") % 2 == 0))
    return rows.select("entry_index", F.get("messages", F.lit(0))["content"].alias("prompt"))


@query("duplicate_entries", sql(
    "SELECT e AS entry_index, fp AS fingerprint FROM whole UNION ALL SELECT (SELECT max(e) + 1 FROM ids) + row_number() OVER (ORDER BY e) - 1, fp FROM whole WHERE e % 5 = 2",
    "whole", "ids"))
def duplicate_entries(spark, sf):
    rows, _ = mu.duplicate_entries(ad.entries_sys(spark, sf), _ids(spark, sf, F.col("e") % 5 == 2))
    return rows.select("entry_index", _fingerprint().alias("fingerprint"))


@query("duplicate_mappings", sql(
    "SELECT i AS turn_index, count(*) AS rows FROM (SELECT e, i FROM tsys WHERE e % 7 = 4 AND r = 'assistant' UNION ALL "
    "SELECT e, i FROM tsys WHERE e % 7 = 4 AND r = 'assistant' AND e % 5 = 2) GROUP BY i", "tsys"))
def duplicate_mappings(spark, sf):
    rows = ad.with_uuids(ad.entries_sys(spark, sf))
    ids = rows.where(F.col("entry_index") % 5 == 2).select(en.entry_id().alias("entry_id"))
    _, maps = mu.duplicate_entries(rows, ids, ad.mappings(spark, sf))
    return maps.groupBy("turn_index").agg(F.count(F.lit(1)).alias("rows"))


# --- split and join -----------------------------------------------------------------------------

# an entry of x complete, clean exchanges is cut after the first one
CTES["cut"] = (
    "SELECT e, count(*) AS n, count(*) >= 5 AND count(*) % 2 = 1 AND NOT bool_or((i % 2 = 1 AND r <> 'user') OR (i > 0 AND i % 2 = 0 AND r <> 'assistant')) AS ok "
    "FROM tsys GROUP BY e"
)
NEEDS["cut"] = ("tsys",)
CTES["segments"] = (
    "SELECT t.e, CASE WHEN c.ok AND t.i > 2 THEN 1 ELSE 0 END AS seg, t.i, t.r, t.c FROM tsys t JOIN cut c ON c.e = t.e UNION ALL "
    "SELECT t.e, 1, 0, t.r, t.c FROM tsys t JOIN cut c ON c.e = t.e WHERE c.ok AND t.i = 0"
)
NEEDS["segments"] = ("tsys", "cut")


def _split_requests(spark, sf):
    return _ids(spark, sf, F.lit(True)).withColumn("split_points", F.array(F.lit(1)))


@query("split_entries", sql(
    f"SELECT row_number() OVER (ORDER BY e, seg) - 1 AS entry_index, fp AS fingerprint FROM (SELECT e, seg, {TEXT_OF} AS fp FROM segments GROUP BY e, seg)",
    "segments"))
def split_entries(spark, sf):
    rows, _, _ = mu.split_entries(ad.entries_sys(spark, sf), _split_requests(spark, sf))
    return rows.select("entry_index", _fingerprint().alias("fingerprint"))


@query("split_rejects", sql(
    "SELECT 'entry_index:' || e AS entry_id FROM cut WHERE NOT ok", "cut"))
def split_rejects(spark, sf):
    _, rejects, _ = mu.split_entries(ad.entries_sys(spark, sf), _split_requests(spark, sf))
    return rejects.select("entry_id")


@query("split_mappings", sql(
    "SELECT CASE WHEN c.ok AND t.i > 2 THEN t.i - 2 ELSE t.i END AS turn_index, count(*) AS rows FROM tsys t JOIN cut c ON c.e = t.e "
    "WHERE t.e % 7 = 4 AND t.r = 'assistant' GROUP BY 1", "cut"))
def split_mappings(spark, sf):
    rows = ad.with_uuids(ad.entries_sys(spark, sf))
    requests = rows.select(en.entry_id().alias("entry_id"), F.array(F.lit(1)).alias("split_points"))
    _, _, maps = mu.split_entries(rows, requests, ad.mappings(spark, sf))
    return maps.groupBy("turn_index").agg(F.count(F.lit(1)).alias("rows"))


# neighbours 2g and 2g+1 are chained when the result is well formed
CTES["glue"] = (
    "SELECT e // 2 AS g, e % 2 AS s, i, r, c, count(*) FILTER (i > 0) OVER (PARTITION BY e) AS turns FROM tsys"
)
CTES["joined"] = (
    "SELECT g, s, i, r, c, CASE WHEN s = 0 THEN i ELSE i + (SELECT max(turns) FROM glue x WHERE x.g = glue.g AND x.s = 0) END AS k FROM glue WHERE NOT (s = 1 AND i = 0)"
)
CTES["fit"] = (
    "SELECT g, count(DISTINCT s) = 2 AND count(*) % 2 = 1 AND count(*) >= 3 AND NOT bool_or((k % 2 = 1 AND r <> 'user') OR (k > 0 AND k % 2 = 0 AND r <> 'assistant')) AS ok FROM joined GROUP BY g"
)
NEEDS.update({"glue": ("tsys",), "joined": ("glue",), "fit": ("joined",)})


def _join_groups(spark, sf):
    rows = ad.table(spark, sf, "conversations").select(F.col("conv_id").alias("e")).distinct()
    return rows.select(
        F.floor(F.col("e") / 2).alias("group_id"),
        F.concat(F.lit("entry_index:"), F.col("e").cast("string")).alias("entry_id"),
        (F.col("e") % 2).alias("seq"),
    )


@query("join_entries", sql(
    f"SELECT row_number() OVER (ORDER BY o) - 1 AS entry_index, fp AS fingerprint FROM (SELECT j.g * 2 AS o, md5(string_agg(r || chr(1) || c, chr(2) ORDER BY k)) AS fp "
    "FROM joined j JOIN fit f ON f.g = j.g AND f.ok GROUP BY j.g UNION ALL SELECT w.e, w.fp FROM whole w JOIN fit f ON f.g = w.e // 2 AND NOT f.ok)",
    "joined", "fit", "whole"))
def join_entries(spark, sf):
    rows, _, _ = mu.join_entries(ad.entries_sys(spark, sf), _join_groups(spark, sf))
    return rows.select("entry_index", _fingerprint().alias("fingerprint"))


@query("join_report", sql(
    "SELECT g AS group_id, p <> q AS prompts_differ, ok AS joined FROM (SELECT g, max(CASE WHEN s = 0 THEN c END) AS p, max(CASE WHEN s = 1 THEN c END) AS q "
    "FROM glue WHERE i = 0 GROUP BY g HAVING count(*) = 2) JOIN fit USING (g)", "glue", "fit"))
def join_report(spark, sf):
    _, report, _ = mu.join_entries(ad.entries_sys(spark, sf), _join_groups(spark, sf))
    return report.where(F.col("members") == 2).select("group_id", "prompts_differ", F.col("reason").isNull().alias("joined"))


@query("join_mappings", sql(
    "SELECT CASE WHEN f.ok THEN j.k ELSE j.i END AS turn_index, count(*) AS rows FROM joined j JOIN fit f ON f.g = j.g "
    "WHERE (j.g * 2 + j.s) % 7 = 4 AND j.r = 'assistant' GROUP BY 1", "joined", "fit"))
def join_mappings(spark, sf):
    rows = ad.with_uuids(ad.entries_sys(spark, sf))
    groups = rows.select(
        F.floor(F.col("entry_index") / 2).alias("group_id"), en.entry_id().alias("entry_id"),
        (F.col("entry_index") % 2).alias("seq"),
    )
    _, _, maps = mu.join_entries(rows, groups, ad.mappings(spark, sf))
    return maps.groupBy("turn_index").agg(F.count(F.lit(1)).alias("rows"))


# --- upsert -------------------------------------------------------------------------------------------

# patch: two turns for every third entry; every ninth one lacks an answer
def _patch(spark, sf):
    rows = ad.entries_sys(spark, sf).where(F.col("entry_index") % 3 == 0)
    answer = F.when(F.col("entry_index") % 9 == 0, "").otherwise("Sure.")
    turns = F.array(
        F.get("messages", F.lit(0)), en.message(F.lit("human"), F.lit(" Hello ")), en.message(F.lit("assistant"), answer)
    )
    return rows.withColumn("entry_id", en.entry_id()).withColumn("messages", turns)


@query("upsert_entries", sql(
    "SELECT e AS entry_index, CASE WHEN e % 3 = 0 AND e % 9 <> 0 THEN 3 ELSE n END AS n_messages, "
    "CASE WHEN e % 3 = 0 AND e % 9 <> 0 THEN 'Hello' ELSE x END AS first_turn FROM whole JOIN (SELECT e, c AS x FROM tsys WHERE i = 1) USING (e)", "whole", "tsys"))
def upsert_entries(spark, sf):
    rows, _ = mu.upsert_entries(ad.entries_sys(spark, sf), _patch(spark, sf))
    return rows.select("entry_index", F.size("messages").alias("n_messages"), F.get("messages", F.lit(1))["content"].alias("first_turn"))


@query("upsert_rejects", sql(
    "SELECT 'entry_index:' || e AS entry_id, 1 AS errors FROM ids WHERE e % 9 = 0", "ids"))
def upsert_rejects(spark, sf):
    _, rejects = mu.upsert_entries(ad.entries_sys(spark, sf), _patch(spark, sf))
    return rejects.select("entry_id", F.size("errors").alias("errors"))
