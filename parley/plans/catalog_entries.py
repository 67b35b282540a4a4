"""Queries: entry building, features, statistics, normalization, search."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import entries as en
from ..operators import features as fe
from ..operators import normalize as no
from ..operators import search as se
from ..operators import stats as st
from ..operators.mutate import shuffle_entries
from . import adapters as ad
from .base import collapse, display, folded, query, slug, sql, std_role, strip, words

ROLES_CONTENT = "md5(string_agg(r || chr(1) || c, chr(2) ORDER BY i))"


def _fingerprint(col="messages"):
    return F.md5(
        F.array_join(F.transform(col, lambda m: F.concat(m["role"], F.lit("\u0001"), m["content"])), "\u0002")
    )


@query("exchange_distribution", sql(
    "SELECT x AS exchanges, count(*) AS entries FROM (SELECT e, count(*) FILTER (r <> 'system') // 2 AS x FROM raw GROUP BY e) GROUP BY x",
    "raw"))
def exchange_distribution(spark, sf):
    return st.exchange_distribution(fe.from_turns(ad.turns(spark, sf)))


@query("turns_to_entries", sql(
    f"SELECT e AS entry_index, count(*) AS n_messages, {ROLES_CONTENT} AS fingerprint FROM tsys GROUP BY e", "tsys"))
def turns_to_entries(spark, sf):
    return ad.entries_sys(spark, sf).select(
        "entry_index", F.size("messages").alias("n_messages"), _fingerprint().alias("fingerprint")
    )


@query("entries_to_turns", sql(
    "SELECT e AS entry_index, i AS turn_index, r AS role, length(c) AS chars FROM tsys WHERE r = 'assistant'", "tsys"))
def entries_to_turns(spark, sf):
    return en.entries_to_turns(ad.entries_sys(spark, sf), "assistant").select(
        "entry_index", "turn_index", "role", F.length("content").alias("chars")
    )


FEATURE_SQL = f"""
SELECT e AS entry_index, count(*) AS n_messages, count(*) FILTER (r <> 'system') // 2 AS exchanges,
 count(*) FILTER (r = 'user') AS user_n, coalesce(sum(length(c)) FILTER (r = 'user'), 0)::BIGINT AS user_chars,
 coalesce(sum({words('c')}) FILTER (r = 'user'), 0)::BIGINT AS user_words,
 count(*) FILTER (r = 'assistant') AS asst_n,
 coalesce(sum(length(c)) FILTER (r = 'assistant'), 0)::BIGINT AS asst_chars,
 coalesce(sum({words('c')}) FILTER (r = 'assistant'), 0)::BIGINT AS asst_words,
 min(length(c)) FILTER (r = 'assistant') AS asst_min_chars, max(length(c)) FILTER (r = 'assistant') AS asst_max_chars,
 sum(length(c))::BIGINT AS text_chars,
 count(*) FILTER (r = 'assistant' AND {words('c')} < 20) AS short_n,
 count(*) FILTER (r = 'assistant' AND {words('c')} = 0) AS empty_n,
 max(CASE WHEN i = 0 AND r = 'system' THEN sha1({folded('c')}) END) AS prompt_key,
 coalesce(max(CASE WHEN i = 0 AND r = 'system' THEN length({strip('c')}) END), 0) AS prompt_chars
FROM @T GROUP BY e"""


@query("entry_features", sql(FEATURE_SQL.replace("@T", "raw"), "raw"))
def entry_features(spark, sf):
    """Flat route: sums over turns, no nested rows."""
    return fe.from_turns(ad.turns(spark, sf)).drop("placeholder_n")


@query("entry_features_nested", sql(FEATURE_SQL.replace("@T", "dirty"), "dirty"))
def entry_features_nested(spark, sf):
    """Nested route over damaged entries."""
    f = fe.from_entries(ad.entries_dirty(spark, sf))
    return f.select(*[c for c in fe.FEATURES if c != "placeholder_n"])


STATS_SQL = f"""
SELECT count(*) AS total, sum(exchanges)::BIGINT AS total_exchanges, sum(exchanges) / count(*) AS avg_exchanges,
 count(*) FILTER (exchanges = 1) AS single_turn, count(*) FILTER (exchanges > 1) AS multi_turn,
 sum(user_chars) / sum(user_n) AS avg_user_len, sum(asst_chars) / sum(asst_n) AS avg_asst_len,
 sum(text_chars) / count(*) AS avg_entry_len, min(asst_min_chars) AS min_asst_len, max(asst_max_chars) AS max_asst_len
FROM ({FEATURE_SQL.replace('@T', 'raw')})"""


@query("dataset_stats", sql(STATS_SQL, "raw"))
def dataset_stats(spark, sf):
    return st.dataset_stats(fe.from_turns(ad.turns(spark, sf)))


@query("exchange_depth_rows", sql(
    "SELECT CASE WHEN x >= 8 THEN '8+' ELSE x::VARCHAR END AS exchange_count, count(*) AS entries, "
    "CASE WHEN x BETWEEN 3 AND 7 THEN 'Optimal 3-7' ELSE 'Review' END AS \"range\" FROM "
    "(SELECT least(count(*) FILTER (r <> 'system') // 2, 8) AS x FROM raw GROUP BY e) GROUP BY x", "raw"))
def exchange_depth_rows(spark, sf):
    return st.exchange_depth_rows(fe.from_turns(ad.turns(spark, sf)))


@query("response_length_distribution", sql(
    f"SELECT {words('c')} AS words, count(*) AS messages FROM raw WHERE r = 'assistant' GROUP BY 1", "raw"))
def response_length_distribution(spark, sf):
    return st.response_length_distribution(fe.answer_words_from_turns(ad.turns(spark, sf)))


@query("split_candidates", sql(
    "SELECT e AS entry_index, x AS exchanges FROM (SELECT e, count(*) FILTER (r <> 'system') // 2 AS x FROM raw GROUP BY e) WHERE x >= 4",
    "raw"))
def split_candidates(spark, sf):
    """Threshold 4: the test conversations stay under the default of 8."""
    return st.split_candidates(fe.from_turns(ad.turns(spark, sf)), 4).select("entry_index", "exchanges")


@query("prompt_concentration", sql(
    f"SELECT substr(sha1({folded('c')}), 1, 12) AS prompt_key, count(*) AS entries FROM tsys WHERE i = 0 AND r = 'system' GROUP BY 1",
    "tsys"))
def prompt_concentration(spark, sf):
    return st.prompt_concentration(fe.from_entries(ad.entries_sys(spark, sf)))


@query("prompt_rows", sql(
    f"SELECT k AS prompt_key, arg_min(p, e) AS prompt, count(*) AS entries, "
    "printf('%.1f%%', count(*) / (SELECT count(DISTINCT e) FROM tsys) * 100) AS share, "
    "count(*) / (SELECT count(DISTINCT e) FROM tsys) > 0.8 AS dominant FROM "
    f"(SELECT e, substr(sha1({folded('c')}), 1, 12) AS k, CASE WHEN length({collapse('c')}) <= 100 THEN {collapse('c')} "
    f"ELSE rtrim({collapse('c')}[1:99]) || '...' END AS p FROM tsys WHERE i = 0 AND r = 'system') GROUP BY k", "tsys"))
def prompt_rows(spark, sf):
    e = ad.entries_sys(spark, sf)
    return st.prompt_rows(en.entries_to_turns(e), fe.from_entries(e))


# --- tags ----------------------------------------------------------------------------------


@query("tag_counts", sql("SELECT tag, count(*) AS uses FROM tagrows GROUP BY tag", "tagrows"))
def tag_counts(spark, sf):
    return st.tag_counts(ad.entries_tagged(spark, sf))


@query("tag_totals", sql(
    "SELECT (SELECT count(*) FROM ids WHERE e % 5 = 0) AS untagged_count, count(DISTINCT tag) AS unique_tags FROM tagrows",
    "tagrows"))
def tag_totals(spark, sf):
    return st.tag_totals(ad.entries_tagged(spark, sf))


@query("tag_category_counts", sql(
    f"SELECT coalesce(r.category_slug, 'Unknown') AS category, count(*) AS uses FROM (SELECT {slug('tag')} AS s FROM tagrows) t "
    "LEFT JOIN reg r ON r.slug = t.s AND r.status = 'active' GROUP BY 1", "tagrows", "reg"))
def tag_category_counts(spark, sf):
    from ..operators.tags import active_tags

    live = active_tags(ad.tags(spark, sf), ad.categories(spark, sf))
    e = no.normalize_tags(ad.entries_tagged(spark, sf))
    return st.tag_category_counts(e, live.select(F.col("slug").alias("tag"), F.col("category_slug").alias("category")))


@query("top_tags", sql(
    "SELECT tag, entries, printf('%.1f%%', entries / (SELECT count(DISTINCT e) FROM tagrows) * 100) AS share FROM "
    "(SELECT tag, count(DISTINCT e) AS entries, min(e * 10 + pos) AS f FROM tagrows GROUP BY tag) ORDER BY entries DESC, f LIMIT 5",
    "tagrows"))
def top_tags(spark, sf):
    return st.top_tags(ad.entries_tagged(spark, sf))


@query("used_tags", sql("SELECT DISTINCT tag FROM tagrows", "tagrows"))
def used_tags(spark, sf):
    return se.used_tags(ad.entries_tagged(spark, sf))


@query("untagged_entries", sql("SELECT e AS entry_index FROM ids WHERE e % 5 = 0", "ids"))
def untagged_entries(spark, sf):
    return se.untagged_entries(ad.entries_tagged(spark, sf)).select("entry_index")


@query("available_filter_tags", sql(
    f"SELECT CASE WHEN k.slug IS NULL THEN 1 ELSE 0 END AS grp, coalesce(k.rank, 0) AS pos, u.s AS tag FROM "
    f"(SELECT DISTINCT {slug('tag')} AS s FROM tagrows) u LEFT JOIN (SELECT slug, row_number() OVER (ORDER BY slug) AS rank "
    "FROM reg WHERE status = 'active') k ON k.slug = u.s "
    "UNION ALL SELECT 2, 0, '__untagged__' WHERE EXISTS (SELECT 1 FROM ids WHERE e % 5 = 0)", "tagrows", "reg"))
def available_filter_tags(spark, sf):
    known = ad.tags(spark, sf).where("status = 'active'").select(
        F.col("slug").alias("tag"), F.expr("row_number() over (order by slug)").alias("rank")
    )
    return se.available_filter_tags(no.normalize_tags(ad.entries_tagged(spark, sf)), known)


@query("tag_slugs", sql(
    f"SELECT tag, {slug('tag')} AS slug, {display(slug('tag'))} AS display_name FROM (SELECT DISTINCT tag FROM tagrows)", "tagrows"))
def tag_slugs(spark, sf):
    t = se.used_tags(ad.entries_tagged(spark, sf))
    s = tx.slug(F.col("tag"))
    return t.select("tag", s.alias("slug"), no.tag_display_name(s).alias("display_name"))


@query("normalize_tags", sql(
    "SELECT count(*) FILTER (ts <> ss) AS changed_entries, coalesce(sum(len(list_filter(list_zip(ts, ss), lambda p: p[1] <> p[2]))), 0)::BIGINT AS changed_tags, "
    "(SELECT count(DISTINCT s) FROM t) AS normalized_slugs FROM (SELECT e, list(tag ORDER BY pos) AS ts, list(s ORDER BY pos) AS ss FROM t GROUP BY e)",
    "tagrows", t=f"SELECT *, {slug('tag')} AS s FROM tagrows"))
def normalize_tags(spark, sf):
    out = no.tag_normalization_summary(no.normalize_tags(ad.entries_tagged(spark, sf)))
    return out.select("changed_entries", "changed_tags", "normalized_slugs")


# --- normalization ------------------------------------------------------------------------------

WANT = "CASE WHEN i = 0 THEN 'system' WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END"
NORMAL_ROLE = f"CASE WHEN {std_role('r')} = {WANT} THEN {std_role('r')} ELSE r END"


@query("normalize_role", sql(
    f"SELECT r AS role, coalesce({std_role('r')}, r) AS normalized, count(*) AS uses FROM dirty GROUP BY 1, 2", "dirty"))
def normalize_role(spark, sf):
    from ..functions.roles import normalize_role as normal

    t = en.entries_to_turns(ad.entries_dirty(spark, sf))
    return t.groupBy("role", normal(F.col("role")).alias("normalized")).agg(F.count(F.lit(1)).alias("uses"))


@query("normalize_roles_positional", sql(
    f"SELECT e AS entry_index, count(*) FILTER ({NORMAL_ROLE} <> r) AS roles_normalized, string_agg({NORMAL_ROLE}, ',' ORDER BY i) AS roles "
    "FROM dirty GROUP BY e", "dirty"))
def normalize_roles_positional(spark, sf):
    return no.normalize_roles(ad.entries_dirty(spark, sf)).select(
        "entry_index", "roles_normalized", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles")
    )


@query("trim_content", sql(
    f"SELECT e AS entry_index, count(*) FILTER ({strip('c')} <> c) AS contents_trimmed, sum(length({strip('c')}))::BIGINT AS chars FROM dirty GROUP BY e",
    "dirty"))
def trim_content(spark, sf):
    return no.trim_content(ad.entries_dirty(spark, sf)).select(
        "entry_index", "contents_trimmed",
        F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"])).alias("chars"),
    )


@query("normalize_baseline", sql(
    f"SELECT e AS entry_index, count(*) FILTER ({NORMAL_ROLE} <> r) AS roles_normalized, "
    f"count(*) FILTER ({strip('c')} <> c) AS contents_trimmed, bool_or({NORMAL_ROLE} <> r OR {strip('c')} <> c) AS changed, "
    f"md5(string_agg({NORMAL_ROLE} || chr(1) || {strip('c')}, chr(2) ORDER BY i)) AS fingerprint FROM dirty GROUP BY e", "dirty"))
def normalize_baseline(spark, sf):
    return no.normalize_baseline(ad.entries_dirty(spark, sf)).select(
        "entry_index", "roles_normalized", "contents_trimmed", "changed", _fingerprint().alias("fingerprint")
    )


@query("normalize_entries", sql(
    f"SELECT d.e AS entry_index, m.fp AS fingerprint, coalesce(t.tags, '') AS tags, m.ch OR coalesce(t.ch, false) AS changed FROM ids d "
    f"JOIN (SELECT e, bool_or({NORMAL_ROLE} <> r OR {strip('c')} <> c) AS ch, md5(string_agg({NORMAL_ROLE} || chr(1) || {strip('c')}, chr(2) ORDER BY i)) AS fp "
    "FROM dirty GROUP BY e) m ON m.e = d.e LEFT JOIN "
    f"(SELECT e, string_agg({slug('tag')}, ',' ORDER BY pos) AS tags, bool_or({slug('tag')} <> tag) AS ch FROM tagrows GROUP BY e) t ON t.e = d.e",
    "dirty", "tagrows"))
def normalize_entries(spark, sf):
    rows = ad.with_part_tags(ad.entries_dirty(spark, sf), spark, sf)
    return no.normalize_entries(rows).select(
        "entry_index", _fingerprint().alias("fingerprint"), F.array_join("tags", ",").alias("tags"), "changed"
    )


@query("set_system_prompt", sql(
    "SELECT e AS entry_index, count(*) FILTER (i > 0 OR r <> 'system') + 1 AS n_messages, 'New prompt' AS first_content FROM raw GROUP BY e", "raw"))
def set_system_prompt(spark, sf):
    rows = ad.entries(spark, sf).withColumn("messages", no.set_system_prompt(F.col("messages"), F.lit("New prompt")))
    return rows.select(
        "entry_index", F.size("messages").alias("n_messages"), F.get("messages", F.lit(0))["content"].alias("first_content")
    )


@query("scaffold_turns", sql(
    "SELECT e AS entry_index, CASE WHEN bool_or(r = 'system') THEN 1 ELSE 0 END + n AS n_messages FROM "
    "(SELECT *, (count(*) FILTER (r <> 'system') OVER (PARTITION BY e) + 1) // 2 * 2 AS n FROM raw) GROUP BY e, n", "raw"))
def scaffold_turns(spark, sf):
    """The test turns alternate, so only a missing last answer is added."""
    rows = ad.entries(spark, sf).withColumn("messages", no.scaffold_turns(F.col("messages")))
    return rows.select("entry_index", F.size("messages").alias("n_messages"))


@query("ensure_entry_uuid", sql("SELECT count(*) AS entries, count(*) AS different_ids, 36 AS id_length FROM ids", "ids"))
def ensure_entry_uuid(spark, sf):
    rows = no.ensure_entry_uuid(ad.entries(spark, sf))
    return rows.agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("meta.entry_uuid").alias("different_ids"),
        F.max(F.length("meta.entry_uuid")).alias("id_length"),
    )


@query("stamp_entries", sql("SELECT count(*) AS native_entries, 1 AS dataset_ids FROM ids", "ids"))
def stamp_entries(spark, sf):
    return no.stamp_entries(ad.entries(spark, sf)).agg(
        F.count_if("meta.native").alias("native_entries"), F.count_distinct("meta.dataset_uuid").alias("dataset_ids")
    )


@query("dataset_identity", sql("SELECT 'dataset-1' AS dataset_uuid, false AS is_native FROM ids LIMIT 1", "ids"))
def dataset_identity(spark, sf):
    rows = ad.with_uuids(ad.entries(spark, sf))
    return no.dataset_uuid(rows).crossJoin(no.is_native_dataset(rows))


# --- search -----------------------------------------------------------------------------------------

SEARCH_TEXT = f"SELECT e, {folded('string_agg(c, chr(10) ORDER BY i)')} AS t FROM raw WHERE r IN ('user', 'assistant') GROUP BY e"


@query("search_contains", sql("SELECT e AS entry_index FROM s WHERE contains(t, 'the and')", "raw", s=SEARCH_TEXT))
def search_contains(spark, sf):
    return se.search(ad.entries(spark, sf), "  THE   and").select("entry_index")


@query("search_all_words", sql(
    "SELECT e AS entry_index FROM s WHERE contains(t, 'the') AND contains(t, 'ing') AND contains(t, 'sh')", "raw", s=SEARCH_TEXT))
def search_all_words(spark, sf):
    return se.search(ad.entries(spark, sf), "The ING sh", "all_words").select("entry_index")


@query("search_exact_phrase", sql(
    "SELECT e AS entry_index FROM s WHERE contains(t, 'in the')", "raw",
    s=f"SELECT e, {folded('string_agg(c, chr(10) ORDER BY i)')} AS t FROM raw WHERE r = 'assistant' GROUP BY e"))
def search_exact_phrase(spark, sf):
    return se.search(ad.entries(spark, sf), "in the", "exact_phrase", ("assistant",)).select("entry_index")


TAG_SETS = "SELECT i.e, coalesce(list(t.tag) FILTER (t.tag IS NOT NULL), []) AS ts FROM ids i LEFT JOIN tagrows t ON t.e = i.e GROUP BY i.e"


@query("filter_tags_any", sql(
    "SELECT e AS entry_index FROM s WHERE list_has_any(ts, ['ECONOMY', 'Brand#2'])", "tagrows", s=TAG_SETS))
def filter_tags_any(spark, sf):
    return se.filter_tags(ad.entries_tagged(spark, sf), ["ECONOMY", "Brand#2"]).select("entry_index")


@query("filter_tags_all", sql(
    "SELECT e AS entry_index FROM s WHERE list_has_all(ts, ['ECONOMY', 'Brand#17'])", "tagrows", s=TAG_SETS))
def filter_tags_all(spark, sf):
    return se.filter_tags(ad.entries_tagged(spark, sf), ["ECONOMY", "Brand#17"], "all").select("entry_index")


@query("filter_tags_exact", sql(
    "SELECT e AS entry_index FROM s WHERE len(ts) = 0 OR (list_has_all(ts, ['ECONOMY', 'Brand#17', 'red widget']) AND len(ts) = 3)",
    "tagrows", s=TAG_SETS))
def filter_tags_exact(spark, sf):
    picked = ["ECONOMY", "Brand#17", "red widget", "__untagged__"]
    return se.filter_tags(ad.entries_tagged(spark, sf), picked, "exact").select("entry_index")


@query("filter_entries", sql(
    "SELECT s.e AS entry_index FROM s JOIN x ON x.e = s.e WHERE list_has_any(ts, ['ECONOMY', 'SMALL', 'LARGE']) AND contains(t, 'the') "
    "AND s.e IN (SELECT doc_id FROM labels WHERE quality = 1)", "tagrows", "raw", s=TAG_SETS, x=SEARCH_TEXT))
def filter_entries(spark, sf):
    """Tags, text and a set of ids that comes from the labels table."""
    ids = ad.table(spark, sf, "labels").where("quality = 1").select(
        F.concat(F.lit("entry_index:"), F.col("doc_id").cast("string")).alias("entry_id")
    )
    return se.filter_entries(
        ad.entries_tagged(spark, sf), tags=["ECONOMY", "SMALL", "LARGE"], query="the", ids=ids
    ).select("entry_index")


@query("lookup_by_uuid", sql(
    "SELECT 'id-' || e % 10 AS entry_uuid, max(e) AS entry_index FROM ids GROUP BY 1", "ids"))
def lookup_by_uuid(spark, sf):
    """Ten shared ids: the last entry of each wins."""
    rows = ad.with_uuids(ad.entries(spark, sf))
    shared = F.concat(F.lit("id-"), (F.col("entry_index") % 10).cast("string"))
    rows = rows.withColumn("meta", F.col("meta").withField("entry_uuid", shared))
    ids = rows.select(F.col("meta.entry_uuid").alias("entry_uuid")).distinct()
    return se.lookup_by_uuid(rows, ids).select(F.col("meta.entry_uuid").alias("entry_uuid"), "entry_index")


@query("page", sql(
    "SELECT e AS entry_index, p AS position FROM (SELECT e, row_number() OVER (ORDER BY e) - 1 AS p, count(*) OVER () AS n FROM s "
    "WHERE contains(t, 'the')) WHERE p // 5 = least(2, greatest(ceil(n / 5.0) - 1, 0))", "raw", s=SEARCH_TEXT))
def page(spark, sf):
    hits = se.search(ad.entries(spark, sf), "the").select("entry_index")
    return se.page(hits, 2, 5).select("entry_index", "position")


@query("entry_order", sql(
    "SELECT e AS conv_id, row_number() OVER (ORDER BY n, e) - 1 AS entry_index FROM (SELECT e, count(*) AS n FROM raw GROUP BY e)", "raw"))
def entry_order(spark, sf):
    """Dense positions of all conversations by their number of turns."""
    from ..operators.ordering import dense_index

    sizes = ad.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return dense_index(sizes, "n", ("conv_id",)).select("conv_id", "entry_index")


@query("shuffle_entries", sql("SELECT e AS entry_index FROM ids", "ids"))
def shuffle(spark, sf):
    return shuffle_entries(ad.entries(spark, sf), 7).select("entry_index")
