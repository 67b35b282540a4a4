"""Queries: quality scores, near duplicates, reports."""

from pyspark.sql import functions as F

from ..functions.constants import PLACEHOLDER_PHRASES, QUOTE_PATTERN, WORD_PATTERN
from ..operators import entries as en
from ..operators import features as fe
from ..operators import neardup as nd
from ..operators import normalize as no
from ..operators import quality as qu
from ..operators import tags as tg
from ..operators import validate as va
from . import adapters as ad
from . import catalog_validate  # noqa: F401  (defines the diagnostics SQL)
from .base import CTES, NEEDS, folded, lit, query, slug, sql, strip, words

PLACEHOLDER = f"({folded('c')} <> '' AND ({words('c')} = 1 OR " + " OR ".join(
    f"contains({folded('c')}, {lit(p)})" for p in PLACEHOLDER_PHRASES
) + "))"
CTES["wordy"] = f"SELECT e, i, r, c, {words('c')} AS w, {PLACEHOLDER} AS ph FROM raw"
NEEDS["wordy"] = ("raw",)
CTES["response"] = (
    "SELECT sum(w) FILTER (r = 'assistant') / count(*) FILTER (r = 'assistant') AS av, "
    "sum(w) FILTER (r = 'user') / count(*) FILTER (r = 'user') AS au, count(*) FILTER (r = 'assistant') AS n, "
    "median(w) FILTER (r = 'assistant') AS md, count(*) FILTER (r = 'assistant' AND w < 20) AS sh, "
    "count(*) FILTER (r = 'assistant' AND w = 0) AS em, count(*) FILTER (r = 'assistant' AND ph) AS pl FROM wordy"
)
NEEDS["response"] = ("wordy",)


@query("response_quality", sql(
    "SELECT round(greatest(0, least(25, 15 * least(av / 300, 1) + 5 * (1 - least(em / n + pl / n, 1)) + "
    "CASE WHEN au / av BETWEEN 0.2 AND 2 THEN 5 WHEN au / av BETWEEN 0.1 AND 5 THEN 3 ELSE 0 END - 5 * (sh / n))), 6) AS score, "
    "av AS avg_response_length, md::DOUBLE AS median_response_length, sh AS short_response_count, em AS empty_response_count, "
    "pl AS placeholder_count, au / av AS user_assistant_length_ratio FROM response", "response"))
def response_quality(spark, sf):
    t = ad.turns(spark, sf)
    out = qu.response_quality(fe.from_turns(t), fe.answer_words_from_turns(t))
    return out.withColumn("score", F.round("score", 6))


@query("response_flags", sql(
    "SELECT e AS entry_index FROM (SELECT e, coalesce(sum(w) FILTER (r = 'user'), 0) AS u, coalesce(sum(w) FILTER (r = 'assistant'), 0) AS a, "
    "bool_or(r = 'assistant' AND (w < 20 OR ph)) AS b FROM wordy GROUP BY e) WHERE b OR u = 0 OR a = 0 OR u / a < 0.1 OR u / a > 5", "wordy"))
def response_flags(spark, sf):
    return qu.response_flags(fe.from_turns(ad.turns(spark, sf))).select("entry_index")


# --- near duplicates ------------------------------------------------------------------------

WORD_SET = "list_sort(list_distinct(list_transform(regexp_extract_all({x}, " + lit(WORD_PATTERN) + "), lambda w: lower(w))))"


def word_set(x: str) -> str:
    return WORD_SET.replace("{x}", x)


CTES["sets"] = (
    f"SELECT min(e) AS id, count(*) AS copies, ws FROM (SELECT doc_id AS e, {word_set('text')} AS ws FROM documents) "
    "WHERE len(ws) > 0 GROUP BY ws"
)
# words shared by size-compatible pairs, counted word by word
CTES["tok"] = "SELECT id, copies, len(ws) AS n, unnest(ws) AS w FROM sets WHERE len(ws) >= 10"
CTES["pairs"] = (
    "SELECT a.id AS l, b.id AS r, any_value(a.copies) AS lc, any_value(b.copies) AS rc, count(*) AS common, any_value(a.n + b.n) AS total "
    "FROM tok a JOIN tok b ON a.w = b.w AND a.id < b.id AND least(a.n, b.n) * 10 > greatest(a.n, b.n) * 9 "
    "GROUP BY a.id, b.id HAVING count(*) * 10 > (any_value(a.n + b.n) - count(*)) * 9"
)
NEEDS["tok"] = ("sets",)
NEEDS["pairs"] = ("tok",)


@query("near_duplicates", sql(
    "SELECT l AS left_id, r AS right_id, lc AS left_copies, rc AS right_copies, common, total - common AS total FROM pairs", "pairs"))
def near_duplicates(spark, sf):
    """Similar word sets over all documents, whole texts."""
    return nd.near_duplicates(ad.documents_as_texts(spark, sf))[1]


@query("near_duplicate_sets", sql("SELECT id AS set_id, copies, len(ws) AS words FROM sets", "sets"))
def near_duplicate_sets(spark, sf):
    sets = nd.distinct_sets(nd.word_sets(ad.documents_as_texts(spark, sf)))
    return sets.select("set_id", "copies", F.size("tokens").alias("words"))


@query("near_duplicate_summary", sql(
    "SELECT ((SELECT sum(copies * (copies - 1) // 2) FROM sets) + (SELECT coalesce(sum(lc * rc), 0) FROM pairs))::BIGINT AS pair_count, "
    "(SELECT sum(copies) FROM sets WHERE copies > 1 OR id IN (SELECT l FROM pairs UNION SELECT r FROM pairs))::BIGINT AS duplicate_entries", "pairs"))
def near_duplicate_summary(spark, sf):
    return nd.near_duplicate_summary(*nd.near_duplicates(ad.documents_as_texts(spark, sf)))


@query("near_duplicate_entries", sql(
    f"SELECT doc_id AS entry_index FROM documents JOIN sets ON {word_set('text')} = ws "
    "WHERE copies > 1 OR id IN (SELECT l FROM pairs UNION SELECT r FROM pairs)", "pairs"))
def near_duplicate_entries(spark, sf):
    sets = nd.written_sets(ad.documents_as_texts(spark, sf))
    return nd.near_duplicate_entries(sets, *nd.near_duplicates(sets))


@query("near_duplicates_banded")
def near_duplicates_banded(spark, sf):
    """The pairs that a four-band SimHash blocking finds; its hash has no SQL form."""
    sets, pairs = nd.near_duplicates(ad.documents_as_texts(spark, sf))
    return nd.banded(sets, pairs)


# --- diversity, structure, metadata ---------------------------------------------------------------

CTES["esets"] = (
    f"SELECT {word_set('t')} AS ws, e FROM (SELECT e, string_agg(c, ' ' ORDER BY i) AS t FROM tsys GROUP BY e)"
)
NEEDS["esets"] = ("tsys",)
CTES["dups"] = (
    "SELECT DISTINCT a.e FROM esets a JOIN esets b ON a.e <> b.e AND least(len(a.ws), len(b.ws)) * 10 > greatest(len(a.ws), len(b.ws)) * 9 "
    "WHERE len(list_intersect(a.ws, b.ws)) * 10 > (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) * 9"
)
NEEDS["dups"] = ("esets",)
CTES["live"] = f"SELECT t.e, t.pos, r.slug, r.category_slug FROM (SELECT e, pos, {slug('tag')} AS s FROM tagrows) t JOIN reg r ON r.slug = t.s AND r.status = 'active'"
NEEDS["live"] = ("tagrows", "reg")
CTES["div"] = (
    f"SELECT (SELECT count(*) FROM ids) AS n, (SELECT count(DISTINCT {folded('c')}) FROM tsys WHERE i = 0) AS up, "
    "(SELECT count(DISTINCT e) FROM live) AS tagged, (SELECT count(DISTINCT category_slug) FROM live) AS cats, "
    "(SELECT count(*) FROM dups) AS dup, "
    f"(SELECT count(DISTINCT e) FROM tagrows WHERE {slug('tag')} NOT IN (SELECT slug FROM reg WHERE status = 'active')) AS unres, "
    "(SELECT CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END FROM "
    "(SELECT count(*) / (SELECT count(*) FROM live) AS p FROM live GROUP BY slug)) AS ent"
)
NEEDS["div"] = ("ids", "tsys", "live", "dups", "tagrows", "reg")
DIV_SCORE = (
    "greatest(0, least(25, 8 * least(up / least(n, 10), 1) + 6 * (tagged / n) + 5 * ent + 3 * least(cats / 4, 1) "
    "+ 3 * (1 - least(dup / n / 0.25, 1)) - 2 * least(unres / n, 1)))"
)


def _tagged(spark, sf):
    return no.normalize_tags(ad.with_uuids(ad.entries_tagged(spark, sf)))


def _active(spark, sf):
    live = tg.active_tags(ad.tags(spark, sf), ad.categories(spark, sf))
    return live.select(F.col("slug").alias("tag"), F.col("category_slug").alias("category"))


def _duplicates(entries):
    sets = nd.written_sets(nd.entry_texts(entries))
    return nd.near_duplicate_entries(sets, *nd.near_duplicates(sets))


@query("diversity", sql(
    f"SELECT round({DIV_SCORE}, 6) AS score, n AS total_entries, up AS unique_system_prompts, up / n AS system_prompt_diversity_ratio, "
    "tagged / n * 100 AS tag_coverage_percent, round(ent, 6) AS tag_entropy, cats AS category_count, dup AS duplicate_entries, "
    "unres AS unresolved_entries FROM div", "div"))
def diversity(spark, sf):
    e = _tagged(spark, sf)
    out = qu.diversity(fe.from_entries(e), _duplicates(e), active_tags=_active(spark, sf))
    return out.withColumn("score", F.round("score", 6)).withColumn("tag_entropy", F.round("tag_entropy", 6))


CTES["struct"] = (
    f"SELECT i.e, coalesce(x.bad, false) AS bad, coalesce(x.fl, false) AS flagged, d.ex, d.pc FROM ids i JOIN (SELECT e, count(*) FILTER (r <> 'system') // 2 AS ex, "
    f"coalesce(max(CASE WHEN i = 0 AND r = 'system' THEN length({strip('c')}) END), 0) AS pc FROM dirty GROUP BY e) d ON d.e = i.e "
    "LEFT JOIN (SELECT e, bool_or(sev = 'error') AS bad, bool_or(code IN ('chatml.duplicate_system_message', 'chatml.ai_refusal_language', "
    "'chatml.split_candidate', 'chatml.formatting_leakage')) AS fl FROM diag GROUP BY e) x ON x.e = i.e"
)
NEEDS["struct"] = ("ids", "dirty", "diag")
CTES["st"] = (
    "SELECT count(*) AS n, count(*) FILTER (bad) AS inv, sum(ex) / count(*) AS av, count(*) FILTER (ex <= 1) AS b1, count(*) FILTER (ex = 2) AS b2, "
    "count(*) FILTER (ex BETWEEN 3 AND 7) AS b3, count(*) FILTER (ex >= 8) AS b8, count(*) FILTER (pc BETWEEN 1 AND 49) AS sh, count(*) FILTER (pc = 0) AS mi FROM struct"
)
NEEDS["st"] = ("struct",)
ST_SCORE = "10 * ((n - inv) / n) + 8 * (b3 / n) + 3 * ((n - mi) / n) + 4 * ((n - mi - sh) / n)"


@query("structure", sql(
    f"SELECT round({ST_SCORE}, 6) AS score, (n - inv) / n * 100 AS validation_pass_rate, inv AS invalid_entry_count, av AS avg_exchange_count, "
    "b1 AS bucket_1, b2 AS bucket_2, b3 AS bucket_3_7, b8 AS bucket_8, b3 / n * 100 AS in_optimal_range_percent, "
    "sh AS short_system_prompt_count, mi AS missing_system_prompt_count FROM st", "st"))
def structure(spark, sf):
    rows = qu.structure_rows(va.analyze_chatml(ad.entries_dirty(spark, sf)))
    return qu.structure(rows).withColumn("score", F.round("score", 6))


@query("metadata_integrity", sql(
    "SELECT round(8 * (nat / n) + 7 * (tg / n) + 5 * (mp / n) + 2 + 3, 6) AS score, nat / n * 100 AS native_stamp_percent, tg / n * 100 AS tagged_entry_percent, "
    "mp / n * 100 AS character_mapping_percent, true AS sidecar_present, true AS sidecar_current FROM (SELECT count(*) AS n, count(*) FILTER (e % 4 <> 0) AS nat, "
    "(SELECT count(DISTINCT e) FROM live) AS tg, (SELECT count(DISTINCT e) FROM tsys WHERE e % 7 = 4 AND r = 'assistant') AS mp FROM ids)",
    "ids", "live", "tsys"))
def metadata_integrity(spark, sf):
    e = _tagged(spark, sf)
    sidecar = e.agg(F.count(F.lit(1)).alias("entry_count"), F.max("meta.dataset_uuid").alias("dataset_uuid"))
    out = qu.metadata_integrity(
        fe.from_entries(e), mapped_uuids=ad.mappings(spark, sf), sidecar=sidecar, active_tags=_active(spark, sf)
    )
    return out.withColumn("score", F.round("score", 6))


# --- narrative ----------------------------------------------------------------------------------------

QUOTES = QUOTE_PATTERN.replace("*+", "*")
CTES["ratios"] = (
    f"SELECT e, CASE WHEN length({strip('t')}) = 0 THEN 0.0 ELSE least(list_sum(list_transform(regexp_extract_all(t, {lit(QUOTES)}, 1), lambda q: length(q)))"
    f" / length({strip('t')}), 1.0) END AS ratio FROM (SELECT i.e, coalesce(string_agg(CASE WHEN i % 4 = 2 THEN '\"' || c || '\"' ELSE c END, chr(10) ORDER BY i) "
    "FILTER (r = 'assistant'), '') AS t FROM ids i LEFT JOIN tsys USING (e) GROUP BY i.e)"
)
CTES["quoted"] = "SELECT e, coalesce(ratio, 0.0)::DOUBLE AS ratio FROM ratios"
NEEDS["ratios"] = ("ids", "tsys")
NEEDS["quoted"] = ("ratios",)


def _quoted(spark, sf):
    """Every second answer is put in quotation marks."""
    mark = lambda m, i: en.with_fields(
        m, content=F.when(i % 4 == 2, F.concat(F.lit('"'), m["content"], F.lit('"'))).otherwise(m["content"])
    )
    rows = ad.entries_sys(spark, sf)
    return qu.dialogue_ratios(rows.withColumn("messages", F.transform("messages", mark)))


@query("dialogue_ratios", sql("SELECT e AS entry_index, ratio FROM quoted", "quoted"))
def dialogue_ratios(spark, sf):
    return _quoted(spark, sf).select("entry_index", "ratio")


@query("narrative_insight", sql(
    "SELECT round(m, 6) AS dialogue_ratio, CASE WHEN m < 0.2 THEN 'Heavy Narrative' WHEN m < 0.4 THEN 'Narrative-Leaning' WHEN m < 0.6 THEN 'Balanced' "
    "WHEN m < 0.8 THEN 'Dialogue-Leaning' ELSE 'Heavy Dialogue' END AS spectrum_label FROM (SELECT avg(ratio) AS m FROM quoted)", "quoted"))
def narrative_insight(spark, sf):
    return qu.narrative_insight(_quoted(spark, sf)).withColumn("dialogue_ratio", F.round("dialogue_ratio", 6))


@query("dialogue_histogram", sql(
    "SELECT b.l AS density, count(q.e) AS entries FROM (VALUES ('0-20%', 0.0, 0.2), ('20-40%', 0.2, 0.4), ('40-60%', 0.4, 0.6), ('60-80%', 0.6, 0.8), "
    "('80-100%', 0.8, 1.01)) b(l, lo, hi) LEFT JOIN quoted q ON q.ratio >= b.lo AND q.ratio < b.hi GROUP BY b.l", "quoted"))
def dialogue_histogram(spark, sf):
    return qu.dialogue_histogram(_quoted(spark, sf))


# --- composite -------------------------------------------------------------------------------------------


def report(spark, sf):
    """The report over tagged entries: features are read from one projection."""
    e = _tagged(spark, sf)
    f = fe.from_entries(e)
    active = _active(spark, sf)
    return qu.quality_report(
        qu.response_quality(f, fe.answer_words_from_features(f)),
        qu.diversity(f, _duplicates(e), active_tags=active),
        qu.structure(qu.structure_rows(va.analyze_chatml(e))),
        qu.metadata_integrity(f, mapped_uuids=ad.mappings(spark, sf), active_tags=active),
    )


CTES["w2"] = f"SELECT e, i, r, c, {words('c')} AS w, {PLACEHOLDER} AS ph FROM tsys"
CTES["resp2"] = CTES["response"].replace("FROM wordy", "FROM w2")
CTES["clean"] = (
    "SELECT e, count(*) AS n, count(*) FILTER (r <> 'system') // 2 AS ex, max(CASE WHEN i = 0 THEN length(c) END) AS pc, "
    "bool_or((i = 0 AND r <> 'system') OR (i % 2 = 1 AND r <> 'user') OR (i > 0 AND i % 2 = 0 AND r <> 'assistant')) AS off FROM tsys GROUP BY e"
)
CTES["scores"] = (
    "SELECT (SELECT round(greatest(0, least(25, 15 * least(av / 300, 1) + 5 * (1 - least(em / n + pl / n, 1)) + "
    "CASE WHEN au / av BETWEEN 0.2 AND 2 THEN 5 WHEN au / av BETWEEN 0.1 AND 5 THEN 3 ELSE 0 END - 5 * (sh / n))), 2) FROM resp2) AS response, "
    f"(SELECT round({DIV_SCORE}, 2) FROM div) AS diversity, "
    "(SELECT round(10 * (count(*) FILTER (n >= 3 AND n % 2 = 1 AND NOT off) / count(*)) + 8 * (count(*) FILTER (ex BETWEEN 3 AND 7) / count(*)) + 3 "
    "+ 4 * (count(*) FILTER (pc >= 50) / count(*)), 2) FROM clean) AS structure, "
    "(SELECT round(8 * (count(*) FILTER (e % 4 <> 0) / count(*)) + 7 * ((SELECT count(DISTINCT e) FROM live) / count(*)) "
    "+ 5 * ((SELECT count(DISTINCT e) FROM tsys WHERE e % 7 = 4 AND r = 'assistant') / count(*)), 2) FROM ids) AS metadata"
)
NEEDS.update({"w2": ("tsys",), "resp2": ("w2",), "clean": ("tsys",), "scores": ("resp2", "div", "clean", "ids", "live", "tsys")})


@query("quality_report", sql(
    "SELECT round(response + diversity + structure + metadata, 2) AS composite_score, CASE WHEN t >= 90 THEN 'Excellent' WHEN t >= 70 THEN 'Good' "
    "WHEN t >= 50 THEN 'Fair' WHEN t >= 30 THEN 'Needs Attention' ELSE 'Significant Issues' END AS grade, response, diversity, structure, metadata "
    "FROM (SELECT *, response + diversity + structure + metadata AS t FROM scores)", "scores"))
def quality_report(spark, sf):
    r = report(spark, sf)
    part = lambda name: F.round(F.col(f"{name}.score"), 2)
    return r.select(
        F.round("composite_score", 2).alias("composite_score"), "grade", part("response_quality").alias("response"),
        part("diversity").alias("diversity"), part("structure").alias("structure"),
        part("metadata_integrity").alias("metadata"),
    )


@query("recommendations", sql(
    "SELECT row_number() OVER (ORDER BY s, p) AS rank, d AS dimension, s AS score FROM (SELECT unnest(['response_quality', 'diversity', 'structure', 'metadata_integrity']) AS d, "
    "unnest([response, diversity, structure, metadata]) AS s, unnest([0, 1, 2, 3]) AS p, response + diversity + structure + metadata AS t, "
    "least(response, diversity, structure, metadata) AS lo FROM scores) WHERE t < 70 AND (s < 18 OR lo >= 18) QUALIFY lo < 18 OR row_number() OVER (ORDER BY s, p) <= 3", "scores"))
def recommendations(spark, sf):
    return qu.recommendations(report(spark, sf)).select("rank", "dimension", F.round("score", 2).alias("score"))


@query("subscore_status", sql(
    "SELECT d AS dimension, CASE WHEN s >= 23 THEN 'Excellent' WHEN s >= 18 THEN 'Good' WHEN s >= 13 THEN 'Fair' WHEN s >= 7 THEN 'Needs Attention' "
    "ELSE 'Significant Issues' END AS status FROM (SELECT unnest(['response_quality', 'diversity', 'structure', 'metadata_integrity']) AS d, "
    "unnest([response, diversity, structure, metadata]) AS s FROM scores)", "scores"))
def subscore_status(spark, sf):
    parts = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"{d}.score").alias("score")) for d in qu.DIMENSIONS])
    return report(spark, sf).select(F.inline(parts)).select("dimension", qu.subscore_status(F.col("score")).alias("status"))


CTES["wdirty"] = f"SELECT e, i, r, c, {words('c')} AS w, {PLACEHOLDER} AS ph FROM dirty"
CTES["dirtysets"] = CTES["esets"].replace("FROM tsys", "FROM dirty")
CTES["dirtydups"] = CTES["dups"].replace("esets", "dirtysets")
NEEDS.update({"wdirty": ("dirty",), "dirtysets": ("dirty",), "dirtydups": ("dirtysets",)})


@query("flagged_entries", sql(
    "SELECT 'structure' AS dimension, 'invalid' AS reason, e AS entry_index FROM struct WHERE bad UNION ALL "
    "SELECT 'structure', 'short_prompt', e FROM struct WHERE pc BETWEEN 1 AND 49 UNION ALL "
    "SELECT 'structure', 'missing_prompt', e FROM struct WHERE pc = 0 UNION ALL SELECT 'structure', 'diagnostic', e FROM struct WHERE flagged UNION ALL "
    "SELECT 'metadata_integrity', 'not_native', e FROM ids WHERE e % 4 = 0 UNION ALL "
    "SELECT 'metadata_integrity', 'untagged', e FROM ids WHERE e NOT IN (SELECT e FROM live) UNION ALL "
    f"SELECT DISTINCT 'diversity', 'unresolved_tag', e FROM tagrows WHERE {slug('tag')} NOT IN (SELECT slug FROM reg WHERE status = 'active') UNION ALL "
    "SELECT 'metadata_integrity', 'unmapped', e FROM ids WHERE e NOT IN (SELECT e FROM tsys WHERE e % 7 = 4 AND r = 'assistant') UNION ALL "
    "SELECT 'diversity', 'near_duplicate', e FROM dirtydups UNION ALL "
    "SELECT 'response_quality', 'weak_response', e FROM (SELECT e, coalesce(sum(w) FILTER (r = 'user'), 0) AS u, coalesce(sum(w) FILTER (r = 'assistant'), 0) AS a, "
    "coalesce(bool_or(r = 'assistant' AND (w < 20 OR ph)), false) AS b FROM wdirty GROUP BY e) WHERE b OR u = 0 OR a = 0 OR u / a < 0.1 OR u / a > 5",
    "struct", "ids", "live", "tagrows", "reg", "tsys", "dirtydups", "wdirty"))
def flagged_entries(spark, sf):
    """All findings of all dimensions."""
    dirty = no.normalize_tags(ad.with_uuids(ad.with_part_tags(ad.entries_dirty(spark, sf), spark, sf)))
    return qu.flagged_entries(
        fe.from_entries(dirty), qu.structure_rows(va.analyze_chatml(dirty)), _duplicates(dirty), active_tags=_active(spark, sf), mapped_uuids=ad.mappings(spark, sf)
    )
