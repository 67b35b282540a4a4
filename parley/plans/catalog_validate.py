"""Queries: diagnostics, repair, record formats."""

from pyspark.sql import functions as F

from ..functions.constants import (
    BOLD_PATTERN,
    HEADING_PATTERN,
    IMPORT_SYSTEM_PROMPT,
    JSON_FRAGMENT_PATTERN,
    REFUSAL_PHRASES,
)
from ..operators import entries as en
from ..operators import formats as fo
from ..operators import search as se
from ..operators import stats as st
from ..operators import validate as va
from . import adapters as ad
from .base import CTES, NEEDS, lit, query, sql, std_role, strip, words

WANT = "CASE WHEN i = 0 THEN 'system' WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END"

# Every diagnostic of the dirty entries as (e, i, code, sev, auto).
CTES["noted"] = (
    f"SELECT e, i, r, c, {std_role('r')} AS std, {WANT} AS want, {strip('c')} AS cut, lower(c) AS low, "
    "count(*) OVER (PARTITION BY e) AS n, "
    f"row_number() OVER (PARTITION BY e, CASE WHEN {std_role('r')} IS NULL AND i > 0 THEN lower({strip('r')}) ELSE i::VARCHAR || '#' END ORDER BY i) AS nth "
    "FROM dirty"
)
REFUSALS = " OR ".join(f"contains(low, {lit(p)})" for p in REFUSAL_PHRASES)
FORMATTED = (
    f"contains(c, '```') OR regexp_matches(c, {lit(BOLD_PATTERN)}) OR regexp_matches(c, {lit(HEADING_PATTERN)}) "
    f"OR contains(low, '<html') OR contains(low, '<div') OR regexp_matches(c, {lit(JSON_FRAGMENT_PATTERN)})"
)
FULL = "n >= 3 AND n % 2 = 1"
CTES["diag"] = " UNION ALL ".join([
    "SELECT DISTINCT e, -1 AS i, 'chatml.insufficient_messages' AS code, 'error' AS sev, false AS auto FROM noted WHERE n < 3",
    "SELECT DISTINCT e, -1, 'chatml.incomplete_exchanges', 'error', false FROM noted WHERE n >= 3 AND n % 2 = 0",
    f"SELECT e, i, 'chatml.role_canonicalization', 'warning', true FROM noted WHERE {FULL} AND std = want AND r <> want",
    f"SELECT e, i, 'chatml.missing_system_role', 'error', false FROM noted WHERE {FULL} AND i = 0 AND std IS DISTINCT FROM 'system'",
    f"SELECT e, i, 'chatml.wrong_role', 'error', false FROM noted WHERE {FULL} AND i > 0 AND std IS DISTINCT FROM want AND (std IS NOT NULL OR nth = 1)",
    f"SELECT e, i, 'chatml.content_whitespace', 'warning', true FROM noted WHERE {FULL} AND c <> cut",
    f"SELECT e, i, 'chatml.empty_system_content', 'error', false FROM noted WHERE {FULL} AND i = 0 AND cut = ''",
    f"SELECT e, i, 'chatml.empty_content', 'error', false FROM noted WHERE {FULL} AND i > 0 AND cut = ''",
    f"SELECT e, i, 'chatml.ai_refusal_language', 'warning', false FROM noted WHERE {FULL} AND i > 0 AND std = 'assistant' AND cut <> '' AND ({REFUSALS})",
    f"SELECT e, i, 'chatml.formatting_leakage', 'info', false FROM noted WHERE {FULL} AND i > 0 AND std = 'assistant' AND cut <> '' AND ({FORMATTED})",
    f"SELECT e, -1, 'chatml.split_candidate', 'info', false FROM noted WHERE {FULL} GROUP BY e "
    f"HAVING count(*) FILTER (r <> 'system') // 2 >= 8 OR coalesce(sum({words('c')}) FILTER (r = 'assistant'), 0) > 2000",
])
NEEDS["noted"] = ("dirty",)
NEEDS["diag"] = ("noted",)


def analyzed(spark, sf):
    return va.analyze_chatml(ad.entries_dirty(spark, sf))


@query("analyze_chatml", sql(
    "SELECT e AS entry_index, i AS turn_index, code, sev AS severity, auto AS automatic FROM diag", "diag"))
def analyze_chatml(spark, sf):
    rows = va.diagnostic_rows(analyzed(spark, sf))
    return rows.select(
        "entry_index", F.coalesce(F.get("path", F.lit(1)).cast("int"), F.lit(-1)).alias("turn_index"), "code",
        "severity", (F.col("repair_kind") == "automatic").alias("automatic"),
    )


@query("validate", sql(
    "SELECT e + 1 AS row, count(*) AS error_count FROM diag WHERE sev = 'error' GROUP BY e", "diag"))
def validate(spark, sf):
    return va.validation_errors(analyzed(spark, sf)).select("row", "error_count")


@query("validity_counts", sql(
    "SELECT count(*) FILTER (b IS NULL) AS valid_count, count(*) FILTER (b) AS invalid_count FROM ids LEFT JOIN "
    "(SELECT DISTINCT e, true AS b FROM diag WHERE sev = 'error') USING (e)", "ids", "diag"))
def validity_counts(spark, sf):
    return st.validity_counts(analyzed(spark, sf))


@query("diagnostic_summary", sql(
    "SELECT count(*) AS entries_analyzed, count(*) FILTER (er + wa = 0) AS valid_entries, count(*) FILTER (er > 0) AS entries_with_errors, "
    "count(*) FILTER (wa > 0) AS entries_with_warnings, count(*) FILTER (nf > 0) AS entries_with_info, sum(er)::BIGINT AS error_count, "
    "sum(wa)::BIGINT AS warning_count, sum(nf)::BIGINT AS info_count, sum(au)::BIGINT AS auto_repairable_count FROM "
    "(SELECT i.e, count(*) FILTER (sev = 'error') AS er, count(*) FILTER (sev = 'warning') AS wa, count(*) FILTER (sev = 'info') AS nf, "
    "count(*) FILTER (auto) AS au FROM ids i LEFT JOIN diag d ON d.e = i.e GROUP BY i.e)", "ids", "diag"))
def diagnostic_summary(spark, sf):
    return va.diagnostic_summary(analyzed(spark, sf))


@query("auto_fix_groups", sql(
    "SELECT code, count(*) AS count, count(DISTINCT e) AS entries, min(sev) AS severity, "
    "array_to_string(list_slice(list(e || ':' || i ORDER BY e, i), 1, 5), ',') AS samples FROM diag WHERE auto GROUP BY code", "diag"))
def auto_fix_groups(spark, sf):
    groups = va.auto_fix_groups(analyzed(spark, sf))
    named = F.transform("samples", lambda x: F.concat_ws(":", x["entry_index"], F.get(x["path"], F.lit(1))))
    return groups.withColumn("samples", F.array_join(named, ","))


@query("repair_all", sql(
    f"SELECT e AS entry_index, count(*) FILTER ({FULL} AND ((std = want AND r <> want) OR c <> cut)) > 0 AS changed, "
    f"md5(string_agg(CASE WHEN {FULL} AND std = want THEN want ELSE r END || chr(1) || CASE WHEN {FULL} THEN cut ELSE c END, chr(2) ORDER BY i)) AS fingerprint "
    "FROM noted GROUP BY e", "noted"))
def repair_all(spark, sf):
    from .catalog_entries import _fingerprint

    return va.repair_chatml(ad.entries_dirty(spark, sf)).select("entry_index", "changed", _fingerprint().alias("fingerprint"))


@query("repair_group", sql(
    f"SELECT e AS entry_index, count(*) FILTER ({FULL} AND c <> cut) AS trimmed FROM noted GROUP BY e HAVING trimmed > 0", "noted"))
def repair_group(spark, sf):
    before = ad.entries_dirty(spark, sf).withColumn("_old", F.col("messages"))
    after = va.repair_chatml(before, only=("chatml.content_whitespace",)).where("changed")
    pairs = F.arrays_zip(F.col("_old").alias("a"), F.col("messages").alias("b"))
    return after.select(
        "entry_index", F.size(F.filter(pairs, lambda p: p["a"]["content"] != p["b"]["content"])).alias("trimmed")
    )


@query("needs_full_edit", sql(
    "SELECT i.e AS entry_index, coalesce(bool_or(code IN ('chatml.insufficient_messages', 'chatml.missing_system_role', 'chatml.empty_system_content')), false) AS full_edit, "
    "coalesce(bool_or(auto), false) AS has_issue FROM ids i LEFT JOIN diag d ON d.e = i.e GROUP BY i.e", "ids", "diag"))
def needs_full_edit(spark, sf):
    return analyzed(spark, sf).select(
        "entry_index", se.needs_full_edit().alias("full_edit"), se.has_automatic_issue().alias("has_issue")
    )


# --- records with every kind of top-level fault -----------------------------------------------

KINDS = "SELECT e, e % 10 AS k, count(*) AS n FROM tsys GROUP BY e"


@query("detect_record_format", sql(
    "SELECT e AS entry_index, CASE WHEN k IN (3, 4, 5, 8) THEN 'unknown' WHEN k = 7 THEN 'sharegpt' ELSE 'chatml' END AS format FROM kinds",
    "tsys", kinds=KINDS))
def detect_record_format(spark, sf):
    return ad.records(spark, sf).select("entry_index", fo.detect_record_format(F.col("record")).alias("format"))


@query("detect_dataset_format", sql(
    "SELECT 'table' AS source, 'chatml' AS format, count(*) FILTER (k IN (0, 1, 2, 6, 9)) AS n_chatml, count(*) FILTER (k = 7) AS n_sharegpt, "
    "count(*) FILTER (k IN (3, 4, 5, 8)) AS n_unknown, count(*) AS total, count(*) FILTER (k IN (0, 1, 2, 6, 9)) / count(*) AS confidence FROM kinds",
    "tsys", kinds=KINDS))
def detect_dataset_format(spark, sf):
    return fo.detect_dataset_format(ad.records(spark, sf))


@query("analyze_base", sql(
    "SELECT e AS entry_index, code, severity, path FROM kinds JOIN (VALUES (0, 'base.missing_tags', 'warning', 'tags'), "
    "(1, 'base.tags_not_list', 'warning', 'tags'), (2, 'base.invalid_tag_value', 'warning', 'tags/0'), (2, 'base.empty_tag', 'info', 'tags/2'), "
    "(4, 'base.unknown_top_level_key', 'info', 'extra'), (5, 'base.not_dict', 'error', ''), (6, 'base.unknown_top_level_key', 'info', 'alpha'), "
    "(6, 'base.unknown_top_level_key', 'info', 'zeta'), (7, 'base.unknown_top_level_key', 'info', 'origin')) v(kk, code, severity, path) ON kk = k",
    "tsys", kinds=KINDS))
def analyze_base(spark, sf):
    good = ad.records(spark, sf).where(F.try_parse_json(F.col("record")).isNotNull())
    rows = va.diagnostic_rows(va.analyze_base(en.parse_entries(good)))
    return rows.select("entry_index", "code", "severity", F.array_join("path", "/").alias("path"))


@query("analyze_records", sql(
    "SELECT e AS entry_index, code, severity FROM kinds JOIN (VALUES (0, 'base.missing_tags', 'error'), "
    "(1, 'base.tags_not_list', 'error'), (2, 'base.invalid_tag_value', 'error'), (2, 'base.empty_tag', 'info'), "
    "(3, 'chatml.messages_not_list', 'error'), (4, 'base.unknown_top_level_key', 'info'), (4, 'chatml.missing_messages', 'error'), "
    "(5, 'base.not_dict', 'error'), (6, 'base.unknown_top_level_key', 'info'), (6, 'base.unknown_top_level_key', 'info'), "
    "(7, 'base.unknown_top_level_key', 'info'), (7, 'chatml.missing_messages', 'error')) v(kk, code, severity) ON kk = k "
    "UNION ALL SELECT e, code, sev FROM diag WHERE e % 10 IN (0, 1, 2, 6, 9)", "tsys", "diag", kinds=KINDS))
def analyze_records(spark, sf):
    """The ChatML analyzer on parsed JSON text, all faults together."""
    good = ad.records(spark, sf).where(F.try_parse_json(F.col("record")).isNotNull())
    return va.diagnostic_rows(va.analyze_chatml(en.parse_entries(good))).select("entry_index", "code", "severity")


@query("json_round_trip", sql(
    "SELECT e AS entry_index, CASE WHEN k IN (0, 1, 2, 6, 9) THEN md5(string_agg(r || chr(1) || c, chr(2) ORDER BY i)) END AS fingerprint "
    "FROM dirty JOIN kinds USING (e) WHERE k <> 8 GROUP BY e, k", "dirty", kinds=KINDS))
def json_round_trip(spark, sf):
    """Entries to JSON text and back, twice; every record that is JSON."""
    from .catalog_entries import _fingerprint

    first = en.parse_entries(ad.records(spark, sf).where(F.try_parse_json(F.col("record")).isNotNull()))
    again = first.select("entry_index", "source", en.entry_json().alias("record"))
    return en.parse_entries(again).select("entry_index", _fingerprint().alias("fingerprint"))


# --- ShareGPT ------------------------------------------------------------------------------------

SHARE_CONTENT = f"CASE WHEN {strip('c')} = '' THEN {lit(IMPORT_SYSTEM_PROMPT)} ELSE c END"


@query("sharegpt_to_chatml", sql(
    f"SELECT e AS entry_index, md5(string_agg(coalesce({std_role('r')}, r) || chr(1) || CASE WHEN i = 0 THEN {SHARE_CONTENT} ELSE c END, chr(2) ORDER BY i)) AS fingerprint, "
    f"count(*) FILTER ({std_role('r')} IS NULL) AS warnings FROM dirty GROUP BY e", "dirty"))
def sharegpt_to_chatml(spark, sf):
    from .catalog_entries import _fingerprint

    out = fo.sharegpt_to_chatml(ad.sharegpt_records(spark, sf))
    return out.select("entry_index", _fingerprint().alias("fingerprint"), F.size("warnings").alias("warnings"))


@query("convert_to_chatml", sql(
    f"SELECT 'table' AS source, count(DISTINCT e) AS converted_count, 0 AS passed_count, count(*) FILTER ({std_role('r')} IS NULL) AS warning_count FROM dirty",
    "dirty"))
def convert_to_chatml(spark, sf):
    return fo.conversion_summary(fo.convert_to_chatml(ad.sharegpt_records(spark, sf)))


@query("chatml_to_sharegpt", sql(
    f"SELECT e AS entry_index, coalesce(string_agg(CASE {std_role('r')} WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE {std_role('r')} END || chr(1) || c, chr(2) ORDER BY i) "
    f"FILTER ({std_role('r')} IS NOT NULL), '') AS turns, count(*) FILTER ({std_role('r')} IS NULL) AS warnings FROM dirty GROUP BY e", "dirty"))
def chatml_to_sharegpt(spark, sf):
    out = fo.chatml_to_sharegpt(ad.entries_dirty(spark, sf))
    text = F.transform("conversations", lambda t: F.concat(t["from"], F.lit("\u0001"), t["value"]))
    return out.select("entry_index", F.array_join(text, "\u0002").alias("turns"), F.size("warnings").alias("warnings"))


@query("analyze_sharegpt", sql(
    f"SELECT e AS entry_index, code, count(*) AS n FROM (SELECT e, 'base.missing_tags' AS code FROM ids UNION ALL "
    f"SELECT e, 'sharegpt.unknown_role' FROM dirty WHERE {std_role('r')} IS NULL UNION ALL "
    f"SELECT e, 'sharegpt.role_variant' FROM dirty WHERE {strip('r')} <> CASE {std_role('r')} WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' WHEN 'system' THEN 'system' END UNION ALL "
    f"SELECT e, 'sharegpt.empty_content' FROM dirty WHERE {strip('c')} = '') GROUP BY e, code", "ids", "dirty"))
def analyze_sharegpt(spark, sf):
    rows = va.diagnostic_rows(va.analyze_sharegpt(ad.sharegpt_records(spark, sf)))
    return rows.groupBy("entry_index", "code").agg(F.count(F.lit(1)).alias("n"))


@query("repair_sharegpt", sql(
    f"SELECT e AS entry_index, bool_or(coalesce({strip('r')} <> m, false)) AS changed, md5(string_agg(coalesce(m, r) || chr(1) || c, chr(2) ORDER BY i)) AS fingerprint "
    f"FROM (SELECT *, CASE {std_role('r')} WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE {std_role('r')} END AS m FROM dirty) GROUP BY e", "dirty"))
def repair_sharegpt(spark, sf):
    """Standard role texts in ShareGPT records, read back from the repaired text."""
    out = fo.sharegpt_turns(va.repair_sharegpt(ad.sharegpt_records(spark, sf)))
    text = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\u0001"), t["content"]))
    return out.select("entry_index", "changed", F.md5(F.array_join(text, "\u0002")).alias("fingerprint"))


@query("custom_role_turns", sql(
    f"SELECT e AS entry_index, i AS turn_index, {strip('r')} AS label FROM dirty WHERE {std_role('r')} IS NULL", "dirty"))
def custom_role_turns(spark, sf):
    return fo.custom_role_turns(ad.entries_dirty(spark, sf)).select("entry_index", "turn_index", "label")


@query("custom_role_pattern", sql(
    "SELECT 'given' AS dataset, l AS label, CASE WHEN l = (SELECT first(l ORDER BY e, i) FROM named) THEN 'user' ELSE 'assistant' END AS role FROM (SELECT DISTINCT l FROM named) "
    "WHERE (SELECT count(DISTINCT l) = 2 FROM named) AND (SELECT count(*) = 0 FROM (SELECT l, lag(l) OVER (ORDER BY e, i) AS p FROM named) WHERE l = p) UNION ALL "
    "SELECT 'padded', unnest(['Ann', 'Bob']), unnest(['user', 'assistant']) FROM (SELECT 1 FROM raw LIMIT 1)",
    "raw", named="SELECT CASE r WHEN 'user' THEN 'Ann' ELSE 'Bob' END AS l, e, i FROM raw WHERE r IN ('user', 'assistant')"))
def custom_role_pattern(spark, sf):
    """All conversations twice: with names in place of the roles as they come, and
    with names by turns, an odd last turn repeated, so that the names alternate."""
    rows = ad.entries(spark, sf)
    given = lambda m: en.with_fields(
        m, role=F.when(m["role"] == "user", "Ann").when(m["role"] == "assistant", "Bob").otherwise(m["role"])
    )
    spoken = F.filter("messages", lambda m: m["role"] != "system")
    even = F.when(F.size(spoken) % 2 == 1, F.concat(spoken, F.slice(spoken, -1, 1))).otherwise(spoken)
    by_turn = lambda m, i: en.with_fields(m, role=F.when(i % 2 == 0, "Ann").otherwise("Bob"))
    out = None
    for name, messages in (("given", F.transform("messages", given)), ("padded", F.transform(even, by_turn))):
        found = fo.custom_role_pattern(fo.custom_role_turns(rows.withColumn("messages", messages)))
        found = found.select(F.lit(name).alias("dataset"), "label", "role")
        out = found if out is None else out.unionByName(found)
    return out
