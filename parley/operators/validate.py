"""Entry diagnostics and automatic repair, one projection per format.

Each entry gets ``diagnostics ARRAY<STRUCT<...>>`` built from the entry row
alone: no UDF and no shuffle, so the same code runs on a stream.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sqltext as sq
from ..functions import text as tx
from ..functions.constants import (
    AUTOMATIC_CODES,
    BOLD_PATTERN,
    CHATML,
    HEADING_PATTERN,
    JSON_FRAGMENT_PATTERN,
    KNOWN_KEYS,
    META_KEY,
    REFUSAL_PHRASES,
    SHAREGPT,
    SHAREGPT_KNOWN_KEYS,
    TAG_CODES,
)
from ..functions.roles import expected_role, sharegpt_role, standard_role
from .entries import (
    empty_strings,
    entries_projection,
    entry_id,
    has_key,
    once,
    with_fields,
)
from .formats import sharegpt_turns

DIAGNOSTIC_TYPE = (
    "struct<code:string,severity:string,message:string,path:array<string>,"
    "fixable:boolean,repair_kind:string,suggested_repair:string,"
    "original_value:string,normalized_value:string>"
)
NO_DIAGNOSTICS = f"cast(array() as array<{DIAGNOSTIC_TYPE}>)"


def diag(code, severity, text, path=(), *, kind="none", hint=None, original=None, normalized=None) -> str:
    """SQL of one diagnostic; text, path parts and values are SQL snippets."""
    steps = ", ".join(f"cast({p} as string)" for p in path)
    value = lambda x: "cast(NULL as string)" if x is None else f"cast({x} as string)"
    return (
        f"named_struct('code', '{code}', 'severity', '{severity}', 'message', {text}, "
        f"'path', cast(array({steps}) as array<string>), "
        f"'fixable', {str(kind in ('automatic', 'suggested')).lower()}, 'repair_kind', '{kind}', "
        f"'suggested_repair', {value(None if hint is None else sq.lit(hint))}, "
        f"'original_value', {value(original)}, 'normalized_value', {value(normalized)})"
    )


def some(*pairs) -> str:
    """SQL array of the diagnostics whose condition holds, in the given order."""
    cases = ", ".join(f"CASE WHEN {cond} THEN {d} END" for cond, d in pairs)
    return f"array_compact(array({cases}))"


# --- checks shared by the formats ------------------------------------------------


def base_diagnostics(known_keys, *, strict: bool) -> str:
    """Top-level key and tag checks; ``strict`` raises tag faults to errors."""
    level = "error" if strict else "warning"
    known = ", ".join(f"'{k}'" for k in known_keys)
    unknown_key = diag(
        "base.unknown_top_level_key", "info", "concat('Unknown key kept: ', k)", ("k",), original="extras[k]"
    )
    unknown = (
        f"transform(sort_array(filter(map_keys(extras), k -> k NOT IN ({known}))), k -> {unknown_key})"
    )
    not_text = diag(
        "base.invalid_tag_value", level, "'Tag is not text'", ("'tags'", "i"),
        kind="automatic", hint="Drop the value", original="get(tags_raw, i)",
    )
    empty = diag(
        "base.empty_tag", "info", "'Tag is empty'", ("'tags'", "i"),
        kind="automatic", hint="Drop the value", original="t",
    )
    per_tag = (
        f"array_compact(transform(tags, (t, i) -> CASE WHEN t IS NULL THEN {not_text} "
        f"WHEN {sq.strip('t')} = '' THEN {empty} END))"
    )
    not_list = diag(
        "base.tags_not_list", level, "'tags is not a list'", ("'tags'",),
        kind="automatic", hint="Replace by []", original="extras['tags']", normalized="'[]'",
    )
    missing = diag(
        "base.missing_tags", level, "'tags is missing'", ("'tags'",),
        kind="automatic", hint="Add []", normalized="'[]'",
    )
    not_object = diag("base.not_dict", "error", "'Entry is not an object'")
    return (
        f"CASE WHEN is_object THEN concat({unknown}, CASE WHEN tags IS NOT NULL THEN {per_tag} "
        f"WHEN map_contains_key(extras, 'tags') THEN array({not_list}) ELSE array({missing}) END) "
        f"ELSE array({not_object}) END"
    )


# --- ChatML -------------------------------------------------------------------------

# One pass binds what the checks of a message share: its standard role, the
# role its place asks for, its stripped text and the folded custom name.
NOTED_MESSAGES = (
    "transform(transform(messages, (m, i) -> named_struct('m', m, 'i', i, "
    f"'std', {sq.standard_role('m.role')}, 'want', {sq.expected_role('i')}, "
    f"'cut', {sq.strip('m.content')})), "
    "a -> named_struct('m', a.m, 'i', a.i, 'std', a.std, 'want', a.want, 'cut', a.cut, "
    f"'key', CASE WHEN a.i > 0 AND a.m.is_obj AND a.std IS NULL THEN nullif({sq.casefold(sq.strip('a.m.role'))}, '') END, "
    f"'low', CASE WHEN a.std = 'assistant' AND a.cut <> '' THEN {sq.casefold('a.m.content')} END))"
)
VARIANT = "(a.std <=> a.want AND a.m.role <> a.want)"
FOUND_ROLE = "coalesce(a.m.role, get_json_object(a.m.other, '$.role'), 'none')"
FORMATTING = (
    "(contains(a.m.content, '```') "
    f"OR a.m.content RLIKE {sq.lit(BOLD_PATTERN)} OR a.m.content RLIKE {sq.lit(HEADING_PATTERN)} "
    f"OR contains(a.low, '<html') OR contains(a.low, '<div') OR a.m.content RLIKE {sq.lit(JSON_FRAGMENT_PATTERN)})"
)


def _message_checks(*, system: bool) -> list:
    """Checks of one noted message ``a``; ``a.n`` is its 1-based number."""
    number = "cast(a.i + 1 as string)"
    custom = "(a.m.role IS NOT NULL AND a.std IS NULL)"
    wrong = (
        f"CASE WHEN {custom} THEN concat('Custom role name ', char(39), {FOUND_ROLE}, char(39)) "
        f"ELSE concat('Message ', {number}, ' should be ', a.want, ', found ', char(39), {FOUND_ROLE}, char(39)) END"
    )
    at = lambda field: ("'messages'", "a.i", f"'{field}'")
    checks = [
        (
            VARIANT,
            diag("chatml.role_canonicalization", "warning",
                 "concat('Role ', char(39), a.m.role, char(39), ' stands for ', a.want)", at("role"),
                 kind="automatic", hint="Use the standard role", original="a.m.role", normalized="a.want"),
        ),
        (
            f"NOT (a.m.role <=> a.want) AND NOT {VARIANT}"
            + ("" if system else " AND NOT coalesce(array_position(names, a.key) < a.i + 1, false)"),
            diag("chatml.missing_system_role" if system else "chatml.wrong_role", "error", wrong, at("role"),
                 kind="manual", original=FOUND_ROLE, normalized="a.want"),
        ),
        (
            "a.m.content <> a.cut",
            diag("chatml.content_whitespace", "warning", f"concat('Message ', {number}, ' has outer white space')",
                 at("content"), kind="automatic", hint="Trim", original="a.m.content", normalized="a.cut"),
        ),
    ]
    if system:
        checks.append(
            (
                "coalesce(a.cut, '') = ''",
                diag("chatml.empty_system_content", "error", "'System prompt is empty'", at("content"),
                     kind="suggested", hint="Write a system prompt", original="a.m.content"),
            )
        )
        return checks
    return checks + [
        (
            "coalesce(a.cut, '') = ''",
            diag("chatml.empty_content", "error", f"concat('Message ', {number}, ' (', a.want, ') is empty')",
                 at("content"), kind="manual", original="a.m.content"),
        ),
        (
            f"a.low IS NOT NULL AND {sq.contains_any('a.low', REFUSAL_PHRASES)}",
            diag("chatml.ai_refusal_language", "warning", "'Assistant text has refusal language'",
                 at("content"), kind="manual", original="a.m.content"),
        ),
        (
            f"a.low IS NOT NULL AND {FORMATTING}",
            diag("chatml.formatting_leakage", "info", "'Assistant text has markup'",
                 at("content"), kind="manual", original="a.m.content"),
        ),
    ]


def chatml_diagnostics() -> str:
    """SQL of every diagnostic of a ChatML entry, in document order.

    Reads ``noted`` and ``names`` beside the entry columns.
    """
    whole = lambda code, text, original=None, sev="error": diag(
        code, sev, sq.lit(text), ("'messages'",), kind="manual", original=original
    )
    not_object = diag(
        "chatml.message_not_dict", "error", "concat('Message ', cast(a.i + 1 as string), ' is not an object')",
        ("'messages'", "a.i"), kind="manual", original="a.m.other",
    )
    turns = (
        "flatten(transform(slice(noted, 2, size(noted) - 1), a -> CASE WHEN NOT a.m.is_obj "
        f"THEN array({not_object}) ELSE {some(*_message_checks(system=False))} END))"
    )
    head = f"element_at(transform(slice(noted, 1, 1), a -> {some(*_message_checks(system=True))}), 1)"
    n = "size(noted)"
    exchanges = "floor(size(filter(noted, a -> a.m.is_obj AND NOT (a.m.role <=> 'system'))) / 2)"
    words = (
        "aggregate(filter(noted, a -> a.m.is_obj AND a.m.role <=> 'assistant'), 0L, "
        f"(acc, a) -> acc + {sq.word_count('a.m.content')})"
    )
    n_system = "size(filter(noted, a -> a.m.is_obj AND a.m.role <=> 'system'))"
    first_not_object = diag(
        "chatml.system_not_dict", "error", "'First message is not an object'", ("'messages'", "0"),
        kind="manual", original="noted[0].m.other",
    )
    body = (
        f"CASE WHEN {n} < 3 THEN array({whole('chatml.insufficient_messages', 'Fewer than 3 messages', n)}) "
        f"WHEN {n} % 2 = 0 THEN array({whole('chatml.incomplete_exchanges', 'Exchanges are incomplete', n)}) "
        f"WHEN NOT noted[0].m.is_obj THEN array({first_not_object}) "
        f"ELSE concat({head}, {turns}, "
        f"{some((f'{exchanges} >= 8 OR {words} > 2000', whole('chatml.split_candidate', 'Entry is long', sev='info')))}) END"
    )
    doubled = whole("chatml.duplicate_system_message", "More than one system message", n_system, "warning")
    not_list = whole("chatml.messages_not_list", "messages is not a list", "extras['messages']")
    missing = whole("chatml.missing_messages", "messages is missing")
    chat = (
        f"CASE WHEN NOT is_object THEN {NO_DIAGNOSTICS} "
        f"WHEN messages IS NOT NULL THEN concat({some((f'{n_system} > 1', doubled))}, {body}) "
        f"WHEN map_contains_key(extras, 'messages') THEN array({not_list}) "
        f"ELSE array({missing}) END"
    )
    return f"concat({base_diagnostics(KNOWN_KEYS, strict=True)}, {chat})"


def analyze_chatml(entries: DataFrame) -> DataFrame:
    """Entries plus ``format``, ``diagnostics`` and ``is_valid``."""
    noted = entries.withColumn("noted", F.expr(NOTED_MESSAGES)).withColumn(
        "names", F.expr("transform(noted, a -> a.key)")
    )
    return _finish(once(noted, diagnostics=F.expr(chatml_diagnostics())).drop("noted", "names"), CHATML)


def analyze_base(entries: DataFrame) -> DataFrame:
    """Format-agnostic checks only."""
    return _finish(
        once(entries, diagnostics=F.expr(base_diagnostics(KNOWN_KEYS, strict=False))), "unknown"
    )


def _finish(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("format", F.lit(name)).withColumn("is_valid", ~has_severity("error"))


def has_severity(severity: str, ignore=()) -> Column:
    def hit(d):
        ok = d["severity"] == severity
        return ok & ~d["code"].isin(*ignore) if ignore else ok

    return F.exists("diagnostics", hit)


def codes() -> Column:
    return F.transform("diagnostics", lambda d: d["code"])


# --- ShareGPT --------------------------------------------------------------------------


def sharegpt_diagnostics() -> str:
    """SQL of the diagnostics of a ShareGPT record; reads ``turns``."""
    whole = lambda code, text, sev="error", kind="manual", original=None, hint=None: diag(
        code, sev, sq.lit(text), ("'conversations'",), kind=kind, original=original, hint=hint
    )
    where = "concat('Turn ', cast(a.i + 1 as string))"
    at = ("'conversations'", "a.i")
    role_at, content_at = at + ("a.t.role_key",), at + ("a.t.content_key",)
    noted = (
        "transform(transform(turns, (t, i) -> named_struct('t', t, 'i', i, 'role', coalesce(t.role, 'None'))), "
        f"x -> named_struct('t', x.t, 'i', x.i, 'role', x.role, 'std', {sq.standard_role('x.role')}))"
    )
    target = sq.sharegpt_role("a.std")
    content = sq.strip("coalesce(a.t.content, 'None')")
    not_object = diag("sharegpt.turn_not_dict", "error", f"concat({where}, ' is not an object')", at,
                      kind="manual", original="a.t.raw")
    checks = some(
        (
            "a.t.role_key IS NULL",
            diag("sharegpt.missing_role_field", "error", f"concat({where}, ' has no role')", at, kind="manual"),
        ),
        (
            "a.t.role_key IS NOT NULL AND a.std IS NULL",
            diag("sharegpt.unknown_role", "warning", f"concat({where}, ' has role ', a.role)", role_at,
                 kind="manual", original="a.role"),
        ),
        (
            f"a.t.role_key IS NOT NULL AND {sq.strip('a.role')} <> {target}",
            diag("sharegpt.role_variant", "info", f"concat({where}, ' writes ', a.role, ' for ', {target})", role_at,
                 kind="automatic", hint="Use the standard role", original="a.role", normalized=target),
        ),
        (
            "a.t.content_key IS NULL",
            diag("sharegpt.missing_content_field", "error", f"concat({where}, ' has no content')", at, kind="manual"),
        ),
        (
            f"a.t.content_key IS NOT NULL AND {content} = ''",
            diag("sharegpt.empty_content", "warning", f"concat({where}, ' is empty')", content_at,
                 kind="suggested", hint="Fill or remove the turn", original="a.t.content"),
        ),
    )
    n_system = (
        f"size(filter({noted}, a -> a.t.is_obj AND a.t.role_key IS NOT NULL AND a.std <=> 'system'))"
    )
    ends = some(
        (f"{n_system} > 1", whole("sharegpt.multiple_system_turns", "Several system turns", "info", "suggested",
                                  n_system, "Merge the system turns")),
        (f"{n_system} = 0", whole("sharegpt.no_system_turn", "No system turn", "info", "suggested",
                                  hint="Add a system turn")),
    )
    return (
        f"CASE WHEN NOT is_object THEN {NO_DIAGNOSTICS} "
        f"WHEN NOT has_turns THEN array({whole('sharegpt.missing_conversations', 'conversations is missing')}) "
        f"WHEN turns IS NULL THEN array({whole('sharegpt.conversations_not_list', 'conversations is not a list')}) "
        f"WHEN size(turns) = 0 THEN array({whole('sharegpt.empty_conversations', 'conversations is empty')}) "
        f"ELSE concat(flatten(transform({noted}, a -> CASE WHEN NOT a.t.is_obj THEN array({not_object}) "
        f"ELSE {checks} END)), {ends}) END"
    )


def analyze_sharegpt(records: DataFrame, record: str = "record") -> DataFrame:
    """Records plus ``turns``, ``diagnostics``, ``format`` and ``is_valid``."""
    base = sharegpt_turns(records, record).drop("is_object")
    both = entries_projection(base, record, META_KEY, keep=("has_turns", "turns", record))
    found = F.expr(f"concat({base_diagnostics(SHAREGPT_KNOWN_KEYS, strict=False)}, {sharegpt_diagnostics()})")
    return _finish(once(both, diagnostics=found), SHAREGPT)


# --- reports over analyzed entries --------------------------------------------------------


def validation_errors(analyzed: DataFrame) -> DataFrame:
    """Rows with at least one error: 1-based row number, count, messages."""
    errors = F.transform(
        F.filter("diagnostics", lambda d: d["severity"] == "error"), lambda d: d["message"]
    )
    return (
        analyzed.select((F.col("entry_index") + 1).alias("row"), errors.alias("errors"))
        .where(F.size("errors") > 0)
        .select("row", F.size("errors").alias("error_count"), "errors", F.array_join("errors", "; ").alias("errors_text"))
    )


def diagnostic_rows(analyzed: DataFrame) -> DataFrame:
    """One row per diagnostic."""
    return analyzed.select(
        "entry_index", entry_id().alias("entry_id"), F.posexplode("diagnostics").alias("pos", "d")
    ).select("entry_index", "entry_id", "pos", "d.*")


def diagnostic_summary(analyzed: DataFrame, *, tag_faults_block: bool = True) -> DataFrame:
    """One-row counters. Without ``tag_faults_block`` the tag codes are left out
    of the three ``entries_with_*`` counts and of nothing else."""
    ignore = () if tag_faults_block else TAG_CODES
    number = lambda cond: F.size(F.filter("diagnostics", cond))
    total = lambda cond: F.coalesce(F.sum(number(cond)), F.lit(0))
    return analyzed.agg(
        F.count(F.lit(1)).alias("entries_analyzed"),
        F.count_if(~has_severity("error") & ~has_severity("warning")).alias("valid_entries"),
        F.count_if(has_severity("error", ignore)).alias("entries_with_errors"),
        F.count_if(has_severity("warning", ignore)).alias("entries_with_warnings"),
        F.count_if(has_severity("info", ignore)).alias("entries_with_info"),
        total(lambda d: d["severity"] == "error").alias("error_count"),
        total(lambda d: d["severity"] == "warning").alias("warning_count"),
        total(lambda d: d["severity"] == "info").alias("info_count"),
        total(lambda d: d["repair_kind"] == "automatic").alias("auto_repairable_count"),
    )


def auto_fix_groups(analyzed: DataFrame, samples: int = 5, span: int = 100_000) -> DataFrame:
    """Automatic diagnostics by code, with the first few as samples.

    Pass one counts by code and run of ``span`` entries, a partial aggregate of
    numbers. The counts say how many runs hold the first ``samples`` findings of
    each code; pass two reads only those entries and ranks what is left.
    """
    auto = F.filter("diagnostics", lambda d: d["repair_kind"] == "automatic")
    rows = analyzed.select("entry_index", F.posexplode(auto).alias("pos", "d"))
    run = F.floor(F.col("entry_index") / span).alias("run")
    per_entry = analyzed.select(
        "entry_index",
        F.explode(F.array_distinct(F.transform(auto, lambda d: F.struct(d["code"].alias("code"), d["severity"].alias("severity"))))).alias("c"),
        F.transform(auto, lambda d: d["code"]).alias("all"),
    )
    found = per_entry.select(
        "entry_index", "c.code", "c.severity",
        F.size(F.filter("all", lambda x: x == F.col("c.code"))).alias("n"),
    )
    by_run = found.groupBy("code", run).agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("entries"),
        F.min(F.struct("entry_index", "severity")).alias("first"),
    )
    upto = Window.partitionBy("code").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    needed = by_run.withColumn("before", F.coalesce(F.sum("count").over(upto), F.lit(0))).where(
        F.col("before") < samples
    )
    cut = needed.groupBy("code").agg(F.max("run").alias("last_run"))
    ranked = Window.partitionBy("code").orderBy("entry_index", "pos")
    first = (
        rows.select("entry_index", "pos", "d.code", "d.path", "d.original_value", "d.normalized_value")
        .join(F.broadcast(cut), "code")  # one row per repair code
        .where(F.floor(F.col("entry_index") / span) <= F.col("last_run"))
        .withColumn("_r", F.row_number().over(ranked))
        .where(F.col("_r") <= samples)
        .groupBy("code")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("entry_index", "pos", "path", "original_value", "normalized_value"))
            ).alias("samples")
        )
    )
    counts = by_run.groupBy("code").agg(
        F.sum("count").alias("count"), F.sum("entries").alias("entries"),
        F.min("first").getField("severity").alias("severity"),
    )
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return (
        counts.join(first, "code")
        .select("code", "count", "entries", "severity", "samples", rank.alias("_rank"))
        .orderBy("_rank", F.desc("count"), "code")
        .drop("_rank")
    )


# --- repair ---------------------------------------------------------------------------------


def repair_chatml(entries: DataFrame, only=AUTOMATIC_CODES) -> DataFrame:
    """Apply the automatic repairs of the given codes; adds ``changed``.

    Message repairs reach only entries whose message checks run to the end,
    as their diagnostics exist only there.
    """
    want = set(only)
    messages, tags, obj = F.col("messages"), F.col("tags"), F.col("is_object")
    n = F.size(messages)
    reached = messages.isNotNull() & (n >= 3) & ((n - 1) % 2 == 0) & F.get(messages, F.lit(0))["is_obj"]

    def fixed(m, i):
        role, content = m["role"], m["content"]
        if "chatml.role_canonicalization" in want:
            std = standard_role(role)
            role = F.when(m["is_obj"] & (std == expected_role(i)), std).otherwise(role)
        if "chatml.content_whitespace" in want:
            content = F.when(m["is_obj"], tx.strip(content)).otherwise(content)
        return with_fields(m, role=role, content=content)

    new_messages = F.when(reached, F.transform(messages, fixed)).otherwise(messages)
    conditions = []
    if "base.invalid_tag_value" in want:
        conditions.append(lambda t: t.isNull())
    if "base.empty_tag" in want:
        conditions.append(lambda t: F.coalesce(tx.strip(t) == "", F.lit(False)))
    keep = lambda t: ~reduce(lambda a, b: a | b, [c(t) for c in conditions], F.lit(False))
    new_tags = F.filter(tags, keep)
    not_list = has_key("tags")
    if "base.missing_tags" in want:
        new_tags = F.when(obj & tags.isNull() & ~not_list, empty_strings()).otherwise(new_tags)
    if "base.tags_not_list" in want:
        new_tags = F.when(obj & tags.isNull() & not_list, empty_strings()).otherwise(new_tags)
    out = entries.withColumn("_m", new_messages).withColumn("_t", new_tags)
    return (
        out.withColumn("changed", ~F.col("_m").eqNullSafe(messages) | ~F.col("_t").eqNullSafe(tags))
        .withColumn("messages", F.col("_m"))
        .withColumn(
            "extras",
            F.when(F.col("_t").isNotNull(), F.map_filter("extras", lambda k, _: k != "tags")).otherwise(F.col("extras")),
        )
        .withColumn(
            "tags_raw",
            F.when(
                F.exists("_t", lambda t: t.isNull()),
                F.filter("tags_raw", lambda _, i: keep(F.get(tags, i))),
            ),
        )
        .withColumn("tags", F.col("_t"))
        .drop("_m", "_t")
    )


def repair_sharegpt(records: DataFrame, record: str = "record") -> DataFrame:
    """ShareGPT records with standard role texts; adds ``changed``.

    A turn whose role is a known spelling gets the standard one under its own
    key; all other keys, turns and records keep their values.
    """
    rows = once(sharegpt_turns(records, record), _v=F.try_parse_json(F.col(record)))
    variant = lambda t: F.coalesce(
        t["is_obj"] & t["role_key"].isNotNull() & (tx.strip(t["role"]) != sharegpt_role(t["role"])), F.lit(False)
    )
    parts = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    put = lambda whole, key, text: F.to_json(
        F.map_concat(F.map_filter(whole, lambda k, _: k != key), F.map_from_arrays(F.array(key), F.array(F.parse_json(text))))
    )
    fixed = lambda t: F.when(
        variant(t),
        put(parts(F.try_parse_json(t["raw"])), t["role_key"], F.concat(F.lit('"'), sharegpt_role(t["role"]), F.lit('"'))),
    ).otherwise(t["raw"])
    turns = F.concat(F.lit("["), F.array_join(F.transform("turns", fixed), ","), F.lit("]"))
    changed = F.coalesce(F.exists("turns", variant), F.lit(False))
    out = once(rows, changed=changed)
    new = F.when(F.col("changed"), put(parts(F.col("_v")), F.lit("conversations"), turns)).otherwise(F.col(record))
    return out.select(*[new.alias(c) if c == record else c for c in records.columns], "changed")
