"""Record format detection and ChatML <-> ShareGPT conversion.

Records are ``(entry_index, source, record)`` rows where ``record`` is JSON
text. Everything here is a projection except the majority vote and the
custom-role pattern, which are small aggregates.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.constants import (
    CHATML,
    IMPORT_SYSTEM_PROMPT,
    META_KEY,
    SHAREGPT,
    SHAREGPT_CONTENT_KEYS,
    SHAREGPT_ROLE_KEYS,
    UNKNOWN,
)
from ..functions.roles import sharegpt_role, standard_role
from .entries import (
    EXTRAS_TYPE,
    MESSAGES_TYPE,
    empty_messages,
    empty_strings,
    entries_projection,
    entry_id,
    message,
    messages_or_empty,
    once,
    parse_entries,
)
from .ordering import running_total


TURN_TYPE = (
    "struct<is_obj:boolean,role_key:string,role:string,content_key:string,content:string,raw:string>"
)


def _text_of(v: Column) -> Column:
    """Text of a variant value: strings as they are, others as JSON text."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def _present(v: Column, names) -> Column:
    """First of the named fields that exists; a JSON null exists."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "variant") for n in names])


def _present_key(v: Column, names) -> Column:
    return F.coalesce(
        *[
            F.when(F.try_variant_get(v, f"$.{n}", "variant").isNotNull(), F.lit(n))
            for n in names
        ]
    )


def detect_record_format(record: Column) -> Column:
    """chatml / sharegpt / unknown for one record's JSON text."""
    v = F.try_parse_json(record)
    has_messages = F.try_variant_get(v, "$.messages", "array<variant>").isNotNull()
    has_turns = F.try_variant_get(v, "$.conversations", "array<variant>").isNotNull()
    return (
        F.when(has_messages & ~has_turns, CHATML)
        .when(has_turns & ~has_messages, SHAREGPT)
        .otherwise(UNKNOWN)
    )


def detect_dataset_format(records: DataFrame, record: str = "record") -> DataFrame:
    """Majority format per source with counts and confidence."""
    votes = records.select("source", detect_record_format(F.col(record)).alias("f"))
    counts = votes.groupBy("source").agg(
        *[F.count_if(F.col("f") == f).alias(f"n_{f}") for f in (CHATML, SHAREGPT, UNKNOWN)],
        F.count(F.lit(1)).alias("total"),
    )
    top = F.greatest(*[F.col(f"n_{f}") for f in (CHATML, SHAREGPT, UNKNOWN)])
    leaders = sum(
        (F.col(f"n_{f}") == top).cast("int") for f in (CHATML, SHAREGPT, UNKNOWN)
    )
    winner = F.when(leaders > 1, UNKNOWN)
    for f in (CHATML, SHAREGPT):
        winner = winner.when(F.col(f"n_{f}") == top, f)
    return counts.select(
        "source",
        winner.otherwise(UNKNOWN).alias("format"),
        *[f"n_{f}" for f in (CHATML, SHAREGPT, UNKNOWN)],
        "total",
        (top / F.col("total")).alias("confidence"),
    )


def sharegpt_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """Records plus ``turns``: what a converter or analyzer needs of each turn."""
    v = F.try_parse_json(F.col(record))
    parsed = once(records, v=v).withColumn(
        "arr", F.try_variant_get(F.col("v"), "$.conversations", "array<variant>")
    )

    def turn(t: Column) -> Column:
        role = _present(t, SHAREGPT_ROLE_KEYS)
        content = _present(t, SHAREGPT_CONTENT_KEYS)
        return F.struct(
            F.try_variant_get(t, "$", "map<string,variant>").isNotNull().alias("is_obj"),
            _present_key(t, SHAREGPT_ROLE_KEYS).alias("role_key"),
            F.when(~F.is_variant_null(role), _text_of(role)).alias("role"),
            _present_key(t, SHAREGPT_CONTENT_KEYS).alias("content_key"),
            F.when(~F.is_variant_null(content), _text_of(content)).alias("content"),
            F.to_json(t).alias("raw"),
        )

    return parsed.select(
        *[c for c in records.columns],
        F.try_variant_get(F.col("v"), "$", "map<string,variant>").isNotNull().alias("is_object"),
        F.try_variant_get(F.col("v"), "$.conversations", "variant").isNotNull().alias("has_turns"),
        F.transform("arr", turn).alias("turns"),
    )


def _numbered(index: Column, before: str, after: str) -> Column:
    return F.concat(F.lit(before), index.cast("string"), F.lit(after))


def sharegpt_to_chatml(
    records: DataFrame,
    *,
    record: str = "record",
    default_system_prompt: str = IMPORT_SYSTEM_PROMPT,
    meta_key: str = META_KEY,
) -> DataFrame:
    """Entries from ShareGPT records, with ``warnings ARRAY<STRING>``."""
    no_turns = f"cast(array() as array<{TURN_TYPE}>)"
    noted = F.transform(
        F.coalesce(F.col("turns"), F.expr(no_turns)),
        lambda t, i: F.struct(t.alias("t"), i.alias("i"), standard_role(t["role"]).alias("std")),
    )
    base = sharegpt_turns(records, record).withColumn("noted", noted)
    base = base.withColumn("usable", F.filter("noted", lambda a: a["t"]["is_obj"] & a["t"]["role"].isNotNull()))
    base = base.withColumn(
        "system_parts",
        F.transform(
            F.filter("usable", lambda a: a["std"].eqNullSafe("system")),
            lambda a: F.coalesce(a["t"]["content"], F.lit("")),
        ),
    ).withColumn("joined", F.array_join(F.filter("system_parts", lambda p: ~tx.is_blank(p)), "\n\n"))
    turns, system_parts, joined = F.col("noted"), F.col("system_parts"), F.col("joined")
    system_content = F.when(tx.is_blank(joined), default_system_prompt).otherwise(joined)
    others = F.filter("usable", lambda a: ~a["std"].eqNullSafe("system"))
    messages = F.concat(
        F.array(message(F.lit("system"), system_content)),
        F.transform(
            others,
            lambda a: message(
                F.coalesce(a["std"], a["t"]["role"]), F.coalesce(a["t"]["content"], F.lit(""))
            ),
        ),
    )
    per_turn = F.flatten(
        F.transform(
            turns,
            lambda a: F.when(
                ~a["t"]["is_obj"], F.array(_numbered(a["i"], "Turn ", ": not an object"))
            )
            .when(a["t"]["role"].isNull(), F.array(_numbered(a["i"], "Turn ", ": no role field")))
            .otherwise(
                F.array_compact(
                    F.array(
                        F.when(a["t"]["content"].isNull(), _numbered(a["i"], "Turn ", ": no content field")),
                        F.when(
                            a["std"].isNull(),
                            F.concat(
                                _numbered(a["i"], "Turn ", ": role '"), a["t"]["role"], F.lit("' needs mapping")
                            ),
                        ),
                    )
                )
            ),
        )
    )
    n_system = F.size(system_parts)
    warnings = F.concat(
        F.array_compact(
            F.array(
                F.when(F.col("turns").isNull(), F.lit("No conversations list")),
                F.when(F.size(turns) == 0, F.lit("No conversation turns")),
            )
        ),
        per_turn,
        F.array_compact(
            F.array(
                F.when((n_system > 0) & tx.is_blank(joined), F.lit("System turn empty; default prompt used")),
                F.when(n_system > 1, F.lit("System turns merged")),
                F.when(n_system == 0, F.lit("No system turn; default prompt used")),
            )
        ),
    )
    converted = base.select(
        "entry_index", "source", F.col(record), messages.cast(MESSAGES_TYPE).alias("c_messages"),
        warnings.alias("warnings"),
    )
    # every other top-level key is carried across by the entry parser
    rest = parse_entries_keep(converted, record, meta_key)
    drop = lambda k: (k == "messages") | (k == "conversations")
    return rest.withColumn(
        "extras", F.map_filter("extras", lambda k, _: ~drop(k)).cast(EXTRAS_TYPE)
    )


def parse_entries_keep(converted: DataFrame, record: str, meta_key: str) -> DataFrame:
    """Parse the record's other keys next to already converted messages."""
    out = entries_projection(converted, record, meta_key, keep=("c_messages", "warnings"))
    return out.select(
        *[
            F.col("c_messages").alias("messages") if c == "messages" else F.col(c)
            for c in out.columns
            if c != "c_messages"
        ]
    )


def convert_to_chatml(records: DataFrame, *, record: str = "record", meta_key: str = META_KEY) -> DataFrame:
    """Entries of every record; ShareGPT conversion where it is the majority.

    The vote is one small row per source and decides per source, as each file
    of the dataset is converted or passed through as a whole.
    """
    formats = detect_dataset_format(records, record).select("source", "format")
    tagged = records.join(formats, "source")
    plain = parse_entries(
        tagged.where(F.col("format") != SHAREGPT), record=record, meta_key=meta_key
    ).withColumn("warnings", empty_strings())
    converted = sharegpt_to_chatml(
        tagged.where(F.col("format") == SHAREGPT).drop("format"), record=record, meta_key=meta_key
    )
    return plain.withColumn("converted", F.lit(False)).unionByName(
        converted.withColumn("converted", F.lit(True))
    )


def conversion_summary(converted: DataFrame) -> DataFrame:
    """Converted / already-ChatML counts and number of warnings per source."""
    return converted.groupBy("source").agg(
        F.count_if("converted").alias("converted_count"),
        F.count_if(~F.col("converted")).alias("passed_count"),
        F.sum(F.size("warnings")).alias("warning_count"),
    )


def chatml_to_sharegpt(entries: DataFrame, *, import_prompt: str = IMPORT_SYSTEM_PROMPT) -> DataFrame:
    """ShareGPT turns ``conversations ARRAY<STRUCT<from,value>>`` and warnings."""
    field = lambda m, name: F.coalesce(m[name], F.get_json_object(m["other"], f"$.{name}"))
    first = F.transform(
        messages_or_empty(),
        lambda m, i: F.struct(
            m.alias("m"), i.alias("i"), field(m, "role").alias("role"), field(m, "content").alias("content")
        ),
    )
    noted = F.transform(
        "noted",
        lambda a: F.struct(
            a["m"].alias("m"), a["i"].alias("i"), a["role"].alias("role"), a["content"].alias("content"),
            sharegpt_role(a["role"]).alias("to"),
        ),
    )
    rows = entries.withColumn("noted", first).withColumn("noted", noted)
    kept = F.filter(
        "noted",
        lambda a: a["m"]["is_obj"]
        & a["to"].isNotNull()
        & ~(a["m"]["role"].eqNullSafe("system") & (F.coalesce(a["content"], F.lit("")) == import_prompt)),
    )
    turns = F.transform(
        kept,
        lambda a: F.struct(a["to"].alias("from"), F.coalesce(a["content"], F.lit("")).alias("value")),
    )
    messages = F.col("noted")
    per_message = F.flatten(
        F.transform(
            "noted",
            lambda a: F.when(
                ~a["m"]["is_obj"], F.array(_numbered(a["i"], "Message ", ": not an object"))
            )
            .when(a["role"].isNull(), F.array(_numbered(a["i"], "Message ", ": no role field")))
            .otherwise(
                F.array_compact(
                    F.array(
                        F.when(a["content"].isNull(), _numbered(a["i"], "Message ", ": no content field")),
                        F.when(
                            a["to"].isNull(),
                            F.concat(_numbered(a["i"], "Message ", ": unknown role '"), a["role"], F.lit("'")),
                        ),
                    )
                )
            ),
        )
    )
    warnings = F.concat(
        F.array_compact(
            F.array(
                F.when(F.col("messages").isNull(), F.lit("No messages list")),
                F.when(F.size(messages) == 0, F.lit("No messages")),
            )
        ),
        per_message,
    )
    return rows.withColumn("conversations", turns).withColumn("warnings", warnings).drop("noted")


def custom_role_turns(entries: DataFrame) -> DataFrame:
    """Turns of message objects whose role is not a known spelling.

    ``(entry_index, entry_id, turn_index, label)`` with a non-blank label.
    """
    rows = entries.select(
        "entry_index", entry_id().alias("entry_id"), F.posexplode("messages").alias("turn_index", "m")
    ).where(F.col("m.is_obj"))
    label = F.coalesce(F.col("m.role"), F.get_json_object("m.other", "$.role"))
    return (
        rows.select("entry_index", "entry_id", "turn_index", tx.strip(label).alias("label"))
        .where((F.col("label") != "") & standard_role(F.col("label")).isNull())
    )


def custom_role_pattern(custom_turns: DataFrame) -> DataFrame:
    """Suggested standard role per custom label, or no rows.

    Two labels that strictly alternate over the whole dataset read as user and
    assistant; a third one that opens the dataset and occurs once reads as the
    system. A cheap label count runs first: with more than three labels there
    is no pattern and the ordering work sees no rows. Alternation is checked
    per entry and then along the chain of entry ends, so no global window over
    turns is needed.
    """
    labels = custom_turns.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("entry_index", "turn_index")).alias("first_at"),
    )
    n_labels = labels.agg(F.count(F.lit(1)).alias("n_labels"))
    few = labels.crossJoin(F.broadcast(n_labels)).where(F.col("n_labels").isin(2, 3))
    order = few.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("first_at", "label", "n"))),
            lambda s: F.struct(s["label"].alias("label"), s["n"].alias("n")),
        ).alias("labels")
    ).where(F.size("labels") >= 2)
    candidate = order.where(
        (F.size("labels") == 2) | (F.get("labels", F.lit(0))["n"] == 1)
    ).select(
        "labels",
        F.when(F.size("labels") == 3, F.get("labels", F.lit(0))["label"]).alias("lead"),
        F.element_at("labels", -2)["label"].alias("first"),
        F.element_at("labels", -1)["label"].alias("second"),
    )
    body = (
        custom_turns.crossJoin(F.broadcast(candidate))
        .where(~F.col("label").eqNullSafe(F.col("lead")))
        .select("entry_index", "turn_index", (F.col("label") == F.col("second")).cast("int").alias("bit"))
    )
    inside = Window.partitionBy("entry_index").orderBy("turn_index")
    per_entry = (
        body.withColumn("prev", F.lag("bit").over(inside))
        .groupBy("entry_index")
        .agg(
            F.bool_and(F.coalesce(F.col("prev") != F.col("bit"), F.lit(True))).alias("ok"),
            F.count(F.lit(1)).alias("n"),
            F.min_by("bit", "turn_index").alias("starts"),
        )
    )
    # position parity: an entry must start with bit = (turns before it) mod 2
    placed = running_total(per_entry, "entry_index", "n", "before")
    verdict = placed.agg(
        F.bool_and(F.col("ok") & (F.col("starts") == F.pmod(F.col("before"), F.lit(2)))).alias("ok")
    ).where("ok")
    role_names = F.array(
        F.struct(F.col("lead").alias("label"), F.lit("system").alias("role")),
        F.struct(F.col("first").alias("label"), F.lit("user").alias("role")),
        F.struct(F.col("second").alias("label"), F.lit("assistant").alias("role")),
    )
    return (
        candidate.crossJoin(verdict)
        .select(F.explode(role_names).alias("r"))
        .where(F.col("r.label").isNotNull())
        .select("r.label", "r.role")
    )
