"""The entry model: one row per conversation record.

Columns
    entry_index BIGINT   position in the dataset
    source      STRING   file or table the entry came from
    is_object   BOOLEAN  false when the record was not a JSON object
    messages    ARRAY<STRUCT<is_obj, role, content, other>>, NULL when the
                record has no message list
    tags        ARRAY<STRING>, NULL elements stand for non-string items; NULL
                when the record has no tag list
    tags_raw    ARRAY<STRING>  JSON text of each item of a tag list that holds
                non-string items, NULL for a clean list
    meta        STRUCT<version, native, validated_at, entry_uuid, dataset_uuid>
    extras      MAP<STRING,STRING>  JSON text of every other top-level key,
                including ``messages`` / ``tags`` that are not lists

``role`` and ``content`` are NULL unless they are strings. ``other`` keeps the
JSON text of a message that is more than ``{role, content}`` strings, so
nothing is lost on the way back to JSON.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.constants import META_KEY

MESSAGE_TYPE = "struct<is_obj:boolean,role:string,content:string,other:string>"
MESSAGES_TYPE = f"array<{MESSAGE_TYPE}>"
META_TYPE = (
    "struct<version:int,native:boolean,validated_at:string,"
    "entry_uuid:string,dataset_uuid:string>"
)
EXTRAS_TYPE = "map<string,string>"
ENTRY_COLUMNS = (
    "entry_index", "source", "is_object", "messages", "tags", "tags_raw",
    "meta", "extras",
)


def message(role, content) -> Column:
    """A plain message struct."""
    return F.struct(
        F.lit(True).alias("is_obj"),
        role.alias("role"),
        content.alias("content"),
        F.lit(None).cast("string").alias("other"),
    )


def with_fields(msg: Column, role: Column = None, content: Column = None) -> Column:
    """Copy of a message with its role and/or content replaced."""
    return F.struct(
        msg["is_obj"].alias("is_obj"),
        (msg["role"] if role is None else role).alias("role"),
        (msg["content"] if content is None else content).alias("content"),
        msg["other"].alias("other"),
    )


def empty_messages() -> Column:
    return F.array().cast(MESSAGES_TYPE)


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def entry_columns(
    entry_index, messages, tags=None, source=None, meta=None, extras=None
) -> list:
    """Projection list of a full entry row built from clean columns."""
    return [
        entry_index.cast("bigint").alias("entry_index"),
        (F.lit("table") if source is None else source).alias("source"),
        F.lit(True).alias("is_object"),
        messages.alias("messages"),
        (empty_strings() if tags is None else tags).alias("tags"),
        F.lit(None).cast("array<string>").alias("tags_raw"),
        (F.lit(None).cast(META_TYPE) if meta is None else meta).alias("meta"),
        (F.create_map().cast(EXTRAS_TYPE) if extras is None else extras).alias("extras"),
    ]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on an ordinary computed column is pushed below the projection and
    takes a copy of the expression with it. Columns that come out of a generator
    stay where they are, so an expensive expression is not evaluated twice.
    """
    boxed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(boxed))


# --- column shorthands ------------------------------------------------------


def messages_or_empty() -> Column:
    return F.coalesce(F.col("messages"), empty_messages())


def clean_tags() -> Column:
    """The tag list, or an empty list when it is absent or holds non-strings."""
    ok = F.col("tags").isNotNull() & ~F.exists(F.col("tags"), lambda t: t.isNull())
    return F.when(ok, F.col("tags")).otherwise(empty_strings())


def has_key(name: str) -> Column:
    return F.coalesce(F.map_contains_key(F.col("extras"), F.lit(name)), F.lit(False))


def entry_uuid() -> Column:
    value = F.col("meta.entry_uuid")
    return F.when(value != "", value)


def entry_id() -> Column:
    """The stored identity, else one derived from the position."""
    return F.coalesce(
        entry_uuid(), F.concat(F.lit("entry_index:"), F.col("entry_index").cast("string"))
    )


def role_contents(role: str) -> Column:
    picked = F.filter(
        messages_or_empty(), lambda m: m["is_obj"] & m["role"].eqNullSafe(role)
    )
    return F.transform(picked, lambda m: F.coalesce(m["content"], F.lit("")))


def exchanges() -> Column:
    """Complete pairs among the non-system messages."""
    turns = F.filter(
        messages_or_empty(), lambda m: m["is_obj"] & ~m["role"].eqNullSafe("system")
    )
    return F.floor(F.size(turns) / 2).cast("int")


def text_length() -> Column:
    return F.aggregate(
        messages_or_empty(),
        F.lit(0).cast("long"),
        lambda acc, m: acc
        + F.when(m["is_obj"], F.coalesce(F.length(m["content"]), F.lit(0))).otherwise(0),
    )


def system_prompt() -> Column:
    """Content of message 0 when its role is exactly ``system``, else ''."""
    first = F.get(F.col("messages"), F.lit(0))
    return F.when(
        first["is_obj"] & (first["role"] == "system"),
        F.coalesce(first["content"], F.lit("")),
    ).otherwise("")


# --- turns <-> entries --------------------------------------------------------


def turns_to_entries(
    turns: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    system_prompt_text: str | None = None,
) -> DataFrame:
    """One entry per conversation from a table with one row per turn.

    Blank turns are dropped and text is trimmed. With ``system_prompt_text`` a
    conversation that lacks a leading system turn gets that prompt. A row is
    one conversation, as one JSON line is in a file; statistics that only need
    sums use ``features.from_turns`` and never build the nested row.
    """
    body = turns.select(
        F.col(conversation).cast("bigint").alias("entry_index"),
        F.struct(
            F.col(turn).alias("turn"),
            F.col(role).alias("role"),
            tx.strip(F.col(text)).alias("content"),
        ).alias("t"),
    ).where(F.coalesce(F.col("t.content"), F.lit("")) != "")
    grouped = body.groupBy("entry_index").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    messages = F.transform("ts", lambda t: message(t["role"], t["content"]))
    if system_prompt_text is not None:
        first = F.element_at("ts", 1)["role"]
        prompt = F.array(message(F.lit("system"), F.lit(system_prompt_text)))
        messages = F.when(first == "system", messages).otherwise(F.concat(prompt, messages))
    return grouped.select(*entry_columns(F.col("entry_index"), messages))


def entries_to_turns(entries: DataFrame, role: str | None = None) -> DataFrame:
    """One row per message object: position, role and content."""
    rows = entries.select(
        "entry_index", F.posexplode("messages").alias("turn_index", "m")
    ).where(F.col("m.is_obj"))
    if role is not None:
        rows = rows.where(F.col("m.role") == role)
    return rows.select(
        "entry_index",
        "turn_index",
        F.col("m.role").alias("role"),
        F.col("m.content").alias("content"),
    )


# --- JSON <-> entries -------------------------------------------------------------


def _variant_text(v: Column) -> Column:
    """The string value of a variant string, NULL for any other type."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def message_from_variant(v: Column) -> Column:
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    role = _variant_text(F.try_variant_get(v, "$.role", "variant"))
    content = _variant_text(F.try_variant_get(v, "$.content", "variant"))
    plain = role.isNotNull() & content.isNotNull() & (F.size(keys) == 2)
    return F.struct(
        keys.isNotNull().alias("is_obj"),
        role.alias("role"),
        content.alias("content"),
        F.when(F.coalesce(plain, F.lit(False)), F.lit(None))
        .otherwise(F.to_json(v))
        .alias("other"),
    )


def parse_entries(records: DataFrame, *, record: str = "record", meta_key: str = META_KEY) -> DataFrame:
    """Entry rows from ``(entry_index, source, <record JSON text>)``.

    The record is parsed once; element types are read from the VARIANT, so a
    number among the tags or an object as content stays visible as such.
    """
    return entries_projection(records, record, meta_key)


def entries_projection(records: DataFrame, record: str, meta_key: str, keep=()) -> DataFrame:
    """``parse_entries`` that also carries the columns named in ``keep``."""
    v = F.col("v")
    rows = records.select("entry_index", "source", F.col(record).alias("_text"), *[c for c in keep if c != record])
    parsed = once(rows, v=F.try_parse_json(F.col("_text")))
    if record in keep:
        parsed = parsed.withColumn(record, F.col("_text"))
    parsed = parsed.select(
        "entry_index",
        "source",
        F.try_variant_get(v, "$", "map<string,variant>").alias("top"),
        F.try_variant_get(v, "$.messages", "array<variant>").alias("m"),
        F.try_variant_get(v, "$.tags", "array<variant>").alias("t"),
        F.try_variant_get(v, f"$.{meta_key}", "variant").alias("meta_v"),
        *keep,
    )
    tags = F.transform("t", _variant_text)
    extras = F.map_filter(
        F.col("top"),
        lambda k, _: ~(
            ((k == "messages") & F.col("m").isNotNull())
            | ((k == "tags") & F.col("t").isNotNull())
            | (k == meta_key)
        ),
    )
    field = lambda name, kind: F.try_variant_get(F.col("meta_v"), f"$.{name}", kind)
    meta = F.when(
        _is_object(F.col("meta_v")),
        F.struct(
            field("version", "int").alias("version"),
            field("native", "boolean").alias("native"),
            field("validated_at", "string").alias("validated_at"),
            _variant_text(field("entry_uuid", "variant")).alias("entry_uuid"),
            _variant_text(field("dataset_uuid", "variant")).alias("dataset_uuid"),
        ),
    )
    return parsed.select(
        "entry_index",
        "source",
        F.col("top").isNotNull().alias("is_object"),
        F.transform("m", message_from_variant).alias("messages"),
        tags.alias("tags"),
        F.when(F.exists(tags, lambda x: x.isNull()), F.transform("t", lambda x: F.to_json(x))).alias("tags_raw"),
        meta.cast(META_TYPE).alias("meta"),
        F.coalesce(
            F.transform_values(extras, lambda _, x: F.to_json(x)),
            F.create_map().cast(EXTRAS_TYPE),
        ).alias("extras"),
        *keep,
    )


def quote(col: Column) -> Column:
    """JSON text of a string."""
    boxed = F.to_json(F.array(col))
    return F.substr(boxed, F.lit(2), F.length(boxed) - 2)


def message_json(msg: Column) -> Column:
    """JSON text of a message; edited role and content override ``other``."""
    plain = F.to_json(F.struct(msg["role"].alias("role"), msg["content"].alias("content")))
    keyed = F.try_variant_get(F.try_parse_json(msg["other"]), "$", "map<string,variant>")
    rest = F.transform(
        F.filter(
            F.json_object_keys(msg["other"]),
            lambda k: ~(((k == "role") & msg["role"].isNotNull())
                        | ((k == "content") & msg["content"].isNotNull())),
        ),
        lambda k: F.concat(
            quote(k), F.lit(":"),
            F.to_json(F.element_at(keyed, k)),
        ),
    )
    parts = F.concat(
        F.when(msg["role"].isNotNull(), F.array(F.concat(F.lit('"role":'), quote(msg["role"])))).otherwise(empty_strings()),
        F.when(msg["content"].isNotNull(), F.array(F.concat(F.lit('"content":'), quote(msg["content"])))).otherwise(empty_strings()),
        F.coalesce(rest, empty_strings()),
    )
    merged = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    return (
        F.when(~msg["is_obj"], msg["other"])
        .when(msg["other"].isNull(), plain)
        .otherwise(merged)
    )


def entry_json(*, clean: bool = False, meta_key: str = META_KEY) -> Column:
    """JSON text of an entry; ``clean`` keeps the messages only."""
    messages = F.concat(
        F.lit('"messages":['),
        F.array_join(F.transform("messages", message_json), ","),
        F.lit("]"),
    )
    if clean:
        return F.concat(F.lit("{"), F.coalesce(messages, F.lit('"messages":[]')), F.lit("}"))
    items = F.coalesce(F.col("tags_raw"), F.transform("tags", quote))
    tags = F.when(
        F.col("tags").isNotNull(),
        F.concat(F.lit('"tags":['), F.array_join(items, ","), F.lit("]")),
    )
    extras = F.transform(
        F.map_entries("extras"),
        lambda e: F.concat(quote(e["key"]), F.lit(":"), e["value"]),
    )
    meta = F.when(
        F.col("meta").isNotNull(),
        F.concat(F.lit(f'"{meta_key}":'), F.to_json("meta")),
    )
    parts = F.concat(
        F.array(messages, tags),
        F.coalesce(extras, empty_strings()),
        F.array(meta),
    )
    return F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), ","), F.lit("}"))
