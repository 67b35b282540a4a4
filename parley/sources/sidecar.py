"""The registry sidecar: one JSON document per dataset."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.entries import once
from ..session import cut_lineage

# --- fixed values: document header ---------------------------------------------
KIND = "dataset_registry"
SCHEMA_VERSION = 1

# name -> (required text, optional text or null, {optional field: (type, default)})
ITEM_RULES = {
    "categories": (("slug", "name"), (), {"sort_order": ("int", 0), "is_active": ("boolean", True), "is_builtin": ("boolean", False)}),
    "tags": (("slug", "name"), ("category_slug",), {
        "sort_order": ("int", 0), "status": ("string", "active"),
        "is_active": ("boolean", True), "is_builtin": ("boolean", False),
    }),
    "aliases": (("old_slug", "action"), ("new_slug",), {}),
    "characters": (("slug", "display_name"), ("description",), {"is_active": ("boolean", True)}),
    "system_prompts": (("slug", "name", "content"), ("description",), {"is_active": ("boolean", True)}),
}
OBJECT_FIELDS = {"tags": "lifecycle", "aliases": "metadata"}
KIND_OF = {"string": "STRING", "int": "BIGINT", "boolean": "BOOLEAN"}


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _type(v: Column, path: str) -> Column:
    """Type name of a field; NULL when the field is absent."""
    return F.schema_of_variant(_get(v, path))


def _text(v: Column, path: str) -> Column:
    return F.when(_type(v, path) == "STRING", _get(v, path, "string"))


def _required_text(v: Column, path: str) -> Column:
    return F.when(F.coalesce(_text(v, path), F.lit("")) == "", F.lit(path))


def _is_object(v: Column, path: str) -> Column:
    return F.coalesce(_type(v, path).startswith("OBJECT"), F.lit(False))


def _item_fault(x: Column, name: str) -> Column:
    """First fault of one list item, NULL when it is well formed."""
    required, nullable, optional = ITEM_RULES[name]
    checks = [F.when(F.try_variant_get(x, "$", "map<string,variant>").isNull(), F.lit("not an object"))]
    checks += [_required_text(x, f) for f in required]
    checks += [F.when(~_type(x, f).isin("STRING", "VOID"), F.lit(f)) for f in nullable]
    checks += [F.when(_type(x, f) != KIND_OF[t], F.lit(f)) for f, (t, _) in optional.items()]
    if name in OBJECT_FIELDS:
        f = OBJECT_FIELDS[name]
        checks.append(F.when(~(_type(x, f).startswith("OBJECT") | (_type(x, f) == "VOID")), F.lit(f)))
    return F.coalesce(*checks)


def _mapping_fault(x: Column) -> Column:
    turns = F.try_variant_get(x, "$.turns", "array<variant>")
    turn_fault = lambda t: F.coalesce(
        F.when(F.try_variant_get(t, "$", "map<string,variant>").isNull(), F.lit("turn is not an object")),
        F.when(~F.coalesce(_type(t, "turn_index") == "BIGINT", F.lit(False)), F.lit("turn_index")),
        _required_text(t, "character_slug"),
        _required_text(t, "training_role"),
        F.when(~_type(t, "source_role_label").isin("STRING", "VOID"), F.lit("source_role_label")),
    )
    return F.coalesce(
        F.when(F.try_variant_get(x, "$", "map<string,variant>").isNull(), F.lit("not an object")),
        _required_text(x, "entry_uuid"),
        F.when(_get(x, "turns").isNotNull() & turns.isNull(), F.lit("turns")),
        F.get(F.array_compact(F.transform(turns, turn_fault)), F.lit(0)),
    )


def _checker(name: str):
    """Fault test of one kind of item; a one-argument function, as Spark calls
    two-argument ones with the index."""
    if name == "entry_character_mappings":
        return _mapping_fault
    return lambda x: _item_fault(x, name)


def _labelled(name: str):
    return lambda fault: F.concat(F.lit(f"{name}: "), fault)


def parse_sidecars(docs: DataFrame) -> DataFrame:
    """``(source, v, errors)`` from ``(source, value)`` documents.

    ``errors`` lists every violation; a document with any is not used.
    """
    v = F.col("v")
    parsed = once(docs.select("source", "value"), v=F.try_parse_json(F.col("value"))).select("source", "v")
    header = [
        F.when(F.try_variant_get(v, "$", "map<string,variant>").isNull(), F.lit("document is not an object")),
        F.when(~_is_object(v, "metadata"), F.lit("metadata")),
        F.when(~_is_object(v, "dataset"), F.lit("dataset")),
        F.when(~F.coalesce(_type(v, "metadata.schema_version") == "BIGINT", F.lit(False)), F.lit("metadata.schema_version")),
        _required_text(v, "metadata.kind"),
        _required_text(v, "metadata.exported_at"),
        F.when(_text(v, "metadata.kind") != KIND, F.lit("unsupported kind")),
        F.when(_get(v, "metadata.schema_version", "int") != SCHEMA_VERSION, F.lit("unsupported schema_version")),
        _required_text(v, "dataset.dataset_uuid"),
        _required_text(v, "dataset.filename"),
        F.when(_type(v, "dataset.entry_count") != "BIGINT", F.lit("dataset.entry_count")),
        F.when(~_type(v, "dataset.tag_usage_counts").startswith("OBJECT"), F.lit("dataset.tag_usage_counts")),
    ]
    lists, items = [], []
    for name in (*ITEM_RULES, "entry_character_mappings"):
        arr = _get(v, name, "array<variant>")
        lists.append(F.when(_get(v, name).isNotNull() & arr.isNull(), F.lit(name)))
        items.append(F.transform(F.array_compact(F.transform(arr, _checker(name))), _labelled(name)))
    nothing = F.array().cast("array<string>")
    errors = F.concat(
        F.array_compact(F.array(*header, *lists)), *[F.coalesce(i, nothing) for i in items]
    )
    return once(parsed, errors=errors)


def sidecar_frames(parsed: DataFrame) -> dict:
    """Frames of the valid documents: dataset, the five registries, mappings."""
    good = parsed.where(F.size("errors") == 0)
    v = F.col("v")
    frames = {
        "dataset": good.select(
            "source",
            _text(v, "dataset.dataset_uuid").alias("dataset_uuid"),
            _text(v, "dataset.filename").alias("filename"),
            F.coalesce(_get(v, "dataset.entry_count", "long"), F.lit(0)).alias("entry_count"),
            _get(v, "dataset.tag_usage_counts", "map<string,long>").alias("tag_usage_counts"),
        )
    }
    for name, (required, nullable, optional) in ITEM_RULES.items():
        rows = good.select("source", F.posexplode(_get(v, name, "array<variant>")).alias("pos", "x"))
        x = F.col("x")
        cols = [_text(x, f).alias(f) for f in (*required, *nullable)]
        cols += [F.coalesce(_get(x, f, t), F.lit(d)).alias(f) for f, (t, d) in optional.items()]
        if name in OBJECT_FIELDS:
            f = OBJECT_FIELDS[name]
            text = F.to_json(_get(x, f))
            cols.append(F.when(text.isNull() | (text == "null"), "{}").otherwise(text).alias("metadata_json"))
        frames[name] = rows.select("source", "pos", *cols)
    turns = good.select(
        "source", F.explode(_get(v, "entry_character_mappings", "array<variant>")).alias("x")
    ).select("source", _text(F.col("x"), "entry_uuid").alias("entry_uuid"),
             F.explode(_get(F.col("x"), "turns", "array<variant>")).alias("t"))
    t = F.col("t")
    frames["mappings"] = turns.select(
        "source", "entry_uuid", _get(t, "turn_index", "int").alias("turn_index"),
        _text(t, "character_slug").alias("character_slug"),
        _text(t, "training_role").alias("training_role"),
        _text(t, "source_role_label").alias("source_role_label"),
    )
    return frames


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), "value"
    )
    return parse_sidecars(docs)


def read_frames(spark: SparkSession, path: str) -> dict:
    """``sidecar_frames`` of the documents under a path, each written once as rows.

    A document is one row, so that one task parses and checks it; it does so once,
    not again for each later use of a frame.
    """
    parsed = cut_lineage(read_sidecars(spark, path))
    return {k: cut_lineage(v) for k, v in sidecar_frames(parsed).items()}


LINES = "section int, key string, value string"
USAGE, FIRST_LIST = 1, 3


def sidecar_lines(dataset: DataFrame, frames: dict, usage: DataFrame, *, exported_at: str) -> DataFrame:
    """The document as text lines ``section, key, value``, in this order.

    ``dataset`` is one row (dataset_uuid, filename, entry_count). Each registry item
    and each entry's turn mappings are a line of their own, so that no cell and no
    task holds a whole list. Lines that are equal are one.
    """
    spark = dataset.sparkSession
    names = [*ITEM_RULES, "entry_character_mappings"]
    null = {"ignoreNullFields": "false"}
    head = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(KIND).alias("kind"), F.lit(exported_at).alias("exported_at"))
    about = F.to_json(F.struct("dataset_uuid", "filename", "entry_count"), null)
    fixed = dataset.select(
        F.lit(0).alias("section"), F.lit("").alias("key"),
        F.concat(F.lit('{"metadata":'), F.to_json(head), F.lit(',"dataset":'), F.regexp_replace(about, r"\}$", ',"tag_usage_counts":{')).alias("value"),
    )
    closes = [(USAGE + 1, "", f'}}}},"{names[0]}":[')]
    closes += [(FIRST_LIST + 2 * i + 1, "", f'],"{n}":[') for i, n in enumerate(names[1:])]
    closes.append((FIRST_LIST + 2 * len(names) - 1, "", "]}"))
    items = usage.where(F.col("slug").isNotNull()).select(
        F.lit(USAGE).alias("section"), F.col("slug").alias("key"),
        F.regexp_replace(F.to_json(F.create_map("slug", "entries")), r"^\{|\}$", "").alias("value"),
    )
    for i, (name, (required, nullable, optional)) in enumerate(ITEM_RULES.items()):
        item = F.to_json(F.struct(*required, *nullable, *optional), null)
        items = items.unionByName(frames[name].select(F.lit(FIRST_LIST + 2 * i).alias("section"), F.col(required[0]).alias("key"), item.alias("value")))
    turns = F.sort_array(F.collect_list(F.struct("turn_index", "character_slug", "training_role", "source_role_label"))).alias("turns")
    mapped = frames["mappings"].groupBy("entry_uuid").agg(turns).select(
        F.lit(FIRST_LIST + 2 * len(ITEM_RULES)).alias("section"), F.col("entry_uuid").alias("key"), F.to_json(F.struct("entry_uuid", "turns"), null).alias("value")
    )
    items = items.unionByName(mapped).withColumn("key", F.coalesce("key", F.lit(""))).dropDuplicates(["section", "key", "value"])
    items = cut_lineage(items)  # read twice below
    # all but the first of a list follow a comma
    first = items.groupBy("section").agg(F.min(F.struct("key", "value")).alias("_first"))
    marked = items.join(F.broadcast(first), "section")  # one row a list
    comma = F.when(F.struct("key", "value") == F.col("_first"), "").otherwise(",")
    rows = marked.select("section", "key", F.concat(comma, "value").alias("value"))
    return fixed.unionByName(rows).unionByName(spark.createDataFrame(closes, LINES))


def write_sidecar(lines: DataFrame, path: str, *, partitions: int | None = None) -> None:
    """The lines as one JSON document, a single file at ``path``.

    Ranges of the order are written as parts by parallel tasks. At the commit their
    bytes are appended to one file, which then takes its name; a file that is there
    is replaced, and a failure before leaves it as it was.
    """
    spark = lines.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    order = ["section", "key", "value"]
    lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select("value").write.text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to_path = jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(conf)
    names = sorted(s.getPath().toString() for s in fs.listStatus(to_path(parts)) if s.getPath().getName().startswith("part-"))
    whole = to_path(f"{parts}/whole")
    out = fs.create(whole, True)
    try:
        for name in names:  # bytes alone, through a small buffer
            source = fs.open(to_path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()
    if fs.exists(to_path(path)):
        fs.delete(to_path(path), False)
    fs.rename(whole, to_path(path))
    fs.delete(to_path(parts), True)
