"""Dataset files in and out: JSON lines, JSON arrays, single objects, text."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.constants import DATASET_EXTENSIONS, TRAINING_OBJECT_KEYS
from ..operators.entries import entry_json, once
from ..session import cut_lineage
from .json_stream import read_documents


def survey_files(spark: SparkSession, path: str) -> DataFrame:
    """``(source, error, whole, maybe_whole)`` per file: whether it can be read, and how.

    The error tells of a wrong extension or bytes that are not UTF-8, else NULL.
    ``whole`` marks files that hold one JSON array or object instead of lines, by
    their first line: an array opens, or a ``.json`` object that does not end on
    it; ``maybe_whole`` also those objects that do. Lines are tested where they are read; only flags leave the scan.
    """
    name = F.col("_metadata.file_path").alias("source")
    listed = spark.read.format("binaryFile").load(path).select(name)  # names only, no content
    text = tx.strip(F.col("value"))
    lines = spark.read.text(path).select(
        name, (~F.is_valid_utf8("value")).alias("bad"), (text != "").alias("filled"),
        # one task reads the start of a file, in order
        F.when((F.col("_metadata.file_block_start") == 0) & (text != ""), F.ascii(F.left(text, F.lit(1)))).alias("opens"),
        F.when((F.col("_metadata.file_block_start") == 0) & (text != ""), F.ascii(F.right(text, F.lit(1)))).alias("ends"),
    )
    facts = lines.groupBy("source").agg(
        F.bool_or("bad").alias("bad"), F.count_if("filled").alias("n"),
        F.first("opens", ignorenulls=True).alias("opens"), F.first("ends", ignorenulls=True).alias("ends"),
    )
    ext = F.lower(F.regexp_extract("source", r"(\.[^./]+)$", 1))
    one = (ext == ".json") & (F.col("opens") == ord("{")) & ((F.col("n") == 1) | (F.col("ends") != ord("}")))
    return listed.join(facts, "source", "left").select(
        "source",
        F.when(~ext.isin(*DATASET_EXTENSIONS), F.concat(F.lit("Unsupported file type: "), ext))
        .when(F.col("bad"), "Not valid UTF-8")
        .alias("error"),
        F.coalesce((F.col("opens") == ord("[")) | one, F.lit(False)).alias("whole"),
        F.coalesce((F.col("opens") == ord("[")) | (F.col("opens") == ord("{")) & (ext == ".json"), F.lit(False)).alias("maybe_whole"),
    )


def gate(spark: SparkSession, path: str) -> DataFrame:
    """``(source, error)`` per file: extension and UTF-8 checks, error NULL when
    the file can be read."""
    return survey_files(spark, path).select("source", "error")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with ``source`` and a 1-based ``line`` number.

    A large file is read in splits. Inside a split the scan hands out
    consecutive ids; the number of lines in each split is counted first (a
    small aggregate by file and split) and gives the offset of the next split.
    No shuffle of the text and no single-task numbering.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
        "value",
    )
    return number_lines(raw)


def number_lines(raw: DataFrame) -> DataFrame:
    """``source, line, value`` of scanned lines ``source, block, mid, value``; ``mid`` counts up inside a split."""
    blocks = raw.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    # one row per split goes through the window, none of the text
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("source", "block", "first", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    return raw.join(offsets, ["source", "block"]).select(
        "source", (F.col("mid") - F.col("first") + F.col("offset") + 1).alias("line"), "value"
    )


def is_one_value(text: Column) -> Column:
    """Whether a text is a single JSON value. The parser stops after a first value,
    so the text is tried as the only item of a list."""
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return boxed.isNotNull() & F.try_variant_get(boxed, "$[1]", "variant").isNull() & (text != "")


def parse_lines(lines: DataFrame) -> DataFrame:
    """``(source, line, record, error)`` for every non-blank line.

    ``record`` is the text of a line that holds one JSON value, else NULL.
    """
    text = tx.strip(F.col("value"))
    rows = lines.select("source", "line", text.alias("text")).where(F.col("text") != "")
    ok = F.col("ok")
    return (
        once(rows, ok=is_one_value(F.col("text")))
        .select(
            "source", "line",
            F.when(ok, F.col("text")).alias("record"),
            F.when(~ok, F.concat(F.lit("Line "), F.col("line").cast("string"), F.lit(": not valid JSON"))).alias("error"),
        )
    )


def read_counts(parsed: DataFrame) -> DataFrame:
    """Line, entry and error counts per source; ``no_valid`` when all failed."""
    return parsed.groupBy("source").agg(
        F.count(F.lit(1)).alias("source_line_count"),
        F.count("record").alias("parsed_entry_count"),
        F.count("error").alias("parse_error_count"),
        (F.count("record") == 0).alias("no_valid"),
    )


def whole_documents(spark: SparkSession, path) -> DataFrame:
    """Files read whole, for arrays and single objects: ``(source, value)``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), "value"
    )


def document_kind(source: Column, value: Column) -> Column:
    """array / object / lines: how the content of a file has to be read.

    The JSON parser stops after a first value, so the text is tried as the only
    item of a list: several values one after another are lines.
    """
    text = tx.strip(value)
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    single = boxed.isNotNull() & F.try_variant_get(boxed, "$[1]", "variant").isNull()
    is_json = F.lower(source).endswith(".json")
    return (
        F.when(text.startswith("[") & single, "array")
        .when(is_json & text.startswith("{") & single, "object")
        .otherwise("lines")
    )


def parse_documents(docs: DataFrame) -> DataFrame:
    """``(source, line, record, error)`` from whole-file JSON.

    An array must hold objects only; an object must look like a training
    record. Faulty files give one error and no records. Files of kind ``lines``
    are left to the line reader.
    """
    kinds = once(
        docs, v=F.try_parse_json(tx.strip(F.col("value"))), kind=document_kind(F.col("source"), F.col("value"))
    )
    items = F.try_variant_get(F.col("v"), "$", "array<variant>")
    is_obj = lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull()
    arrays = kinds.where(F.col("kind") == "array").select("source", items.alias("items"))
    mixed = F.exists("items", lambda x: ~is_obj(x))
    good = arrays.where(~mixed).select("source", F.posexplode("items").alias("pos", "x")).select(
        "source", (F.col("pos") + 1).cast("long").alias("line"), F.to_json("x").alias("record"),
        F.lit(None).cast("string").alias("error"),
    )
    bad = arrays.where(mixed).select("source", F.lit("Array holds items that are not objects").alias("error"))
    keys = F.map_keys(F.try_variant_get(F.col("v"), "$", "map<string,variant>"))
    objects = kinds.where(F.col("kind") == "object").select(
        "source", "value",
        F.arrays_overlap(keys, F.array(*[F.lit(k) for k in TRAINING_OBJECT_KEYS])).alias("ok"),
    )
    one = objects.where("ok").select(
        "source", F.lit(1).cast("long").alias("line"), tx.strip(F.col("value")).alias("record"),
        F.lit(None).cast("string").alias("error"),
    )
    odd = objects.where(~F.col("ok")).select("source", F.lit("Object is not a training record").alias("error"))
    errors = bad.unionByName(odd).select(
        "source", F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("record"), "error"
    )
    return good.unionByName(one).unionByName(errors)


def read_dataset(spark: SparkSession, path: str, *, layout: str = "auto") -> DataFrame:
    """Parsed rows ``(source, line, record, error)`` of one or many files.

    ``"auto"`` looks at each file first: refused files give one error row, files
    of lines are split at lines, arrays and single objects at their records.
    ``"lines"`` and ``"documents"`` take that choice for all files; the latter
    falls back to lines per file.
    """
    if layout == "lines":
        return parse_lines(read_lines(spark, path))
    found = cut_lineage(survey_files(spark, path))  # one row a file
    refused = found.where(F.col("error").isNotNull()).select(
        "source", F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("record"), "error"
    )
    fine = found if layout == "documents" else found.where(F.col("error").isNull())
    whole = F.col("maybe_whole" if layout == "documents" else "whole")
    by_line, out = fine.where(~whole).select("source"), None
    chosen = fine.where(whole).select("source")
    if not chosen.isEmpty():
        docs = cut_lineage(read_documents(spark, path, chosen))
        by_line = by_line.unionByName(docs.where("as_lines").select("source"))
        out = docs.where("not as_lines").select("source", "line", "record", "error")
    lines = parse_lines(read_lines(spark, path).join(by_line, "source", "left_semi"))
    out = lines if out is None else lines.unionByName(out)
    return out if layout == "documents" else out.unionByName(refused)


def parse_whole(docs: DataFrame) -> DataFrame:
    """``(source, line, record, error)`` of files read whole, of any kind."""
    by_line = docs.where(document_kind(F.col("source"), F.col("value")) == "lines").select(
        "source", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("pos", "value")
    ).select("source", (F.col("pos") + 1).cast("long").alias("line"), "value")
    return parse_documents(docs).unionByName(parse_lines(by_line))


def index_records(parsed: DataFrame) -> DataFrame:
    """Dense ``entry_index`` over the good records of all sources.

    The order is by source, then by line, so positions and the ids derived from
    them are unique over a load of many files. Counts per run of a million lines
    give the offsets; no task numbers a whole file.
    """
    rows = parsed.where(F.col("record").isNotNull()).withColumn("_b", F.floor(F.col("line") / 1_000_000))
    counts = rows.groupBy("source", "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("source", "_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per run
    base = counts.select("source", "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    pos = F.expr("row_number() over (partition by source, _b order by line)")
    return (
        rows.withColumn("_pos", pos)
        .join(base, ["source", "_b"])
        .select("source", "line", (F.col("_base") + F.col("_pos") - 1).alias("entry_index"), "record")
    )


def write_jsonl(entries: DataFrame, path: str, *, clean: bool = False, partitions: int | None = None) -> None:
    """One JSON object per line in dataset order.

    Range partitions keep the order across part files, so no task sorts it all.
    The output folder appears as a whole when the job commits.
    """
    rows = entries.select("entry_index", entry_json(clean=clean).alias("value"))
    n = partitions or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows.repartitionByRange(n, "entry_index").sortWithinPartitions("entry_index").select("value").write.text(path)


def sharegpt_json(entries: DataFrame) -> DataFrame:
    """Export text of ``chatml_to_sharegpt`` output, without metadata."""
    return entries.select(
        "entry_index", F.to_json(F.struct("conversations")).alias("value")
    )


def export_rows(entries: DataFrame, *, fmt: str = "chatml", clean: bool = True,
                selected: DataFrame | None = None, filtered: DataFrame | None = None) -> DataFrame:
    """``(entry_index, value)`` JSON lines of the export scope: the selected ids
    if given, else the filtered ids if given, else everything."""
    from ..operators.entries import entry_id
    from ..operators.formats import chatml_to_sharegpt

    scope = selected if selected is not None else filtered
    rows = entries
    if scope is not None:
        rows = rows.withColumn("_id", entry_id()).join(
            scope.select(F.col("entry_id").alias("_id")), "_id", "left_semi"
        )
    if fmt == "sharegpt":
        return sharegpt_json(chatml_to_sharegpt(rows))
    if fmt != "chatml":
        raise ValueError(f"unknown export format: {fmt}")
    return rows.select("entry_index", entry_json(clean=clean).alias("value"))


def sidecar_path(dataset_path: Column) -> Column:
    """Path of the registry file next to a dataset file."""
    return F.concat(F.regexp_replace(dataset_path, r"\.[^./]+$", ""), F.lit(".registry.json"))
