"""JSON arrays and objects of any size, read in splits.

A JSON text has no line ends to cut at, but every record of an array is an object
and ends with a closing brace. So a file is scanned as text that ends at braces;
Spark splits it like any text. What a brace closes depends on all that came before:
whether a string is open, and how deep the brackets are. That state is a value that
composes. The first scan sums every split up for both answers to "does it begin
inside a string"; running sums over the splits of a file, one short row each, give
the state in which each begins. The second scan cuts the records where the depth
falls back to the array's. Pieces at the edges of splits are joined by order.

A file that turns out not to be one array of objects or one object is told apart by
its pieces: valid JSON with other items is refused, anything else is read as lines.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.constants import TRAINING_OBJECT_KEYS
from ..session import cut_lineage

QUOTE, SLASH, CLOSE = ord('"'), ord("\\"), ord("}")
WEIGHT = np.zeros(256, np.int64)
WEIGHT[[ord("{"), ord("[")]] = 1
WEIGHT[[ord("}"), ord("]")]] = -1
SPACES = b" \t\n\r\v\f\x1c\x1d\x1e\x1f"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``source, block, size, value``: the text between closing braces, in order inside a split."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"),
    )


def _stretches(batches: Iterator[pa.RecordBatch]):
    """(source, block, size, bytes with a brace after each piece, ends of the pieces) of consecutive rows of one split."""
    for batch in batches:
        source, block = batch.column("source"), batch.column("block").to_numpy()
        names = source.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(names, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
            value = batch.column("value").slice(a, b - a)
            joined = pc.binary_join_element_wise(value, pa.scalar(b"}", value.type), pa.scalar(b"", value.type))
            ends = np.cumsum(pc.binary_length(joined).to_numpy().astype(np.int64))
            data = np.frombuffer(b"".join(joined.to_pylist()), np.uint8)
            yield source[a].as_py(), int(block[a]), int(batch.column("size")[a].as_py()), data, ends


def _quotes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every byte, the number of string marks up to and with it; escaped ones do not count."""
    mark = data == QUOTE
    at = np.flatnonzero(mark)
    if len(at) and (data == SLASH).any():
        plain = np.maximum.accumulate(np.where(data != SLASH, np.arange(len(data)), -1))
        before = np.where(at > 0, plain[at - 1], -1)
        mark[at[(at - 1 - before) % 2 == 1]] = False  # a brace between pieces ends any escape
    return np.cumsum(mark)


SUMMARY = "source string, block long, size long, bytes long, turn int, out long, inside long, opens string"


def _summarize(batches):
    """Sums of a split: whether it turns strings on or off, how far its depth moves from either start, a file's first letter."""
    names = ("source", "block", "size", "bytes", "turn", "out", "inside", "opens")
    types = (pa.string(), *[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 2, pa.string())
    kinds = pa.schema(list(zip(names, types)))
    row = lambda key, state: pa.RecordBatch.from_pylist([dict(zip(names, (*key, *state)))], schema=kinds)
    key, state = None, None
    for source, block, size, data, ends in _stretches(batches):
        if key != (source, block, size):
            if key:
                yield row(key, state)
            key, state = (source, block, size), [0, 0, 0, 0, None]
        quotes = _quotes(data, ends)
        weight, within = WEIGHT[data], quotes % 2 == 1
        moves = [int(weight[~within].sum()), int(weight[within].sum())]
        if state[1]:
            moves.reverse()
        opens = state[4] or (data.tobytes().lstrip(SPACES)[:1].decode("latin-1") or None if block == 0 else None)
        state = [state[0] + len(data), int(state[1] + quotes[-1]) % 2, state[2] + moves[0], state[3] + moves[1], opens]
    if key:
        yield row(key, state)


def split_states(summaries: DataFrame) -> DataFrame:
    """The state in which each split begins: ``inside`` a string or not, its ``depth``, and the ``opens`` of its file."""
    line = Window.partitionBy("source").orderBy("block")  # one row a split
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    turned = summaries.withColumn("inside_at", (F.coalesce(F.sum("turn").over(before), F.lit(0)) % 2).cast("int"))
    moved = F.when(F.col("inside_at") == 0, F.col("out")).otherwise(F.col("inside"))
    return turned.select(
        "source", "block", F.col("inside_at").alias("inside"), F.coalesce(F.sum(moved).over(before), F.lit(0)).alias("depth"),
        F.max("opens").over(Window.partitionBy("source")).alias("opens"),
    )


PIECES = "source string, block long, place long, part string, value string"


def _cut(batches, states: dict):
    """Pieces of a split: ``record`` for whole ones, ``head``, ``middle`` and ``tail`` at its edges."""
    key, held, floor, place, inside, depth = None, [], None, 0, 0, 0
    kinds = pa.schema([("source", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("part", pa.string()), ("value", pa.string())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    def rest():
        return [(*key[:2], place, "tail" if place or key[1] == 0 else "middle", b"".join(held).decode("utf-8", "replace"))]

    for source, block, size, data, ends in _stretches(batches):
        rows = []
        if key != (source, block, size):
            if key:
                yield batch(rest())
            key, held, place = (source, block, size), [], 0
            inside, depth, floor = states.get((source, block), (0, 0, None)) if block else (0, 0, None)
        if floor is None:  # the first letter of a file tells what its records are
            opens = data.tobytes().lstrip(SPACES)[:1] if block == 0 else b""
            floor = 1 if opens == b"[" else 0
        within = (_quotes(data, ends) + inside) % 2 == 1
        depths = depth + np.cumsum(np.where(within, 0, WEIGHT[data]))
        last = ends - 1
        cut = last[(depths[last] == floor) & ~within[last]] + 1
        begin = 0
        text = data.tobytes()
        for end in cut.tolist():
            value = b"".join([*held, text[begin:end]]).decode("utf-8", "replace")
            rows.append((source, block, place, "record" if place or block == 0 else "head", value))
            held, begin, place = [], end, place + 1
        held.append(text[begin:])
        inside, depth = int(within[-1]), int(depths[-1])
        if rows:
            yield batch(rows)
    if key:
        yield batch(rest())


def _sound(value):
    """Whether a text is one JSON value: the parser stops after a first one, so it is tried as the only item of a list."""
    boxed = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))
    return boxed.isNotNull() & F.try_variant_get(boxed, "$[1]", "variant").isNull()


def read_pieces(spark: SparkSession, path: str, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, files)``: texts cut at records, and what stands at the end of each file.

    records: ``source, opens, block, place, value``, in order by block and place;
    files: ``source, opens, open, value``, the text after the last record.
    """
    summaries = cut_lineage(scan(spark, path).mapInArrow(_summarize, SUMMARY).join(chosen, "source", "left_semi"))
    # a row for each 128 MB but the first of a large file
    later = split_states(summaries).where("block > 0")
    states = {(r["source"], r["block"]): (r["inside"], r["depth"], 1 if r["opens"] == "[" else 0) for r in later.toLocalIterator()}
    sent = spark.sparkContext.broadcast(states)
    facts = summaries.groupBy("source").agg(F.max("opens").alias("opens"), (F.sum("bytes") > F.max("size")).alias("open"))
    pieces = cut_lineage(scan(spark, path).mapInArrow(lambda b: _cut(b, sent.value), PIECES).join(facts, "source"))
    # a tail, the splits in which no record ends, and the head that closes the record
    line = Window.partitionBy("source").orderBy("block", "place")
    edges = pieces.where("part <> 'record'").withColumn("_tail", F.sum((F.col("part") == "tail").cast("int")).over(line))
    joined = edges.groupBy("source", "opens", "open", "_tail").agg(
        F.max_by(F.struct("block", "place", "part"), F.struct("block", "place")).alias("last"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "place", "value"))), lambda x: x["value"]), "").alias("value"),
    )
    heads = joined.where("last.part = 'head'").select("source", "opens", "last.block", "last.place", "value")
    records = pieces.where("part = 'record'").select("source", "opens", "block", "place", "value").unionByName(heads)
    return records, joined.where("last.part <> 'head'").select("source", "opens", "open", "value")


def read_documents(spark: SparkSession, path: str, chosen: DataFrame) -> DataFrame:
    """``(source, line, record, error, as_lines)`` of the files of ``chosen`` (``source``).

    ``line`` is the number of the record. A file that is neither an array nor an
    object has one row with ``as_lines``, to be read as lines by the caller.
    """
    records, ends = read_pieces(spark, path, chosen)
    text = tx.strip(F.col("value"))
    lead, array = F.left(text, F.lit(1)), F.col("opens") == "["
    counts = records.groupBy("source", "block").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("source", "block", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    records = records.join(base, ["source", "block"]).withColumn("line", F.col("_base") + F.col("place") + 1)
    first = F.col("line") == 1
    led = F.when(array, lead == F.when(first, "[").otherwise(",")).otherwise(first)
    body = F.when(array, tx.strip(F.substr(text, F.lit(2)))).otherwise(text)
    parsed = records.select("source", "opens", "line", led.alias("led"), body.alias("record"))
    items = F.try_parse_json(F.concat(F.lit("["), F.col("record"), F.lit("]")))
    is_object = F.try_variant_get(items, "$[0]", "map<string,variant>").isNotNull()
    parsed = cut_lineage(
        parsed.withColumn("valid", items.isNotNull() & F.col("led"))
        .withColumn("object", F.coalesce(_sound(F.col("record")) & is_object, F.lit(False)))
    )
    seen = parsed.groupBy("source").agg(F.bool_and("valid").alias("valid"), F.bool_and("object").alias("object"), F.count(F.lit(1)).alias("n"))
    # the text ends with a brace that is not in the file, unless the file ends with one
    end = tx.strip(F.when(F.col("open"), F.left("value", F.length("value") - 1)).otherwise(F.col("value")))
    left = ends.join(seen, "source", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("end", end)
    left = left.withColumn("items", F.when(F.col("n") == 0, F.col("end")).when(F.col("end").rlike(r"^(\]|,\s*[^\s\]])"), F.concat(F.lit("["), F.regexp_replace("end", "^,", ""))))
    cut_short = F.col("open") & (F.col("value") == "")
    good = F.when(array, F.coalesce(_sound(F.col("items")), F.lit(False))).otherwise((F.col("end") == "") & (F.col("n") == 1))
    others = F.coalesce(F.json_array_length("items") > 0, F.lit(False))
    verdict = (
        F.when(cut_short | ~good | ~F.coalesce("valid", F.lit(True)), "lines")
        .when(array & (others | ~F.coalesce("object", F.lit(True))), "mixed")
        .otherwise("fine")
    )
    files = cut_lineage(left.select("source", verdict.alias("verdict")))

    fine = parsed.join(files.where("verdict = 'fine'"), "source")
    keys = F.json_object_keys("record")
    training = F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in TRAINING_OBJECT_KEYS])), F.lit(False))
    ok = array | training
    none = lambda t: F.lit(None).cast(t)
    rows = fine.select(
        "source", F.when(ok, F.col("line")).alias("line"), F.when(ok, F.col("record")).alias("record"),
        F.when(~ok, "Object is not a training record").alias("error"), F.lit(False).alias("as_lines"),
    )
    odd = files.where("verdict <> 'fine'").select(
        "source", none("long").alias("line"), none("string").alias("record"),
        F.when(F.col("verdict") == "mixed", "Array holds items that are not objects").alias("error"), (F.col("verdict") == "lines").alias("as_lines"),
    )
    return rows.unionByName(odd)
