"""Secrets in texts: fixed patterns, and character Markov models for the rest.

Native: DataFrame expressions, joins and windows only.

Patterns find assigned values, access keys and hexadecimal runs. Any other run
of at least ``RUN`` key characters is a candidate, cut at the patterns' spans.
Its pieces of ``RUN`` or more characters are judged by their best-scoring stretch
under the log-likelihood ratio of two first-order Markov chains over characters: one of random strings,
one of ordinary identifiers. Both are trained on labelled samples: the values
the patterns found, and all runs of the corpus that neither mix letters with
digits nor cases inside a part. Runs that do are judged, not learned from. The
table of ratios has one cell per pair of characters of a fixed alphabet.

Positions are code points. Spark's functions return matches without places, so
a text is also split at the same pattern; running sums of the lengths of gaps
and matches are the places. Only rows that hold a match leave the scan.

Defined cases: a null text is empty and has no spans; spans of one kind never
overlap; a piece is reported whole when a stretch of it is; without samples of
a class its chain is uniform; long texts and runs take time in proportion; repeated rows are scanned each; an empty table
gives an empty result; columns named like the results are replaced.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters in all
HEX = r"[0-9a-f]{16,}"
RUN = 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % RUN
KINDS = ("assign", "access", "hex", "model")
ASSIGN_CHARS = 12
MIXED = "[A-Za-z][0-9]|[0-9][A-Za-z]|[a-z][A-Z]|[A-Z][A-Z][a-z]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
WIDTH = len(ALPHABET) + 1
SMOOTHING = 0.5
PRIOR = 20.0  # weight of all characters' shares in each context
MIN_RATIO = 12.0  # nats for the whole run
MIN_RATE = 0.5  # nats for each character


def _hits(text: Column, kind: int, pattern: str, value_group: int) -> Column:
    """Matches of a pattern with the length of the gap before each."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(
        gaps.alias("before"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("value"),
    )
    named = F.transform(
        F.filter(rows, lambda r: r["hit"].isNotNull()),
        lambda r, i: F.struct(F.lit(kind).alias("rank"), i.alias("pos"), r["before"].alias("before"), r["hit"].alias("hit"), r["value"].alias("value")),
    )
    none = F.array().cast("array<struct<rank:int,pos:int,before:int,hit:string,value:string>>")
    return F.when(text.rlike(pattern), named).otherwise(none)


def locate(docs: DataFrame, text_col: str = "text", keep=("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): ``_row``, whether it holds ``_any`` match and the columns ``kept`` as a struct, and all matches with their places."""
    text = text_of(text_col)
    found = F.flatten(F.array(
        _hits(F.col("_t"), 0, ASSIGN, 2), _hits(F.col("_t"), 1, ACCESS, 0),
        _hits(F.col("_t"), 2, HEX, 0), _hits(F.col("_t"), 3, CANDIDATE, 0),
    ))
    rows = cut_lineage(
        docs.select(
            F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), text.alias("_t")
        ).select("_row", "kept", found.alias("_found"))
    )
    upto = Window.partitionBy("_row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.where(F.size("_found") > 0).select("_row", F.inline("_found"))
    size = F.length("hit")
    end = F.sum(F.col("before") + size).over(upto)
    spans = spans.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - size)
    spans = spans.where((F.col("rank") != 0) | (F.length("value") >= ASSIGN_CHARS))
    spans = spans.select("_row", "rank", "start", "end", "value")
    # a candidate goes from the furthest end of the base spans so far to the next one that starts:
    # base spans cut it into pieces, each opened by the candidate itself or by a base span inside it
    base, order = F.col("rank") < 3, ["at", "close", "rank"]
    ends = F.array(
        F.struct(F.col("start").alias("at"), F.lit(0).alias("close")), F.struct(F.col("end").alias("at"), F.lit(1).alias("close"))
    )
    marks = spans.select("*", F.inline(ends))
    line = Window.partitionBy("_row").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("close") == 0, 1).otherwise(-1)
    within = F.last(F.when(F.col("rank") == 3, F.struct("start", "end", "value", "close")), ignorenulls=True).over(line)
    marks = marks.withColumn("_deep", F.sum(F.when(base, step).otherwise(0)).over(line)).withColumn("_in", within)
    marks = marks.withColumn("_to", F.lead("at").over(Window.partitionBy("_row").orderBy(*order)))
    open_ = (F.col("_deep") == 0) & (F.col("_in.close") == 0)
    pieces = marks.where(open_ & (F.col("_to") - F.col("at") >= RUN)).select(
        "_row", F.lit(3).alias("rank"), F.col("at").alias("start"), F.col("_to").alias("end"),
        F.substring(F.col("_in.value"), (F.col("at") - F.col("_in.start") + 1).cast("int"), (F.col("_to") - F.col("at")).cast("int")).alias("value"),
    )
    return rows.withColumn("_any", F.size("_found") > 0).drop("_found"), cut_lineage(spans.where(base).unionByName(pieces))


def _pairs(value: Column) -> Column:
    """Cells of a string's character pairs, the first one with the start mark."""
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    before = F.concat(F.array(F.lit(0)), codes)
    return F.zip_with(F.slice(before, 1, F.size(codes)), codes, lambda a, b: a * WIDTH + b)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios by cell from ``(value string, random boolean)``.

    The result has ``WIDTH`` squared numbers, whatever the size of the samples.
    """
    cells = samples.select("random", F.explode(_pairs(F.col("value"))).alias("cell")).groupBy("random", "cell").count().collect()
    counts = {k: [[0.0] * WIDTH for _ in range(WIDTH)] for k in (True, False)}
    for r in cells:  # at most 2 * WIDTH ** 2 rows
        counts[r["random"]][r["cell"] // WIDTH][r["cell"] % WIDTH] = float(r["count"])

    def chain(lines: list[list[float]]) -> list[list[float]]:
        """Log-probabilities of the next character; rare contexts lean on all characters' shares."""
        share = [sum(line[c] for line in lines) + SMOOTHING for c in range(WIDTH)]
        total = sum(share)
        return [[math.log((n + PRIOR * u / total) / (sum(line) + PRIOR)) for n, u in zip(line, share)] for line in lines]

    random, ordinary = chain(counts[True]), chain(counts[False])
    return [p - q for a, b in zip(random, ordinary) for p, q in zip(a, b)]


def stands_out(spans: DataFrame, model: list[float]) -> DataFrame:
    """The rows of which a stretch of at least ``RUN`` characters of ``value`` reaches ``MIN_RATIO`` and ``MIN_RATE`` a character.

    The table joins the narrow rows as a single one, and a row's ratios are made once.
    A stretch has the rate when its ratios less the rate sum to 0 or more. The best one
    that ends at a character starts at the least sum of ratios less the rate so far,
    ``RUN`` characters back or more: two running sums, one of them ``RUN`` behind, and
    that least sum are carried along, one step a character. From ``MIN_RATIO /
    MIN_RATE`` characters on the rate implies the ratio, so those stretches are also
    followed alone, and the whole string is judged too.
    """
    table = spans.sparkSession.range(1).select(F.from_json(F.lit(json.dumps(model)), "array<double>").alias("_table"))
    rows = spans.crossJoin(F.broadcast(table))  # WIDTH squared numbers
    gains = F.transform(_pairs(F.col("value")), lambda c: F.get("_table", c))
    rows = rows.select(*spans.columns, F.inline(F.array(F.struct(gains.alias("_gains")))))
    size, get = F.size("_gains"), lambda i: F.get("_gains", i)
    start = F.struct(
        F.lit(0.0).alias("sum"), F.lit(0.0).alias("late"), F.lit(math.inf).alias("least"), F.lit(0.0).alias("at"), F.lit(False).alias("found")
    )

    def step(n, acc, i):
        """Character ``i``, from 0; stretches that end with it start at ``i + 1 - n`` or before."""
        total = acc["sum"] + get(i)
        late = acc["late"] + F.when(i >= n, get(i - n)).otherwise(0.0)
        low = late - MIN_RATE * (i + 1 - n)
        open_ = i + 1 >= n
        lower = open_ & (low < acc["least"])
        least, at = F.when(lower, low).otherwise(acc["least"]), F.when(lower, late).otherwise(acc["at"])
        hit = open_ & (total - MIN_RATE * (i + 1) - least >= 0) & (total - at >= MIN_RATIO)
        return F.struct(total.alias("sum"), late.alias("late"), least.alias("least"), at.alias("at"), (acc["found"] | hit).alias("found"))

    def best(n):
        return F.aggregate(F.sequence(F.lit(0), size - 1), start, lambda acc, i: step(n, acc, i))["found"]

    whole = F.aggregate("_gains", F.lit(0.0), lambda a, x: a + x) >= F.greatest(F.lit(MIN_RATIO), MIN_RATE * size)
    return rows.where((size > 0) & (whole | best(RUN) | best(math.ceil(MIN_RATIO / MIN_RATE)))).select(*spans.columns)


def find_spans(docs: DataFrame, text_col: str = "text", keep=("doc_id",), model: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans) with spans ``_row, kind, rank, start, end``.

    Without a model it is trained on the documents: values found by the patterns
    are the random strings, runs that mix nothing the ordinary ones.
    """
    rows, spans = locate(docs, text_col, keep)
    if model is None:
        random = F.col("rank") < 3
        model = train(spans.where(random | ~F.col("value").rlike(MIXED)).select("value", random.alias("random")))
    spans = spans.where("rank < 3").unionByName(stands_out(spans.where("rank = 3"), model))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)
    return rows, spans.select("_row", kind.alias("kind"), "rank", "start", "end")


def scan(docs: DataFrame, text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    rows, spans = find_spans(docs, text_col, ("doc_id",), model)
    mark = F.struct("start", "rank", F.concat_ws(":", "kind", "start", "end").alias("s"))
    by_row = spans.groupBy("_row").agg(
        *[F.count_if(F.col("rank") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sort_array(F.collect_list(mark)).alias("_all"),
    )
    join = lambda xs: F.array_join(F.transform(xs, lambda x: x["s"]), ",")
    out = rows.join(by_row, "_row", "left")
    return out.select(
        "kept.doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.coalesce(join(F.filter("_all", lambda x: x["rank"] < 3)), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(join(F.col("_all")), F.lit("")).alias("spans"),
        F.coalesce("n_model", F.lit(0)).cast("long").alias("n_model"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """The documents, all kept, with every span of their texts replaced by ``mark``; a null text stays null."""
    rows, spans = find_spans(docs, text_col, docs.columns, model)
    # overlapping spans become one; then the text between them is kept
    line = Window.partitionBy("_row").orderBy("start", "rank")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    heads = spans.withColumn("_reach", reach).withColumn("_new", F.coalesce(F.col("start") > F.col("_reach"), F.lit(True)))
    heads = heads.withColumn("_n", F.sum(F.col("_new").cast("int")).over(line))
    merged = heads.groupBy("_row", "_n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    by_row = merged.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    text = F.col(f"kept.`{text_col}`")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("_spans", lambda s: s["end"]))
    starts = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    new = F.when(F.col("_spans").isNotNull(), F.array_join(kept, mark)).otherwise(text)
    # texts without a match are not moved
    out = rows.where("_any").join(by_row, "_row", "left").withColumn("_new", new)
    out = out.select("kept", "_new").unionByName(rows.where("not _any").select("kept", text.alias("_new")))
    return out.select(*[F.col("_new").alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in docs.columns])
