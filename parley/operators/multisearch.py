"""Many needles in many texts: an automaton over the needles, run once over each text."""

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

NEEDLES = 50_000  # needles of one automaton, built by every task


def _search(batches: Iterator[pa.RecordBatch], needles: list[str], keep: list[str], text: str):
    automaton = ahocorasick.Automaton()
    for i, needle in enumerate(needles):
        automaton.add_word(needle, i)
    automaton.make_automaton()
    for batch in batches:
        rows, hits = [], []
        for row, value in enumerate(batch.column(text).to_pylist()):
            if value:
                found = {i for _, i in automaton.iter(value)}
                rows += [row] * len(found)
                hits += sorted(found)
        at = pa.array(rows, pa.int64())
        columns = [batch.column(c).take(at) for c in keep]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([needles[i] for i in hits], pa.string())], [*keep, "needle"])


def find_needles(texts: DataFrame, needles: DataFrame, *, text: str = "text", part: int = NEEDLES) -> DataFrame:
    """Columns of ``texts`` without the text, and every ``needle`` that it contains.

    The work follows the length of the texts and the number of occurrences, not the
    number of needles. Needles are distinct and dealt by hash to parts of about
    ``part``; each part is an automaton of its own and reads the texts once.
    Null and empty texts and needles match nothing.
    """
    keep = [c for c in texts.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes if c != text) + ", needle string"
    distinct = cut_lineage(needles.select("needle").where(F.coalesce("needle", F.lit("")) != "").distinct())
    parts = max(1, -(-distinct.count() // part))
    dealt = F.pmod(F.xxhash64("needle"), F.lit(parts))
    out = None
    for p in range(parts):
        words = sorted(r["needle"] for r in distinct.where(dealt == p).collect())  # about ``part`` needles
        found = texts.mapInArrow(lambda b, w=words: _search(b, w, keep, text), schema) if words else texts.drop(text).limit(0).withColumn("needle", F.lit(""))
        out = found if out is None else out.unionByName(found)
    return out
