"""Token counts kept by signed deltas: totals by source, language and tokenizer version.

A batch is a frame of events on documents' counts: ``insert`` adds one, ``delete``
takes it back, ``revise`` replaces the old count by a new one. Events become
signed sums a key before anything is written, so a hot source is a few rows a
task. A commit writes a batch once, under its name; a name that is already there
is left alone, so that a batch may be sent again after a failure. Totals are sums
over committed batches, in any order; compaction folds them into one and keeps
their names, so that a batch that is sent again later still counts once. A name has
one writer at a time; the folder's marker does not keep two apart.

Defined cases: null sources, languages and versions are keys of their own; a null
count is 0; an unknown or null action raises no error and counts nothing; keys
whose documents are all gone stay, with zeros; no batch gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
MEASURES = ("docs", "tokens")
BASE, NAMES = "compacted", "compacted-names"  # folders that no batch is named after
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def deltas(events: DataFrame) -> DataFrame:
    """Signed sums by key of events ``action, source, lang, tokenizer, tokens, old_tokens``."""
    new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    action = F.col("action")
    docs = F.when(action == "insert", 1).when(action == "delete", -1).otherwise(0)
    tokens = F.when(action == "insert", new).when(action == "delete", -new).when(action == "revise", new - old).otherwise(0)
    keys = [F.col(k).cast("string").alias(k) for k in KEYS]
    return events.groupBy(*keys).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class Rollup:
    """Committed batches in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def batches(self) -> list[str]:
        """Folders of committed batches; a folder without its marker is not one."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        found = [s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() != NAMES]
        return sorted(x for x in found if self._done(x))

    def _done(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def commit(self, name: str, events: DataFrame) -> bool:
        """Write a batch unless it is there; whether it was written."""
        path = f"{self.path}/{name}"
        if self._done(path) or self.folded().where(F.col("name") == name).limit(1).count():
            return False
        deltas(events).write.mode("overwrite").parquet(path)
        return True

    def totals(self) -> DataFrame:
        paths = self.batches()
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])

    def folded(self) -> DataFrame:
        """Names of the batches that compactions have folded."""
        if self._done(f"{self.path}/{NAMES}"):
            return self.spark.read.schema("name string").parquet(f"{self.path}/{NAMES}")
        return self.spark.createDataFrame([], "name string")

    def compact(self, path: str) -> "Rollup":
        """The totals as a new rollup that still knows the names of all batches in it.

        The names are written before the totals: a rollup that a failure left without
        totals is empty, but takes no batch twice.
        """
        path = path.rstrip("/")
        own = [p.rsplit("/", 1)[1] for p in self.batches()]
        names = self.folded().union(self.spark.createDataFrame([(n,) for n in own], "name string")).distinct()
        names.write.mode("overwrite").parquet(f"{path}/{NAMES}")
        self.totals().write.mode("overwrite").parquet(f"{path}/{BASE}")
        return Rollup(self.spark, path)
