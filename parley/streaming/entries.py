"""The per-entry operators on a stream of JSON lines.

Parsing, normalization, diagnostics and filters look at one record at a time,
so the batch code runs unchanged; only dataset-wide steps (majority vote,
dense positions, reports) need the finished data.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entries as en
from ..operators import normalize as no
from ..operators import validate as va


def stream_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries from new files of JSON lines; broken lines are left to the batch
    reader's error report. ``entry_index`` is a hash: a stream has no position."""
    lines = spark.readStream.format("text").load(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("record")
    )
    good = lines.where(F.try_parse_json("record").isNotNull())
    return en.parse_entries(
        good.select(F.xxhash64("source", "record").alias("entry_index"), "source", "record")
    )


def clean_stream(spark: SparkSession, path: str) -> DataFrame:
    """Normalized entries with their diagnostics."""
    rows = no.normalize_entries(no.normalize_baseline(stream_entries(spark, path)).select(*en.ENTRY_COLUMNS))
    return va.analyze_chatml(rows.select(*en.ENTRY_COLUMNS))


def write_clean(stream: DataFrame, out: str, checkpoint: str):
    """Run what is available now into Parquet and return the finished query."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
