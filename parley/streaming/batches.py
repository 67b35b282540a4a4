"""Every operator on a stream: each micro-batch is a finished table.

Steps that group and join back (alias rewriting, character names, format vote of a
file) cannot run on an unbounded frame. The file source hands a file to one
micro-batch as a whole, so that inside ``foreachBatch`` they run as they are, on
complete files. Lines are numbered by file as in a batch read, so that equal lines
are different entries.

The sink is idempotent: a micro-batch owns the folder of its number, and a batch
that Spark sends again after a failure replaces it. Positions are
``batch number * 2**40 + position inside the batch``: unique over the stream, in
the order of arrival, and the same when a batch is sent again.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources import files

PER_BATCH = 1 << 40
RESULTS, ERRORS = "results", "errors"


def stream_lines(spark: SparkSession, path: str, *, files_per_batch: int | None = None) -> DataFrame:
    """Text lines of new files with their file and split."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def batch_records(lines: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """``(records, errors)`` of one micro-batch: ``source, line, entry_index, record`` and ``source, line, error``."""
    raw = lines.withColumn("mid", F.monotonically_increasing_id())
    parsed = cut_lineage(files.parse_lines(files.number_lines(raw)))  # parsed once for rows and errors
    records = files.index_records(parsed).withColumn("entry_index", F.col("entry_index") + F.lit(number * PER_BATCH))
    return records, parsed.where(F.col("error").isNotNull()).select("source", "line", "error")


def run_stream(
    spark: SparkSession, path: str, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], *,
    files_per_batch: int | None = None, trigger: dict | None = None,
):
    """Feed new files of JSON lines through ``step(records)`` and return the query.

    ``step`` is any chain of batch operators from records to rows. Its rows go to
    ``out/results/batch=N``, unreadable lines to ``out/errors/batch=N``. By default
    all files that are there are read and the query ends; then it is awaited.
    """

    def one(lines: DataFrame, number: int) -> None:
        records, errors = batch_records(lines, number)
        step(records).write.mode("overwrite").parquet(f"{out}/{RESULTS}/batch={number}")
        errors.write.mode("overwrite").parquet(f"{out}/{ERRORS}/batch={number}")

    lines = stream_lines(spark, path, files_per_batch=files_per_batch)
    writer = lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    query = writer.trigger(**(trigger or {"availableNow": True})).start()
    if trigger is None:
        query.awaitTermination()
    return query


def results(spark: SparkSession, out: str, part: str = RESULTS) -> DataFrame:
    """Rows of all batches so far, with their ``batch``."""
    return spark.read.parquet(f"{out}/{part}")
