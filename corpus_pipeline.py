"""From raw documents to packed sequences: five stages, each a DataFrame to the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm import mixing, packing, quality_model, secret_scan, trie_join
from parley.llm.common import text_of
from parley.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# a classifier, a similarity join and a tokenizer: tested piece by piece instead
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_model.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest id."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), text_of())
    rows = docs.select(*COLUMNS).withColumn("_key", key)
    classes = trie_join.similar_documents(rows.select(F.struct("doc_id", "_key").alias("doc_id"), "text"))
    kept = classes.where("doc_id = component_id").select(F.col("doc_id._key").alias("_key")).distinct()
    # rows that agree in id and text are one document
    first = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return rows.join(kept, "_key").withColumn("_first", first).where("_first = 1").select(*COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced."""
    out = secret_scan.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: whole epochs as repeated rows."""
    mixed = mixing.mix_documents(docs.select(*COLUMNS), keep=COLUMNS).where("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).drop("_copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in the sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", hide_secrets),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
