"""Queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

from . import fingerprint, lm, mixing, multi_index, packing, quality_model, rollup, runs, secret_scan, shards, spellings, trie_join, vptree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_lm_score")
def op1_lm_score(spark, sf_dir):
    """All documents scored by a model of those not held out."""
    return lm.score_by_id(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), r AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size,
    greatest(CASE WHEN length(t) > 0 THEN length(translate(t, '!#$%&*|<>{}[]\^~_=+/@0123456789', '')) / length(t) ELSE 1.0 END, 1e-6) AS weight,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#17'), 1, 13))::BIGINT AS draw
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM r GROUP BY source
), c AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM c WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t
), k AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY r.source ORDER BY -ln((draw + 0.5) / 4503599627370496.0) / weight, draw, doc_id, size
      ROWS UNBOUNDED PRECEDING) - size AS done
  FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  CAST(epochs + CASE WHEN size > 0 AND done + size / 2 <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies,
  CAST((epochs + CASE WHEN size > 0 AND done + size / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM k
"""


@query("op2_mixture", OP2_SQL)
def op2_mixture(spark, sf_dir):
    """All documents mixed to weights 1, 2, 3 by source."""
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    strlen(coalesce(text, '')) AS bytes,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.toxic = 1) AS toxic
  FROM documents
)
SELECT source, lang, 'words-1' AS tokenizer, count(*) FILTER (NOT toxic) AS docs,
  CAST(coalesce(sum(words + 1) FILTER (NOT toxic), 0) AS BIGINT) AS tokens
FROM d GROUP BY source, lang
UNION ALL
SELECT source, lang, 'bytes-1', count(*) FILTER (NOT toxic), CAST(coalesce(sum(bytes) FILTER (NOT toxic), 0) AS BIGINT)
FROM d GROUP BY source, lang
"""


@query("op4_token_counts", OP4_SQL)
def op4_token_counts(spark, sf_dir):
    """Counts of all documents after an insert, a takedown of toxic ones and a revision, each sent twice."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    text = F.coalesce("text", F.lit(""))
    counts = docs.select("doc_id", "source", "lang", mixing.word_count(text).alias("w"), F.octet_length(text).cast("long").alias("b"))
    counts = cut_lineage(counts)
    versions = lambda add: F.explode(F.array(
        F.struct(F.lit("words-1").alias("tokenizer"), (F.col("w") + add).alias("tokens")),
        F.struct(F.lit("bytes-1").alias("tokenizer"), F.col("b").alias("tokens")),
    ))
    event = lambda action, df, add=0: df.select(
        F.lit(action).alias("action"), "source", "lang", versions(add).alias("v")
    ).select("action", "source", "lang", "v.*", F.lit(None).cast("long").alias("old_tokens"))
    gone = counts.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    left = counts.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_anti")
    # the revised tokenizer also counts the end token
    revised = left.select(
        F.lit("revise").alias("action"), "source", "lang", F.lit("words-1").alias("tokenizer"),
        (F.col("w") + 1).alias("tokens"), F.col("w").alias("old_tokens"),
    )
    store = rollup.Rollup(spark, scratch_path(spark, "rollup"))
    for name, events in (("insert", event("insert", counts)), ("takedown", event("delete", gone)), ("revise", revised)):
        store.commit(name, events)
        store.commit(name, events)  # a repeated commit changes nothing
    return store.totals()


@query("op5_sharding")
def op5_sharding(spark, sf_dir):
    """All documents in 16 shards."""
    return shards.shard_documents(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), b AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r(d, z) AS (
  SELECT DISTINCT x, x FROM b UNION SELECT r.d, b.y FROM r JOIN b ON b.x = r.z
), m AS (
  SELECT d, min(z) AS low FROM r GROUP BY d
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.low, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.d = w.doc_id
"""


@query("op6_ngram_join", OP6_SQL)
def op6_ngram_join(spark, sf_dir):
    """Classes of all documents whose 4-word shingles agree by 85 in 100."""
    return trie_join.similar_documents(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


@query("op7_fingerprint")
def op7_fingerprint(spark, sf_dir):
    """Sketches of all documents and of their edited texts."""
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    """Secrets of all documents."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, c.r, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score, vec_id, r) AS rank FROM d
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= 10
"""


@query("op9_vantage_points", OP9_SQL)
def op9_vantage_points(spark, sf_dir):
    """The ten nearest vectors of every hundredth one, exactly."""
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op10_quality")
def op10_quality(spark, sf_dir):
    """Quality scores of all documents."""
    return quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    """Runs of repeated words of all documents."""
    return runs.digests(runs.collapse_runs(table(spark, sf_dir, "documents"), runs.plant_repeats))


@query("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    """Spelling variants among the words of all documents."""
    return spellings.group_variants(spellings.count_words(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), v AS (
  SELECT r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM t
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.r AS x, b.r AS y FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.95
), reach(x, z) AS (
  SELECT DISTINCT x, x FROM p UNION SELECT reach.x, p.y FROM reach JOIN p ON p.x = reach.z
), n AS (
  SELECT x, count(*) AS n_links FROM p GROUP BY x
), c AS (
  SELECT reach.x, min(t.vec_id) AS low FROM reach JOIN t ON t.r = reach.z GROUP BY reach.x
)
SELECT t.vec_id, coalesce(n.n_links, 0) AS n_links, CASE WHEN n.x IS NULL THEN t.vec_id ELSE c.low END AS component_id,
  t.vec_id IS NOT DISTINCT FROM CASE WHEN n.x IS NULL THEN t.vec_id ELSE c.low END AS kept
FROM t LEFT JOIN n ON n.x = t.r LEFT JOIN c ON c.x = t.r
"""


@query("op13_near_vectors", OP13_SQL)
def op13_near_vectors(spark, sf_dir):
    """Classes of all vectors whose cosine is 0.95 or more."""
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"))
