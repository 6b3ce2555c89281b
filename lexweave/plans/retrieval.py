"""Retrieval queries: benchmark texts ask documents, vectors stand for the documents and questions of the same number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieval as op
from . import sql
from .registry import register, table


def _inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), F.col("embedding").alias("vector"))
    return docs, asked, vectors, vectors.join(asked.select(F.col("query_id").alias("source_id")), "source_id", "left_semi").select(F.col("source_id").alias("query_id"), "vector")


@register(f"WITH {sql.POSTS} SELECT word, count(*) AS df FROM posts GROUP BY word")
def doc_frequency(spark, sf_dir):
    return op.document_frequency(op.postings(table(spark, sf_dir, "documents"), "doc_id", "text"))


@register(f"WITH {sql.SCORES} SELECT query_id, source_id, round(score, 6) AS score, rank FROM lexical")
def lexical_rank(spark, sf_dir):
    docs, asked, _, _ = _inputs(spark, sf_dir)
    return op.lexical_ranked(docs, asked, 32, "doc_id", "text").select("query_id", "source_id", F.round("score", 6).alias("score"), "rank")


@register(f"WITH {sql.DENSE} SELECT query_id, source_id, round(score, 6) AS score, rank FROM dense")
def dense_rank(spark, sf_dir):
    docs, _, vectors, asked = _inputs(spark, sf_dir)
    known = vectors.join(docs.select(F.col("doc_id").alias("source_id")), "source_id", "left_semi")
    return op.dense_ranked(known, asked, 32).select("query_id", "source_id", F.round("score", 6).alias("score"), "rank")


def _fused(spark, sf_dir):
    docs, asked, vectors, by = _inputs(spark, sf_dir)
    lexical = op.lexical_ranked(docs, asked, 32, "doc_id", "text")
    known = vectors.join(docs.select(F.col("doc_id").alias("source_id")), "source_id", "left_semi")
    return op.reciprocal_rank({"lexical": lexical, "dense": op.dense_ranked(known, by, 32)})


@register(f"WITH {sql.SCORES}, {sql.DENSE}, {sql.FUSED} SELECT query_id, source_id, round(score, 9) AS score, lexical_rank, dense_rank FROM fused")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "source_id", F.round("score", 9).alias("score"), "lexical_rank", "dense_rank")


@register(f"WITH {sql.SCORES}, {sql.DENSE}, {sql.FUSED} SELECT query_id, {sql.ROUTE} AS route, count(*) AS n FROM fused GROUP BY ALL")
def route_label(spark, sf_dir):
    return _fused(spark, sf_dir).groupBy("query_id", op.route(F.col("lexical_rank"), F.col("dense_rank")).alias("route")).agg(F.count("*").alias("n"))


_OFFSET = f"greatest(coalesce(list_min(list_filter(list_transform({sql.words('q.text')}, lambda w: instr({sql.fold('d.text')}, w)), lambda p: p > 0)), 1) - 1 - 160, 0)"


@register(f"""WITH {sql.SCORES}, {sql.DENSE}, {sql.FUSED},
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, source_id) AS rank FROM fused QUALIFY rank <= 8)
SELECT query_id, source_id, rank, round(score, 9) AS score, {sql.ROUTE} AS route, CAST({_OFFSET} AS INTEGER) AS "offset"
FROM best JOIN documents d ON d.doc_id = source_id JOIN benchmark q ON q.item_id = query_id""")
def hybrid_recall(spark, sf_dir):
    docs, asked, vectors, by = _inputs(spark, sf_dir)
    return op.hybrid_recall(docs, asked, vectors, by)


@register(f"""SELECT doc_id AS source_id, CAST({_OFFSET} AS INTEGER) AS "offset" FROM documents d JOIN benchmark q ON q.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")
def excerpt_offset(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select("item_id", tx.words(F.col("text")).alias("asked"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("item_id", F.col("doc_id") % asked.count())
    return docs.join(asked, "item_id").select(F.col("doc_id").alias("source_id"), op.excerpt_offset(F.col("text"), F.col("asked")).alias("offset"))


@register("""WITH r AS (SELECT source, CASE WHEN n_chars < 200 THEN 'Metadata-Only' WHEN n_chars < 1000 THEN 'abstract' ELSE 'full_document' END AS scope FROM documents)
SELECT source, count(*) FILTER (replace(lower(scope), '-', '_') NOT IN ('metadata', 'metadata_only', 'bibliographic_metadata')) AS n_kept,
count(*) FILTER (replace(lower(scope), '-', '_') IN ('metadata', 'metadata_only', 'bibliographic_metadata')) AS n_excluded FROM r GROUP BY source""")
def metadata_exclusion(spark, sf_dir):
    scope = F.when(F.col("n_chars") < 200, "Metadata-Only").when(F.col("n_chars") < 1000, "abstract").otherwise("full_document")
    out = F.replace(F.lower(scope), F.lit("-"), F.lit("_")).isin("metadata", "metadata_only", "bibliographic_metadata")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.when(~out, 1)).alias("n_kept"), F.count(F.when(out, 1)).alias("n_excluded"))


@register("SELECT doc_id AS source_id, sha256(text) AS content_sha256, doc_id % 7 <> 3 AS accepted FROM documents")
def content_hash_check(spark, sf_dir):
    own = F.sha2("text", 256)
    declared = F.when(F.col("doc_id") % 7 == 3, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(own)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), own.alias("content_sha256"), (own == declared).alias("accepted"))
