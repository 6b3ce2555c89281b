"""Candidate-pair queries: words of a document's first line are terms, its language a tag, its source a collection;
orders that share a part share a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import candidates as op
from ..operators import neighbors
from . import sql
from .neighbors import KNN, vectors
from .registry import register, table

_TITLE = r"trim(regexp_replace(substr(split_part(text, chr(10), 1), 1, 1000), '\s+', ' ', 'g'))"
SIGNALS = f"""signals AS (SELECT 'term' AS kind, unnest({sql.words(_TITLE)}) AS signal, doc_id AS source_id, source AS grp FROM documents
  UNION ALL SELECT 'tag', lang, doc_id, source FROM documents),
freq AS (SELECT kind, signal, count(*) AS df FROM signals GROUP BY ALL)"""
CAPPED = f"""{SIGNALS},
turns AS (SELECT *, row_number() OVER (PARTITION BY kind, signal, grp ORDER BY source_id) AS turn FROM signals),
posts AS (SELECT kind, signal, source_id, row_number() OVER (PARTITION BY kind, signal ORDER BY turn, grp) AS position FROM turns QUALIFY position <= 64)"""
SHARED = f"""{CAPPED},
shared AS (SELECT a.source_id AS left_id, b.source_id AS right_id, kind, signal FROM posts a JOIN posts b USING (kind, signal) WHERE a.source_id < b.source_id)"""
SCORED = f"""{SHARED},
size AS (SELECT count(*) AS n FROM documents),
direct AS (SELECT doc_id AS left_id, doc_id + 1 AS right_id FROM documents WHERE doc_id % 10 = 0),
sums AS (SELECT left_id, right_id, sum(CASE kind WHEN 'term' THEN 1.0 WHEN 'tag' THEN 2.0 ELSE 4.0 END::DOUBLE * (1 + ln((1 + n) / CAST(1 + df AS DOUBLE)))) AS s FROM shared JOIN freq USING (kind, signal), size GROUP BY ALL),
scored AS (SELECT left_id, right_id, round(coalesce(s, 0) + 8 * coalesce(d, 0), 6) AS score FROM sums FULL JOIN (SELECT left_id, right_id, count(*) AS d FROM direct GROUP BY ALL) USING (left_id, right_id))"""


def signals(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    term = docs.select(F.lit("term").alias("kind"), F.explode(tx.words(tx.title(F.col("text")))).alias("signal"), F.col("doc_id").alias("source_id"), F.col("source").alias("group"))
    return term.unionByName(docs.select(F.lit("tag").alias("kind"), F.col("lang").alias("signal"), F.col("doc_id").alias("source_id"), F.col("source").alias("group")))


def scored(spark, sf_dir) -> DataFrame:
    found = signals(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    direct = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id"))
    return op.pair_scores(op.shared_signals(op.capped_postings(found)), op.frequencies(found), docs.count(), direct)


@register(f"WITH {SIGNALS} SELECT source_id, kind, signal, df, row_number() OVER (PARTITION BY source_id ORDER BY df, kind, signal) AS rank FROM signals JOIN freq USING (kind, signal) QUALIFY rank <= 8")
def rare_signals(spark, sf_dir):
    return op.rare_signals(signals(spark, sf_dir), 8).select("source_id", "kind", "signal", "df", "rank")


@register(f"WITH {CAPPED} SELECT kind, signal, source_id, position FROM posts")
def capped_postings(spark, sf_dir):
    return op.capped_postings(signals(spark, sf_dir))


@register(f"WITH {SHARED} SELECT left_id, right_id, count(*) FILTER (kind = 'term') AS terms, count(*) FILTER (kind = 'tag') AS tags FROM shared GROUP BY ALL")
def shared_signal_pairs(spark, sf_dir):
    return op.shared_signals(op.capped_postings(signals(spark, sf_dir))).groupBy("left_id", "right_id").agg(F.count(F.when(F.col("kind") == "term", 1)).alias("terms"), F.count(F.when(F.col("kind") == "tag", 1)).alias("tags"))


@register(f"WITH {SCORED} SELECT left_id, right_id, score FROM scored")
def pair_score(spark, sf_dir):
    return scored(spark, sf_dir)


@register(f"""WITH {KNN}, {SCORED},
ways AS (SELECT left_id AS source_id, right_id AS target_id, score FROM scored UNION ALL SELECT right_id, left_id, score FROM scored),
local AS (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS rank FROM ways QUALIFY rank <= 8),
lanes AS (SELECT source_id, target_id, 2 * rank AS spot FROM knn UNION ALL SELECT source_id, target_id, 2 * rank + 1 FROM local),
firsts AS (SELECT source_id, target_id, min(spot) AS spot FROM lanes GROUP BY ALL)
SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY spot) AS position FROM firsts QUALIFY position <= 12""")
def alternating_fusion_scoped(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    both = pairs.select(F.col("left_id").alias("source_id"), F.col("right_id").alias("target_id"), "score").unionByName(pairs.select(F.col("right_id").alias("source_id"), F.col("left_id").alias("target_id"), "score"))
    local = neighbors.best_of(both.withColumn("lane", F.lit("local")), 8)
    return op.alternating(neighbors.knn(vectors(spark, sf_dir)), local, 12)


@register(f"WITH {SCORED} SELECT left_id, right_id, score FROM scored WHERE NOT ((left_id + right_id) % 3 = 0 AND left_id % 2 = 0)")
def resolved_anti_join(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    return op.unresolved(pairs, pairs.where("(left_id + right_id) % 3 = 0 and left_id % 2 = 0"))


@register(f"""WITH {SCORED} SELECT CASE WHEN a.source = b.source THEN 'within_collection' ELSE 'whole_library' END AS comparison_scope, count(*) AS n, round(max(score), 6) AS best
FROM scored JOIN documents a ON a.doc_id = left_id JOIN documents b ON b.doc_id = right_id GROUP BY ALL""")
def scope_flags(spark, sf_dir):
    return _scoped(spark, sf_dir).groupBy(F.col("scope").alias("comparison_scope")).agg(F.count("*").alias("n"), F.max("score").alias("best"))


def _scoped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    ends = scored(spark, sf_dir).join(docs.toDF("left_id", "a"), "left_id").join(docs.toDF("right_id", "b"), "right_id")
    return ends.select("left_id", "right_id", "score", (F.col("a") == F.col("b")).alias("same_group"), F.when(F.col("a") == F.col("b"), "within_collection").otherwise("whole_library").alias("scope"))


@register()
def greedy_degree_cap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", "source").join(docs.groupBy("source").agg(F.count("*").alias("size")), "source").select(F.col("doc_id").alias("source_id"), "size")
    return op.greedy_degree_cap(_scoped(spark, sf_dir), sizes)


@register()
def scope_balanced_select(spark, sf_dir):
    return op.scope_balanced_select(_scoped(spark, sf_dir))


@register()
def degree_capped_view(spark, sf_dir):
    return op.degree_capped(neighbors.fold_edges(neighbors.knn(vectors(spark, sf_dir))), 4)
