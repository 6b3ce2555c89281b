"""Neighbour queries over the embeddings; a vector's label stands for its collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbors as op
from .registry import register, table

KNN = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
sims AS (SELECT a.vec_id AS source_id, b.vec_id AS target_id, list_dot_product(a.e, b.e) / (a.n * b.n) AS score, a.label = b.label AS same
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) > 0),
knn AS (SELECT source_id, target_id, score, row_number() OVER (PARTITION BY source_id ORDER BY round(score, 9) DESC, target_id) AS rank FROM sims QUALIFY rank <= 8)"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), F.col("embedding").alias("vector"), F.array("label").alias("groups"))


@register(f"WITH {KNN} SELECT source_id, target_id, round(score, 6) AS score, rank FROM knn")
def knn_cosine(spark, sf_dir):
    return op.knn(vectors(spark, sf_dir)).select("source_id", "target_id", F.round("score", 6).alias("score"), "rank")


@register(f"""WITH {KNN},
lanes AS (SELECT source_id, target_id, score, same, row_number() OVER (PARTITION BY source_id, same ORDER BY round(score, 9) DESC, target_id) AS r FROM sims QUALIFY r <= 8),
placed AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN r <= 4 THEN 0 ELSE 1 END, CASE WHEN r <= 4 THEN r ELSE 0 END,
  CASE WHEN r <= 4 AND NOT same THEN 1 ELSE 0 END, round(score, 9) DESC, target_id) AS position FROM lanes QUALIFY position <= 8)
SELECT source_id, target_id, round(score, 6) AS score, CASE WHEN same THEN 'within_collection' ELSE 'whole_library' END AS scope, position FROM placed""")
def scoped_knn(spark, sf_dir):
    return op.scoped_knn(vectors(spark, sf_dir)).withColumn("score", F.round("score", 6))


@register(f"WITH {KNN} SELECT least(source_id, target_id) AS left_id, greatest(source_id, target_id) AS right_id, round(max(score), 6) AS score FROM knn GROUP BY ALL")
def edge_fold(spark, sf_dir):
    return op.fold_edges(op.knn(vectors(spark, sf_dir))).withColumn("score", F.round("score", 6))


MEANS = """m AS (SELECT {key}, dim, avg(x) AS m FROM u GROUP BY ALL), l AS (SELECT {key}, sqrt(sum(m * m)) AS length FROM m GROUP BY ALL)
SELECT {key}, CAST(dim - 1 AS INTEGER) AS dim, round(m / length, 6) AS value FROM m JOIN l USING ({key})"""


@register("WITH u AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), " + MEANS.format(key="label"))
def community_centroid(spark, sf_dir):
    return op.unit_means(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("vector")), "label", False).withColumn("value", F.round("value", 6))


@register("""WITH c AS (SELECT vec_id % 50 AS source, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT source, unnest(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))) AS x, generate_subscripts(e, 1) AS dim FROM c), """ + MEANS.format(key="source"))
def source_mean_vector(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("source"), F.col("embedding").alias("vector"))
    return op.unit_means(chunks, "source", True).withColumn("value", F.round("value", 6))


@register(f"WITH {KNN} SELECT round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50 FROM knn WHERE score > 0")
def similarity_percentiles(spark, sf_dir):
    return op.knn(vectors(spark, sf_dir)).where("score > 0").agg(F.round(F.percentile("score", 0.25), 6).alias("p25"), F.round(F.percentile("score", 0.5), 6).alias("p50"))


@register(f"""WITH {KNN}, pairs AS (SELECT a.label AS a, b.label AS b FROM knn JOIN v a ON a.vec_id = source_id JOIN v b ON b.vec_id = target_id WHERE rank = 1),
cells AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY ALL),
s AS (SELECT sum(n * (n - 1) / 2)::DOUBLE AS s, sum(n)::DOUBLE AS total FROM cells),
sa AS (SELECT sum(n * (n - 1) / 2)::DOUBLE AS sa FROM (SELECT sum(n)::DOUBLE AS n FROM cells GROUP BY a)),
sb AS (SELECT sum(n * (n - 1) / 2)::DOUBLE AS sb FROM (SELECT sum(n)::DOUBLE AS n FROM cells GROUP BY b))
SELECT round((s - sa * sb / (total * (total - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (total * (total - 1) / 2)), 6) AS ari FROM s, sa, sb""")
def adjusted_rand(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    first = op.knn(vectors(spark, sf_dir), k=1)
    pairs = first.join(rows.select(F.col("vec_id").alias("source_id"), F.col("label").alias("a")), "source_id").join(rows.select(F.col("vec_id").alias("target_id"), F.col("label").alias("b")), "target_id")
    return op.adjusted_rand(pairs.select("a", "b")).select(F.round("ari", 6).alias("ari"))


@register(f"WITH {KNN} SELECT source_id, target_id, round(score, 6) AS score, rank FROM knn")
def incremental_knn(spark, sf_dir):
    v = vectors(spark, sf_dir)
    dirty = v.where("source_id % 11 = 0").select("source_id")
    stale = op.knn(v).withColumn("score", F.when(F.col("source_id") % 11 == 0, 0.0).otherwise(F.col("score")))
    return op.incremental_knn(stale, v, dirty).select("source_id", "target_id", F.round("score", 6).alias("score"), "rank")
