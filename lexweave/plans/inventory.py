"""Queries of inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bibliography as bib
from ..operators import inventory as op
from .registry import register, table

ITEM = [
    "CASE WHEN o_orderkey % 40 = 0 THEN ' ' ELSE concat('item', o_orderkey) END AS key", "CASE WHEN o_orderkey % 3 = 0 THEN concat('c', o_custkey) END AS parent", "concat('t', o_orderpriority) AS title",
    "CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS creator", "o_orderkey % 9 AS version",
]


@register(f"""WITH i AS (SELECT {', '.join(ITEM)}, list_distinct([o_orderpriority, o_orderstatus, o_orderpriority]) AS c FROM orders), p AS (SELECT 'c' || c_custkey AS parent, c_name AS pt, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS pc FROM customer),
n AS (SELECT trim(key) AS key, coalesce(pt, title) AS title, coalesce(pc, creator) AS creator, array_to_string(list_sort(c), '|') AS collections, version FROM i LEFT JOIN p USING (parent) WHERE trim(key) <> '')
SELECT key, title, creator, collections, sha256(key || chr(31) || title || chr(31) || coalesce(creator, '')) AS content, sha256(key || chr(31) || title || chr(31) || coalesce(creator, '') || chr(31) || collections || chr(31) || version) AS full FROM n""")
def snapshot_normalize(spark, sf_dir):
    items = table(spark, sf_dir, "orders").selectExpr(*ITEM, "array(o_orderpriority, o_orderstatus, o_orderpriority) AS collections")
    parents = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("creator"))
    return op.normalised(items, parents)


@register("WITH g AS (SELECT doc_id, unnest(list_distinct([source, lang, source])) AS key FROM documents) SELECT key, count(*) AS sources FROM g GROUP BY key")
def collection_sizes(spark, sf_dir):
    return op.group_sizes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.array("source", "lang", "source").alias("groups")), "groups")


@register("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN list_append(embedding::DOUBLE[], 'nan'::DOUBLE) WHEN vec_id % 4 = 0 THEN embedding::DOUBLE[] ELSE list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) END AS v FROM embeddings)
SELECT vec_id AS source_id, len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND abs(sqrt(list_dot_product(v, v)) - 1) <= 0.001 AS usable FROM v""")
def vector_checkpoint(spark, sf_dir):
    x = F.col("embedding").cast("array<double>")
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), x.alias("x"), length.alias("n"))
    v = F.when(F.col("source_id") % 9 == 0, F.concat("x", F.array(F.lit(float("nan"))))).when(F.col("source_id") % 4 == 0, F.col("x")).otherwise(F.transform("x", lambda c: c / F.col("n")))
    return op.usable_vectors(rows.select("source_id", v.alias("vector")))


@register("SELECT o_orderkey, nullif(regexp_extract(CASE WHEN o_orderkey % 6 = 0 THEN 'no date' ELSE 'ca. ' || strftime(o_orderdate, '%Y-%m-%d') END, '([12][0-9]{3})', 1), '') AS year FROM orders")
def publication_year(spark, sf_dir):
    written = F.when(F.col("o_orderkey") % 6 == 0, "no date").otherwise(F.concat(F.lit("ca. "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return table(spark, sf_dir, "orders").select("o_orderkey", bib.year(written).alias("year"))
