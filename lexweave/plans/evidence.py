"""Queries of packets, fidelity and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as op
from ..operators import retrieval
from .registry import register, table
from .retrieval import _inputs


@register()
def recall_excerpts(spark, sf_dir):
    """Hybrid recall with excerpts that keep to 4,000 characters a question; a packet's budget depends on all its rows, so there is no SQL."""
    docs, asked, vectors, by = _inputs(spark, sf_dir)
    return op.excerpts(retrieval.hybrid_recall(docs, asked, vectors, by), docs, 4000)


@register("""WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS line, min(l_quantity) AS x, min(l_suppkey) AS s FROM lineitem GROUP BY ALL), c AS (SELECT doc * 10 + line AS claim_id, doc, line + s % 3 - 1 AS page, x FROM b),
q AS (SELECT *, unnest([page - 1, page, page + 1]) AS near FROM c), n AS (SELECT claim_id, q.page AS cited, near AS page, q.x, b.x AS y FROM q LEFT JOIN b ON b.doc = q.doc AND b.line = near),
s AS (SELECT claim_id, bool_or(y IS NOT NULL) FILTER (page = cited) AS e, max(coalesce(x = y, false)::INT) FILTER (page = cited) AS own, max(coalesce(x = y, false)::INT) FILTER (page <> cited) AS beside, max(coalesce(x = y, false)::INT) AS best FROM n GROUP BY 1)
SELECT claim_id, array_to_string(list_filter([CASE WHEN NOT e THEN 'invalid_page' END, CASE WHEN best = 0 THEN 'numbers_absent' END, CASE WHEN beside > own THEN 'adjacent_page_better' END], lambda v: v IS NOT NULL), ',') AS risks FROM s""")
def fidelity_risks(spark, sf_dir):
    base = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line")).agg(F.min("l_quantity").alias("x"), F.min("l_suppkey").alias("s"))
    pages = base.select("doc", F.col("line").alias("page"), F.array("x").alias("numbers"))
    claims = base.select((F.col("doc") * 10 + F.col("line")).alias("claim_id"), "doc", (F.col("line") + F.col("s") % 3 - 1).cast("int").alias("page"), F.array("x").alias("numbers"))
    return op.fidelity(claims, pages)


SIZES = {"1-URGENT": 24, "2-HIGH": 2, "3-MEDIUM": 2, "4-NOT SPECIFIED": 4, "5-LOW": 4}


@register(f"""SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(CAST(o_orderkey AS VARCHAR))) AS place FROM orders
QUALIFY place <= CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN {n}" for k, n in SIZES.items())} ELSE 0 END""")
def challenge_strata(spark, sf_dir):
    """A sample by strata: the sizes are the feature."""
    return op.strata_sample(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", F.col("o_orderkey"), SIZES)


@register("""SELECT coalesce(CASE l_suppkey % 4 WHEN 0 THEN 'citation' WHEN 1 THEN 'table' WHEN 2 THEN 'caption' END, 'unknown') AS kind, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS characters, count(*) AS spans FROM lineitem GROUP BY 1""")
def coverage_accounting(spark, sf_dir):
    kind = F.when(F.col("l_suppkey") % 4 == 0, "citation").when(F.col("l_suppkey") % 4 == 1, "table").when(F.col("l_suppkey") % 4 == 2, "caption")
    return op.excluded_characters(table(spark, sf_dir, "lineitem").select(kind.alias("kind"), F.lit(0).cast("long").alias("start"), F.col("l_quantity").cast("long").alias("end")))


@register("""WITH s AS (SELECT DISTINCT l_orderkey AS left_id, l_suppkey AS right_id, l_returnflag AS kind, l_partkey AS value FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY left_id, right_id, kind ORDER BY value) AS r FROM s)
SELECT left_id, right_id, kind, count(*) AS n, coalesce(string_agg(CAST(value AS VARCHAR), '|' ORDER BY CAST(value AS VARCHAR)) FILTER (r <= 6), '') AS samples FROM r GROUP BY ALL""")
def signal_counts(spark, sf_dir):
    return op.signal_counts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("left_id"), F.col("l_suppkey").alias("right_id"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("value")))


@register("""SELECT p_brand, p_partkey AS topic, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 7 = 0 DESC, p_size DESC, p_partkey % 13 DESC, length(p_name) DESC, p_partkey) AS rank FROM part QUALIFY rank <= 12""")
def neighborhood_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("topic"), (F.col("p_partkey") % 7 == 0).alias("proposition"), F.col("p_size").alias("usefulness"), (F.col("p_partkey") % 13).alias("members"), F.length("p_name").alias("tokens"))
    return op.neighbourhood_rank(rows, "p_brand", 12).select("p_brand", "topic", "rank")
