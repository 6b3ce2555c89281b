"""Catalogue queries: regions and nations are the collection tree, orders and events change, the ledger is events' values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as op
from .registry import register, table

TREE = """tree AS (SELECT 'r' || r_regionkey AS node, 'root' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'root', NULL),
items AS (SELECT 'n' || c_nationkey AS node, 'c' || c_custkey AS item FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""


def _tree(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    tree = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node"), F.lit("root").alias("parent"))
    tree = tree.unionByName(table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"))).unionByName(spark.sql("select 'root' as node, cast(null as string) as parent"))
    items = table(spark, sf_dir, "customer").select(name("n", "c_nationkey").alias("node"), name("c", "c_custkey").alias("item"))
    return tree, items.unionByName(table(spark, sf_dir, "supplier").select(name("n", "s_nationkey").alias("node"), name("s", "s_suppkey").alias("item")))


@register(f"""WITH RECURSIVE {TREE}, up(node, ancestor) AS (SELECT node, node FROM tree UNION SELECT up.node, tree.parent FROM up JOIN tree ON tree.node = up.ancestor WHERE tree.parent IS NOT NULL)
SELECT t.node, (SELECT count(DISTINCT item) FROM items i WHERE i.node = t.node) AS direct, (SELECT count(DISTINCT item) FROM items i JOIN up ON up.node = i.node WHERE up.ancestor = t.node) AS total FROM tree t""")
def tree_rollup(spark, sf_dir):
    return op.rollup(*_tree(spark, sf_dir))


@register(f"""WITH RECURSIVE {TREE}, up(node, ancestor) AS (SELECT node, node FROM tree UNION SELECT up.node, tree.parent FROM up JOIN tree ON tree.node = up.ancestor WHERE tree.parent IS NOT NULL)
SELECT node, ancestor FROM up WHERE node = 'n7'""")
def snapshot_scope(spark, sf_dir):
    return op.closure(_tree(spark, sf_dir)[0], spark.createDataFrame([("n7",)], "node string"))


@register("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderstatus END AS c, o_orderpriority AS p FROM orders WHERE o_orderkey % 10 <> 0),
n AS (SELECT o_orderkey, o_orderstatus AS c, CASE WHEN o_orderkey % 11 = 0 THEN 'moved' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 13 <> 0)
SELECT o_orderkey, change FROM (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o.c IS DISTINCT FROM n.c THEN 'changed'
WHEN o.p IS DISTINCT FROM n.p THEN 'moved' END AS change FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey) WHERE change IS NOT NULL""")
def snapshot_diff(spark, sf_dir):
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = orders.where("o_orderkey % 10 <> 0").select("o_orderkey", F.when(k % 7 == 0, "x").otherwise(F.col("o_orderstatus")).alias("c"), F.col("o_orderpriority").alias("p"))
    new = orders.where("o_orderkey % 13 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("c"), F.when(k % 11 == 0, "moved").otherwise(F.col("o_orderpriority")).alias("p"))
    return op.snapshot_diff(old, new, "o_orderkey", "c", "p")


LATEST = "l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL)"


def _latest(spark, sf_dir):
    return op.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", "ts"), ["user_id", "event_type"], F.col("ts"), F.col("event_id"))


@register(f"WITH {LATEST} SELECT user_id, event_type, event_id, value FROM l")
def latest_decision(spark, sf_dir):
    return _latest(spark, sf_dir).select("user_id", "event_type", "event_id", "value")


@register(f"WITH {LATEST} SELECT event_type AS status, count(*) AS n, count(*) FILTER (value < 10) AS ineligible FROM l GROUP BY 1")
def queue_status_counts(spark, sf_dir):
    return _latest(spark, sf_dir).groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.count(F.when(F.col("value") < 10, 1)).alias("ineligible"))


@register("""WITH q AS (SELECT l_orderkey AS a, l_linenumber AS b, l_partkey AS rank, CASE WHEN l_returnflag = 'R' THEN 'resolved' ELSE 'unexamined' END AS status FROM lineitem WHERE l_partkey % 3 <> 0),
n AS (SELECT l_orderkey AS a, l_linenumber AS b, l_suppkey AS rank FROM lineitem WHERE l_suppkey % 2 = 0)
SELECT coalesce(q.a, n.a) AS a, coalesce(q.b, n.b) AS b, coalesce(n.rank, q.rank) AS rank, coalesce(status, 'unexamined') AS status, n.a IS NOT NULL AS eligible FROM q FULL JOIN n ON q.a = n.a AND q.b = n.b""")
def queue_upsert(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "a", "l_linenumber": "b"})
    queue = line.where("l_partkey % 3 <> 0").select("a", "b", F.col("l_partkey").alias("rank"), F.when(F.col("l_returnflag") == "R", "resolved").otherwise("unexamined").alias("status"))
    return op.upsert(queue, line.where("l_suppkey % 2 = 0").select("a", "b", F.col("l_suppkey").alias("rank")), ["a", "b"])


@register("""SELECT user_id AS key, CAST(sum(CASE WHEN event_id % 3 = 0 THEN CAST(value AS DECIMAL(18,2)) ELSE CAST(value AS DECIMAL(18,2)) + 1 END) AS DOUBLE) AS exposure, count(*) FILTER (event_id % 3 <> 0) AS open FROM events GROUP BY 1""")
def ledger_exposure(spark, sf_dir):
    value = F.col("value").cast("decimal(18,2)")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_id") % 3 == 0, "settled").otherwise("reserved").alias("status"), value.alias("actual"), (value + 1).alias("reserved"))
    return op.exposure(rows).withColumn("exposure", F.col("exposure").cast("double"))


@register("SELECT source, doc_id, used FROM (SELECT source, doc_id, CAST(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used FROM documents) WHERE used <= 50000")
def byte_budget_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return op.within_budget(docs, "source", "doc_id", "size", 50_000).select("source", "doc_id", "used")


@register("""WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_type, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rank FROM n QUALIFY rank <= 3""")
def facet_top3(spark, sf_dir):
    return op.top_values(table(spark, sf_dir, "part"), "p_brand", "p_type", 3)


@register("""WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rank FROM n QUALIFY rank <= 4""")
def method_mix(spark, sf_dir):
    return op.top_values(table(spark, sf_dir, "documents"), "source", "lang", 4)


@register("""WITH f AS (SELECT p_partkey AS source_id, unnest([1, 2, 3, 4]) AS place, unnest(['t-' || p_name || p_brand, 't-' || p_brand || p_type, 't-' || p_size || p_type, 't-' || p_name]) AS topic FROM part),
c AS (SELECT topic FROM f GROUP BY 1 HAVING count(DISTINCT source_id) >= 2), o AS (SELECT source_id, topic, min(place) AS place FROM f JOIN c USING (topic) GROUP BY ALL),
t AS (SELECT source_id, topic, row_number() OVER (PARTITION BY source_id ORDER BY place, topic) AS r FROM o QUALIFY r <= 3)
SELECT source_id, topic FROM t UNION ALL SELECT DISTINCT source_id, 'topic-catch-all' FROM f WHERE source_id NOT IN (SELECT source_id FROM t)""")
def virtual_topics(spark, sf_dir):
    c = lambda *x: F.concat(F.lit("t-"), *(F.col(n).cast("string") for n in x))
    topics = F.posexplode(F.array(c("p_name", "p_brand"), c("p_brand", "p_type"), c("p_size", "p_type"), c("p_name"))).alias("place", "topic")
    return op.virtual_topics(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), topics))
