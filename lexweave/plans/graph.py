"""Graph queries: parts are documents whose names are often shared, line items link orders and parts, pages link by href."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as op
from .registry import register, table

LINKS = """links AS (SELECT l_orderkey AS source_id, CASE l_linenumber % 5 WHEN 0 THEN 'p/' || l_partkey WHEN 1 THEN upper(p_name) WHEN 2 THEN p_brand || '#' || p_size WHEN 3 THEN ' ' ELSE 'nowhere ' || l_suppkey END AS target
  FROM lineitem JOIN part ON p_partkey = l_partkey), docs AS (SELECT 'p/' || p_partkey AS path, p_name AS name, p_brand || '#' || p_size AS alias FROM part)"""


def _graph(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat("p_brand", F.lit("#"), F.col("p_size").cast("string")).alias("alias"))
    path = lambda c: F.concat(F.lit("p/"), F.col(c).cast("string"))
    k = F.col("l_linenumber") % 5
    target = F.when(k == 0, path("l_partkey")).when(k == 1, F.upper("p_name")).when(k == 2, F.col("alias")).when(k == 3, " ").otherwise(F.concat(F.lit("nowhere "), F.col("l_suppkey").cast("string")))
    links = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("source_id"), target.alias("target"))
    return links, part.select(path("p_partkey").alias("path"), F.col("p_name").alias("name")), part.select(path("p_partkey").alias("path"), "alias")


@register(f"""WITH {LINKS}, n AS (SELECT lower(name) AS key, count(*) AS names, min(path) AS by_name FROM docs GROUP BY 1), a AS (SELECT lower(alias) AS key, count(DISTINCT path) AS aliases, min(path) AS by_alias FROM docs GROUP BY 1),
s AS (SELECT source_id, target, path, names, by_name, aliases, by_alias, CASE WHEN trim(target) = '' THEN 'invalid' WHEN path IS NOT NULL OR names = 1 THEN 'resolved' WHEN names > 1 THEN 'ambiguous' WHEN aliases = 1 THEN 'resolved' WHEN aliases > 1 THEN 'ambiguous' ELSE 'missing' END AS status
  FROM links LEFT JOIN docs ON path = target LEFT JOIN n ON n.key = lower(target) LEFT JOIN a ON a.key = lower(target))
SELECT source_id, target, status, CASE WHEN status = 'resolved' THEN coalesce(path, CASE WHEN names = 1 THEN by_name WHEN names IS NULL THEN by_alias END) END AS resolved FROM s""")
def link_resolution(spark, sf_dir):
    return op.resolve(*_graph(spark, sf_dir))


EDGES = "edges AS (SELECT l_orderkey % 997 AS source_id, l_partkey % 997 AS target_id FROM lineitem)"


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 997).alias("source_id"), (F.col("l_partkey") % 997).alias("target_id"))


@register(f"WITH {EDGES} SELECT target_id, source_id, count(*) AS n FROM edges GROUP BY ALL")
def backlinks(spark, sf_dir):
    return op.backlinks(_edges(spark, sf_dir))


@register("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'a') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def note_search(spark, sf_dir):
    return op.search(table(spark, sf_dir, "part"), ["A", "Brand#1"], "p_name", "p_brand", "p_type").select("p_partkey", "p_name")


@register(f"""WITH {EDGES}, r AS (SELECT p_partkey % 997 AS source_id, p_size AS target_id FROM part)
SELECT 'citation' AS layer, source_id, target_id, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT 'relation', least(source_id, target_id), greatest(source_id, target_id), count(*) FROM r GROUP BY ALL""")
def layer_edges(spark, sf_dir):
    relations = table(spark, sf_dir, "part").select((F.col("p_partkey") % 997).alias("source_id"), F.col("p_size").cast("long").alias("target_id"))
    return op.layers(("citation", _edges(spark, sf_dir)), ("relation", relations))


@register(f"""WITH {EDGES}, step AS (SELECT source_id AS node, target_id AS t FROM edges UNION SELECT target_id, source_id FROM edges),
h1 AS (SELECT DISTINCT t AS node FROM step WHERE node = 7 AND t <> 7), h2 AS (SELECT DISTINCT t AS node FROM h1 JOIN step USING (node) WHERE t <> 7 AND t NOT IN (SELECT node FROM h1))
SELECT CAST(7 AS BIGINT) AS node, 0 AS distance UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def khop_local(spark, sf_dir):
    return op.k_hops(_edges(spark, sf_dir), spark.sql("select 7L as node"), 2)


@register(f"WITH {EDGES} SELECT node, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM (SELECT source_id AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target_id, 0, 1 FROM edges) GROUP BY node")
def degree_counts(spark, sf_dir):
    return op.degrees(_edges(spark, sf_dir))


@register(f"WITH {EDGES} SELECT source_id, target_id, NOT (source_id % 10 = 3 AND target_id % 10 = 3) AS bridge FROM edges WHERE source_id % 10 = 3 OR target_id % 10 = 3")
def focus_community(spark, sf_dir):
    return op.focus(_edges(spark, sf_dir), spark.range(997).where("id % 10 = 3").select(F.col("id").alias("node")))


@register(f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT source_id AS node FROM edges WHERE source_id % 2 = target_id % 2 UNION ALL SELECT target_id FROM edges WHERE source_id % 2 = target_id % 2) GROUP BY node")
def discovery_scope_filter(spark, sf_dir):
    kept = _edges(spark, sf_dir).where("source_id % 2 = target_id % 2")
    return op.degrees(kept).select("node", (F.col("outgoing") + F.col("incoming")).alias("degree"))


@register("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) SELECT page_id, target, count(*) AS n FROM l GROUP BY ALL""")
def page_links(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return found.groupBy("page_id", "target").agg(F.count("*").alias("n"))
