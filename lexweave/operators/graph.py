"""Document-graph queries: links, backlinks, search, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(links: DataFrame, documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """source_id, target, status, resolved: a link names a path, else one document's name, else one alias.

    links: source_id, target. documents: path, name. aliases: path, alias.
    """
    low = F.lower("target")
    named = documents.groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("names"), F.min("path").alias("by_name"))
    other = aliases.groupBy(F.lower("alias").alias("key")).agg(F.countDistinct("path").alias("aliases"), F.min("path").alias("by_alias"))
    out = links.withColumn("key", low).join(documents.select(F.col("path").alias("target"), F.lit(True).alias("by_path")), "target", "left").join(named, "key", "left").join(other, "key", "left")
    blank = F.trim(F.coalesce("target", F.lit(""))) == ""
    status = F.when(blank, "invalid").when(F.col("by_path"), "resolved").when(F.col("names") == 1, "resolved").when(F.col("names") > 1, "ambiguous").when(F.col("aliases") == 1, "resolved").when(F.col("aliases") > 1, "ambiguous").otherwise("missing")
    found = F.when(F.col("by_path"), F.col("target")).when(F.col("names") == 1, F.col("by_name")).when(F.col("names").isNull() & (F.col("aliases") == 1), F.col("by_alias"))
    return out.select("source_id", "target", status.alias("status"), F.when(status == "resolved", found).alias("resolved"))


def backlinks(edges: DataFrame) -> DataFrame:
    """target_id, source_id, n: how often each source links to each target."""
    return edges.groupBy("target_id", "source_id").agg(F.count("*").alias("n"))


def search(documents: DataFrame, terms: list[str], *columns: str) -> DataFrame:
    """Documents whose folded columns hold all terms."""
    text = F.lower(F.concat_ws(" ", *columns))
    for t in terms:
        documents = documents.where(text.contains(t.lower()))
    return documents


def k_hops(edges: DataFrame, seeds: DataFrame, hops: int, out: bool = True, into: bool = True) -> DataFrame:
    """node, distance of the nodes within 1 to 3 hops of seeds (node); each hop joins only the last one's nodes."""
    ways = [edges.select(F.col(a).alias("node"), F.col(b).alias("to")) for a, b, on in (("source_id", "target_id", out), ("target_id", "source_id", into)) if on]
    if not ways:
        return seeds.select("node", F.lit(0).alias("distance"))
    step = ways[0].unionByName(ways[-1]).distinct()
    found = seeds.select("node", F.lit(0).alias("distance")).distinct()
    last = found
    for d in range(1, max(1, min(3, hops)) + 1):
        last = last.select("node").join(step, "node").select(F.col("to").alias("node")).distinct().join(found.select("node"), "node", "left_anti").withColumn("distance", F.lit(d))
        found = found.unionByName(last)
    return found


def layers(*named: tuple[str, DataFrame]) -> DataFrame:
    """layer, source_id, target_id, n of all layers; symmetric pairs are folded to sorted ends but for citations."""
    out = None
    for name, edges in named:
        a, b = (F.col("source_id"), F.col("target_id")) if name == "citation" else (F.least("source_id", "target_id"), F.greatest("source_id", "target_id"))
        part = edges.select(F.lit(name).alias("layer"), a.alias("source_id"), b.alias("target_id"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("layer", "source_id", "target_id").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source_id").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target_id").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def focus(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with at least one end among members (node), and whether they lead out of them."""
    a = edges.join(members.select(F.col("node").alias("source_id"), F.lit(True).alias("a")), "source_id", "left").join(members.select(F.col("node").alias("target_id"), F.lit(True).alias("b")), "target_id", "left")
    return a.where("a or b").select("source_id", "target_id", (F.col("a").isNull() | F.col("b").isNull()).alias("bridge"))
