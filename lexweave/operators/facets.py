"""Subject tags, typed relations and topic neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def registry(assigned: DataFrame) -> DataFrame:
    """facet, tag, label (shortest variant), variants, sources, families of assignments (facet, tag, label, source_id, family)."""
    # each column's distinct values are counted by themselves: together they would be four rows of each assignment
    tag = ["facet", "tag"]
    labels = assigned.select(*tag, "label").distinct().groupBy(*tag).agg(F.min(F.struct(F.length("label").alias("n"), "label")).getField("label").alias("label"), F.count("label").alias("variants"))
    many = lambda c, name: assigned.where(F.col(c).isNotNull()).select(*(F.col(t).alias(f"{name}_{t}") for t in tag), c).distinct().groupBy(f"{name}_facet", f"{name}_tag").agg(F.count("*").alias(name))
    for c, name in (("source_id", "sources"), ("family", "families")):
        same = [F.col(t).eqNullSafe(F.col(f"{name}_{t}")) for t in tag]
        labels = labels.join(many(c, name), same[0] & same[1], "left").drop(f"{name}_facet", f"{name}_tag").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return labels


def active(assigned: DataFrame, least: int = 2) -> DataFrame:
    """Tags with enough distinct evidence bases among analytical sources."""
    return assigned.where("analytical").groupBy("facet", "tag").agg(F.countDistinct("family").alias("bases")).withColumn("active", F.col("bases") >= least)


def two_facet_relations(assigned: DataFrame, most: int, least: int = 2) -> DataFrame:
    """left_id, right_id, facets, shared of pairs that share tags in at least two facets; tags of over ``most`` sources give none."""
    own = assigned.select("facet", "tag", "source_id").distinct()
    sizes = own.groupBy("facet", "tag").agg(F.count("*").alias("n")).where(F.col("n").between(2, most))
    few = own.join(sizes.select("facet", "tag"), ["facet", "tag"], "left_semi")
    a, b = (few.select("facet", "tag", F.col("source_id").alias(n)) for n in ("left_id", "right_id"))
    return a.join(b, ["facet", "tag"]).where("left_id < right_id").groupBy("left_id", "right_id").agg(F.countDistinct("facet").alias("facets"), F.count("*").alias("shared")).where(F.col("facets") >= least)


def overlap(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """pairs (with shared) and their overlap coefficient: shared tags over the smaller source's tags."""
    n = assigned.select("facet", "tag", "source_id").distinct().groupBy("source_id").agg(F.count("*").alias("n"))
    ends = pairs.join(n.toDF("left_id", "ln"), "left_id").join(n.toDF("right_id", "rn"), "right_id")
    return ends.select("left_id", "right_id", "shared", F.round(F.col("shared") / F.greatest(F.lit(1), F.least("ln", "rn")), 3).alias("overlap"))


def usefulness(prevalence: Column, tokens: Column, priority: Column, families: Column) -> Column:
    return F.round((1 - prevalence) * 50 + F.least(F.lit(5), tokens) * 8 + F.greatest(F.lit(0), 11 - priority) + F.least(F.lit(5), families) * 2, 3)


def related(edges: DataFrame, most: int = 8) -> DataFrame:
    """Each source's related links: explicit ones all, of inferred ones the strongest; edges: source_id, target_id, strength, inferred."""
    best = edges.groupBy("source_id", "target_id", "inferred").agg(F.max("strength").alias("strength"))
    order = Window.partitionBy("source_id").orderBy(F.desc("strength"), "target_id")
    some = best.where("inferred").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.where("not inferred").withColumn("rank", F.lit(0)).unionByName(some)


def with_inverse(citations: DataFrame) -> DataFrame:
    """Each cites with its cited_by, and the other way round."""
    turned = citations.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.when(F.col("relation_type") == "cites", "cited_by").otherwise("cites").alias("relation_type"))
    return citations.select("source_id", "target_id", "relation_type").unionByName(turned).distinct()
