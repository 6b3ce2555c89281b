"""Inventories: normalised snapshots, group sizes, stored vectors and relation registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _identity(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def normalised(items: DataFrame, parents: DataFrame) -> DataFrame:
    """key, title, creator, collections, content and full fingerprints of items (key, parent, title, creator, collections, version).

    An attachment's identity is its parent's, where that is known. The content fingerprint leaves out where an item is
    filed and its version, the full one has all. Keys that are blank name no item; collections are sorted, each once.
    """
    up = parents.select(F.col("key").alias("parent"), F.col("title").alias("parent_title"), F.col("creator").alias("parent_creator"))
    rows = items.withColumn("key", F.trim("key")).where("key <> ''")
    # items without a parent need no join, which would send them all to one task
    alone = rows.where("parent is null").withColumns({c: F.lit(None).cast(up.schema[c].dataType) for c in ("parent_title", "parent_creator")})
    rows = rows.where("parent is not null").join(up, "parent", "left").unionByName(alone)
    named = rows.select("key", F.coalesce("parent_title", "title").alias("title"), F.coalesce("parent_creator", "creator").alias("creator"), F.array_join(F.array_sort(F.array_distinct("collections")), "|").alias("collections"), "version")
    content = _identity(F.col("key"), F.col("title"), F.col("creator"))
    return named.select("key", "title", "creator", "collections", content.alias("content"), _identity(F.col("key"), F.col("title"), F.col("creator"), F.col("collections"), F.col("version")).alias("full"))


def group_sizes(rows: DataFrame, groups: str) -> DataFrame:
    """key, sources: how many sources (source_id) each of their groups (an array column) has."""
    return rows.select("source_id", F.explode(F.array_distinct(groups)).alias("key")).groupBy("key").agg(F.count("*").alias("sources"))


def usable_vectors(vectors: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """source_id, usable of stored vectors (source_id, vector): all components finite and the length one, within the tolerance."""
    x = F.col("vector").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return vectors.select("source_id", F.coalesce(finite & (F.abs(length - 1) <= tolerance), F.lit(False)).alias("usable"))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """A relation registry in CSV with a header: all columns as text, blank fields null, quoted line breaks kept."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
