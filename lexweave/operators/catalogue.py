"""Catalogue roll-ups, snapshots, queues and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def closure(tree: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """node, ancestor (itself included) of a tree (node, parent), in rounds; a cycle ends with the nodes it has seen.

    starts: the nodes to walk up from, all if None. A round joins only the last round's rows and is written, so a
    tree of d levels takes d rounds of one join each, however deep it is.
    """
    nodes = tree if starts is None else tree.join(starts.select("node").distinct(), "node", "left_semi")
    up = tree.where("parent is not null").select(F.col("node").alias("ancestor"), "parent").distinct()
    found = last = written(nodes.select("node", F.col("node").alias("ancestor")).distinct(), "closure")
    while not last.isEmpty():
        step = last.join(up, "ancestor").select("node", F.col("parent").alias("ancestor")).distinct()
        last = written(step.join(found, ["node", "ancestor"], "left_anti"), "closure")
        found = found.unionByName(last)
    return found


def rollup(tree: DataFrame, items: DataFrame) -> DataFrame:
    """node, direct, total: distinct items filed at a node, and at it or below."""
    direct = items.groupBy("node").agg(F.countDistinct("item").alias("direct"))
    below = items.join(closure(tree), "node").groupBy(F.col("ancestor").alias("node")).agg(F.countDistinct("item").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return tree.select("node").join(direct, "node", "left").join(below, "node", "left").select("node", zero("direct"), zero("total"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: str, place: str) -> DataFrame:
    """key, change: new, removed, changed (content) or moved (place only); unchanged keys are left out."""
    a, b = (d.select(key, F.col(content).alias(f"{p}c"), F.col(place).alias(f"{p}p"), F.lit(True).alias(p)) for d, p in ((old, "o"), (new, "n")))
    both = a.join(b, key, "full")
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "removed").when(~F.col("oc").eqNullSafe(F.col("nc")), "changed").when(~F.col("op").eqNullSafe(F.col("np")), "moved")
    return both.select(key, change.alias("change")).where("change is not null")


def upsert(queue: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """queue (keys, rank, status, eligible) after a batch (keys, rank): rows of the batch are eligible, others are not;
    known rows keep their status, new ones are unexamined."""
    b = batch.select(*keys, F.col("rank").alias("new_rank"), F.lit(True).alias("offered"))
    return queue.join(b, keys, "full").select(*keys, F.coalesce("new_rank", "rank").alias("rank"), F.coalesce("status", F.lit("unexamined")).alias("status"), F.coalesce("offered", F.lit(False)).alias("eligible"))


def exposure(ledger: DataFrame) -> DataFrame:
    """key, exposure, reserved: settled entries count as spent, others as reserved."""
    spent = F.when(F.col("status") == "settled", F.col("actual")).otherwise(F.col("reserved"))
    return ledger.groupBy("key").agg(F.sum(spent).cast("decimal(38,2)").alias("exposure"), F.count(F.when(F.col("status") != "settled", 1)).alias("open"))


def within_budget(rows: DataFrame, scope: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each scope, in order, as long as their running size fits the budget."""
    running = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(size).over(running)).where(F.col("used") <= budget)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key, the greatest by order: max_by keeps one row a key and task, so hot keys stay small."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("row")).select("row.*")


def top_values(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return rows.groupBy(key, value).agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def virtual_topics(facets: DataFrame, most: int = 3, least: int = 2) -> DataFrame:
    """source_id, topic: each source's first topics, in facet order, that enough sources share; else topic-catch-all.

    facets: source_id, place (the facet's order), topic.
    """
    common = facets.groupBy("topic").agg(F.countDistinct("source_id").alias("n")).where(F.col("n") >= least).select("topic")
    order = Window.partitionBy("source_id").orderBy("place", "topic")
    own = facets.join(common, "topic", "left_semi").groupBy("source_id", "topic").agg(F.min("place").alias("place"))
    first = own.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("source_id", "topic")
    rest = facets.select("source_id").distinct().join(first, "source_id", "left_anti").withColumn("topic", F.lit("topic-catch-all"))
    return first.unionByName(rest)
