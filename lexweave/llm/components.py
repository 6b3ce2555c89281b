"""Connected components of a graph, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (the smallest node that it is connected with) of all nodes of edges that have two ends.

    Large-star and small-star in turns: every edge points from a larger to a smaller node; a large-star leads it to
    the smallest node that its lower end points to, a small-star ties all that a node points to to the smallest of
    them. The number of rounds grows with the logarithm of a path's length, and rounds go on until nothing changes.
    Minima are added up in each task before the shuffle and written, so that both sides of a join are plain tables
    and Spark splits a hot node.
    """
    ends = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi != lo").distinct()
    now, mark = written(ends, "edges"), None
    while True:
        low = written(now.groupBy("hi").agg(F.min("lo").alias("low")), "low")
        large = written(now.join(low.withColumnRenamed("hi", "lo").hint("merge"), "lo", "left").select("hi", F.coalesce("low", "lo").alias("lo")).distinct(), "edges")
        dropped(now, low)
        low = written(large.groupBy("hi").agg(F.min("lo").alias("low")), "low")
        tied = large.join(low.hint("merge"), "hi").where("lo != low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        now = written(tied.union(low.select("hi", "low")).distinct(), "edges")
        dropped(large, low)
        last, mark = mark, tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).head())
        if mark == last:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(now.select("lo", "lo").distinct())
