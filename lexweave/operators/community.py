"""Communities of an undirected weighted graph: label propagation at any size, Louvain over a bounded edge set."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Edges that one task's Louvain takes, of some 200 bytes each; more is an error.
EDGES = 10_000_000


def label_propagation(edges: DataFrame, rounds: int = 6, least: float = 0.0) -> DataFrame:
    """node, label of edges (left_id, right_id, score): in each round a node takes the label of most weight around it.

    Ties go to the smaller label, rounds are fixed and each is written, so the result does not depend on the input's
    order. A lone node keeps its own label. This is not Leiden and does not claim its partitions.
    """
    strong = edges.where(F.col("score") > least)
    both = written(strong.select(F.col("left_id").alias("node"), F.col("right_id").alias("to"), "score").unionByName(strong.select(F.col("right_id").alias("node"), F.col("left_id").alias("to"), "score")), "lp-edges")
    nodes = edges.select(F.col("left_id").alias("node")).union(edges.select("right_id")).distinct()
    labels = written(nodes.withColumn("label", F.col("node")), "lp-labels")
    for _ in range(rounds):
        sums = both.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node", "label").agg(F.sum("score").alias("w"))
        best = sums.groupBy("node").agg(F.min_by("label", F.struct((-F.round("w", 9)).alias("w"), "label")).alias("best"))
        labels = written(labels.join(best, "node", "left").select("node", F.coalesce("best", "label").alias("label")), "lp-labels")
    return labels


def _folded(left: np.ndarray, right: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges with left <= right, each pair once, in order; an edge inside a node is its weight, once."""
    pair, at = np.unique(np.minimum(left, right) * n + np.maximum(left, right), return_inverse=True)
    return pair // n, pair % n, np.bincount(at, weight, len(pair))


def _homes(left: np.ndarray, right: np.ndarray, weight: np.ndarray, n: int, resolution: float, rng: random.Random) -> list[int]:
    """Local moving: the community of each of n nodes once no node gains by a move; of equal gains the smaller one's.

    A node that stayed is looked at again when a neighbour has moved, or when so much degree has moved anywhere that a
    community's mass may outweigh the lead of its own: until then it would stay, so the result is that of looking at all.
    """
    inner = left == right
    degree = np.bincount(left, weight, n) + np.bincount(right, weight, n)
    total = float(degree.sum()) or 1.0
    left, right, weight = left[~inner], right[~inner], weight[~inner]
    source, to = np.concatenate([left, right]), np.concatenate([right, left])
    by = np.lexsort((to, source))
    starts = np.searchsorted(source[by], np.arange(n + 1)).tolist()
    to, weight = memoryview(to[by].astype(np.int32)), memoryview(np.concatenate([weight, weight])[by])
    del left, right, source, by
    degree = degree.tolist()
    home, mass = list(range(n)), list(degree)
    calm = [-1.0] * n  # degree moved so far up to which the node surely stays
    order, gone, moved = list(range(n)), 0.0, True
    rng.shuffle(order)
    while moved:
        moved = False
        for x in order:
            if calm[x] >= gone:
                continue
            around, own, pull = to[starts[x] : starts[x + 1]].tolist(), home[x], resolution * degree[x] / total
            near = {own: 0.0}
            for y, w in zip(around, weight[starts[x] : starts[x + 1]].tolist(), strict=True):
                c = home[y]
                near[c] = near.get(c, 0.0) + w
            mass[own] -= degree[x]
            stay = near.pop(own) - pull * mass[own]
            best, most, second = own, -math.inf, -math.inf
            for c, w in near.items():
                gain = w - pull * mass[c]
                if gain > most or (gain == most and c < best):
                    best, most, second = c, gain, most
                elif gain > second:
                    second = gain
            if most > stay + 1e-12:
                lead, moved, home[x] = most - max(stay, second), True, best
                gone += degree[x]
                for y in around:
                    calm[y] = -1.0
            else:
                lead, best = stay - most, own
            mass[best] += degree[x]
            # the masses of two communities differ by at most twice the degree that has moved
            calm[x] = math.inf if not pull else gone + lead / (2 * pull) * (1 - 1e-6) - 1e-9 * total
    return home


def _communities(left: np.ndarray, right: np.ndarray, weight: np.ndarray, n: int, resolution: float, seed: int) -> np.ndarray:
    """The community of each of n nodes: local moving and aggregation until modularity stops rising."""
    rng, part = random.Random(seed), np.arange(n)
    left, right, weight = _folded(left, right, weight, n)
    while n:
        own, home = np.unique(_homes(left, right, weight, n, resolution, rng), return_inverse=True)
        if len(own) == n:
            break
        part, n = home[part], len(own)
        left, right, weight = _folded(home[left], home[right], weight, n)
    return part


def louvain(edges: list[tuple], resolution: float = 1.0, seed: int = 0) -> dict:
    """node -> community, named by its smallest node, of weighted edges (a, b, w)."""
    names = sorted({n for e in edges for n in e[:2]}, key=str)
    number = {n: i for i, n in enumerate(names)}
    ends = np.array([(number[a], number[b]) for a, b, _ in edges], np.int64).reshape(-1, 2)
    part = _communities(ends[:, 0], ends[:, 1], np.array([w for *_, w in edges], np.float64), len(names), resolution, seed)
    first: dict = {}
    for n, c in zip(names, part.tolist(), strict=True):
        first[c] = min(first.get(c, n), n)
    return {n: first[c] for n, c in zip(names, part.tolist(), strict=True)}


def louvain_partition(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """node, community of a checked, bounded edge set, in one task; deterministic by order and seed."""
    n = edges.count()
    if n > EDGES:
        raise ValueError(f"{n} edges; Louvain takes {EDGES}")
    kind = edges.schema["left_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["left_id", "right_id"])
        codes, names = pd.factorize(pd.concat([rows["left_id"], rows["right_id"]], ignore_index=True))
        place = np.empty(len(names), np.int64)
        place[np.argsort(names.astype(str), kind="stable")] = np.arange(len(names))
        ends = place[codes].reshape(2, -1)
        part = _communities(*ends, rows["score"].to_numpy(np.float64), len(names), resolution, 0)[place]
        out = pd.DataFrame({"node": names, "community": part})
        out["community"] = out.groupby("community")["node"].transform("min")
        return out.sort_values("node")

    return edges.groupBy(F.lit(0).alias("all")).applyInPandas(run, f"node {kind}, community {kind}")


def calibration_grid(edges: DataFrame, reviewed: DataFrame, ks: list[int], floors: list[float]) -> DataFrame:
    """k, floor, recovered, missed, unsupported, selected, rank: each setting's result on reviewed pairs, all in one pass.

    edges: source_id, target_id, score, rank (up to the largest k). reviewed: left_id, right_id, label. Settings are
    ranked by fewest unsupported less recovered, then by fewer edges.
    """
    grid = edges.sparkSession.createDataFrame([(k, f) for k in ks for f in floors], "k int, floor double")
    chosen = edges.crossJoin(F.broadcast(grid)).where((F.col("rank") <= F.col("k")) & (F.col("score") >= F.col("floor")))  # a few settings
    pairs = chosen.select("k", "floor", F.least("source_id", "target_id").alias("left_id"), F.greatest("source_id", "target_id").alias("right_id")).distinct()
    sums = pairs.join(reviewed, ["left_id", "right_id"], "left").groupBy("k", "floor").agg(
        F.count(F.when(F.col("label") == "useful", 1)).alias("recovered"), F.count(F.when(F.col("label") == "unsupported", 1)).alias("unsupported"), F.count("*").alias("selected")
    )
    useful = reviewed.agg(F.count(F.when(F.col("label") == "useful", 1)).alias("useful"))
    order = Window.orderBy(F.col("unsupported") - F.col("recovered"), "selected", "k", "floor")  # one row a setting
    return sums.crossJoin(F.broadcast(useful)).select("k", "floor", "recovered", (F.col("useful") - F.col("recovered")).alias("missed"), "unsupported", "selected", F.row_number().over(order).alias("rank"))
