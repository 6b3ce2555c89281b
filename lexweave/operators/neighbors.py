"""Exact cosine neighbours by blocks, derived edges, centroids, agreement of partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block: a task holds one block of sources and takes the blocks of targets one after another.
BLOCK = 8192
#: Pairs whose exact scores are worked out at a time.
PAIRS = 200_000


def _packed(vectors: DataFrame, number: int) -> DataFrame:
    """block, n, d, ids, data, groups: the vectors of a block in one row, dealt by the hash of their id."""
    kind = vectors.schema["source_id"].dataType.simpleString()
    group = vectors.schema["groups"].dataType.simpleString()
    dealt = vectors.select(F.pmod(F.xxhash64("source_id"), F.lit(number)).cast("int").alias("block"), "source_id", F.col("vector").cast("array<double>").alias("vector"), "groups")

    def pack(part: pa.Table) -> pa.Table:
        column = part.column("vector").combine_chunks()
        x = column.flatten().to_numpy(zero_copy_only=False)
        small = x.astype("<f4")
        data = (small if (small == x).all() else x.astype("<f8")).tobytes()
        ids, groups = part.column("source_id"), part.column("groups")
        return pa.table({
            "block": part.column("block")[:1], "n": pa.array([len(part)], pa.int32()), "d": pa.array([len(x) // len(part)], pa.int32()), "ids": pa.array([ids.to_pylist()], pa.list_(ids.type)),
            "data": pa.array([data], pa.binary()), "groups": pa.array([groups.to_pylist()], pa.list_(groups.type)),
        })

    return dealt.groupBy("block").applyInArrow(pack, f"block int, n int, d int, ids array<{kind}>, data binary, groups array<{group}>")


class _Block:
    """Vectors of a block: x as they are, their lengths, unit vectors in single precision, ids and groups."""

    def __init__(self, batch: pa.RecordBatch, at: int):
        get = lambda c: batch.column(c)[at]
        n, d, data = get("n").as_py(), get("d").as_py(), get("data").as_py()
        self.x = np.frombuffer(data, "<f4" if len(data) == 4 * n * d else "<f8").reshape(n, d).astype(np.float64)
        self.length = np.sqrt((self.x**2).sum(axis=1))
        self.unit = (self.x / np.maximum(self.length, 1e-300)[:, None]).astype(np.float32)
        ids = get("ids").values.to_numpy(zero_copy_only=False)
        self.ids = ids.astype(str) if ids.dtype == object else ids
        self.groups = get("groups").as_py()


def _shared(a: list, b: list) -> np.ndarray:
    """Which pairs share a group."""
    if all(s is None or len(s) < 2 for s in (*a, *b)):
        number: dict = {}
        one = [np.array([number.setdefault(s[0], len(number)) if s else -1 - k for s in side], np.int32) for k, side in enumerate((a, b))]
        return np.equal.outer(*one)
    keys = {g: i for i, g in enumerate({g for s in (*a, *b) for g in s or ()})}
    one = [np.zeros((len(side), len(keys)), np.float32) for side in (a, b)]
    for m, side in zip(one, (a, b), strict=True):
        for i, s in enumerate(side):
            m[i, [keys[g] for g in s or ()]] = 1
    return one[0] @ one[1].T > 0


class _Nearest:
    """The k best targets of each source of a block in one lane, as targets come. Scores count to nine digits; of equal
    ones the smaller ids are better."""

    def __init__(self, source: _Block, k: int, least: float):
        self.source, self.k, self.least = source, k, max(0.0, least)
        # products of unit vectors in single precision are off by at most this
        self.slack = (source.x.shape[1] + 4) * 1.3e-7 + 2e-9
        self.floor = np.full(len(source.ids), self.least, np.float64)  # the k-th best score so far
        self.full = np.zeros(len(source.ids), bool)
        self.i, self.ids, self.score = np.zeros(0, np.int64), source.ids[:0], np.zeros(0)

    def offer(self, start: int, rough: np.ndarray, target: _Block, allowed: np.ndarray | None = None) -> None:
        """rough: scores of sources from start on. allowed: which pairs are of the lane; all if None."""
        rows = slice(start, start + len(rough))
        floor = (self.floor[rows] - self.slack).astype(np.float32)
        short = np.flatnonzero(~self.full[rows])
        if len(short) and rough.shape[1] > self.k:
            own = rough[short] if allowed is None else np.where(allowed[short], rough[short], np.float32(-np.inf))
            best = np.partition(own, rough.shape[1] - self.k, axis=1)[:, rough.shape[1] - self.k]
            floor[short] = np.maximum(floor[short], best - np.float32(2 * self.slack))
        may = rough > floor[:, None]
        if allowed is not None:
            may &= allowed
        at = np.flatnonzero(may.any(axis=1))
        i, j = np.nonzero(may[at])
        i = at[i]
        for at in range(0, len(i), PAIRS):
            self._take(i[at : at + PAIRS] + start, j[at : at + PAIRS], target)

    def _take(self, i: np.ndarray, j: np.ndarray, target: _Block) -> None:
        # a row's own sum of products: the same wherever the row is
        score = (self.source.x[i] * target.x[j]).sum(axis=1) / np.maximum(self.source.length[i] * target.length[j], 1e-300)
        keep = (score > self.least) & (np.round(score, 9) >= np.round(self.floor[i], 9))
        if not keep.any():
            return
        i, j, score = i[keep], j[keep], score[keep]
        touched = np.isin(self.i, i)
        own, ids, score = np.concatenate([self.i[touched], i]), np.concatenate([self.ids[touched], target.ids[j]]), np.concatenate([self.score[touched], score])
        order = np.lexsort((ids, -np.round(score, 9), own))
        own, ids, score = own[order], ids[order], score[order]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        place = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
        full = place == self.k - 1
        self.floor[own[full]], self.full[own[full]] = score[full] - 1e-9, True
        kept = place < self.k
        self.i, self.ids, self.score = np.concatenate([self.i[~touched], own[kept]]), np.concatenate([self.ids[~touched], ids[kept]]), np.concatenate([self.score[~touched], score[kept]])


def lanes(vectors: DataFrame, k: int, scoped: bool, least: float = 0.0, block: int = BLOCK, asked: DataFrame | None = None) -> DataFrame:
    """source_id, target_id, score, lane: each source's k most similar others above ``least``; lane is "within" a shared
    group or "outside" if scoped (k of each), else "all". vectors: source_id, vector, groups (array or null).
    asked: those of the vectors that neighbours are wanted of; all if None.

    Each block of sources is sent all blocks of targets, in order, and keeps its best so far: products of unit vectors
    in single precision tell which pairs may be among them, only those are worked out in double precision. The work is
    quadratic, as all pairs are compared; what a task holds is two blocks, and it puts out k rows a source and lane.
    """
    kind = vectors.schema["source_id"].dataType.simpleString()
    spark = vectors.sparkSession
    number = max(1, math.ceil(vectors.count() / block))
    sources = vectors if asked is None else asked
    # sources come in blocks as small as all cores need
    n = sources.count()
    own = max(1, math.ceil(n / block), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / 512)))
    targets = _packed(vectors, number).withColumnRenamed("block", "step").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(own - 1))))
    both = _packed(sources, own).withColumn("step", F.lit(-1)).unionByName(targets)
    sent = both.repartitionById(own, F.col("block")).sortWithinPartitions("block", "step")
    names = ("within", "outside") if scoped else ("all",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for name, lane in zip(names, found, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(source.ids[lane.i], type_), pa.array(lane.ids, type_), pa.array(lane.score), pa.array([name] * len(lane.i), pa.string())], ["source_id", "target_id", "score", "lane"])

        source, found, block_, type_ = None, [], None, None
        for batch in batches:
            for at in range(batch.num_rows):
                if batch.column("block")[at].as_py() != block_:
                    yield from out() if source else ()
                    source, found, block_ = None, [], batch.column("block")[at].as_py()
                if batch.column("step")[at].as_py() < 0:
                    source = _Block(batch, at)
                    type_ = batch.schema.field("ids").type.value_type
                    found = [_Nearest(source, k, least) for _ in names]
                    continue
                if source is None:  # no source has this block's number
                    continue
                target = _Block(batch, at)
                same = pd.DataFrame({"id": source.ids, "i": np.arange(len(source.ids))}).merge(pd.DataFrame({"id": target.ids, "j": np.arange(len(target.ids))}), on="id")
                shared = _shared(source.groups, target.groups) if scoped else None
                for start in range(0, len(source.ids), 512):
                    rough = source.unit[start : start + 512] @ target.unit.T
                    here = same[(same["i"] >= start) & (same["i"] < start + len(rough))]
                    rough[here["i"].to_numpy() - start, here["j"].to_numpy()] = -np.inf
                    if not scoped:
                        found[0].offer(start, rough, target)
                        continue
                    within = shared[start : start + 512]
                    found[0].offer(start, rough, target, within)
                    found[1].offer(start, rough, target, ~within)
        if source:
            yield from out()

    return best_of(sent.mapInArrow(run, f"source_id {kind}, target_id {kind}, score double, lane string"), k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("source_id", "lane").orderBy(F.desc(F.round("score", 9)), "target_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(vectors: DataFrame, k: int = 8, least: float = 0.0, block: int = BLOCK) -> DataFrame:
    """source_id, target_id, score, rank."""
    return lanes(vectors, k, False, least, block).drop("lane")


def scoped_knn(vectors: DataFrame, k: int = 8, least: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Half the neighbours share a group, half do not; if a lane is short the other fills up. scope says which."""
    found = lanes(vectors, k, True, least, block)
    share = F.when(F.col("lane") == "within", math.ceil(k / 2)).otherwise(k // 2)
    order = Window.partitionBy("source_id").orderBy((F.col("rank") > share).cast("int"), F.when(F.col("rank") <= share, F.col("rank")).otherwise(0), F.when(F.col("rank") <= share, F.when(F.col("lane") == "within", 0).otherwise(1)).otherwise(0), F.desc(F.round("score", 9)), "target_id")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("source_id", "target_id", "score", F.when(F.col("lane") == "within", "within_collection").otherwise("whole_library").alias("scope"), "position")


def incremental_knn(edges: DataFrame, vectors: DataFrame, dirty: DataFrame, k: int = 8) -> DataFrame:
    """edges with the outgoing edges of dirty sources (source_id) computed again; others stay as they are."""
    asked = vectors.join(dirty.select("source_id"), "source_id", "left_semi")
    fresh = lanes(vectors, k, False, asked=asked).drop("lane")
    return edges.join(dirty.select("source_id"), "source_id", "left_anti").unionByName(fresh)


def fold_edges(edges: DataFrame) -> DataFrame:
    """left_id, right_id, score: the larger score of each unordered pair."""
    return edges.groupBy(F.least("source_id", "target_id").alias("left_id"), F.greatest("source_id", "target_id").alias("right_id")).agg(F.max("score").alias("score"))


def unit_means(vectors: DataFrame, key: str, normalise_first: bool) -> DataFrame:
    """key, dim, value: the mean of each key's vectors (made unit vectors first, if so asked), as a unit vector.

    Dimensions are averaged by a partial aggregation, so a key of any size costs one small row a task.
    """
    v = F.col("vector").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    v = F.transform(v, lambda x: x / norm) if normalise_first else v
    means = vectors.select(key, F.posexplode(v).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("m"))
    return means.join(means.groupBy(key).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length")), key).select(key, "dim", (F.col("m") / F.col("length")).alias("value"))


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """One row, ari: the adjusted Rand index of the partitions a and b; 1 if both are trivial."""
    two = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("double")
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    s = cells.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("total"))
    a = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sa"))
    b = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sb"))
    one = s.crossJoin(a).crossJoin(b)  # one row each
    expected = F.col("sa") * F.col("sb") / two("total")
    middle = (F.col("sa") + F.col("sb")) / 2
    return one.select(F.when(F.coalesce(middle == expected, F.lit(True)), 1.0).otherwise((F.col("s") - expected) / (middle - expected)).alias("ari"))
