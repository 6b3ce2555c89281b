"""Operator 8: near-duplicate embeddings by int8 tile products with rigorous error bounds.

A unit vector x is stored as s q with int8 q and has the quantisation error e = |x - s q|. For two of them
|x y - (s q)(t r)| <= e + f + e f, so the tile product of the quantised vectors plus that bound is never below the
cosine. Only pairs whose upper bound reaches the threshold are computed again, from the original vectors in
double precision. Tiles give links per vector and stars of what is connected, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .ngram_join import stars
from .vectors import blocks, matrix, numbered

THRESHOLD = 0.95
#: Vectors in a block, and rows of one of a tile's two blocks that are multiplied at a time.
BLOCK, ROWS = 8192, 1024
#: Dimensions whose int8 products add up exactly in single precision: 127 * 127 * 1024 < 2 ** 24.
EXACT = 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and error norms of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int8 rows, exact: whole numbers that single precision holds, added in double beyond EXACT dimensions."""
    parts = [a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T for k in range(0, a.shape[1], EXACT)]
    return parts[0] if len(parts) == 1 else sum(p.astype(np.float64) for p in parts)


def tile_links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) of unit vectors with a cosine of at least the threshold; same: x is y, each pair once.

    The cosine is at most s t (q r) + e + f + e f, so a pair that the whole number q r leaves below is not computed.
    """
    (q, s, e), (r, t, f) = quantised(x), quantised(y)
    slack = 1e-12 * x.shape[1]  # of the double precision in which e, f and cosines themselves are computed
    a, b = [], []
    for at in range(0, len(x), ROWS):
        start = at if same else 0
        own = slice(at, at + ROWS)
        upper = products(q[own], r[start:]).astype(np.float64)
        upper *= s[own, None]
        upper *= t[None, start:]
        upper += f[None, start:] * (1 + e[own, None])
        upper += e[own, None]
        i, j = np.divmod(np.flatnonzero(upper >= threshold - slack), upper.shape[1])
        i, j = i + at, j + start
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 18):
            part = slice(k, k + (1 << 18))
            close = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= threshold
            a.append(i[part][close])
            b.append(j[part][close])
    return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors of other dimensions,
    are not linked; such a row is its own component. Null ids come last when the smallest id is taken. Rows with
    equal ids are rows of their own; all of them are kept if their id is the component's. Extra columns are not read.
    """
    rows = numbered(table, id_col, vector_col)
    packed = blocks(rows, block)
    # each pair of blocks once: a block goes to those that are not below it
    other = packed.select("d", F.col("block").alias("hi"), *(F.col(c).alias(f"{c}_b") for c in ("n", "ids", "none", "rids", "data")))
    tiles = packed.select("*", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("hi")).join(other, ["d", "hi"])
    node = "struct<none: boolean, id: bigint, rid: bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                x, same = unit(matrix(t["data"], t["n"], t["d"])), t["block"] == t["hi"]
                y = x if same else unit(matrix(t["data_b"], t["n_b"], t["d"]))
                i, j = tile_links(x, y, same, threshold)
                join = lambda c, kind: np.concatenate([np.frombuffer(t[c], kind), np.frombuffer(t[c + "_b"], kind) if not same else np.zeros(0, kind)])  # noqa: E731, B023
                none, ids, rids = join("none", bool), join("ids", "<i8"), join("rids", "<i8")
                j = j if same else j + t["n"]
                links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                has = np.flatnonzero(links)
                place = np.full(len(ids), -1)
                place[has] = np.arange(len(has))
                follow = np.array(stars(len(has), place[i], place[j]), np.int64)
                to = has[np.maximum(follow, 0)]
                struct = lambda at, mask=None: pa.StructArray.from_arrays([pa.array(none[at]), pa.array(ids[at]), pa.array(rids[at])], ["none", "id", "rid"], mask=mask)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([struct(has), struct(to, pa.array(follow < 0)), pa.array(links[has], pa.int64())], ["node", "next", "links"])

    found = written(tiles.select("d", "block", "hi", "n", "ids", "none", "rids", "data", "n_b", "ids_b", "none_b", "rids_b", "data_b").mapInArrow(run, f"node {node}, next {node}, links long"), "links")
    labels = components(found.where("next is not null").select(F.col("node").alias("a"), F.col("next").alias("b")))
    info = found.groupBy(F.col("node.rid").alias("rid")).agg(F.sum("links").alias("links")).join(labels.select(F.col("node.rid").alias("rid"), "label"), "rid")
    component = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.when(F.col("label.none"), F.lit(None)).otherwise(F.col("label.id")))
    return rows.select("rid", "id").join(info, "rid", "left").select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
