"""Vectors in blocks: what near-duplicate search and nearest neighbours share."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def numbered(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """rid (a number of each row), id, x (array<double>) and d, written; x and d are null for a vector that takes no part:
    null, empty, zero, or with a null or non-finite component."""
    x = F.col("x")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    useful = F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return written(rows.select("id", F.when(useful, x).alias("x"), F.when(useful, F.size(x)).alias("d")).withColumn("rid", F.monotonically_increasing_id()), "vectors")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """d, block, blocks, n, ids, none (which ids are null), rids, data: at most about ``size`` vectors of one dimension a row, written.

    A vector's block follows from its row number's hash, so blocks are alike large whatever the vectors are.
    """
    counts = rows.where("d is not null").groupBy("d").count().collect()  # one row for each dimension that occurs
    number = F.lit(1)
    for d, n in counts:
        number = F.when(F.col("d") == d, F.lit(max(1, math.ceil(n / size)))).otherwise(number)

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rid")
        x = np.array(part["x"].tolist(), "<f8")
        small = x.astype("<f4")
        return pd.DataFrame({
            "d": [part["d"].iloc[0]], "block": [part["block"].iloc[0]], "blocks": [part["blocks"].iloc[0]], "n": [len(part)],
            "ids": [part["id"].fillna(0).to_numpy("<i8").tobytes()], "none": [part["id"].isna().to_numpy().tobytes()], "rids": [part["rid"].to_numpy("<i8").tobytes()],
            "data": [(small if (small == x).all() else x).tobytes()],
        })

    dealt = rows.where("d is not null").withColumn("blocks", number).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    return written(dealt.groupBy("d", "block").applyInPandas(packed, "d int, block int, blocks int, n int, ids binary, none binary, rids binary, data binary"), "blocks")


def matrix(data: bytes, n: int, d: int) -> np.ndarray:
    """The vectors of a block in double precision."""
    return np.frombuffer(data, "<f4" if len(data) == 4 * n * d else "<f8").reshape(n, d).astype(np.float64)
