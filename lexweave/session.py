"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once a context, so that Python operators can be imported there."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        handle, path = tempfile.mkstemp(prefix="lexweave-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(path, "w") as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, Path(root.name) / p.relative_to(root))
        context.addPyFile(path)
        _SHIPPED[context.applicationId] = path
    return spark


_OWN: list = []  # a test session's temporary folder


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary one takes its place on one machine (a local master); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.TemporaryDirectory(prefix="lexweave-"))
    return f"file://{_OWN[0].name}"


#: Rows that a task groups or orders: a step whose rows are known in number is dealt to so many tasks.
ROWS = 1_000_000


def spread(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """df dealt by keys to tasks of about ROWS of its ``rows`` rows, so that a task's memory does not grow with the table.

    Tasks of a shuffle are as large as its bytes and the session's number of partitions make them otherwise.
    """
    number = -(-(rows or 0) // ROWS)
    return df.repartition(number, *keys) if number > 1 else df


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
