"""Streams of changes: which sources are dirty, and windows over event time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir


def dirty(changes: DataFrame) -> DataFrame:
    """source_id, fingerprint, changes: a source is dirty in a batch if its latest fingerprint differs from the one last seen.

    changes: source_id, at, fingerprint. State is one fingerprint and one count a source; what repeats a known
    fingerprint gives no work, so a replay is idempotent.
    """
    kind = changes.schema["source_id"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = None
        for rows in batches:
            newest = rows.sort_values(["at", "fingerprint"]).iloc[-1]
            if last is None or (newest["at"], newest["fingerprint"]) > last:
                last = (newest["at"], newest["fingerprint"])
        known, n = state.get if state.exists else (None, 0)
        if last is not None and last[1] != known:
            state.update((last[1], n + 1))
            yield pd.DataFrame({"source_id": [key[0]], "fingerprint": [last[1]], "changes": [n + 1]})

    return changes.groupBy("source_id").applyInPandasWithState(step, f"source_id {kind}, fingerprint string, changes long", "fingerprint string, changes long", "append", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of event-time windows; state older than the watermark is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length, slide or length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def settled(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives once all that is there has been read, as a table in the shared folder.

    Batches are written by their number, so a batch that is repeated replaces itself.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select(*stream.columns)
