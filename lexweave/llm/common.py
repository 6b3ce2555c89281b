"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Entries that a worker's word cache holds before it is emptied; bounds the memory of a Python worker.
CACHE_ENTRIES = 350_000

_PATHS: WeakKeyDictionary = WeakKeyDictionary()  # where written tables are


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, _PATHS.pop(df)
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def placed(docs: DataFrame) -> DataFrame:
    """The rows of docs as ``doc`` with ``key``: the hash of a row's file and its number there, the same at each reading.

    Rows that do not come from such files as they are (a table in memory, a shuffle) are written first.
    """
    try:
        at = docs.metadataColumn("_metadata")
        return docs.select(F.struct("*").alias("doc"), F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row")).alias("key"))
    except AnalysisException:
        return placed(written(docs, "rows"))


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system: it lives on between stages beside a full heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives freed memory back at the end of each task."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are done, whose results are in written tables."""
    for _ in range(2):  # the first lets go of plans, the second of the shuffles that they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def packed_ints(x: np.ndarray) -> bytes:
    """Unsigned integers, byte by byte in planes, compressed: high bytes that are zero take no place."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def unpacked_ints(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column's text form, modulo n; null where the column is null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def id_text(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text (null: empty) of documents and nothing else, so that other columns are never read."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


class WordCache(dict):
    """word -> value, computed once a word; emptied when it is full, so a worker's memory is bounded."""

    def __init__(self, compute, entries: int = CACHE_ENTRIES, longest: int = 64):
        super().__init__()
        self.compute, self.entries, self.longest = compute, entries, longest

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[word] = value
        return value


def sampled(rows: DataFrame, label: str, id_col: str, most: int, counts: dict | None = None) -> DataFrame:
    """About ``most`` rows, alike many of each label: a row stays if the hash of its id is below its label's rate.

    The choice depends on ids and on the number of rows of each label only, so it is the same in each run.
    """
    counts = counts if counts is not None else {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    each = max(1, most // len(counts))
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, each / n))).otherwise(rate)
    return rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30)) < rate * (1 << 30))
