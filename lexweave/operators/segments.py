"""Text segmentation with exact offsets, and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread


def lossless_chunks(texts: DataFrame, size: int = 2000) -> DataFrame:
    """source_id, chunk, start, text: consecutive pieces whose concatenation is the text."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / size)).cast("int")
    return texts.select("source_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select("source_id", "chunk", (F.col("chunk") * size).alias("start"), F.substring(F.col("text"), F.col("chunk") * size + 1, F.lit(size)).alias("text"))


def token_windows(texts: DataFrame, size: int = 128, step: int = 96) -> DataFrame:
    """source_id, window, tokens: overlapping runs of white-space tokens; the last window reaches the end."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = texts.select("source_id", words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step)).cast("int")
    return rows.select("source_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("window")).select("source_id", "window", F.array_join(F.slice("w", F.col("window") * step + 1, F.lit(size)), " ").alias("tokens"))


def chunk_identity(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_id: the hash of content and of which occurrence in its source it is."""
    order = Window.partitionBy("source_id", "text").orderBy("start")
    return chunks.withColumn("occurrence", F.row_number().over(order)).withColumn("chunk_id", F.sha2(F.concat_ws("|", "text", F.col("occurrence").cast("string")), 256))


def merge_intervals(spans: DataFrame) -> DataFrame:
    """owner, start, end of spans (owner, start, end) with overlapping and touching ones made one."""
    before = Window.partitionBy("owner").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("owner").orderBy("start", "end")
    spans = spread(spans, spans.count(), "owner")
    marked = spans.withColumn("fresh", (F.col("start") > F.coalesce(F.max("end").over(before), F.col("start") - 1)).cast("int"))
    return marked.withColumn("island", F.sum("fresh").over(upto)).groupBy("owner", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def disjoint(spans: DataFrame) -> DataFrame:
    """owner, valid: whether an owner's spans are ordered and do not overlap."""
    order = Window.partitionBy("owner").orderBy("start", "end")
    return spans.withColumn("last", F.lag("end").over(order)).groupBy("owner").agg(F.bool_and((F.col("end") > F.col("start")) & (F.coalesce("last", F.col("start")) <= F.col("start"))).alias("valid"))


def near_pages(claims: DataFrame, pages: DataFrame, reach: int = 1) -> DataFrame:
    """Claims (claim, doc, page) with the pages around theirs, by an equi-join on the few pages in reach."""
    around = claims.select("claim", "doc", F.col("page").alias("cited"), F.explode(F.sequence(F.col("page") - reach, F.col("page") + reach)).alias("page"))
    return around.join(pages, ["doc", "page"])
