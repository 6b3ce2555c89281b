"""Sources and sinks: Markdown notes with front matter, decoded bytes, tables that are only written if they changed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def front_matter(x: Column) -> Column:
    """The lines between a leading --- and the next ---; empty if there are none."""
    return F.regexp_extract(x, r"(?s)^---\r?\n(.*?)\r?\n---\r?\n", 1)


def body(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)^---\r?\n.*?\r?\n---\r?\n", "")


def field(matter: Column, name: str) -> Column:
    """A scalar field of front matter, without quotes; null if it is not there."""
    return F.nullif(F.regexp_replace(F.regexp_extract(matter, rf"(?m)^{name}:[ \t]*([^\n\r]*)", 1), "^[\"']|[\"']$", ""), F.lit(""))


def wiki_links(x: Column) -> Column:
    """Targets of [[links]], without display text and fragment."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda t: F.trim(t))


def section(x: Column, heading: str) -> Column:
    """The text of a ## heading up to the next one."""
    return F.trim(F.regexp_extract(F.concat(x, F.lit("\n## ")), rf"(?s)## {heading}[ \t]*\r?\n(.*?)\n## ", 1))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """path, matter, body, title, links of the Markdown files under a path; one row a file."""
    text = F.decode("content", "UTF-8")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path).select("path", text.alias("text"))
    return files.select("path", front_matter(F.col("text")).alias("matter"), body(F.col("text")).alias("body")).select("path", "matter", "body", field(F.col("matter"), "title").alias("title"), wiki_links(F.col("body")).alias("links"))


def decode_bytes(data: bytes) -> str:
    """UTF-8 with or without mark, UTF-16 with a mark, else Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        try:
            return data.decode("utf-16")
        except UnicodeDecodeError:
            pass
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def decoded(files: DataFrame) -> DataFrame:
    """path, text of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [decode_bytes(bytes(c)) for c in b["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows and the sum of their hashes, which does not depend on their order."""
    r = df.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).head()
    return int(r[0]), int(r[1] or 0)


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Writes a table unless the one at path has the same rows; says whether it wrote."""
    try:
        old = df.sparkSession.read.parquet(path)
        if sorted(old.columns) == sorted(df.columns) and fingerprint(old) == fingerprint(df):
            return False
    except AnalysisException:  # nothing there yet
        pass
    df.write.mode("overwrite").parquet(path)
    return True
