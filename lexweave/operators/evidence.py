"""Evidence packets that keep to a budget, fidelity of claims to pages, samples and counts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The longest excerpt of a source.
EXCERPT = 2000


def packet_size(notes: list[dict]) -> int:
    return len(json.dumps({"notes": notes, "relationships": []}, ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def fit(rows: list[dict], most: int) -> tuple[int, int]:
    """How many of some ranked rows (with text and start) stay, and the longest common excerpt, so that the packet keeps to ``most`` characters.

    Rows go from the end while not even one character of each fits.
    """

    def notes(n: int, cap: int) -> list[dict]:
        return [{**{k: v for k, v in r.items() if k not in ("text", "start")}, "text": r["text"][:cap], "excerpt_start": r["start"], "excerpt_end": r["start"] + len(r["text"][:cap])} for r in rows[:n]]

    if packet_size([]) > most:
        raise ValueError("the budget cannot hold an empty packet")
    n = len(rows)
    while n and packet_size(notes(n, 1)) > most:
        n -= 1
    low, high = (1 if n else 0), EXCERPT
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if packet_size(notes(n, middle)) <= most else (low, middle - 1)
    return n, low


def excerpts(found: DataFrame, docs: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, source_id, rank, route, excerpt_start, excerpt_end, excerpt of what a packet of ``most`` characters a query holds.

    found: query_id, source_id, rank, route, offset, a few sources a query; only their excerpts leave the scan of docs.
    """
    text = docs.select(F.col(id_col).alias("source_id"), F.col(text_col).alias("whole"))
    rows = found.join(text, "source_id").select("query_id", "source_id", "rank", "route", F.col("offset").cast("long").alias("start"), F.col("whole").substr(F.col("offset") + 1, F.lit(EXCERPT)).alias("text"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("query_id", "source_id", "rank")}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank").reset_index(drop=True)
        n, cap = fit([{"source_id": str(r.source_id), "recall_route": r.route, "start": int(r.start), "text": r.text} for r in part.itertuples()], most)
        part = part.head(n)
        part = part.assign(excerpt=part["text"].str.slice(0, cap), excerpt_start=part["start"])
        return part.assign(excerpt_end=part["start"] + part["excerpt"].str.len())[["query_id", "source_id", "rank", "route", "excerpt_start", "excerpt_end", "excerpt"]]

    return rows.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, source_id {kinds['source_id']}, rank {kinds['rank']}, route string, excerpt_start long, excerpt_end long, excerpt string")


def fidelity(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """claim_id, risks: invalid_page, numbers_absent (of the cited page and those beside it), adjacent_page_better.

    claims: claim_id, doc, page, numbers (array); pages: doc, page, numbers. The range join is an equi-join on the
    three pages of a claim.
    """
    near = claims.select("claim_id", "doc", F.col("page").alias("cited"), F.col("numbers").alias("own"), F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page"))
    hits = near.join(pages, ["doc", "page"], "left").withColumn("hit", F.size(F.array_intersect("own", F.coalesce("numbers", F.array().cast("array<double>")))))
    seen = hits.groupBy("claim_id").agg(
        F.max(F.when(F.col("page") == F.col("cited"), F.col("numbers").isNotNull())).alias("exists"), F.max(F.when(F.col("page") == F.col("cited"), F.col("hit"))).alias("at"),
        F.max(F.when(F.col("page") != F.col("cited"), F.col("hit"))).alias("beside"), F.max("hit").alias("best"), F.first(F.size("own")).alias("size"),
    )
    risks = F.array(F.when(~F.col("exists"), "invalid_page"), F.when((F.col("size") > 0) & (F.col("best") == 0), "numbers_absent"), F.when(F.col("beside") > F.col("at"), "adjacent_page_better"))
    return seen.select("claim_id", F.array_join(F.array_compact(risks), ",").alias("risks"))


def strata_sample(rows: DataFrame, stratum: str, key: Column, sizes: dict[str, int]) -> DataFrame:
    """rows of each stratum that ``sizes`` names, the first so many by the hash of their key; fewer is an error of the caller's data."""
    most = F.lit(0)
    for name, n in sizes.items():
        most = F.when(F.col(stratum) == name, n).otherwise(most)
    order = Window.partitionBy(stratum).orderBy(F.sha2(key.cast("string"), 256))
    return rows.where(F.col(stratum).isin(*sizes)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def excluded_characters(spans: DataFrame) -> DataFrame:
    """kind, characters of spans (kind, start, end) that are excluded from a text; what has no kind is unknown."""
    return spans.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.sum(F.col("end") - F.col("start")).alias("characters"), F.count("*").alias("spans"))


def signal_counts(signals: DataFrame, samples: int = 6) -> DataFrame:
    """left_id, right_id, kind, n, samples of signals (left_id, right_id, kind, value): the first values are kept, all are counted."""
    own = signals.distinct().withColumn("place", F.row_number().over(Window.partitionBy("left_id", "right_id", "kind").orderBy("value")))
    return own.groupBy("left_id", "right_id", "kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= samples, F.col("value").cast("string")))), "|").alias("samples"))


def neighbourhood_rank(rows: DataFrame, scope: str, most: int) -> DataFrame:
    """The first ``most`` topics of a scope: propositions first, then by usefulness, members, tokens and id."""
    order = Window.partitionBy(scope).orderBy(F.desc("proposition"), F.desc("usefulness"), F.desc("members"), F.desc("tokens"), "topic")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
