"""Text quality, statements and evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that tell a statement's direction and what a number estimates, in the order they are tried.
DIRECTIONS = {
    "negative": ["decrease", "decreased", "decline", "declined", "lower", "negative", "reduce", "reduced"],
    "positive": ["increase", "increased", "higher", "positive", "raise", "raised", "grow", "grew"],
    "no_clear_difference": ["no difference", "null effect", "not statistically significant", "unchanged"],
    "mixed": ["mixed", "heterogeneous", "varied", "inconsistent"],
}
ESTIMANDS = {
    "model_predicted_probability": ["predicted probability", "model probability"],
    "marginal_effect": ["marginal effect"],
    "odds_ratio": ["odds ratio"],
    "hazard_ratio": ["hazard ratio"],
    "coefficient": ["coefficient", "beta"],
    "observed_rate": ["observed rate", "success rate", "prevalence", "proportion"],
    "raw_percentage": ["%", "percent"],
}


def first_class(x: Column, table: dict[str, list[str]], otherwise: str) -> Column:
    """The first class any of whose terms the text holds."""
    low, out = F.lower(x), None
    for name, terms in table.items():
        any_ = low.contains(terms[0])
        for t in terms[1:]:
            any_ = any_ | low.contains(t)
        out = F.when(any_, name) if out is None else out.when(any_, name)
    return out.otherwise(otherwise)


def clean(x: Column) -> Column:
    x = F.regexp_replace(F.replace(x, F.lit("\x00"), F.lit(" ")), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def word_count(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def plain_text_scope(x: Column) -> Column:
    c = clean(x)
    return F.when((F.length(c) >= 80) & (word_count(c) >= 8), "full_document").otherwise("metadata_only")


def numeric_tokens(x: Column) -> Column:
    """Signed decimals without commas or plus sign, a zero before a bare point."""
    found = F.regexp_extract_all(x, F.lit(r"[+-]?(?:[0-9][0-9,]*)?\.?[0-9]+%?"), F.lit(0))
    return F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(F.replace(t, F.lit(","), F.lit("")), r"^\+", ""), r"^(-?)\.", "$10."))


def repeated_lines(pages: DataFrame, least: int = 3) -> DataFrame:
    """line, pages: lines, numbers made #, that stand on at least so many pages. pages: page, text."""
    line = F.explode(F.split("text", "\n")).alias("line")
    units = pages.select("page", line).select("page", F.trim(F.regexp_replace(F.lower("line"), "[0-9]+", "#")).alias("line")).where("line <> ''").distinct()
    return units.groupBy("line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)


class _Page(HTMLParser):
    BLOCKS = {"p", "li", "div", "h1", "h2", "h3", "h4", "td", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.article, self.blocks, self.words, self.article_words, self.paragraphs = 0, 0, 0, 0, 0, 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")
        self.article += tag == "article"
        self.blocks += tag in self.BLOCKS
        self.paragraphs += tag == "p" and self.article > 0

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript") and self.hidden > 0
        self.article -= tag == "article" and self.article > 0

    def handle_data(self, data):
        if not self.hidden:
            n = len(data.split())
            self.words += n
            self.article_words += n if self.article else 0


def html_scope(html: str | None) -> str:
    """What a page holds: a strong article, strong visible text, or metadata only."""
    p = _Page()
    p.feed(html or "")
    if p.article_words >= 300 and p.paragraphs >= 2:
        return "article"
    return "visible_text" if p.words >= 500 and p.blocks >= 4 else "metadata_only"


def html_adequacy(pages: DataFrame) -> DataFrame:
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "scope": [html_scope(h) for h in b["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, f"page_id {kind}, scope string")


def evidence_recall(units: DataFrame, notes: DataFrame) -> DataFrame:
    """unit_id, source_found, passage_found: whether a unit's source was retrieved and its quote stands in the excerpt.

    units: unit_id, source_id, quote (one row an alternative). notes: source_id, excerpt.
    """
    squeezed = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    both = units.join(notes, "source_id", "left")
    return both.groupBy("unit_id").agg(F.bool_or(F.col("excerpt").isNotNull()).alias("source_found"), F.bool_or(F.coalesce(squeezed("excerpt").contains(squeezed("quote")), F.lit(False))).alias("passage_found"))


def paired_deltas(base: DataFrame, challenger: DataFrame) -> DataFrame:
    """improved, regressed, equal, mean: a challenger's value less the baseline's, task by task."""
    d = base.select("task", F.col("value").alias("b")).join(challenger.select("task", F.col("value").alias("c")), "task").select((F.col("c") - F.col("b")).alias("d"))
    return d.agg(F.count(F.when(F.col("d") > 0, 1)).alias("improved"), F.count(F.when(F.col("d") < 0, 1)).alias("regressed"), F.count(F.when(F.col("d") == 0, 1)).alias("equal"), F.avg("d").alias("mean"))


def consensus(reviews: DataFrame) -> DataFrame:
    """pair, label, valid: the label if exactly two reviewers gave the same, else uncertain; not valid if one reviewed twice."""
    g = reviews.groupBy("pair").agg(F.count("*").alias("n"), F.countDistinct("reviewer").alias("people"), F.countDistinct("label").alias("kinds"), F.min("label").alias("first"))
    return g.select("pair", F.when((F.col("n") == 2) & (F.col("kinds") == 1), F.col("first")).otherwise("uncertain").alias("label"), (F.col("n") == F.col("people")).alias("valid"))


def holdout(rows: DataFrame, stratum: str, fraction: float = 0.2, version: str = "v1") -> DataFrame:
    """source_id of held-out rows: of each stratum the first ceil(fraction) by hash, at least one stays in training.

    The hash's rank is counted in two steps (per prefix, then inside the one prefix that is cut), so a stratum of any
    size is never one task's window.
    """
    h = F.sha2(F.concat_ws("|", F.lit(version), F.col(stratum).cast("string"), F.col("source_id").cast("string")), 256)
    keyed = rows.select("source_id", F.col(stratum).alias("s"), h.alias("h")).withColumn("prefix", F.substring("h", 1, 3))
    parts = keyed.groupBy("s", "prefix").agg(F.count("*").alias("n"))  # at most 4096 rows a stratum
    before = F.sum("n").over(Window.partitionBy("s").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("s", "prefix", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("s")).alias("total"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("s", "prefix").orderBy("h", "source_id"))
    quota = F.when(F.col("total") > 1, F.least(F.col("total") - 1, F.greatest(F.lit(1), F.ceil(F.col("total") * fraction)))).otherwise(0)
    return keyed.join(parts, ["s", "prefix"]).withColumn("rank", rank).where(F.col("rank") <= quota).select("source_id", F.col("s").alias(stratum))


def acceptance(top: Column, second: Column, choices: int, margin: float = 0.2, least: float = 0.5) -> tuple[Column, Column]:
    """(confidence, decision): confidence is top's distance from chance; a tie or a small margin defers, little confidence rejects."""
    confidence = (top - 1 / choices) / (1 - 1 / choices)
    return confidence, F.when(top == second, "unresolved_tie").when(top - second < margin, "defer_margin").when(confidence < least, "reject_confidence").otherwise("accept")


def graph_value(edges: DataFrame, reviews: DataFrame) -> DataFrame:
    """edges with shown and priority: inferred edges judged redundant or misleading are hidden, useful ones come first; an
    edge reviewed twice counts as unreviewed. edges: left_id, right_id, inferred. reviews: left_id, right_id, verdict."""
    r = reviews.groupBy("left_id", "right_id").agg(F.when(F.count("*") == 1, F.min("verdict")).alias("verdict"))
    bad = F.col("inferred") & F.coalesce(F.col("verdict").isin("redundant", "misleading"), F.lit(False))
    return edges.join(r, ["left_id", "right_id"], "left").select("left_id", "right_id", (~bad).alias("shown"), F.when(bad, 0).when(F.col("verdict") == "useful", 2).otherwise(1).alias("priority"))
