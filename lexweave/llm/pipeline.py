"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what it keeps of docs.

    toxicity      drops documents that the model predicts to be toxic
    language_id   drops documents whose language stays undetermined or unsure
    ngram_join    keeps one document of each near-duplicate class
    packing       gives each document's pieces a place in a sequence
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import language_id, ngram_join, packing, toxicity
from .common import dropped, lean, written
from .queries import table, vocabulary

#: A language that is predicted with less than this is unsure.
SURE = 0.5


def keep_where(docs: DataFrame, text_col: str, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows of docs, all columns, whose text passes; make gives each task its test."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = make()
        for b in batches:
            yield b.filter(pa.array([good(t.as_py()) for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below 0.5; a null text is an empty one. Without labels nothing is toxic.

    Repeated rows fare alike, null ids are never learned from, an empty table gives none, other columns are carried along.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    terms, fuzzy, weights, context = model.terms, model.fuzzy, model.weights, model.context

    def make() -> Callable[[str | None], bool]:
        own = toxicity.Model(terms, fuzzy, weights, context)
        return lambda t: own.score(t or "") < 0.5

    return keep_where(docs, "text", make)


def drop_unsure_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is predicted with SURE or more. Texts that are null or have no letter are undetermined and go,
    and so do all if there is no language to learn from.

    Repeated rows fare alike; of equally likely languages the first by name counts; other columns are carried along.
    """
    model = language_id.fit(language_id.training_rows(docs))

    def good(t: str | None) -> bool:
        language, score = model.predict(t)
        return language != language_id.UNDETERMINED and score >= SURE

    return keep_where(docs, "text", lambda: good)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, the one of smallest id; null ids come last, of repeated rows one stays.

    Null and blank texts are like no other and stay. All columns are carried along.
    """
    return ngram_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place, see packing.pack: null texts are empty ones, null ids and repeated rows are packed like others."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json").read_text(encoding="utf-8"))


STAGES = [("toxicity", drop_toxic), ("language_id", drop_unsure_language), ("ngram_join", drop_near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table is deleted once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            dropped(last)
        last = docs
    return docs
