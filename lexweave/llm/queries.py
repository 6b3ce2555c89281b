"""Registered queries of the operators in this subpackage, over the whole tables they are meant for."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, language_id, license_scan, lm_scoring, ngram_join, oracles, packing, sentencepiece_codec, toxicity, vector_search, warc


def vocabulary(name: str) -> Path:
    """A public vocabulary file's place; read on the driver, its content (under 5 MB) goes out with the tasks."""
    import public_tokenizers

    return Path(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model").read_bytes())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json").read_text(encoding="utf-8"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_license_scan": op5_license_scan,
    "op6_ngram_join": op6_ngram_join,
    "op7_packing": op7_packing,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_vector_search": op9_vector_search,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {"op4_warc": warc.oracle_sql(), "op6_ngram_join": oracles.NGRAM_JOIN, "op8_embedding_dedup": oracles.EMBEDDING_DEDUP}
