"""Hybrid retrieval: lexical and dense rankings, reciprocal-rank fusion, excerpts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import written

#: Queries are given by the caller; a table of up to so many words is sent to all tasks, a larger one shuffled.
WORDS_SENT = 200_000
#: Query vectors that go to all tasks at a time; a larger set is asked in blocks of about so many.
VECTORS_SENT = 1000
#: Query vectors whose scores are added up by arrays; more are asked as rows.
QUERIES_SENT = 20_000
#: Numbers in a task's table of weights (words by queries) and in its table of scores (sources by queries).
CELLS = 4_000_000


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """source_id, word: each text's set of words."""
    return docs.select(F.col(id_col).alias("source_id"), F.explode(tx.words(F.col(text_col))).alias("word"))


def document_frequency(posts: DataFrame) -> DataFrame:
    """word, df; posts hold a source's word once, so counting is enough."""
    return posts.groupBy("word").agg(F.count("*").alias("df"))


def lexical_scores(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query_id, source_id, score: the sum of idf over words that query and source share.

    queries: query_id, text. Only words of queries leave the scan of docs, so the shuffles are small.
    """
    asked = queries.select("query_id", F.explode(tx.words(F.col("text"))).alias("word"))
    terms = asked.select("word").distinct()
    if terms.count() <= WORDS_SENT:
        terms = F.broadcast(terms)
    posts = postings(docs, id_col, text_col).join(terms, "word", "left_semi")
    size = docs.agg(F.count("*").alias("n"))
    weights = document_frequency(posts).crossJoin(F.broadcast(size)).select("word", tx.idf(F.col("n"), F.col("df")).alias("w"))  # one row
    return posts.join(asked.join(weights, "word"), "word").groupBy("query_id", "source_id").agg(F.sum("w").alias("score")).where(F.col("score") > 0)


def lexical_ranked(docs: DataFrame, queries: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """query_id, source_id, score, rank: ``lexical_scores`` ranked to nine digits, without its row for each shared word.

    Texts are split once: a source's words that queries hold are written as numbers. A task adds up weights for some
    sources and all queries at a time and puts out what may be among the first of a query, so the shuffle grows with
    queries and tasks, not with matches. More words of queries than are sent to all tasks are joined as rows.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    asked = queries.select("query_id", F.explode(tx.words(F.col("text"))).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))
    found = asked.limit(WORDS_SENT + 1).collect()
    if not 0 < len(found) <= WORDS_SENT:
        return ranked(lexical_scores(docs, queries, id_col, text_col), most, digits=9)
    number, query = {w: i for i, w in enumerate(sorted({r["word"] for r in found}))}, {}
    places = np.array([(number[r["word"]], query.setdefault(r["query_id"], len(query)), r["times"]) for r in found])
    terms = F.broadcast(spark.createDataFrame(list(number.items()), "word string, term int"))  # at most WORDS_SENT
    # words of queries are no stop words and long enough, so those of texts need not be looked at for that
    words = docs.select(F.col(id_col).alias("source_id"), F.explode(F.array_distinct(tx.tokens(F.col(text_col)))).alias("word"))
    posts = written(words.join(terms, "word").groupBy("source_id").agg(F.sort_array(F.collect_list("term")).alias("terms")), "lexical-terms")
    df = document_frequency(posts.select(F.explode("terms").alias("word")))
    weight = np.zeros(len(number))
    for r in df.select("word", tx.idf(F.lit(docs.count()), F.col("df")).alias("w")).collect():
        weight[r["word"]] = r["w"]
    scores = posts.mapInArrow(_first_scores(places, weight, len(query), most), T.StructType([T.StructField("query", T.IntegerType()), T.StructField("source_id", kind), T.StructField("score", T.DoubleType())]))
    names = spark.createDataFrame([(i, q) for q, i in query.items()], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("query_id", queries.schema["query_id"].dataType)]))
    return ranked(scores.join(F.broadcast(names), "query").select("query_id", "source_id", "score"), most, digits=9)


def _first_scores(places: np.ndarray, weight: np.ndarray, queries: int, most: int):
    """A function over batches of source_id, terms: the scores that may be among the first ``most`` of a query.

    places: term, query, times. Scores within two units of the ninth digit of the last of them stay, of equal ones those
    of the smallest ids, so rounding and ties are decided by who ranks the rest.
    """
    block = max(1, CELLS // len(weight))
    step = max(most, CELLS // min(block, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, tables = np.full(queries, 1e-300), {}
        for b in batches:
            ids, flat = b.column(0), b.column(1).flatten().to_numpy()
            ends = np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
            place = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
            for first in range(0, queries, block):
                if first not in tables:
                    tables.clear()
                    own = places[(places[:, 1] >= first) & (places[:, 1] < first + block)]
                    tables[first] = np.zeros((len(weight), min(block, queries - first)))
                    tables[first][own[:, 0], own[:, 1] - first] = weight[own[:, 0]] * own[:, 2]
                table = tables[first]
                for at in range(0, len(ids), step):
                    bounds = [0 if at == 0 else int(ends[at - 1]), *ends[at : at + step].tolist()]
                    score = np.array([table[flat[lo:hi]].sum(axis=0) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)])
                    q, i, value = _among_first(score, floor[first : first + block], place[at : at + step], most, 2e-9)
                    yield pa.RecordBatch.from_arrays([pa.array(first + q, pa.int32()), ids.take(pa.array(at + i)), pa.array(value)], ["query", "source_id", "score"])

    return run


def _among_first(score: np.ndarray, low: np.ndarray, place: np.ndarray, most: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, source, score of what may be among the first ``most`` of a query; score: sources by queries, place: the order of
    sources by id, low: the least score of each query that may be, raised to what is known now, less ``slack``."""
    if len(score) > most:
        np.maximum(low, np.partition(score, len(score) - most, axis=0)[len(score) - most] - slack, out=low)
    q, i = np.nonzero((score >= low).T)
    value = score[i, q]
    order = np.lexsort((place[i], -value, q))
    q, i, value = q[order], i[order], value[order]
    n = np.arange(len(q))
    fresh = np.concatenate([[True], (q[1:] != q[:-1]) | (value[1:] != value[:-1])])[: len(q)]
    keep = n - np.maximum.accumulate(np.where(fresh, n, 0)) < most
    return q[keep], i[keep], value[keep]


def dense_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, source_id, score of all vectors (source_id, vector) for given query vectors (query_id, vector), negative ones too."""
    asked = queries.select("query_id", F.col("vector").alias("q"), F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // VECTORS_SENT)))).alias("part"))
    parts = sorted(r[0] for r in asked.select("part").distinct().collect())
    found = [vectors.crossJoin(F.broadcast(asked.where(F.col("part") == p))) for p in parts] or [vectors.crossJoin(asked)]
    return reduce(DataFrame.unionByName, found).select("query_id", "source_id", tx.dot(F.col("vector"), F.col("q")).alias("score"))


def dense_ranked(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """query_id, source_id, score, rank: ``dense_scores`` ranked, without its row for each pair.

    Products are added up in the order of the components, as in ``dense_scores``, for some sources and some queries at a
    time; a task puts out what may be among the first of a query. Vectors with nulls, numbers that are not finite or whose
    products might not be, or another length than the queries' are looked at as rows, and so are all if a query is such.
    """
    spark, kind = vectors.sparkSession, vectors.schema["source_id"].dataType
    whole = lambda c: F.col(c).cast("array<double>")
    finite = lambda c: F.coalesce(F.forall(whole(c), lambda x: F.coalesce(F.abs(x) < 1e150, F.lit(False))), F.lit(False))
    asked = queries.select("query_id", whole("vector").alias("vector"), F.when(finite("vector"), F.size("vector")).alias("d"))
    found = asked.limit(QUERIES_SENT + 1).collect()
    lengths = {r["d"] for r in found}
    if len(found) > QUERIES_SENT or len(lengths) != 1 or not max(lengths, key=lambda d: d or 0):
        return ranked(dense_scores(vectors, queries), most)
    d = lengths.pop()
    plain = finite("vector") & (F.size("vector") == d)
    q = np.array([r["vector"] for r in found], np.float64)
    step = max(most, CELLS // min(len(q), VECTORS_SENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(len(q), -np.inf)
        for b in batches:
            ids = b.column(0)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            place = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
            for first in range(0, len(q), VECTORS_SENT):
                by = np.ascontiguousarray(q[first : first + VECTORS_SENT].T)
                for at in range(0, len(ids), step):
                    part = x[at : at + step]
                    score, one = np.zeros((len(part), by.shape[1])), np.empty((len(part), by.shape[1]))
                    for k in range(d):
                        score += np.multiply(part[:, k, None], by[k], out=one)
                    n, i, value = _among_first(score, floor[first : first + VECTORS_SENT], place[at : at + step], most, 0.0)
                    yield pa.RecordBatch.from_arrays([pa.array(first + n, pa.int32()), ids.take(pa.array(at + i)), pa.array(value)], ["query", "source_id", "score"])

    scores = vectors.where(plain).select("source_id", whole("vector")).mapInArrow(run, T.StructType([T.StructField("query", T.IntegerType()), T.StructField("source_id", kind), T.StructField("score", T.DoubleType())]))
    names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(found)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("query_id", queries.schema["query_id"].dataType)]))
    rest = dense_scores(vectors.where(~plain), queries)
    return ranked(scores.join(F.broadcast(names), "query").select("query_id", "source_id", "score").unionByName(rest), most)


def ranked(scores: DataFrame, most: int, score: str = "score", digits: int | None = None) -> DataFrame:
    """The first ``most`` sources of each query by (-score, id); ranks are pruned in each task before the shuffle."""
    value = F.round(score, digits) if digits is not None else F.col(score)
    order = Window.partitionBy("query_id").orderBy(value.desc(), "source_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def reciprocal_rank(rankings: dict[str, DataFrame], constant: int = 60) -> DataFrame:
    """query_id, source_id, score, and each route's rank: the sum of 1 / (constant + rank) over rankings."""
    both = None
    for name, r in rankings.items():
        part = r.select("query_id", "source_id", F.lit(name).alias("route"), "rank")
        both = part if both is None else both.unionByName(part)
    ranks = [F.max(F.when(F.col("route") == name, F.col("rank"))).alias(f"{name}_rank") for name in rankings]
    return both.groupBy("query_id", "source_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"), *ranks)


def route(lexical: Column, dense: Column) -> Column:
    return F.when(lexical.isNotNull() & dense.isNotNull(), "hybrid").when(dense.isNotNull(), "semantic").otherwise("lexical")


def excerpt_offset(text: Column, query_words: Column, before: int = 160) -> Column:
    """Where an excerpt starts: so many characters before the first word of the query that occurs, else 0."""
    low = tx.fold(text)
    at = F.array_min(F.filter(F.transform(query_words, lambda w: F.position(w, low)), lambda p: p > 0))
    return F.greatest(F.coalesce(at, F.lit(1)) - 1 - before, F.lit(0))


def hybrid_recall(docs: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_route: int = 32, most: int = 8) -> DataFrame:
    """query_id, source_id, rank, score, route, offset: both routes' first sources, fused, the best of them with an excerpt."""
    lexical = lexical_ranked(docs, queries, per_route, id_col, text_col)
    known = vectors.join(docs.select(F.col(id_col).alias("source_id")), "source_id", "left_semi")
    dense = dense_ranked(known, query_vectors, per_route)
    fused = ranked(reciprocal_rank({"lexical": lexical, "dense": dense}), most, digits=12)
    asked = queries.select("query_id", tx.words(F.col("text")).alias("asked"))
    # at most queries x most rows: the documents are scanned once more and only these are kept
    found = fused.join(asked, "query_id").join(docs.select(F.col(id_col).alias("source_id"), F.col(text_col).alias("text")), "source_id")
    return found.select("query_id", "source_id", "rank", F.round("score", 9).alias("score"), route(F.col("lexical_rank"), F.col("dense_rank")).alias("route"), excerpt_offset(F.col("text"), F.col("asked")).alias("offset"))
