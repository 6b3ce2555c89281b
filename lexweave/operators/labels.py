"""Phrases, contrastive community labels and their selection."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Container, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .. import session
from ..session import written


def phrases(x: Column, sizes: range = range(2, 5)) -> Column:
    """All runs of 2 to 4 words that neither start nor end with a stop word and are at most half stop words."""
    stop = F.array(*map(F.lit, tx.STOP_WORDS))

    def of(words: Column, n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n))
        return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<array<string>>"))

    good = lambda p: ~F.array_contains(stop, F.element_at(p, 1)) & ~F.array_contains(stop, F.element_at(p, -1)) & (2 * F.size(F.filter(p, lambda w: F.array_contains(stop, w))) <= F.size(p))
    runs = lambda words: F.transform(F.filter(F.concat(*(of(words, n) for n in sizes)), good), lambda p: F.array_join(p, " "))
    # the text is split once: a lambda's variable, not its expression, stands for the words
    return F.element_at(F.transform(F.array(tx.tokens(x)), runs), 1)


def phrase_weights(notes: DataFrame, most: int | None = 512) -> DataFrame:
    """note_id, phrase, weight, titled of notes (note_id, title, body rows): 4 for the title and log1p of the body's count; the first ``most`` of a note, or all."""
    # texts move, once: their phrases are many times as large
    notes = notes.repartition("note_id")
    title = notes.select("note_id", F.explode(phrases(F.col("title"))).alias("phrase"), F.lit(1).alias("t"), F.lit(0).alias("b"))
    body = notes.select("note_id", F.explode(phrases(F.col("body"))).alias("phrase"), F.lit(0).alias("t"), F.lit(1).alias("b"))
    sums = title.unionByName(body).groupBy("note_id", "phrase").agg(F.max("t").alias("t"), F.sum("b").alias("b"))
    rated = sums.select("note_id", "phrase", (4 * F.col("t") + F.log1p("b")).alias("weight"), (F.col("t") == 1).alias("titled"))
    if most is None:
        return rated
    order = Window.partitionBy("note_id").orderBy(F.desc(F.round("weight", 9)), "phrase")
    return rated.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def competitors(weights: DataFrame, members: DataFrame) -> DataFrame:
    """community, phrase, w, coverage, titles, outside: outside is the phrase's best coverage in another community.

    Only the two best coverages of a phrase are needed to know the best other one. Sums are written, as each reading
    of them would count all phrases again; a phrase's communities then meet once.
    """
    size = members.groupBy("community").agg(F.countDistinct("note_id").alias("size"))
    sums = weights.join(members, "note_id").groupBy("community", "phrase").agg(F.sum("weight").alias("w"), F.countDistinct("note_id").alias("n"), F.count(F.when(F.col("titled"), 1)).alias("titles"))
    rated = written(sums, "phrases").join(size, "community").select("community", "phrase", "w", (F.col("n") / F.col("size")).alias("coverage"), (F.col("titles") / F.col("size")).alias("titles"))
    own = Window.partitionBy("phrase")
    order = own.orderBy(F.desc("coverage"), F.desc("community"))
    placed = rated.withColumn("place", F.row_number().over(order))
    first, second = (F.max(F.when(F.col("place") == k, F.col("coverage"))).over(own) for k in (1, 2))
    outside = F.when(F.col("place") == 1, F.coalesce(second, F.lit(0.0))).otherwise(first)
    return placed.withColumn("outside", outside).select("community", "phrase", "w", "coverage", "titles", "outside")


def scored(weights: DataFrame, members: DataFrame) -> DataFrame:
    """community, phrase, score, coverage: all phrases that set a community off, by class-based tf-idf and coverage."""
    rated = written(competitors(weights, members), "rated").withColumn("distinct", F.greatest(F.lit(0.0), (F.col("coverage") - F.col("outside")) / F.greatest("coverage", F.lit(1e-12))))
    sums = rated.groupBy("community").agg(F.sum("w").alias("own"))
    mean = sums.agg(F.avg("own").alias("mean"))  # one row
    total = rated.groupBy("phrase").agg(F.sum("w").alias("total"))
    c = rated.where(F.col("distinct") > 0.05).join(sums, "community").join(total, "phrase").crossJoin(F.broadcast(mean))
    ctf = F.col("w") / F.col("own") * F.log1p(F.col("mean") / F.greatest("total", F.lit(1e-12)))
    score = ctf * F.pow("coverage", F.lit(1.5)) * (1 + F.col("titles")) * (0.1 + 0.9 * F.col("distinct")) * (1 + 0.08 * (F.size(F.split("phrase", " ")) - 2))
    return c.select("community", "phrase", F.round(score, 9).alias("score"), F.round("coverage", 6).alias("coverage"))


def label_candidates(weights: DataFrame, members: DataFrame) -> DataFrame:
    """community, phrase, score, coverage, rank: all phrases that set a community off, best first."""
    return ranked(scored(weights, members), "community", F.desc("score"), F.desc("coverage"), F.asc("phrase"))


def ranked(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with rank, their place in their group. No task orders a whole group: rows are dealt to slices by their order,
    numbered in each, and the sizes of a group's slices before are added."""
    rows = written(rows, "unranked")
    slices = -(-rows.count() // session.ROWS)
    if slices <= 1:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    dealt = written(rows.repartitionByRange(slices, group, *order).withColumn("slice", F.spark_partition_id()), "slices")
    earlier = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(group, "slice").agg(F.count("*").alias("n")).select(group, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(group, "slice").orderBy(*order))
    return dealt.withColumn("place", place).join(before, [group, "slice"]).select(*rows.columns, (F.col("before") + F.col("place")).alias("rank"))


#: Candidates that one task looks at in a round, as each choice depends on all before it, and those of a community in the first.
POOL, FIRST = 500_000, 24


def assign(rows: list[tuple], penalty: float = 0.65, same: float = 0.8, labels: Iterable[str] = (), ends: Container[tuple] = ()) -> dict:
    """community -> phrase from (community, phrase, score): jointly, best first, likeness to labels given costs.

    A value can only fall as labels are given, so the best stored one is looked at again and chosen if it still holds.
    labels: those given before to communities that have no rows. ends: rows (community, phrase) behind which a
    community has more candidates, none before it in order; when one comes up the next choice is open, and choosing stops.
    """
    stop = set(tx.STOP_WORDS)
    given: dict[str, list[tuple[int, set]]] = defaultdict(list)  # by word: labels that have it
    for k, label in enumerate(labels, 1):
        own = set(label.split()) - stop
        for w in own:
            given[w].append((-k, own))

    def near(own: set) -> float:
        seen, most = set(), 0.0
        for w in own:
            for k, other in given[w]:
                if k not in seen:
                    seen.add(k)
                    most = max(most, 1.0 if own <= other or other <= own else len(own & other) / len(own | other))
        return most

    heap = [(-s, str(c), p, c, s, set(p.split()) - stop) for c, p, s in rows]
    heapq.heapify(heap)
    chosen: dict = {}
    while heap:
        value, name, p, c, s, own = heapq.heappop(heap)
        if c in chosen:
            continue
        if (c, p) in ends:
            break
        like = near(own)
        if like >= same:
            continue
        now = -(s * (1 - penalty * like))
        if now > value:
            heapq.heappush(heap, (now, name, p, c, s, own))
            continue
        chosen[c] = p
        for w in own:
            given[w].append((len(chosen), own))
    return chosen


def _chosen(end: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Labels given before (place 0) and those that candidates of places up to ``end``, behind which others follow, settle."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        of = lambda part, *names: list(part[list(names)].itertuples(index=False, name=None))
        old = rows[rows["place"] == 0]
        got = assign(of(rows[rows["place"] > 0], "community", "phrase", "score"), labels=old["phrase"], ends=set(of(rows[rows["place"] == end], "community", "phrase")))
        return pd.DataFrame(sorted([*of(old, "community", "phrase"), *got.items()]), columns=["community", "label"])

    return run


def assign_labels(candidates: DataFrame) -> DataFrame:
    """community, label: one task a round over the first candidates of each community without a label; more of them come
    in the next round where the choice is open, so the labels are those of looking at all candidates at once.

    At most POOL candidates are looked at in a round. Where no choice can be made on these it is an error, never a cut.
    """
    candidates = written(candidates.select("community", "phrase", "score"), "candidates")
    kind = candidates.schema["community"].dataType.simpleString()
    order = Window.partitionBy("community").orderBy(F.desc("score"), "phrase")
    given, had, looked, most = None, 0, 0, FIRST
    while True:
        left = candidates if given is None else candidates.join(given.select("community"), "community", "left_anti")
        number = left.select("community").distinct().count()
        most = min(most, POOL // max(1, number) - 1)
        if most < 1 or (given is not None and most <= looked and given.count() == had):
            raise ValueError(f"label candidates of {number} communities; one task looks at {POOL}")
        had, looked = 0 if given is None else given.count(), most
        part = written(left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most + 1), "first")
        rows = part if given is None else part.unionByName(given.select("community", F.col("label").alias("phrase"), F.lit(0.0).alias("score"), F.lit(0).alias("place")))

        given = written(rows.groupBy(F.lit(0).alias("all")).applyInPandas(_chosen(most + 1), f"community {kind}, label string"), "labels")
        if part.where(F.col("place") == most + 1).join(given, "community", "left_anti").isEmpty():
            return given
        most *= 4


def diverse(relevance: np.ndarray, vectors: np.ndarray, keys: list, most: int, share: float = 0.35) -> list[int]:
    """Greedy maximal marginal relevance: (1 - share) * relevance - share * the largest cosine to those chosen."""
    chosen: list[int] = []
    while len(chosen) < min(most, len(keys)):
        best = min((i for i in range(len(keys)) if i not in chosen), key=lambda i: (-((1 - share) * relevance[i] - share * max((float(vectors[i] @ vectors[j]) for j in chosen), default=0.0)), keys[i]))
        chosen.append(best)
    return chosen


def rerank(rows: DataFrame, group: str, most: int = 8) -> DataFrame:
    """group, item, position of rows (group, item, relevance, vector), each group's few rows reordered for diversity."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (group, "item")}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("item").reset_index(drop=True)
        x = np.array(part["vector"].tolist(), float)
        got = diverse(part["relevance"].to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True), part["item"].tolist(), most)
        return part.loc[got, [group, "item"]].assign(position=range(1, len(got) + 1))

    return rows.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, item {kinds['item']}, position int")
