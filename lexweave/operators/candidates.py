"""Candidate pairs from shared signals: capped postings, pair scores, fused pools, capacity-bound selection."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread, written

WEIGHTS = {"term": 1.0, "tag": 2.0, "reference": 4.0}
#: Pairs that a sequential selector takes; more is an error, never a cut.
POOL = 100_000
#: Shares of a scope that are ordered apart.
SHARES = 64


def frequencies(signals: DataFrame) -> DataFrame:
    """kind, signal, df of signals (kind, signal, source_id, one row each): the true frequency, whatever is capped later."""
    return signals.groupBy("kind", "signal").agg(F.count("*").alias("df"))


def rare_signals(signals: DataFrame, most: int = 64) -> DataFrame:
    """Each source's first signals by (df, kind, signal)."""
    order = Window.partitionBy("source_id").orderBy("df", "kind", "signal")
    return signals.join(frequencies(signals), ["kind", "signal"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def capped_postings(signals: DataFrame, most: int = 64) -> DataFrame:
    """kind, signal, source_id, position: up to ``most`` sources a signal, taken in turns from its groups.

    The first window's limit is applied in each task before the shuffle, so a hot signal sends few rows.
    """
    inner = Window.partitionBy("kind", "signal", "group").orderBy("source_id")
    outer = Window.partitionBy("kind", "signal").orderBy("turn", "group")
    few = signals.withColumn("turn", F.row_number().over(inner)).where(F.col("turn") <= most)
    return few.withColumn("position", F.row_number().over(outer)).where(F.col("position") <= most).select("kind", "signal", "source_id", "position")


def shared_signals(posts: DataFrame) -> DataFrame:
    """left_id, right_id, kind, signal of pairs that meet in a capped posting; at most most * (most - 1) / 2 a posting.

    Pairs are dealt by their ends to as many tasks as their number needs.
    """
    posts = written(posts, "posts")
    number = pairs_of(posts)
    posts = spread(posts, number, "kind", "signal")
    a, b = (posts.select("kind", "signal", F.col("source_id").alias(n)) for n in ("left_id", "right_id"))
    return spread(a.join(b, ["kind", "signal"]).where("left_id < right_id").select("left_id", "right_id", "kind", "signal"), number, "left_id", "right_id")


def pairs_of(posts: DataFrame) -> int:
    """How many pairs the postings make."""
    return posts.groupBy("kind", "signal").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long")).head()[0] or 0


def pair_scores(shared: DataFrame, counts: DataFrame, sources: int, direct: DataFrame) -> DataFrame:
    """left_id, right_id, score: 8 for each direct reference and the weighted idf of each shared signal."""
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("kind")]
    sums = shared.join(counts, ["kind", "signal"]).groupBy("left_id", "right_id").agg(F.sum(weight * (1 + F.log((1 + F.lit(sources)) / (1 + F.col("df")).cast("double")))).alias("s"))
    both = sums.join(direct.groupBy("left_id", "right_id").agg(F.count("*").alias("d")), ["left_id", "right_id"], "full")
    return both.select("left_id", "right_id", F.round(F.coalesce("s", F.lit(0.0)) + 8 * F.coalesce("d", F.lit(0)), 6).alias("score"))


def alternating(semantic: DataFrame, local: DataFrame, fanout: int = 32) -> DataFrame:
    """source_id, target_id, position: both lanes (source_id, target_id, rank) in turns, semantic first, each target once."""
    both = semantic.select("source_id", "target_id", (2 * F.col("rank")).alias("at")).unionByName(local.select("source_id", "target_id", (2 * F.col("rank") + 1).alias("at")))
    first = both.groupBy("source_id", "target_id").agg(F.min("at").alias("at"))
    order = Window.partitionBy("source_id").orderBy("at")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= fanout).select("source_id", "target_id", "position")


def unresolved(pairs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pairs that no decision is known for; before any cap."""
    return pairs.join(resolved.select("left_id", "right_id"), ["left_id", "right_id"], "left_anti")


def interleaved(streams: DataFrame, fanout: int = 32) -> DataFrame:
    """source_id, target_id, position: targets of a source's streams (source_id, stream, place, target_id) row by row, each once."""
    first = streams.groupBy("source_id", "target_id").agg(F.min(F.struct("place", "stream")).alias("at"))
    order = Window.partitionBy("source_id").orderBy("at", "target_id")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= fanout).select("source_id", "target_id", "position")


def _bounded(pairs: DataFrame) -> DataFrame:
    n = pairs.count()
    if n > POOL:
        raise ValueError(f"{n} pairs; a sequential selection takes {POOL}")
    return pairs


def select_rounds(sources: Iterable[list[tuple]], cap: int, most: int) -> list[tuple]:
    """Pairs (left, right, ...) chosen by rounds: in each, every source in order takes its best pair that is free at both ends.

    sources: each source's pairs, best first, read once and only as far as needed. A source without a free pair never
    gets one again, so later rounds need only the at most ``most`` sources that took one.
    """
    degree: dict = {}
    taken, chosen = set(), []
    for _ in range(cap):
        again = []
        for own in sources:
            for pair in own:
                a, b = pair[:2]
                if (a, b) not in taken and degree.get(a, 0) < cap and degree.get(b, 0) < cap:
                    taken.add((a, b))
                    chosen.append(pair)
                    degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
                    again.append(own)
                    break
            if len(chosen) >= most:
                return chosen
        sources = again
    return chosen


def greedy_degree_cap(pairs: DataFrame, sizes: DataFrame, cap: int = 8, most: int = 256) -> DataFrame:
    """left_id, right_id, score, position of pairs (left_id, right_id, score, same_group; each once) chosen under a degree cap.

    sizes: source_id, size (of its smallest group); small groups choose first, pairs of different groups are chosen
    first. At any time a source that can choose has taken fewer than ``cap`` pairs, and at most 2 * most / cap others
    are full, so no more of its pairs than their sum are ever looked at: the rest is cut in Spark, without an effect.
    The driver reads the sources in order until ``most`` pairs are chosen.
    """
    known = pairs.join(sizes.select(F.col("source_id").alias("left_id"), F.col("size").alias("left_size")), "left_id").join(sizes.select(F.col("source_id").alias("right_id"), F.col("size").alias("right_size")), "right_id")
    ends = [known.select(F.col(f"{end}_id").alias("source_id"), F.col(f"{end}_size").alias("size"), "left_id", "right_id", "score", "same_group") for end in ("left", "right")]
    best = Window.partitionBy("source_id").orderBy("same_group", F.desc("score"), "left_id", "right_id")
    near = ends[0].unionByName(ends[1]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cap + 2 * most // cap).orderBy("size", "source_id", "rank")
    groups = groupby(near.select("source_id", "left_id", "right_id", "score").toLocalIterator(), key=itemgetter(0))
    chosen = select_rounds(([tuple(r)[1:] for r in own] for _, own in groups), cap, most)
    kind = pairs.schema["left_id"].dataType.simpleString()
    return pairs.sparkSession.createDataFrame([(*pair, k) for k, pair in enumerate(chosen, 1)], f"left_id {kind}, right_id {kind}, score double, position int")


def balanced(rows: list[tuple], cap: int, most: int) -> list[tuple]:
    """(left, right, score, scope) rows chosen in two passes: the first keeps half of each endpoint's and of all places
    for each scope, the second fills what is left, in the order of score."""
    rows = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
    degree, by_scope, ends, out, taken = {}, {}, {}, [], set()
    for reserve in (True, False):
        for i, (a, b, _, scope) in enumerate(rows):
            if len(out) >= most or i in taken or any(degree.get(x, 0) >= cap for x in (a, b)):
                continue
            half = math.ceil(cap / 2)
            if reserve and (by_scope.get(scope, 0) >= math.ceil(most / 2) or any(ends.get((x, scope), 0) >= half for x in (a, b))):
                continue
            taken.add(i)
            out.append(rows[i])
            by_scope[scope] = by_scope.get(scope, 0) + 1
            for x in (a, b):
                degree[x] = degree.get(x, 0) + 1
                ends[x, scope] = ends.get((x, scope), 0) + 1
    return out


def scope_balanced_select(pairs: DataFrame, cap: int = 8, most: int = 256) -> DataFrame:
    """left_id, right_id, score, scope, position of pairs (left_id, right_id, score, scope; each once) in two passes.

    Most pairs can't be chosen. In either pass a pair is passed over only if an end is full (by the cap, or by half of
    it in its scope: ``full`` ends at most) or its scope is. So it needs no look behind ``few`` better ones of an
    end in its scope, nor behind ``far`` better ones that are left of its scope. One task chooses among the others, a
    checked, bounded pool.
    """
    full = 2 * most // cap + 2 * math.ceil(most / 2) // math.ceil(cap / 2)
    few = cap + full
    far = most + full * 2 * few  # an end has so many pairs as left and as right end each
    order = (F.desc("score"), "left_id", "right_id")
    # the first of a scope are the first of the first of its shares, so no task orders a whole scope
    shares = pairs.select("*", F.pmod(F.xxhash64("left_id", "right_id"), F.lit(SHARES)).alias("share"))
    for keys, enough in ((("left_id", "scope"), few), (("right_id", "scope"), few), (("scope", "share"), far), (("scope",), far)):
        shares = shares.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= enough).drop("place")
    pairs = shares.drop("share")
    kind = pairs.schema["left_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = balanced(list(rows[["left_id", "right_id", "score", "scope"]].itertuples(index=False, name=None)), cap, most)
        return pd.DataFrame(out, columns=["left_id", "right_id", "score", "scope"]).assign(position=range(1, len(out) + 1))

    return _bounded(pairs).groupBy(F.lit(0).alias("all")).applyInPandas(run, f"left_id {kind}, right_id {kind}, score double, scope string, position int")


def _capped(rows: list[tuple], room: dict, cap: int) -> list[tuple]:
    """Rows (left, right, score) in order, each while both ends have room; room: what is left of cap, where it is less."""
    out = []
    for a, b, score in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if room.get(a, cap) > 0 and room.get(b, cap) > 0:
            room[a], room[b] = room.get(a, cap) - 1, room.get(b, cap) - 1
            out.append((a, b, score))
    return out


def degree_capped(edges: DataFrame, cap: int, pool: int = POOL) -> DataFrame:
    """Edges by (-score, ids), each admitted while both ends have fewer than ``cap``; edges of any number.

    In a round each edge that is among the first of both ends, as many as an end has room for, is admitted: no edge
    before it can fill an end. Those of an end without room come behind the ones that filled it and are let go. So
    rounds give what one look at all edges in order gives. When at most ``pool`` edges are open, one task looks at them.
    """
    kind = edges.schema["left_id"].dataType.simpleString()
    form = f"left_id {kind}, right_id {kind}, score double"
    rest = written(edges.select("left_id", "right_id", F.col("score").cast("double").alias("score"), F.lit(cap).alias("left_room"), F.lit(cap).alias("right_room")), "open")
    done = []
    while rest.count() > pool:
        ends = [rest.select(F.col(f"{end}_id").alias("node"), F.col(f"{end}_room").alias("room"), "left_id", "right_id", "score", F.lit(end).alias("end")) for end in ("left", "right")]
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "left_id", "right_id", "end"))
        first = ends[0].unionByName(ends[1]).withColumn("first", place <= F.col("room"))
        both = written(first.groupBy("left_id", "right_id", "score").agg(F.bool_and("first").alias("sure"), F.min(F.when(F.col("end") == "left", F.col("room"))).alias("left_room"), F.min(F.when(F.col("end") == "right", F.col("room"))).alias("right_room")), "round")
        sure = both.where("sure").select("left_id", "right_id", "score")
        done.append(sure)
        used = sure.select(F.col("left_id").alias("node")).unionAll(sure.select("right_id")).groupBy("node").agg(F.count("*").cast("int").alias("used"))
        left = both.where("not sure").join(used.toDF("left_id", "left_used"), "left_id", "left").join(used.toDF("right_id", "right_used"), "right_id", "left")
        room = lambda end: (F.col(f"{end}_room") - F.coalesce(f"{end}_used", F.lit(0))).alias(f"{end}_room")
        rest = written(left.select("left_id", "right_id", "score", room("left"), room("right")).where("left_room > 0 and right_room > 0"), "open")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        room = dict(zip(rows["left_id"], rows["left_room"], strict=True)) | dict(zip(rows["right_id"], rows["right_room"], strict=True))
        return pd.DataFrame(_capped(list(rows[["left_id", "right_id", "score"]].itertuples(index=False, name=None)), room, cap), columns=["left_id", "right_id", "score"])

    return reduce(DataFrame.unionByName, done, rest.groupBy(F.lit(0).alias("all")).applyInPandas(run, form))
