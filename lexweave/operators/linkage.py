"""References: record linkage and signals from shared references or tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread, written


def reference_status(references: DataFrame, items: DataFrame) -> DataFrame:
    """ref_id, status, matched: references linked to items by identifier, else by title, first author and year.

    references: ref_id, identifier, title, author, year. items: item, identifier, title, author, year. An
    identifier that only items of another year bear is a conflict; two items are ambiguous; an identifier that no
    item bears is external, and a reference without one and without a match is unresolved.
    """
    by_id = references.where("identifier is not null").join(items.select("identifier", "item", F.col("year").alias("item_year")), "identifier")
    found = by_id.groupBy("ref_id").agg(
        F.count("*").alias("n"), F.min("item").alias("item"), F.count(F.when(F.coalesce(F.col("year") == F.col("item_year"), F.lit(True)), 1)).alias("agree")
    )
    rest = references.join(found.select("ref_id"), "ref_id", "left_anti")
    same = rest.join(items.select("title", "author", "year", F.col("item").alias("m")), ["title", "author", "year"]).groupBy("ref_id").agg(F.count("*").alias("k"), F.min("m").alias("m"))
    all_ = references.join(found, "ref_id", "left").join(same, "ref_id", "left")
    status = (
        F.when(F.col("n").isNotNull() & (F.col("agree") == 0), "identifier_conflict").when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "matched_identifier")
        .when(F.col("k") > 1, "ambiguous").when(F.col("k") == 1, "matched_title_author_year").when(F.col("identifier").isNotNull(), "external").otherwise("unresolved")
    )
    out = all_.withColumn("status", status)
    return out.select("ref_id", "status", F.when(F.col("status").startswith("matched"), F.coalesce("item", "m")).alias("matched"))


#: Keys of a member that travel with it. Pairs of which one member has more are added up by a shuffle of pairs.
WIDE = 64
#: Members of a group's part: in a group of more, each part meets all members in a place of its own.
PART = 1024
#: Large groups whose keys are broadcast; more are joined by a shuffle.
SENT = 200_000


def skipped_groups(rows: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """One row, skipped: how many groups have more than ``most`` members."""
    return rows.select(key, member).distinct().groupBy(key).agg(F.count("*").alias("n")).agg(F.count(F.when(F.col("n") > most, 1)).alias("skipped"))


def group_signals(rows: DataFrame, key: str, member: str, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of members that share a key, with the number of keys shared, and with ``most`` one row: how many groups were left out.

    Groups of more than ``most`` members give no pairs; without it all groups do. A member takes its keys along, so a
    pair is put out with its number where the first of the keys it shares is, and pairs are neither moved nor held.
    """
    kept = rows.select(F.col(key).alias("key"), F.col(member).alias("member"))
    if most is not None:
        own = kept.distinct()
        kept = own.join(own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("key"), "key", "left_semi")
    # a row for each WIDE keys of a member: most have one
    kept = spread(kept.where("key is not null and member is not null"), rows.count(), "member").distinct()
    own = Window.partitionBy("member")
    kept = kept.withColumn("piece", F.floor((F.row_number().over(own.orderBy("key")) - 1) / WIDE)).withColumn("degree", F.count("*").over(own))
    lists = written(kept.groupBy("member", "degree", "piece").agg(F.array_sort(F.collect_list("key")).alias("keys")), "signals")
    groups = lists.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    number, large = groups.agg(F.sum("n"), F.count(F.when(F.col("n") > PART, 1))).head()
    widest = lists.agg(F.max("degree")).head()[0] or 0
    parts = groups.where(F.col("n") > PART).select("key", F.ceil(F.col("n") / PART).alias("parts"))
    parts = F.broadcast(parts) if large <= SENT else parts
    number, each = number or 0, lists.select("member", "degree", F.explode("keys").alias("key"), "keys")
    narrow = each.where(F.col("degree") <= WIDE).select("key", "member", F.array_remove("keys", F.col("key")).alias("others"))
    narrow = narrow.withColumn("bits", F.expr("aggregate(others, 0L, (bits, k) -> bits | shiftleft(1L, cast(pmod(xxhash64(k), 64) AS INT)))"))
    pairs = _first_met(*_met(narrow, narrow, parts if large else None, number))
    if widest > WIDE:
        wide = each.where(F.col("degree") > WIDE).select("key", "member")
        a, b = _met(wide, each.select("key", "member", (F.col("degree") > WIDE).alias("other_wide")), parts if large else None, number)
        both = a.join(b, [c for c in a.columns if c in ("key", "part")]).where(F.when(F.col("other_wide"), F.col("left_id") < F.col("right_id")).otherwise(True))
        pairs = pairs.unionByName(both.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).groupBy("left_id", "right_id").agg(F.count("*").alias("shared")))
    return pairs, None if most is None else skipped_groups(rows, key, member, most)


def _met(left: DataFrame, right: DataFrame, parts: DataFrame | None, number: int) -> tuple[DataFrame, DataFrame]:
    """left and right as left_id and right_id, dealt by key; with parts (key, parts) also by part: right by hash, left to all."""
    same = left is right
    on = ["key"]
    if parts is not None:
        many = F.coalesce("parts", F.lit(1))
        right = right.join(parts, "key", "left").withColumn("part", F.pmod(F.xxhash64("member"), many)).drop("parts")
        left = left.join(parts, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("parts")
        on, same = ["key", "part"], False
    left = spread(left, number, *on)
    right = left if same else spread(right, number, *on)
    a, b = left.withColumnRenamed("member", "left_id"), right.withColumnRenamed("member", "right_id")
    names = ("others", "bits")
    return a.withColumnsRenamed({n: f"left_{n}" for n in names}), b.withColumnsRenamed({n: f"right_{n}" for n in names})


def _first_met(a: DataFrame, b: DataFrame) -> DataFrame:
    """left_id, right_id, shared: a pair counts at the first of its shared keys, by the other keys that both members bring."""
    met = a.join(b, [c for c in a.columns if c in ("key", "part")]).where("left_id < right_id")
    # most pairs share one key, and the bits of their keys' hashes show it
    more, again = F.array_intersect("left_others", "right_others"), (F.col("left_bits").bitwiseAND(F.col("right_bits")) != 0) & F.arrays_overlap("left_others", "right_others")
    first = F.when(again, F.array_min(more) > F.col("key")).otherwise(True)
    return met.where(first).select("left_id", "right_id", F.when(again, F.size(more) + 1).otherwise(1).cast("long").alias("shared"))


def sufficient(status: Column, scope: Column, gate: Column, done: Column, total: Column) -> Column:
    """Whether a source was read well enough: succeeded, in full, gate passed, all of it."""
    return F.coalesce((status == "succeeded") & (scope == "full_document") & (gate == "passed") & (total > 0) & (done == total), F.lit(False))
