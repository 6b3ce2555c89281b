"""Operator 6: n-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of hashed five-word shingles. Texts of equal sets are one class and only its representative goes on.
Bands of MinHash values find texts that may be similar; those that bands connect form a candidate component.
Inside a component pairs are compared some MinHash values at a time: with m of n values equal and a uniform prior,
the posterior probability that the similarity reaches the threshold is the tail of a Beta(m + 1, n - m + 1)
distribution; a pair is dropped once that falls below a tolerance. The rest are verified exactly.

A large component is cut into blocks; each pair of blocks is one group, so no task holds a component and no pair
is a row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, lean, placed, release, written
from .components import components
from .shingles import MinHash, mixed, shingle_hashes

THRESHOLD = 0.8
#: MinHash values, values in a band, bands. A pair at 0.8 shares no band with probability (1 - 0.8 ** 6) ** 42 = 3e-6.
VALUES, ROWS, BANDS = 256, 6, 42
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6
#: Texts in a block of a large component; texts of small components that one group holds; shingles that count as a text.
BLOCK, GROUP, LONG = 384, 768, 2000


def fewest_equal(threshold: float, tolerance: float, values: int = VALUES, step: int = STEP) -> list[int]:
    """For each number n of values compared, the fewest equal ones with which a pair stays."""
    out = []
    for n in range(step, values + 1, step):
        # P(Beta(m + 1, n - m + 1) > t) = P(Binomial(n + 1, t) <= m)
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
            if tail >= tolerance:
                break
        out.append(m)
    return out


def pruned(a: np.ndarray, b: np.ndarray, same: bool, fewest: list[int], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that survive the incremental comparison; same: a is b, each pair once."""
    equal = np.zeros((len(a), len(b)), np.int32)
    for at in range(step):
        equal += a[:, at][:, None] == b[:, at][None, :]
    stays = equal >= fewest[0]
    i, j = np.nonzero(np.triu(stays, 1) if same else stays)
    count = equal[i, j]
    for k, least in enumerate(fewest[1:], 1):
        for at in range(0, len(i), 1 << 17):
            part = slice(at, at + (1 << 17))
            count[part] += (a[i[part], k * step : (k + 1) * step] == b[j[part], k * step : (k + 1) * step]).sum(axis=1, dtype=np.int32)
        stays = count >= least
        i, j, count = i[stays], j[stays], count[stays]
    return i, j


def shared(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sorted sets."""
    if len(i) <= 64:
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    rows, cols = np.unique(i), np.unique(j)
    left, right = [a[x] for x in rows], [b[y] for y in cols]
    joint = np.intersect1d(np.concatenate(left), np.concatenate(right))
    total = np.zeros((len(rows), len(cols)), np.float32)  # counts below 2 ** 24 are exact
    for at in range(0, len(joint), 4096):
        part = joint[at : at + 4096]
        total += _incidence(left, part) @ _incidence(right, part).T
    return total[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)


def _incidence(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(part)), np.float32)
    for k, s in enumerate(sets):
        s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
        at = np.searchsorted(part, s)
        out[k, at[part[np.minimum(at, len(part) - 1)] == s]] = 1
    return out


def links(a_sig, a_sets, b_sig, b_sets, same: bool, threshold: float, fewest: list[int]) -> tuple[np.ndarray, np.ndarray]:
    i, j = pruned(a_sig, b_sig, same, fewest)
    if not len(i):
        return i, j
    inter = shared(a_sets, b_sets, i, j)
    union = np.array([len(s) for s in a_sets])[i] + np.array([len(s) for s in b_sets])[j] - inter
    linked = inter >= threshold * union - 1e-9
    return i[linked], j[linked]


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (see placed), id, fp (of the shingle set, null if it is empty), size and bands of each row, written."""
    base = docs.select("key", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(VALUES)
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for b in batches:
            fps, sizes, bands = [], [], []
            for t in b.column(2):
                s = shingle_hashes(t.as_py())
                sizes.append(len(s))
                if not len(s):
                    fps.append(None)
                    bands.append([])
                    continue
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                values = hasher.of(s)[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
                key = salt.copy()
                for r in range(ROWS):
                    key = mixed(key ^ (values[:, r] + np.uint64(r + 1)))
                bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["key", "id", "fp", "size", "bands"])

    more = [T.StructField("fp", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return written(base.mapInArrow(lean(run), T.StructType([*base.drop("text").schema.fields, *more])), "texts")


def candidates(reps: DataFrame) -> DataFrame:
    """node, label: the candidate components of more than one text. Bands tie each text to the smallest one of the band.

    Band minima are added up before they are shuffled, and bands of one text go before the join.
    """
    keyed = reps.select(F.col("rep.key").alias("node"), F.explode("bands").alias("band"))
    lows = keyed.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", "low")
    near = keyed.join(lows.hint("merge"), "band").select(F.col("node").alias("a"), F.col("low").alias("b"))
    return components(near)


def dealt(reps: DataFrame, nodes: DataFrame, block: int, group: int) -> DataFrame:
    """no, rep, copies, part, blocks, block of each candidate: a large component is cut into blocks, written.

    Blocks are bounded in texts and in shingles: very long texts count for several.
    """
    known = written(nodes.join(reps.select(F.col("rep.key").alias("node"), "rep", "copies", "size"), "node"), "candidates")
    weight = F.greatest(F.lit(1.0), F.col("size") / LONG)
    sizes = known.groupBy("label").agg(F.sum(weight).alias("n")).where(F.col("n") > group)
    out = known.join(sizes, "label", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(0)).cast("int"))
    spread = F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int")
    out = written(out.select(F.monotonically_increasing_id().alias("no"), "node", "rep", "copies", weight.alias("weight"), F.xxhash64("label").alias("part"), "blocks", spread.alias("block")), "dealt")
    dropped(known)
    return out


def compared(docs: DataFrame, nodes: DataFrame, threshold: float, group: int, text_col: str) -> DataFrame:
    """no, next, links: each candidate's number of linked rows in a tile and the candidate that it hangs on, written."""
    # texts of candidates only; both sides are shuffled, and on large tables Spark filters the texts by a Bloom filter first
    texts = docs.select(F.col("key").alias("node"), F.col(f"doc.`{text_col}`").cast("string").alias("body"))
    loaded = nodes.select("node", "no", "part", "blocks", "block", "copies").hint("merge").join(texts, "node").drop("node")
    pairs = loaded.mapInArrow(lean(_payload), T.StructType([*loaded.drop("body").schema.fields, T.StructField("sig", T.BinaryType()), T.StructField("hashes", T.BinaryType())]))
    small = max(1, math.ceil((nodes.where("blocks = 0").agg(F.sum("weight")).head()[0] or 0) / group))
    other = F.explode(F.when(F.col("blocks") > 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(-1)))).alias("other")
    whole = F.col("blocks") == 0
    tiles = pairs.select("*", other).select(
        F.when(whole, F.pmod("part", F.lit(small))).otherwise(F.col("part")).alias("of"),
        F.when(whole, -1).otherwise(F.least("block", "other")).alias("lo"),
        F.when(whole, -1).otherwise(F.greatest("block", "other")).alias("hi"),
        "no", "part", "block", "copies", "sig", "hashes",
    )
    return written(tiles.groupBy("of", "lo", "hi").applyInPandas(_tile(threshold), "no long, next long, links long"), "links")


def joined(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", block: int | None = None, group: int | None = None) -> DataFrame:
    """key, id, class_id, n_links, kept of each row of placed documents; see ``classes``. Texts travel for candidates only."""
    block, group, spark = block or BLOCK, group or GROUP, docs.sparkSession
    rows = rows_of(docs, id_col, text_col)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    reps = rows.where("fp is not null").groupBy("fp").agg(F.min(order).alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    reps = written(reps, "reps")
    nodes = dealt(reps, candidates(reps), block, group)
    release(spark)
    found = compared(docs, nodes, threshold, group, text_col)
    release(spark)
    index = nodes.select("no", "rep")
    ends = found.where("next is not null").select("no", F.col("next").alias("to")).distinct()
    named = ends.join(index, "no").select(F.col("rep").alias("a"), F.col("to").alias("no")).join(index, "no").select("a", F.col("rep").alias("b"))
    labels = components(named).select(F.col("node.key").alias("key"), "label")
    counted = found.groupBy("no").agg(F.sum("links").alias("links")).join(index, "no").select(F.col("rep.key").alias("key"), "links")
    info = (
        reps.select("fp", "rep", "copies", F.col("rep.key").alias("key")).join(labels, "key", "left").join(counted, "key", "left")
        .select("fp", F.coalesce("label", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    # only what differs from a text alone is joined back; both sides are plain tables, so a hot key can be split
    info = written(info.where("n_links > 0"), "info")
    dropped(reps, nodes, found)
    out = rows.select("key", "id", "fp").join(info, "fp", "left")
    return out.select("key", "id", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("root.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("root.key") == F.col("key"), F.lit(True)).alias("kept"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs as ``doc``, with class_id, n_links and kept (one row of each class).

    Two rows are linked if the Jaccard similarity of their shingle sets is at least the threshold; class_id is the
    smallest id that links lead to, n_links the number of other rows linked directly. Null and blank texts have
    no shingles and are linked with nothing. Null ids come last in the order; repeated rows are copies like others.
    An empty table gives no rows; other columns are carried along and never looked at.
    """
    rows = placed(docs)
    return rows.join(joined(rows, threshold, id_col, text_col).hint("merge"), "key").select("doc", "class_id", "n_links", "kept")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that ``classes`` keeps, with all their columns."""
    rows = placed(docs)
    gone = written(joined(rows, threshold, id_col, text_col).where("not kept").select("key"), "gone")
    release(docs.sparkSession)
    return rows.join(gone.hint("merge"), "key", "left_anti").select("doc.*")


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = MinHash(VALUES)
    for b in batches:
        sets = [shingle_hashes(t.as_py()) for t in b.column("body")]
        keep = [c for c in b.schema.names if c != "body"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([hasher.of(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], [*keep, "sig", "hashes"])


def _tile(threshold: float):
    fewest = fewest_equal(threshold, TOLERANCE)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        _, lo, hi = key
        for _, part in rows.groupby("part", sort=False):
            part = part.drop_duplicates("no").sort_values("no").reset_index(drop=True)
            sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(-1, VALUES)
            sets = [np.frombuffer(h, np.uint64) for h in part["hashes"]]
            if lo == hi:
                i, j = links(sig, sets, sig, sets, True, threshold, fewest)
            else:
                a, b = np.flatnonzero(part["block"] == lo), np.flatnonzero(part["block"] == hi)
                i, j = links(sig[a], [sets[x] for x in a], sig[b], [sets[x] for x in b], False, threshold, fewest)
                i, j = a[i], b[j]
            if not len(i):
                continue
            no, copies = part["no"].to_numpy(), part["copies"].to_numpy()
            n = np.bincount(i, copies[j], len(no)).astype(np.int64) + np.bincount(j, copies[i], len(no)).astype(np.int64)
            follow = stars(len(no), i, j)
            out.append(pd.DataFrame({"no": no, "next": pd.array([None if f < 0 else no[f] for f in follow], "Int64"), "links": n})[n > 0])
        return pd.concat(out) if out else pd.DataFrame({"no": [], "next": pd.array([], "Int64"), "links": []})

    return run


def stars(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """For each of n members the first of its component, -1 for the first itself: it says what is connected."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [-1 if top(x) == x else top(x) for x in range(n)]


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links of each row of docs (see classes); an empty table gives none, extra columns are not read."""
    return joined(placed(docs.select("doc_id", "text")), threshold).select(F.col("id").alias("doc_id"), "class_id", "n_links")
