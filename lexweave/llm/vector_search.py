"""Operator 9: approximate maximum inner product search by score-aware (anisotropic) product quantisation.

Errors parallel to a vector change the inner products that matter most, so they weigh more than orthogonal ones:
with the residual r of x, the loss is |r|^2 + (eta - 1) (r x)^2 / |x|^2. Codebooks of 16 centres a subspace are
fitted on a bounded sample; every vector is encoded by coordinate descent on that loss, four bits a subspace.
A query's tables hold its inner products with the centres; scanning the codes adds up table entries, two subspaces
a byte. Queries travel to blocks of codes. In a block the first of the scan are ranked exactly, by original vectors,
which lie beside the codes; they and random rows show how far a score may lie above the scan's. Each row that may
still be among the nearest by that is ranked exactly too, so the number ranked depends on the vectors (near copies,
lengths, the table's size), not on a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import lean, written
from .vectors import blocks, matrix, numbered

#: Vectors that codebooks are fitted on: the documented bound of the sample. All vectors are indexed.
SAMPLE = 8000
#: Dimensions of a subspace, centres of a codebook (four bits), the share of a vector's length from which scores matter.
WIDTH, CENTRES, FROM = 2, 16, 0.2
NEIGHBOURS = 20
#: Vectors of an index block, of a part of it (a block is stored and travels as rows of one part each), queries of a query block.
BLOCK, PART, QUERIES = 65_536, 8192, 512
#: Tasks that are wanted: where index blocks are fewer, query blocks are dealt to groups and a block goes to each group.
TASKS = 24
#: Rows of a block that a query ranks exactly first, and random ones that the scan's errors are learned from beside them.
RERANK, PROBES = 400, 256
#: Standard deviations of the scan's relative error that a row may lie above its scan. A row whose residual is more
#: than POOR times the usual one is not coded well: for it the bound is Cauchy's and Schwarz's, without a chance.
SPREADS, POOR = 4.0, 2.0


@dataclass
class Quantiser:
    """centres: subspaces x CENTRES x WIDTH, for vectors padded with zeros to whole pairs of subspaces."""

    centres: np.ndarray
    eta: float
    spread: float = 0.0  # root mean square of residual norms, relative to the vectors'

    def padded(self, x: np.ndarray) -> np.ndarray:
        parts, width = len(self.centres), self.centres.shape[2]
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def encode(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes (rows x subspaces); each sweep gives every subspace the centre of least loss, the others held."""
        out = [self._encode(x[at : at + 8192], sweeps) for at in range(0, len(x), 8192)]
        return np.concatenate([np.zeros((0, len(self.centres)), np.uint8), *out])

    def _encode(self, x: np.ndarray, sweeps: int) -> np.ndarray:
        x = self.padded(x)
        size = np.maximum((x**2).sum(axis=(1, 2)), 1e-300)
        codes = np.zeros(x.shape[:2], np.uint8)
        along = np.zeros(x.shape[:2])  # (residual in a subspace) x
        for m, c in enumerate(self.centres):
            codes[:, m] = ((c**2).sum(axis=1)[None, :] - 2 * x[:, m] @ c.T).argmin(axis=1)
            along[:, m] = ((x[:, m] - c[codes[:, m]]) * x[:, m]).sum(axis=1)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for m, c in enumerate(self.centres):
                inner = x[:, m] @ c.T
                own = (x[:, m] ** 2).sum(axis=1)[:, None]
                rest = (total - along[:, m])[:, None] + own - inner
                codes[:, m] = (own - 2 * inner + (c**2).sum(axis=1)[None, :] + (self.eta - 1) * rest**2 / size[:, None]).argmin(axis=1)
                new = (own - inner)[np.arange(len(x)), codes[:, m]]
                total += new - along[:, m]
                along[:, m] = new
        return codes

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Two subspaces a byte: subspace pairs x rows, so that a scan reads along memory."""
        return np.ascontiguousarray((codes[:, 0::2] | (codes[:, 1::2] << 4)).T)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x subspace pairs x 256 sums of two inner products."""
        one = np.einsum("qmw,mkw->qmk", self.padded(q), self.centres)
        return (one[:, 0::2, None, :] + one[:, 1::2, :, None]).reshape(len(q), -1, CENTRES * CENTRES).astype(np.float32)


def fit(x: np.ndarray, width: int = WIDTH, rounds: int = 6, seed: int = 3) -> Quantiser:
    """Codebooks for the vectors of a sample: k-means in each subspace, then rounds of encoding and of the joint
    least-squares solution for all centres under the anisotropic loss."""
    n, d = x.shape
    parts = -(-d // (2 * width)) * 2
    eta = max(1.0, (d - 1) * FROM**2 / (1 - FROM**2))
    rng = np.random.default_rng(seed)
    model = Quantiser(np.zeros((parts, CENTRES, width)), eta)
    y = model.padded(x)
    for m in range(parts):
        c = y[rng.choice(n, CENTRES, replace=n < CENTRES), m].copy()
        for _ in range(8):
            near = ((c**2).sum(axis=1)[None, :] - 2 * y[:, m] @ c.T).argmin(axis=1)
            for k in range(CENTRES):
                if (near == k).any():
                    c[k] = y[near == k, m].mean(axis=0)
        model.centres[m] = c
    norm = np.maximum(np.sqrt((x**2).sum(axis=1)), 1e-150)
    size = parts * CENTRES * width
    for _ in range(rounds):
        codes = model.encode(x)
        slots = (np.arange(parts)[None, :] * CENTRES + codes)[:, :, None] * width + np.arange(width)[None, None, :]
        flat = slots.reshape(n, -1)
        left, right = np.zeros((size, size)), np.zeros(size)
        counts = np.bincount(flat.ravel(), minlength=size).astype(np.float64)
        np.add.at(right, flat.ravel(), eta * y.reshape(n, -1).ravel())
        for at in range(0, n, 2000):
            u = np.zeros((len(flat[at : at + 2000]), size))
            np.put_along_axis(u, flat[at : at + 2000], y[at : at + 2000].reshape(len(u), -1) / norm[at : at + 2000, None], axis=1)
            left += (eta - 1) * u.T @ u
        left[np.diag_indices(size)] += counts + 1e-6
        free = counts == 0
        solved = np.linalg.solve(left, right)
        solved[free] = model.centres.reshape(-1)[free]
        model.centres = solved.reshape(parts, CENTRES, width)
    codes = model.encode(x)
    made = model.centres[np.arange(parts)[None, :], codes]
    model.spread = float(np.sqrt((((y - made) ** 2).sum(axis=(1, 2)) / norm**2).mean()))
    return model


def scan(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Approximate scores (queries x rows) as sums of table entries."""
    out = np.zeros((len(tables), codes.shape[1]), np.float32)
    for m in range(len(codes)):
        out += np.take(tables[:, m], codes[m], axis=1)
    return out


def residuals(model: Quantiser, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The lengths of what codes leave of vectors, negative for those that are coded badly."""
    out = np.zeros(len(x))
    for at in range(0, len(x), 8192):
        y = model.padded(x[at : at + 8192])
        left = np.sqrt(((y - model.centres[np.arange(len(model.centres))[None, :], codes[at : at + 8192]]) ** 2).sum(axis=(1, 2)))
        out[at : at + 8192] = np.where(left > POOR * model.spread * np.sqrt((y**2).sum(axis=(1, 2))), -left, left)
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the dimensions, so equal vectors have equal ones wherever they are."""
    out = np.zeros(len(x))
    for m in range(len(q)):
        out += x[:, m] * q[m]
    return out


def best(rough: np.ndarray, q: np.ndarray, x: np.ndarray, left: np.ndarray, keys: np.ndarray, rids: np.ndarray, own: int, k: int, rerank: int, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block nearest to the query q, without its own, and their exact scores; of equal scores the smaller ids.

    rough: the scan's scores. left: residual lengths (see ``residuals``). probes: random rows of the block.
    """
    other = rids != own
    if len(rough) > rerank:
        length = max(float(np.sqrt(q @ q)), 1e-300)
        ranked = np.where(other, rough, -np.inf)
        first = np.argpartition(ranked, len(ranked) - rerank)[len(ranked) - rerank :]
        first = first[other[first]]
        exact = x[first] @ q
        least = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
        size = np.abs(left) * length
        above = []
        for at, score in ((first, exact), (probes, x[probes] @ q)):
            real = size[at] > 0
            if real.any():
                c = (score[real] - rough[at][real]) / size[at][real]
                above.append(c.mean() + SPREADS * c.std())
        bound = min(1.0, max(above, default=0.0))
        # the last term is for rounding, of tables in single precision
        slack = 1e-5 * (np.abs(rough) + length * float(np.sqrt((x[first] ** 2).sum(axis=1)).max(initial=0.0)))
        may = np.flatnonzero((rough + np.where(left < 0, size, size * bound) + slack >= least) & other)
        rows = np.union1d(first, may)
    else:
        rows = np.flatnonzero(other)
    near = x[rows] @ q
    if len(rows) > k:
        # a product by the library may differ from the sum in order by a few last bits of its terms
        slack = 1e-12 * float(np.sqrt((x[rows] ** 2).sum(axis=1)).max()) * float(np.sqrt(q @ q))
        rows = rows[near >= np.partition(near, len(near) - k)[len(near) - k] - slack]
    score = products(x[rows], q)
    order = np.lexsort((rids[rows], keys[rows], -score))[:k]
    return rows[order], score[order]


def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """The rows of batches one by one, as a batch and as values: rows are large, so no more than one is copied at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            one = batch.slice(at, 1)
            yield one, one.to_pylist()[0]


def assembled(parts: list[dict]) -> tuple[np.ndarray, ...]:
    """x, left, keys, none, ids, rids and codes of an index block from its parts, which are let go of."""
    of = lambda name, kind: np.concatenate([np.frombuffer(t[name], kind) for t in parts])
    ids, none, rids, left = of("ids", "<i8"), of("none", bool), of("rids", "<i8"), of("rest", np.float64)
    codes = np.concatenate([np.frombuffer(t["codes"], np.uint8).reshape(-1, t["n"]) for t in parts], axis=1)
    x = np.zeros((len(ids), parts[0]["d"]))
    at = 0
    while parts:
        t = parts.pop(0)
        x[at : at + t["n"]] = matrix(t["data"], t["n"], t["d"])
        at += t["n"]
    return x, left, np.where(none, np.iinfo(np.int64).max, ids), none, ids, rids, codes


def search(table: DataFrame, every: int = 20, k: int = NEIGHBOURS, sample: int = SAMPLE, block: int = BLOCK, rerank: int = RERANK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by ``every`` the k rows of largest inner product.

    Vectors that are null, empty, zero or hold null or non-finite components take no part; a query meets vectors
    of its own dimension. A null id is never a query and comes last among ties. Rows with equal ids are rows of
    their own. A table without queries gives no rows; extra columns are not read. Scores are summed in the order of
    the dimensions, so equal vectors have equal scores and ties go to the smaller id.
    """
    rows = numbered(table, id_col, vector_col)
    good = rows.where("d is not null")
    counts = {r[0]: r[1] for r in good.groupBy("d").count().collect()}
    models: dict[int, Quantiser] = {}
    for d, n in counts.items():
        part = good.where(F.col("d") == d).where(F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(1 << 30)) < (1 << 30) * min(1.0, sample / n))
        x = [r[0] for r in part.orderBy("rid").select("x").collect()]
        models[d] = fit(np.array(x or good.where(F.col("d") == d).orderBy("rid").limit(1).select("x").head()["x"]).reshape(-1, d))
    part = min(block, PART)
    packed = blocks(rows, part)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in singles(batches):
            model, x = models[t["d"]], matrix(t["data"], t["n"], t["d"])
            found = model.encode(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([model.packed(found).tobytes()], pa.binary()), pa.array([residuals(model, x, found).tobytes()], pa.binary())], [*batch.schema.names, "codes", "rest"])

    # every vector is encoded once, when the index is made
    index = written(packed.mapInArrow(lean(coded), T.StructType([*packed.schema.fields, T.StructField("codes", T.BinaryType()), T.StructField("rest", T.BinaryType())])), "index")
    asked = blocks(rows.where((F.col("id") % every) == 0), QUERIES)

    # queries against all rows: an index block comes to a task once, part by part, and blocks of queries after it
    sizes = index.groupBy("d").agg(F.ceil(F.max("blocks") / max(1, block // part)).cast("int").alias("all")).join(asked.groupBy("d").agg(F.max("blocks").alias("chunks")), "d")
    sizes = sizes.withColumn("groups", F.least("chunks", F.ceil(F.lit(TASKS) / F.col("all"))).cast("int"))  # one row for each dimension
    number = sizes.agg(F.sum(F.col("all") * F.col("groups"))).head()[0] or 1
    none = [F.lit(None).cast("binary").alias(c) for c in ("ids", "none", "codes", "rest")]
    parts = index.join(F.broadcast(sizes.select("d", "all", "groups")), "d").select("d", (F.col("block") % F.col("all")).alias("at"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(0).alias("kind"), "block", "n", "rids", "data", "ids", "none", "codes", "rest")
    sent = asked.join(F.broadcast(sizes.select("d", "all", "groups")), "d").select("d", F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("at"), (F.col("block") % F.col("groups")).alias("group"), F.lit(1).alias("kind"), "block", "n", "rids", "data", *none)
    # twice as many places as tasks, so that few of them meet in one
    pairs = parts.unionByName(sent).repartition(2 * number, "d", "at", "group").sortWithinPartitions("d", "at", "group", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready = None, [], None
        for _, t in singles(batches):
            if (t["d"], t["at"], t["group"]) != key:
                key, held, ready = (t["d"], t["at"], t["group"]), [], None
            if t["kind"] == 0:
                held.append(t)
                continue
            if held:
                ready, held = assembled(held), []
            if ready is None:  # no row's hash fell into this block
                continue
            x, left, keys, none, ids, rids, codes = ready
            own, q = np.frombuffer(t["rids"], "<i8"), matrix(t["data"], t["n"], t["d"])
            probes = np.random.default_rng(7).permutation(len(x))[:PROBES]
            for at in range(0, len(q), 64):
                rough = scan(codes, models[t["d"]].tables(q[at : at + 64]))
                top = [best(r, v, x, left, keys, rids, me, k, rerank, probes) for r, v, me in zip(rough, q[at : at + 64], own[at : at + 64], strict=True)]
                i, j = np.repeat(np.arange(len(top)), [len(rows) for rows, _ in top]), np.concatenate([rows for rows, _ in top])
                yield pa.RecordBatch.from_arrays([pa.array(own[at + i]), pa.array(rids[j]), pa.array(ids[j], mask=none[j]), pa.array(np.concatenate([score for _, score in top]))], ["query", "rid", "vec_id", "score"])

    found = pairs.mapInArrow(lean(run), "query long, rid long, vec_id long, score double")
    queries = rows.where((F.col("id") % every) == 0).select(F.col("rid").alias("query"), F.col("id").alias("query_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "rid")
    nearest = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return nearest.join(queries, "query").select("query_id", "rank", "vec_id", "score")
