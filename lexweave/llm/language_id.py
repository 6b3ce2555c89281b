"""Operator 10: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

The n-grams of a text (orders 1 to 4, lower case, hashed) are counted, divided by their number and weighted by
inverse document frequency. Weights are trained with follow-the-regularised-leader (FTRL-proximal) and an elastic
net, which leaves most of them zero; a temperature fitted on rows kept from training calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_text, kind_of, sampled, written

ORDERS = (1, 2, 3, 4)
BITS = 18
#: Documents that the classifier is fitted on, alike many of each language: the documented bound of the sample.
SAMPLE = 4000
UNDETERMINED = "und"
#: Characters that are hashed at a time; a longer text is taken in blocks with the overlap that n-grams need.
BLOCK = 1 << 20


def gram_slots(text: str, bits: int = BITS) -> Iterator[np.ndarray]:
    """The slots of all n-grams of a text, order by order and block by block."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    shift = np.uint64(64 - bits)
    for at in range(0, len(points), BLOCK):
        codes = points[at : at + BLOCK + max(ORDERS) - 1].astype(np.uint64)
        own = min(BLOCK, len(points) - at)
        rolled = np.zeros(len(codes), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            rolled = (rolled[: len(codes) - n + 1] * np.uint64(0x100000001B3)) + codes[n - 1 :] if n > 1 else codes
            if n in ORDERS:
                yield ((rolled[:own] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> shift


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # slots x languages, inverse document frequencies folded in
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        total, grams = np.zeros(len(self.languages)), 0
        for slots in gram_slots(text.lower()):
            total += self.weights[slots].sum(axis=0, dtype=np.float64)
            grams += len(slots)
        return total / max(grams, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())  # the first of equals: languages are sorted
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], alpha: float = 5.0, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4, rounds: int = 4, bits: int = BITS) -> Model:
    """rows: (language, slots, shares of the n-grams) in a fixed order; every fifth is kept for the temperature."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0))
    index, k = {v: i for i, v in enumerate(languages)}, len(languages)
    kept = [r for i, r in enumerate(rows) if i % 5 == 4] if len(rows) >= 50 else rows
    train = [r for i, r in enumerate(rows) if i % 5 != 4] if len(rows) >= 50 else rows
    df = np.zeros(1 << bits)
    for _, slots, _ in train:
        df[slots] += 1
    idf = (np.log((1 + len(train)) / (1 + df)) + 1) * (df > 0)
    z, n = np.zeros((1 << bits, k)), np.zeros((1 << bits, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def solved(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(train)):
            language, slots, share = train[i]
            x = (share * idf[slots])[:, None]
            w, b = solved(z[slots], n[slots], l1), solved(zb, nb, 0.0)
            g = softmax((w * x).sum(axis=0) + b)
            g[index[language]] -= 1
            step = g * x
            z[slots] += step - (np.sqrt(n[slots] + step**2) - np.sqrt(n[slots])) / alpha * w
            n[slots] += step**2
            zb += g - (np.sqrt(nb + g**2) - np.sqrt(nb)) / alpha * b
            nb += g**2
    weights, bias = solved(z, n, l1) * idf[:, None], solved(zb, nb, 0.0)
    model = Model(languages, weights.astype(np.float32), bias)
    logits = np.array([(weights[s] * p[:, None]).sum(axis=0) + bias for _, s, p in kept])
    truth = np.array([index[r[0]] for r in kept])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def training_rows(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Counted n-grams of a bounded sample of the rows to learn from; texts are counted on the executors."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots, shares = [], []
            for t in b.column(1):
                found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *gram_slots(t.as_py().lower(), bits)]), return_counts=True)
                slots.append(found.astype("<i4").tobytes())
                shares.append((n / max(n.sum(), 1)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(slots, pa.binary()), pa.array(shares, pa.binary()), b.column(0).cast(pa.string())], ["lang", "slots", "shares", "id"])

    table = written(sampled(rows, "lang", "doc_id", sample, counts).mapInArrow(counted, "lang string, slots binary, shares binary, id string"), "grams")
    # row by row, so that the driver holds the sample once
    found = [(hash_order(r[3]), r[3], r[0], bytes(r[1]), bytes(r[2])) for r in table.toLocalIterator() if len(r[1])]
    found.sort(key=lambda r: r[:4])
    return [(r[2], np.frombuffer(r[3], "<i4"), np.frombuffer(r[4], "<f4")) for r in found]


def hash_order(key: str) -> int:
    import zlib

    return zlib.crc32(b"order" + key.encode())


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row.

    Learns from text and lang of at most about ``sample`` rows whose crc32 of the id modulo 4 is not 2. A null
    text, or one without a letter, is ``und`` with score 0; so is every text if there is nothing to learn from.
    A null id is never learned from and counts as held out. Repeated rows give repeated rows; an empty table
    gives none; extra columns are not read. Texts of any length are read whole, in blocks.
    """
    model = fit(training_rows(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(True)).alias("held_out")
    return id_text(docs, held).mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, held_out boolean, lang_pred string, score double")


