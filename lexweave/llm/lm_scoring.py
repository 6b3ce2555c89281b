"""Operator 1: language-model scoring with a weighted backoff automaton.

The model has orders 1 to 3 over words; every n-gram of the training texts counts, whatever its count and whatever
the size of the corpus. Counts are smoothed by a hierarchical Dirichlet prior (``PRIOR``):

    p1(w)      = (c(w) + 0.5) / (N + 0.5 (V + 1)), unknown words being one more class
    p(w | h)   = (c(h w) + k p(w | h without its first word)) / (c(h) + k)

so an n-gram needs its own count and those of its parts, and probabilities add up to one. A history that was seen is
a state; an n-gram that was seen is an arc with log p; the failure arc of a state leads to the history without its
first word and costs log k / (c(h) + k). One traversal of a text, left to right, carries the state and adds up.

Texts are dealt to pieces of bounded size. A piece asks for the counts of the n-grams that it holds: their hashes,
sorted, are cut by range into shards, each (piece, shard) being one row of packed differences. A shard adds up what
all pieces have and answers each in the order in which it asked, so an answer holds counts and no keys. Each piece
then makes the part of the automaton that its texts can reach, which scores them as the whole automaton would; a
traversal is done for all texts of a piece at once, as arrays of states.
Words are known by 60-bit hashes, so among n of them two are taken for one with a probability of n^2 / 2^61; n-grams
by 53-bit ones, so one of n has the count of another added with a probability of n / 2^53 (1e-6 for ten billion).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_text, kind_of, packed_ints, release, unpacked_ints, written
from .shingles import mixed, span_hashes

#: What the shorter history's probability weighs, as a count, in orders 2 and 3.
PRIOR = (4.0, 2.0)


class Sizes(NamedTuple):
    """What is held at a time; results do not depend on it."""

    piece: int = 1 << 20  # tokens of a piece
    text: int = 1 << 21  # bytes that are hashed
    shard: int = 1 << 20  # keys of a shard


#: The end token; it also stands for what is before a text's first word.
END = np.uint64(0x5851F42D4C957F2D)
#: Keys of words lie from here on, those of n-grams below, whose last bits are not used.
WORDS, UNUSED = np.uint64(7 << 61), np.uint64(0x3FF)
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words, parted by the ASCII space characters."""
    return text.encode().lower().split()


def word_hashes(parts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each part's words."""
    data = np.frombuffer(b" ".join(parts).lower(), np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    begins = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    return np.split(span_hashes(data, edge[::2], edge[1::2]), np.searchsorted(edge[::2], begins[1:]))


def cut(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut at white space."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def pieces(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """Pieces of texts, one a row. A part of a text begins with what is before it: the end token, or two tokens.

    piece, n; texts, doc_ids, folds, sizes, leads (tokens that come before) of its parts; ids and words: of each token
    the number of its word, of each of its kinds of words the hash, by falling frequency and then by hash, as differences.
    """
    kind = kind_of(docs, "doc_id")

    def row(number: int, held: list[tuple], arrow: pa.DataType) -> pa.RecordBatch:
        texts, ids, folds, leads, parts = zip(*held, strict=True)
        flat = np.concatenate(parts)
        words, code, n = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        lengths = [len(p) for p in parts]
        lists = [pa.array([x], pa.list_(t)) for x, t in ((texts, pa.int64()), (ids, arrow), (folds, pa.int32()), (lengths, pa.int32()), (leads, pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(flat)]), *lists, pa.array([packed_ints(rank[code])]), pa.array([packed_ints(np.diff(words[order], prepend=np.uint64(0)))]), pa.array([len(words)])], ["piece", "n", "texts", "doc_ids", "folds", "sizes", "leads", "ids", "words", "kinds"])

    def hashed(held: list[tuple]) -> Iterator[tuple]:
        for (text, doc_id, fold, last), words in zip((h[:4] for h in held), word_hashes([h[4] for h in held]), strict=True):
            yield text, doc_id, fold, last, words

    def grouped(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[tuple]:
        held, size, text = [], 0, base
        for b in batches:
            for doc_id, t, fold in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text += 1
                own = list(cut(t.as_py().encode(), sizes.text))
                for k, part in enumerate(own):
                    held.append((text, doc_id, fold, k + 1 == len(own), part))
                    size += len(part)
                    if size >= sizes.text:
                        yield from hashed(held)
                        held, size = [], 0
        if held:
            yield from hashed(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        number, held, size, text, tail = base, [], 0, -1, np.zeros(0, np.uint64)
        arrow = docs_arrow
        for key, doc_id, fold, last, words in grouped(batches, base):
            before = tail[-2:] if key == text else np.array([END])
            tail = np.concatenate([before, words])
            text = key
            if not last and not len(words):
                continue
            part = np.append(tail, END) if last else tail
            held.append((key, doc_id, fold, len(before), part))
            size += len(part)
            if size >= sizes.piece:
                yield row(number, held, arrow)
                number, held, size = number + 1, [], 0
        if held:
            yield row(number, held, arrow)

    from pyspark.sql.pandas.types import to_arrow_type

    docs_arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.mapInArrow(run, f"piece long, n long, texts array<bigint>, doc_ids array<{kind}>, folds array<int>, sizes array<int>, leads array<int>, ids binary, words binary, kinds long")


class Piece:
    """A piece's row, laid out token by token."""

    def __init__(self, row: dict):
        self.sizes, self.leads, self.folds = (np.array(row[c], np.int64) for c in ("sizes", "leads", "folds"))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = unpacked_ints(row["ids"], row["n"], np.uint32).astype(np.int64)
        place = np.arange(row["n"]) - np.repeat(self.starts, self.sizes)
        self.scored = place >= np.repeat(self.leads, self.sizes)
        self.two, self.three = np.flatnonzero(place >= 1), np.flatnonzero((place >= 2) & self.scored)
        self.train = self.scored & (np.repeat(self.folds, self.sizes) != 1)
        self.hashes = np.cumsum(unpacked_ints(row["words"], row["kinds"], np.uint64), dtype=np.uint64)[self.ids]

    def keys(self) -> np.ndarray:
        """The keys of all tokens' words, then bigrams, then trigrams; the lowest bit is left free."""
        h = self.hashes
        pair = h[self.two - 1] * _FIRST + h[self.two]
        triple = (h[self.three - 2] * _FIRST + h[self.three - 1]) * _SECOND + h[self.three]
        grams = (mixed(np.concatenate([pair, triple ^ _SECOND])) >> np.uint64(3)) * np.uint64(7) & ~UNUSED
        return np.concatenate([WORDS + (mixed(h) >> np.uint64(3) & ~np.uint64(1)), grams])

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys, sorted, and how often each is in the training texts."""
        counts = np.concatenate([self.train, self.train[self.two], self.train[self.three]])
        keys = self.keys() | counts.astype(np.uint64)
        keys.sort()
        own = keys & np.uint64(1)
        keys &= ~np.uint64(1)
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        return keys[first], np.add.reduceat(own, first)


def asked(made: DataFrame, shards: int) -> DataFrame:
    """piece, shard, n, keys: what each piece asks each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                keys, n = Piece(row).asked()
                shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
                at = np.flatnonzero(np.diff(shard, prepend=~shard[:1]))
                ends = [*at[1:].tolist(), len(keys)]
                blobs = [packed_ints(np.diff(keys[i:j], prepend=np.uint64(0))) for i, j in zip(at.tolist(), ends, strict=True)]
                times = [packed_ints(n[i:j]) for i, j in zip(at.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["piece"]] * len(at)), pa.array(shard[at].astype(np.int64)), pa.array(np.array(ends) - at), pa.array(blobs, pa.binary()), pa.array(times, pa.binary())], ["piece", "shard", "n", "keys", "times"]
                )

    return made.select("piece", "n", "folds", "sizes", "leads", "ids", "words", "kinds").mapInArrow(run, "piece long, shard long, n long, keys binary, times binary")


def answers(rows: DataFrame) -> DataFrame:
    """piece, shard, n, totals in the order of the keys asked for; kinds and mass: distinct words and tokens of a shard, in one row."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_numpy()
        keys = np.concatenate([np.cumsum(unpacked_ints(k, n, np.uint64), dtype=np.uint64) for k, n in zip(table["keys"].to_pylist(), sizes.tolist(), strict=True)])
        times = np.concatenate([unpacked_ints(k, n, np.uint64) for k, n in zip(table["times"].to_pylist(), sizes.tolist(), strict=True)])
        order = np.argsort(keys)
        keys = keys[order]
        new = np.diff(keys, prepend=~keys[:1]) != 0
        first = np.flatnonzero(new)
        total = np.add.reduceat(times[order], first)
        word = keys[first] >= WORDS
        out = np.empty(len(keys), np.uint64)
        out[order] = total[np.cumsum(new) - 1]
        blobs = [packed_ints(x) for x in np.split(out, np.cumsum(sizes)[:-1])]
        kinds, mass = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        kinds[0], mass[0] = (total[word] > 0).sum(), total[word].sum()
        return pa.table({"piece": table["piece"], "shard": table["shard"], "n": table["n"], "totals": pa.array(blobs, pa.binary()), "kinds": pa.array(kinds), "mass": pa.array(mass)})

    return rows.groupBy("shard").applyInArrow(run, "piece long, shard long, n long, totals binary, kinds long, mass long")


class Automaton:
    """States, weighted arcs and failure arcs: the part that the tokens of a piece can reach.

    State 0 has no history, state 1 + w the word w, state 1 + words + g the bigram g. counts: of the distinct keys;
    at: which of them each of ``Piece.keys`` is. A token leads to the longest history that was seen, whichever arc it
    takes, so the state in which each token is met is known at once and all texts are traversed together.
    """

    def __init__(self, piece: Piece, counts: np.ndarray, at: np.ndarray, total: int, kinds: int, prior: tuple[float, float] = PRIOR):
        n, two, three, (k2, k3) = len(piece.ids), piece.two, piece.three, prior
        self.piece, self.width = piece, int(piece.ids.max()) + 1
        pair = np.zeros(n, np.int64)
        pair[two] = at[n : n + len(two)]
        c1, c2, c3 = (np.zeros(n) for _ in range(3))
        c1[:], c2[two], c3[three] = counts[at[:n]], counts[pair[two]], counts[at[n + len(two) :]]
        p1 = (c1 + 0.5) / (total + 0.5 * (kinds + 1))
        p2, p3 = p1.copy(), np.ones(n)
        p2[two] = (c2[two] + k2 * p1[two]) / (c1[two - 1] + k2)
        p3[three] = (c3[three] + k3 * p2[three]) / (c2[three - 1] + k3)
        self.known = c1 > 0
        #: by the length of the state's history: whether a token has an arc from there, and its weight
        self.arc = [np.ones(n, bool), c2 > 0, c3 > 0]
        self.weight = [np.log10(p1), np.log10(p2), np.log10(p3)]
        #: states that a token leads to: of one word, and the longest; what their failure arcs cost
        self.one = np.where(self.known, 1 + piece.ids, 0)
        self.to = np.where(c2 > 0, 1 + self.width + pair, self.one)
        self.cost = [np.zeros(n), np.log10(k2 / (c1 + k2)), np.log10(k3 / (c2 + k3))]

    def traverse(self) -> np.ndarray:
        """The log-probability of each token that is scored, 0 for those that only come before."""
        out = np.zeros(len(self.to))
        open_ = np.flatnonzero(self.piece.scored)
        state = self.to[open_ - 1]  # carried over from the token before
        while len(open_):
            length = np.minimum(state, 1) + (state > self.width)
            taken = np.zeros(len(open_), bool)
            for k in range(3):
                here = np.flatnonzero(length == k)
                i = open_[here]
                has = self.arc[k][i]
                out[i] += np.where(has, self.weight[k][i], self.cost[k][i - 1])
                taken[here] = has
                if k == 2:
                    state[here] = self.one[i - 1]  # the failure arc: to the history without its first word
                else:
                    state[here] = 0
            open_, state = open_[~taken], state[~taken]
        return out


def found(distinct: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key is among the distinct ones, which are sorted and spread evenly: a table of their first bits, then steps."""
    bits = max(1, len(distinct).bit_length())
    shift = np.uint64(64 - bits)
    table = np.concatenate([[0], np.cumsum(np.bincount((distinct >> shift).astype(np.int64), minlength=1 << bits))])
    at = table[(keys >> shift).astype(np.int64)]
    todo = np.flatnonzero(distinct[at] != keys)
    while len(todo):
        at[todo] += 1
        todo = todo[distinct[at[todo]] != keys[todo]]
    return at


def scored(made: DataFrame, answered: DataFrame, total: int, kinds: int, kind: str, prior: tuple[float, float] = PRIOR) -> DataFrame:
    """text, doc_id, fold, n_tokens, n_known, base_score, score of each part of a text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        right = right.sort_by("shard")
        piece = Piece(row)
        counts = np.concatenate([unpacked_ints(x, n, np.uint64) for x, n in zip(right["totals"].to_pylist(), right["n"].to_pylist(), strict=True)])
        keys = piece.keys()
        own = np.sort(keys)
        own = own[np.flatnonzero(np.diff(own, prepend=~own[:1]))]
        machine = Automaton(piece, counts, found(own, keys), total, kinds, prior)
        known = np.add.reduceat((piece.scored & machine.known).astype(np.int64), piece.starts)
        base = np.add.reduceat(np.where(piece.scored, machine.weight[0], 0.0), piece.starts)
        full = np.add.reduceat(machine.traverse(), piece.starts)
        return pa.table({"text": pa.array(row["texts"], pa.int64()), "doc_id": left["doc_ids"].combine_chunks().flatten(), "fold": pa.array(row["folds"], pa.int32()), "n_tokens": pa.array(piece.sizes - piece.leads), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(full)})

    return made.groupBy("piece").cogroup(answered.groupBy("piece")).applyInArrow(run, f"text long, doc_id {kind}, fold int, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, prior: tuple[float, float] = PRIOR, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Learns from rows whose crc32 of the id modulo 5 is not 1; a null id is never learned from and counts as held
    out. A null or empty text is its end token. Without anything to learn from, base_score and score are 0.
    Repeated rows give repeated rows, an empty table none; extra columns are not read. Texts are scored whole,
    however long: parts of one text carry their history on.
    """
    spark = docs.sparkSession
    base = id_text(docs, F.coalesce(crc_mod("doc_id", 5), F.lit(1)).cast("int").alias("fold"))
    made = written(pieces(base, sizes), "pieces")
    tokens_in_all = made.agg(F.sum("n")).head()[0] or 0
    answered = written(answers(asked(made, max(1, math.ceil(2 * tokens_in_all / sizes.shard)))), "answers")
    release(spark)
    total, kinds = (int(x or 0) for x in answered.agg(F.sum("mass"), F.sum("kinds")).head())
    parts = scored(made, answered.select("piece", "shard", "n", "totals"), total, kinds, kind_of(base, "doc_id"), prior)
    sums = (F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))
    return parts.groupBy("text", "doc_id", "fold").agg(*sums).select("doc_id", (F.col("fold") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
