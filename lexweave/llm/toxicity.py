"""Operator 3: toxicity by a lexicon trie intersected with Levenshtein automata, and context windows.

A lexicon of words and word stems is learned from labelled documents: candidates that are far more frequent in
toxic ones, then a greedy cover that takes a term only for documents that no earlier term explains, so words
that merely come along in copies of a document stay out. A likelihood test alone sets its size. The trie of the lexicon and the Levenshtein automata of
its terms are walked together; a state of the product is a set of (trie node, errors), made on demand.
Around each match a window is scored: marks and words of reporting speak for a quotation, and the words that
training windows of toxic or of clean documents have more often weigh for or against it. Matches by kind (exact or
misspelled), shared between abuse and quotation by that score, are the inputs of a logistic regression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, crc_mod, id_text, kind_of, sampled, written
from .shingles import shingle_hashes

#: Labelled documents that the lexicon and the weights are fitted on, half of each label: the documented bound.
SAMPLE = 8000
#: Terms that a table too small for any sure term may choose from.
UNSURE = 20
#: What a sign of quotation, or its absence, weighs in the score of a window; the most that a word weighs.
SIGN, WORD_WEIGHT = 4.0, 3.0
WORD = re.compile(r"[^\W_]+")
STEMS = range(4, 9)
#: Words on each side of a match that its context is read from.
WINDOW = 6
# Quotation marks, and words that report what somebody said.
MARKS = "\"“”„«»‹›"
REPORTING = frozenset("said says called calling wrote quote quoted word term phrase dit disait mot sagte schrieb wort dijo palabra escribió".split())


def errors(term: str) -> int:
    """Misspellings that a term's matches may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Automaton:
    """The trie of terms, walked with up to errors(term) insertions, deletions and substitutions.

    A term that ends in * is a stem: what follows it is free.
    """

    terms: list[str]
    fuzzy: frozenset[int] | None = None  # terms that may be misspelled; None: all
    nodes: list[dict[str, int]] = field(default_factory=lambda: [{}])
    most: list[int] = field(default_factory=lambda: [0])  # errors that a term below the node may have
    ends: dict[int, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for t, term in enumerate(self.terms):
            at, k = 0, self.allowed(t)
            self.most[0] = max(self.most[0], k)
            for c in term.rstrip("*"):
                if c not in self.nodes[at]:
                    self.nodes[at][c] = len(self.nodes)
                    self.nodes.append({})
                    self.most.append(0)
                at = self.nodes[at][c]
                self.most[at] = max(self.most[at], k)
            self.ends.setdefault(at, []).append(t)
        self.alphabet = {c for n in self.nodes for c in n}
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.final: list[tuple[int, int] | None] = []  # best term and errors if the word ends here
        self.early: list[tuple[int, int] | None] = []  # the same for stems, whatever follows
        self.start = self._state({0: 0})

    def allowed(self, t: int) -> int:
        return errors(self.terms[t].rstrip("*")) if self.fuzzy is None or t in self.fuzzy else 0

    def _state(self, at: dict[int, int]) -> int:
        todo = list(at)
        while todo:  # a letter of the term is left out
            n = todo.pop()
            for child in self.nodes[n].values():
                e = at[n] + 1
                if e <= self.most[child] and e < at.get(child, 99):
                    at[child] = e
                    todo.append(child)
        key = tuple(sorted(at.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            found = [(e, t) for n, e in key for t in self.ends.get(n, ()) if e <= self.allowed(t)]
            self.final.append(min(found)[::-1] if found else None)
            stems = [(e, t) for e, t in found if self.terms[t].endswith("*") and e == 0]
            self.early.append(min(stems)[::-1] if stems else None)
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        at: dict[int, int] = {}
        for n, e in self.states[state]:
            for x, child in self.nodes[n].items():
                cost = e + (x != c)
                if cost <= self.most[child] and cost < at.get(child, 99):
                    at[child] = cost
            if e + 1 <= self.most[n] and e + 1 < at.get(n, 99):  # a letter too many
                at[n] = e + 1
        return self._state(at) if at else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """The term that a word stands for and its errors, least errors first."""
        state, stem = self.start, None
        for c in word:
            c = c if c in self.alphabet else "\0"
            steps = self.steps[state]
            to = steps.get(c)
            if to is None:
                to = steps[c] = self._step(state, c)
            if to < 0:
                return stem
            state = to
            stem = stem or self.early[state]
        found = self.final[state]
        return found if found and (stem is None or found[1] == 0) else stem


@dataclass
class Model:
    terms: list[str]
    fuzzy: frozenset[int] | None = None
    weights: tuple[float, ...] = (0.0,) * 5  # of the four kinds of matches, then the bias
    context: dict[str, float] = field(default_factory=dict)  # words of a window: above 0 they speak for abuse

    def __post_init__(self) -> None:
        self.machine = Automaton(self.terms, self.fuzzy)
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def matches(self, text: str) -> list[tuple[int, int, int, bool, list[str]]]:
        """(position, term, errors, whether marks or words of reporting are near, window) of each word that stands for a term."""
        text = text.lower()
        words = WORD.findall(text)
        own = set(words)
        fresh = own - self.seen
        if fresh:
            if len(self.seen) + len(fresh) > CACHE_ENTRIES:
                self.seen.clear()
                self.hits.clear()
                fresh = own
            match = self.machine.match
            self.hits.update((w, m) for w in fresh if (m := match(w)))
            self.seen |= fresh
        if own.isdisjoint(self.hits):
            return []
        out = []
        for i, m in enumerate(WORD.finditer(text)):
            if hit := self.hits.get(m.group()):
                near = text[max(0, m.start() - 80) : m.start()], text[m.end() : m.end() + 80]
                window = words[max(0, i - WINDOW) : i] + words[i + 1 : i + WINDOW + 1]
                out.append((i, *hit, quoted(*near) or not REPORTING.isdisjoint(window), window))
        return out

    def inputs(self, text: str) -> np.ndarray:
        x = np.zeros(4)
        for _, _, e, sign, window in self.matches(text):
            q = self.quotation(sign, window)
            x[2 * (e > 0)] += 1 - q
            x[2 * (e > 0) + 1] += q
        return np.minimum(x, 3)

    def quotation(self, sign: bool, window: list[str]) -> float:
        """How likely a match in this window is quoted, 0 to 1."""
        z = (SIGN if sign else -SIGN) - sum(self.context.get(w, 0.0) for w in set(window))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str) -> float:
        if not self.terms:
            return 0.0
        return float(1 / (1 + np.exp(-(self.inputs(text) @ self.weights[:4] + self.weights[4]))))


def quoted(before: str, after: str) -> bool:
    """Whether an odd number of quotation marks opens before a match, on its line, and one closes after it."""
    before, after = before.rsplit("\n", 1)[-1], after.split("\n", 1)[0]
    return sum(map(before.count, MARKS)) % 2 == 1 and any(m in after for m in MARKS)


def vocabulary(text: str) -> set[str]:
    """The words of a text and their stems."""
    words = set(WORD.findall(text.lower()))
    return {w for w in words if 3 <= len(w) <= 40} | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic (0 or 1) of a bounded sample of the rows to learn from; a document with two labels takes the larger."""
    known = labels.where((crc_mod("doc_id", 5) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = sampled(known, "toxic", "doc_id", sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lows = [int(s.min() >> np.uint64(1)) if len(s := shingle_hashes(t.as_py())) else 0 for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lows, pa.int64())], ["text", "toxic", "low"])

    # copies and near copies most often share their least shingle: one of them is enough to learn from
    return rows.mapInArrow(marked, "text string, toxic int, low long").groupBy("low", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def counted(rows: DataFrame, kind: str, of) -> DataFrame:
    """How many of the rows of each label have a term; added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes, no, n = Counter(), Counter(), [0, 0]
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1), strict=True):
                (yes if toxic.as_py() else no).update(of(text.as_py()))
                n[toxic.as_py()] += 1
        both = list(yes.keys() | no.keys())
        yield pa.RecordBatch.from_arrays([pa.array([*both, ""], pa.string()), pa.array([*(yes[t] for t in both), n[1]], pa.int64()), pa.array([*(no[t] for t in both), n[0]], pa.int64())], ["term", "yes", "no"])

    return rows.mapInArrow(run, "term string, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = written(labelled(docs, labels, sample), "toxic-sample")
    counts = written(counted(rows, "terms", vocabulary), "toxic-terms")
    totals = counts.where("term = ''").head()
    if totals is None or not totals["yes"] or not totals["no"]:
        return Model([])
    n_yes, n_no = totals["yes"], totals["no"]
    # likelihood ratio of a term's share of toxic documents against all documents' share; it must outweigh that
    # this many terms were tried
    share, n = n_yes / (n_yes + n_no), F.col("yes") + F.col("no")
    gain = F.col("yes") * F.log(F.col("yes") / (n * share)) + F.when(F.col("no") > 0, F.col("no") * F.log(F.col("no") / (n * (1 - share)))).otherwise(0.0)
    tried = math.log(max(2, counts.where("yes + no >= 2").count())) + 2
    rated = counts.where("term != '' and yes >= 2").withColumn("sure", gain).where(F.col("yes") > n * share)
    found = rated.where(F.col("sure") > tried).orderBy(F.desc("sure"), F.desc(F.length("term")), "term").collect()  # of a bounded sample
    if not found:  # too few rows to be sure of any term
        found = rated.where("no = 0").orderBy(F.desc("sure"), F.desc(F.length("term")), "term").limit(UNSURE).collect()
    if not found:
        return Model([])
    names = [r["term"] for r in found]
    index = {t: i for i, t in enumerate(names)}

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            has = [np.array(sorted(index[t] for t in vocabulary(x.as_py()) if t in index), "<i4").tobytes() for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.binary()), b.column(1)], ["has", "toxic"])

    have = [(np.frombuffer(r[0], "<i4"), r[1]) for r in rows.mapInArrow(having, "has binary, toxic int").collect()]
    terms = [names[i] for i in cover(have, names, n_yes / n_no)]
    machine = Model(terms)

    def misspelled(text: str) -> set[str]:
        return {str(t) for _, t, e, *_ in machine.matches(text) if e}

    wrong = counted(rows, "misspelled", misspelled).where("term != ''").collect()
    # misspellings of a term count unless they are as usual in clean documents
    bad = {int(r["term"]) for r in wrong if (r["yes"] + 0.5) / n_yes < 4 * (r["no"] + 0.5) / n_no}
    fuzzy = frozenset(range(len(terms))) - bad
    plain = Model(terms, fuzzy)

    def near(text: str) -> set[str]:
        found = plain.matches(text)
        return {w for *_, window in found for w in window} | ({" "} if found else set())

    model = Model(terms, fuzzy, context=context_weights(counted(rows, "context", near)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([model.inputs(t.as_py()) for t in b.column(0)]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(4)), b.column(1)], ["a", "b", "c", "d", "toxic"])

    data = np.array([tuple(r) for r in rows.mapInArrow(read, "a double, b double, c double, d double, toxic int").collect()])
    model.weights = regression(data[:, :4], data[:, 4])
    return model


def cover(have: list[tuple[np.ndarray, int]], names: list[str], odds: float) -> list[int]:
    """Terms in the order in which they explain most toxic documents that no earlier term does; clean ones count against a term."""
    yes = [set(h.tolist()) for h, toxic in have if toxic]
    cost = Counter(i for h, toxic in have if not toxic for i in h.tolist())
    gain, of = Counter(), {}
    for d, terms in enumerate(yes):
        gain.update(terms)
        for i in terms:
            of.setdefault(i, set()).add(d)
    least = max(3, min(10, 0.02 * len(yes)))
    chosen: list[int] = []
    open_docs = set(range(len(yes)))
    while gain:
        value = {i: n - 4 * odds * cost[i] for i, n in gain.items() if n > 0}
        if not value:
            break
        # of equal ones the longer, and a word before a stem that says the same
        best = max(value, key=lambda i: (value[i], not names[i].endswith("*"), len(names[i]), names[i]))
        if value[best] < least and chosen:
            break
        chosen.append(best)
        for d in of[best] & open_docs:
            gain.subtract(yes[d])
        open_docs -= of[best]
    # terms that are as pure as those chosen and frequent, though earlier ones explain their documents
    for i, docs in of.items():
        if i not in chosen and not names[i].endswith("*") and len(docs) >= max(least, 0.05 * len(yes)) and not cost[i]:
            chosen.append(i)
    return chosen


def context_weights(counts: DataFrame) -> dict[str, float]:
    """Log odds of words of windows (the blank term counts all documents that have one), of those whose odds are surely not even."""
    rows = counts.where("term != ''").withColumn("n", F.col("yes") + F.col("no")).where("n >= 5").collect()  # of a bounded sample
    whole = next((r for r in rows if r["term"] == " "), None)
    if whole is None or not whole["yes"] or not whole["no"]:
        return {}
    share, tried = whole["yes"] / whole["n"], math.log(max(2, len(rows))) + 2
    out = {}
    for r in rows:
        sure = sum(k * math.log(k / (r["n"] * s)) for k, s in ((r["yes"], share), (r["no"], 1 - share)) if k)
        if r["term"] != " " and sure > tried:
            odds = math.log((r["yes"] + 0.5) / (whole["yes"] + 1)) - math.log((r["no"] + 0.5) / (whole["no"] + 1))
            out[r["term"]] = max(-WORD_WEIGHT, min(WORD_WEIGHT, odds))
    return out


def regression(x: np.ndarray, y: np.ndarray, decay: float = 0.02, steps: int = 60) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small quadratic penalty; labels weigh alike."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(5)
    penalty = decay * np.array([1, 1, 1, 1, 0.01]) * np.sqrt(len(y))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (p - y)) + penalty * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    # kinds of matches that training never saw: quoted, misspelled, both
    for kind, share in ((1, 0.4), (2, 0.95), (3, 0.3)):
        if x[:, kind].max(initial=0) < 0.5:
            w[kind] = share * max(w[0], 0.0)
    return tuple(map(float, w))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    Learns from at most about ``sample`` labelled rows whose crc32 of the id modulo 5 is not 0. A null or empty
    text has no match and gets the score that this has. Without labels to learn from every score is 0. A null id
    counts as held out. Repeated rows give repeated rows of equal scores, an empty table none; extra columns are not read.
    """
    model = learn(docs, labels, sample)
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(True)).alias("held_out")
    return scored(id_text(docs, held), model)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    terms, fuzzy, weights, context = model.terms, model.fuzzy, model.weights, model.context

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(terms, fuzzy, weights, context)
        for b in batches:
            s = [own.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind_of(rows, 'doc_id')}, held_out boolean, score double, predicted int")
