"""Operator 7: bounded-space online best-fit packing of token sequences.

A fixed number of bins is open at a time. A bitset has bit f set while an open bin has f places free, so the
fullest bin that still takes an item is the lowest set bit from the item's length on. If too many bins are open,
the fullest one closes first.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, id_text, kind_of, lean, written

LENGTH = 4096
#: Bins that one packer holds open; with random arrival the loss against unbounded best fit is far below one percent.
OPEN = 2048
#: Pieces that one packer gets; a piece's row has a few numbers and no text, so this bounds its memory.
PIECES = 250_000
END_ID = 1


class BestFit:
    """place(length) -> (bin, offset)."""

    def __init__(self, capacity: int = LENGTH, most_open: int = OPEN):
        self.capacity, self.most_open = capacity, most_open
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free places
        self.mask = 0
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        got = self.free[free].pop()
        if not self.free[free]:
            self.mask ^= 1 << free
        self.open -= 1
        return got

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"an item has {length} places; a bin has {self.capacity}")
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open >= self.most_open:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            self.free[left].append(at)
            self.mask |= 1 << left
            self.open += 1
        return at, self.capacity - free


#: Letters that composition leaves alone and one character's lower case covers, and what may follow them in a word.
PLAIN, AFTER = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$", ".,!?;:"
#: Space to str.split, but not to the tokenizer.
ODD = "[\x1c-\x1f]"
#: Characters of texts that are split into words at a time.
SLICE = 2_000_000


def byte_letters() -> list[str]:
    """For each byte the printable character that stands for it in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordIds:
    """The ids of texts as 32-bit integers, each word of a slice of texts encoded once.

    The tokenizer drops white space and no token spans it, so a text's ids are its words' ids in order. A word of
    letters and then punctuation has the ids of its lower-cased letters and then those of the punctuation; letters
    like these need no normalising and go straight to the merges. Ids lie in one growing array; a word is a place
    in it, so texts are put together by array operations. Texts with one of four control characters that are space
    to ``split`` but not to the tokenizer are encoded whole.
    """

    def __init__(self, tokenizer_json: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.entries = Tokenizer.from_str(tokenizer_json), entries
        self.merges = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.add([""], [], [0])

    def add(self, words: list[str], flat: list[int], ends: list[int]) -> None:
        """Gives words with known ids, laid end to end, their places."""
        at, n, last = len(self.number), len(words), np.array(ends, np.int64)
        self.number.update(zip(words, range(at, at + n), strict=True))
        while len(self.start) < at + n:
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, self.ids])
        size = np.diff(last, prepend=0)
        self.start[at : at + n], self.size[at : at + n] = self.used + last - size, size
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def places(self, words: list[str], plain: bool) -> np.ndarray:
        """Each distinct word's place; plain words are lower-cased letters."""
        fresh, flat, ends = [w for w in words if w not in self.number], [], []
        merge, letters = self.merges.tokenize, self.letters
        for w in fresh:
            if not plain:
                flat += self.whole(w)
            else:
                flat += [t.id for t in merge(w if w.isascii() else w.encode().decode("latin-1").translate(letters))]
            ends.append(len(flat))
        if fresh:
            self.add(fresh, flat, ends)
        return np.array([self.number[w] for w in words], np.int64)

    def slice_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts laid end to end, and where each text ends."""
        lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        core = pc.utf8_rtrim(words, AFTER)
        plain = pc.match_substring_regex(core, PLAIN)
        core = pc.if_else(plain, pc.utf8_lower(core), words)
        after = pc.if_else(plain, pc.utf8_slice_codeunits(words, 0, 0), "")
        if len(words):
            size = pc.if_else(plain, pc.utf8_length(pc.utf8_rtrim(words, AFTER)), pc.utf8_length(words)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(size < pc.utf8_length(words).to_numpy(zero_copy_only=False))
            rest = np.array([""] * len(words), object)
            rest[at] = [w[n:] for w, n in zip(words.take(pa.array(at)).to_pylist(), size[at].tolist(), strict=True)]
            after = pa.array(rest, pa.string())
        if len(self.number) + len(words) > self.entries:
            self._reset()
        place = np.zeros((len(words), 2), np.int64)
        mask = plain.to_numpy(zero_copy_only=False).astype(bool)
        for column, of, kind in ((0, core.filter(plain), True), (0, core.filter(pc.invert(plain)), False), (1, after, False)):
            own = of.dictionary_encode()
            found = self.places(own.dictionary.to_pylist(), kind)[own.indices.to_numpy()]
            place[mask if kind else ~mask if column == 0 else slice(None), column] = found
        parts = place[coded.indices.to_numpy()].reshape(-1)
        size = self.size[parts]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[parts] - ends + size, size) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[2 * (lists.offsets.to_numpy() - lists.offsets[0].as_py())]
        return ids, bounds[1:]

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids; texts hold no nulls."""
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            done = int(size[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(size, done + SLICE, "right")))
            ids, ends = self.slice_ids(texts.slice(at, upto - at))
            begin = 0
            for k, end in zip(range(at, upto), ends.tolist(), strict=True):
                yield np.array(self.whole(texts[k].as_py()), np.uint32) if odd[k] else ids[begin:end]
                begin = end
            at = upto


_KNOWN: dict[int, WordIds] = {}


def ids_of(tokenizer_json: str) -> WordIds:
    """A worker's encoder; it and its words outlive a task."""
    key = hash(tokenizer_json)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = WordIds(tokenizer_json)
    return _KNOWN[key]


def cut_pieces(docs: DataFrame, tokenizer_json: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces: whole if it fits, else cut every ``length`` ids.

    A null or empty text has one piece, its end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ids_of(tokenizer_json)
        tail = end_id.to_bytes(4, "little")
        for b in batches:
            at, piece, start, size, crc = [], [], [], [], []
            for row, ids in enumerate(encoder.of(b.column(1))):
                for k in range(0, len(ids) + 1, length):  # the end id comes after the others
                    part = ids[k : k + length]
                    last = k + length > len(ids)
                    at.append(row)
                    piece.append(k // length)
                    start.append(k)
                    size.append(len(part) + last)
                    own = zlib.crc32(np.ascontiguousarray(part, "<u4"))
                    crc.append(zlib.crc32(tail, own) if last else own)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return id_text(docs).mapInArrow(lean(run), f"doc_id {kind_of(docs, 'doc_id')}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_json: str, length: int = LENGTH, most_open: int = OPEN, pieces: int = PIECES) -> DataFrame:
    """Each piece with the sequence and the offset that it got.

    The pieces (numbers, no text) are written to the shared folder, so texts are tokenised once and a lost
    executor repeats packing only. They are dealt at random to packers of about ``pieces`` rows, each packing its
    own sequences; a packer loses at most a part of its last open bins, once in ``pieces`` rows.
    Null ids and repeated rows are packed like others; an empty table gives none; other columns are not read.
    """
    cut = written(cut_pieces(docs, tokenizer_json, length).withColumn("slot", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    packers = max(1, math.ceil(cut.count() / pieces))
    kind = kind_of(cut, "doc_id")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot", kind="stable").reset_index(drop=True)
        bins = BestFit(length, most_open)
        placed = [bins.place(n) for n in rows["length"].tolist()]
        rows["sequence_id"] = [(int(key[0]) << 40) + b for b, _ in placed]
        rows["offset"] = [o for _, o in placed]
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = cut.withColumn("packer", F.pmod("slot", F.lit(packers)))
    return dealt.groupBy("packer").applyInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
