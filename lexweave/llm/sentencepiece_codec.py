"""Operator 2: SentencePiece BPE encoding and decoding with a prefix table.

Every prefix of a text has one BPE encoding, hence one last token. An automaton reports the pieces that end at
each position; of these exactly one both starts where a prefix ends and is compatible with that prefix's last
token. The table of last tokens is filled left to right and the ids are recovered by walking it backwards.

Two tokens are compatible if BPE over their joined text gives just these two. A merge across a boundary depends
on its two neighbours only, so a sequence is BPE's result if each adjacent pair is compatible.

Texts are cut where no piece can span the cut (before a run of spaces, around a character that no longer piece
contains, between two characters that are neighbours in no piece), so words can be encoded once and reused.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordCache, id_text, kind_of

SPACE = "▁"


class PrefixTableCodec:
    """Encodes and decodes as the library does for a BPE model with identity normalisation and a dummy prefix."""

    def __init__(self, model: bytes, pairs: int = 1_000_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.machine = ahocorasick.Automaton()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.machine.add_word(piece, (piece, len(piece)))
        self.machine.make_automaton()
        self.most = pairs
        self.fits: dict[tuple[str, str], bool] = {}
        #: Characters that are neighbours inside a piece; between any others a text can be cut.
        self.near = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: Each piece's last merge, if BPE makes it from its characters at all.
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.whole = {p for p in self.ids if self._made(p)}
        #: Pieces whose parts, and their parts, each have better scores: their merges happen in the order of scores.
        self.ordered: dict[str, bool] = {}
        #: No piece has a space after another character: a text can be cut before each run of spaces.
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: No longer piece has a line feed: it stands alone.
        self.lines_apart = not any("\n" in p for p in self.ids if len(p) > 1)
        self.stretch = WordCache(self._one)
        self.spaced = WordCache(lambda w: self._coded(SPACE + w))
        self.plain = WordCache(self._coded)
        self.feed = self._coded("\n")

    def merged(self, text: str, last: list | None = None) -> list[str]:
        """BPE by its definition: join the best-scored adjacent pair, leftmost first, until none is a piece."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            if last is not None:
                last[:] = parts[at : at + 2]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _made(self, piece: str) -> bool:
        last: list[str] = []
        whole = self.merged(piece, last) == [piece]
        self.halves[piece] = (last[0], last[1]) if whole and last else None
        return whole

    def _ordered(self, piece: str) -> bool:
        known = self.ordered.get(piece)
        if known is None:
            halves = self.halves.get(piece)
            known = self.ordered[piece] = halves is None or all(len(h) == 1 or (self._ordered(h) and self.score[h] > self.score[piece]) for h in halves)
        return known

    def _spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The symbols that have stood at one end of a piece while it was made, latest first, each with the score of the merge that used it up."""
        out, used = [], float("-inf")
        while True:
            out.append((piece, used))
            halves = self.halves.get(piece)
            if halves is None:
                return out
            used, piece = self.score[piece], halves[side]

    def _apart(self, left: str, right: str) -> bool:
        """Whether no merge crosses from left to right. Two end symbols can merge if both stand at one time and their
        merge comes before those that use them up; an equal score further left comes first."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (x, used_x), (y, used_y) = a[i], b[j]
            s = self.score.get(x + y)
            if s is not None and s > used_x and s >= used_y:
                return False
            if used_x >= used_y:  # back in time: undo the later merge, of equal ones the right one
                if i + 1 < len(a) and (j + 1 == len(b) or a[i + 1][1] <= b[j + 1][1]):
                    i += 1
                elif j + 1 < len(b):
                    j += 1
                else:
                    return True
            elif j + 1 < len(b) and (i + 1 == len(a) or b[j + 1][1] <= a[i + 1][1]):
                j += 1
            elif i + 1 < len(a):
                i += 1
            else:
                return True

    def compatible(self, last: str, piece: str) -> bool:
        if len(self.fits) >= self.most:
            self.fits.clear()
        if not last or piece not in self.whole:
            found = piece in self.whole
        elif self._ordered(last) and self._ordered(piece):
            found = self._apart(last, piece)
        else:
            found = self.merged(last + piece) == [last, piece]
        self.fits[last, piece] = found
        return found

    def pieces(self, text: str) -> list[str]:
        """The prefix table of one stretch of text, read backwards. An unknown character is a token of its own."""
        n, fits = len(text), self.fits
        last: list[str] = [""] * (n + 1)
        strange = [i for i, c in enumerate(text, 1) if c not in self.ids]
        at = 0
        for end, (piece, length) in self.machine.iter(text):
            end += 1
            while at < len(strange) and (i := strange[at]) < end:  # no piece fits there: the unknown character is the token
                last[i] = last[i] or text[i - 1]
                at += 1
            if last[end]:
                continue
            before = last[end - length]
            fit = fits.get((before, piece))
            if fit is None:
                fit = self.compatible(before, piece)
            if fit:
                last[end] = piece
        for i in strange[at:]:
            last[i] = last[i] or text[i - 1]
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def _coded(self, text: str) -> tuple[bytes, bytes]:
        """A stretch, cut where no piece has the two characters side by side."""
        if text.lstrip(SPACE).isalpha():
            return self._one(text)
        near, at, out = self.near, 0, []
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in near:
                out.append(self.stretch[text[at:i]])
                at = i
        if not at:
            return self._one(text)
        out.append(self.stretch[text[at:]])
        return b"".join([p[0] for p in out]), b"".join([p[1] for p in out])

    def _one(self, text: str) -> tuple[bytes, bytes]:
        ids: list[int] = []
        for p in self.pieces(text):
            i = self.ids.get(p)
            if i is not None:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in p.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return array("I", ids).tobytes(), self.text_of(ids)

    def text_of(self, ids: Iterable[int]) -> bytes:
        """The bytes that ids stand for, spaces restored; the dummy prefix is still there."""
        if not hasattr(self, "shown"):
            self.shown = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        return b"".join(self.shown.get(i, b"") if i != self.unknown else " ⁇ ".encode() for i in ids)

    def parts(self, text: str) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of the stretches of a text, in order."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if not self.words_apart:
            return [self._coded((SPACE + text).replace(" ", SPACE))]
        if "  " in text or text[0] == " " or text[-1] == " " or " \n" in text:
            return [self.plain[x] for x in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", (SPACE + text).replace(" ", SPACE))]
        spaced, plain = self.spaced, self.plain
        if not self.lines_apart or "\n" not in text:
            return [spaced[w] for w in text.split(" ")]
        out: list[tuple[bytes, bytes]] = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                out.append(self.feed)
                if words[0]:
                    out.append(plain[words[0]])
                elif len(words) > 1:
                    out.append(plain[""])
            else:
                out.append(spaced[words[0]])
            out += [spaced[w] for w in words[1:]]
        return out

    def encode(self, text: str) -> list[int]:
        """All ids, begin and end among them."""
        return [self.begin, *array("I", b"".join(p[0] for p in self.parts(text))), self.end]

    def decode(self, ids: Iterable[int]) -> str:
        out = self.text_of(ids)
        return out[out[:1] == b" " :].decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        parts = self.parts(text)
        ids = b"".join([p[0] for p in parts])
        shown = b"".join([p[1] for p in parts])
        whole = array("I", [self.begin]).tobytes() + ids + array("I", [self.end]).tobytes()
        return len(whole) // 4, hashlib.sha256(whole).hexdigest(), hashlib.sha256(shown[shown[:1] == b" " :]).hexdigest()


_CODECS: dict[bytes, PrefixTableCodec] = {}


def codec_of(model: bytes) -> PrefixTableCodec:
    """A worker's codec of a model; it and its caches outlive a task."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PrefixTableCodec(model)
    return _CODECS[key]


def encode_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, in one pass without a shuffle.

    A null text counts as empty: its ids are begin and end. A null id stays null; repeated rows give repeated
    rows; an empty table gives none; other columns, whatever their names, are not read. Texts of any length are
    encoded whole, in time linear in their length; what a worker keeps (words, pairs) is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for b in batches:
            rows = [codec.digest(t.as_py()) for t in b.column(1)]
            n, ids, shown = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(shown, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids array<int>, decoded string: the real encodings, for use beyond digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for b in batches:
            ids = [codec.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return id_text(docs).mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, ids array<int>, decoded string")
