"""Operator 5: license scans by patience alignment.

A text and a template are aligned on words that occur once in both: the longest increasing subsequence of their
positions gives anchors, and the gaps between anchors are aligned alike. A gap without such words is aligned by
its longest common subsequence. Coverage is the share of the template's words that are aligned.

Before that, windows of a text are found that hold enough of a template's words to reach the coverage asked for;
aligned words are shared words, so no text without such a window can reach it. A window begins at each word that the
template has and is aligned whatever came of the windows before it; of the passages found the best are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, kind_of

#: Share of a template's words that have to be aligned.
COVERAGE = 0.85
WORD = re.compile(r"[^\W_]+")

# License identifiers and the wording of notices.
TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "MIT/line": "Released under the MIT License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/line": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-3-Clause/line": "Distributed under the BSD 3-Clause License.",
    "MPL-2.0/line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0/work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0/work": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-2.0/notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT/text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without"
        " restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom"
        " the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A"
        " PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "GPL-3.0/notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"
        " of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
}


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first, whose seconds rise: patience sorting with back links."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(y)
            piles.append(k)
        else:
            tops[at], piles[at] = y, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence. A row of its table is an integer: a bit is 0 where the length grows by one."""
    places: dict[str, int] = defaultdict(int)
    for j, w in enumerate(b):
        places[w] |= 1 << j
    row = whole = (1 << len(b)) - 1
    rows = []
    for w in a:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & whole
        rows.append(row)
    i, j = len(a), len(b)
    out = []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:  # as long without b's last word
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:  # as long without a's last word
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        n_a, n_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        where = {w: k for k, w in enumerate(b[j:j_end], j) if n_b[w] == 1}
        anchors = rising([(k, where[w]) for k, w in enumerate(a[i:i_end], i) if n_a[w] == 1 and w in where])
        if anchors:
            out += anchors
            x, y = i, j
            for p, q in [*anchors, (i_end, j_end)]:
                todo.append((x, p, y, q))
                x, y = p + 1, q + 1
        else:
            out += [(i + p, j + q) for p, q in common(a[i:i_end], b[j:j_end])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.words = {name: WORD.findall(t.lower()) for name, t in templates.items()}
        self.need = {name: Counter(w) for name, w in self.words.items()}
        self.all = frozenset(w for ws in self.words.values() for w in ws)

    def windows(self, name: str, places: list[tuple[int, str]]) -> Iterator[tuple[int, int]]:
        """Word ranges of a text, of twice a template's length from each of its words on, that hold enough of its words."""
        need, most = self.need[name], 2 * len(self.words[name])
        least = self.coverage * len(self.words[name])
        have: Counter = Counter()
        held = right = 0
        for at, w in places:
            while right < len(places) and places[right][0] - at < most:
                x = places[right][1]
                have[x] += 1
                held += have[x] <= need[x]
                right += 1
            if held >= least:
                yield at, at + most
            held -= have[w] <= need[w]
            have[w] -= 1

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first character, character after the last) of each passage, whole text."""
        low = text.lower()
        if len(low) != len(text):  # a few capitals have longer lower forms, which would move the positions
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        words = WORD.findall(low)
        own = self.all.intersection(words)
        if not own:
            return []
        near = [name for name, need in self.need.items() if sum(n for w, n in need.items() if w in own) >= self.coverage * len(self.words[name])]
        if not near:
            return []
        at: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for k, w in enumerate(words):
            if w in own:
                for name in near:
                    if w in self.need[name]:
                        at[name].append((k, w))
        out, spans = [], None
        for name in near:
            for start, end in self.windows(name, at[name]):
                pairs = align(words[start:end], self.words[name])
                share = len(pairs) / len(self.words[name])
                if share >= self.coverage:
                    spans = spans or [m.span() for m in WORD.finditer(low)]
                    out.append((name, share, spans[start + pairs[0][0]][0], spans[start + pairs[-1][0]][1]))
        return self.best(out)

    def best(self, found: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
        """Of passages that overlap, the one of most aligned words: a notice outweighs the line it starts with; then the shortest."""
        kept: list[tuple[str, float, int, int]] = []
        starts: list[int] = []
        for f in sorted(set(found), key=lambda f: (-f[1] * len(self.words[f[0]]), -f[1], f[0], f[3] - f[2], f[2])):
            at = bisect_left(starts, f[2])
            if (at == 0 or kept[at - 1][3] <= f[2]) and (at == len(kept) or f[3] <= kept[at][2]):
                kept.insert(at, f)
                starts.insert(at, f[2])
        return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start, end: a row for each license passage of each text, in one pass.

    A null or empty text has none. A null id stays null; repeated rows give repeated rows; an empty table gives
    none; extra columns are not read. Texts are scanned whole; words are parted by what is no letter or digit.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage)
        for b in batches:
            found = [(k, *f) for k, t in enumerate(b.column(1)) for f in scanner.scan(t.as_py())]
            rows, names, shares, starts, ends = zip(*found, strict=True) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "license", "coverage", "start", "end"]
            )

    return id_text(docs).mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, license string, coverage double, start long, end long")
