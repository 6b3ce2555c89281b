import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from lexweave.llm import language_id, license_scan, packing, pipeline, sentencepiece_codec, toxicity, warc
from lexweave.llm.queries import vocabulary
from lexweave.llm.shingles import shingle_hashes

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType()), T.StructField("length", T.StringType())])
TEXTS = [None, "", " ", "the", "The cat sat.", "The cat sat.", "a\tb\n\nc  d ", "漢字 🙂 ß É\x00", "x" * 9000, "the of and " * 30_000]


def docs(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang[i] if lang else "en", "clash", None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def model():
    return vocabulary("piece_bpe_32k.model").read_bytes()


@pytest.fixture(scope="module")
def tokenizer_json():
    return vocabulary("word_bpe_49k.json").read_text(encoding="utf-8")


def test_codec_equals_the_library(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec = sentencepiece_codec.PrefixTableCodec(model)
    rng = random.Random(5)
    pieces = list(codec.ids)
    letters = [*"ab thein  \n▁ßé🙂漢字́\t.,!", "▁▁", "the ", " \n", "\x00", "<s>", "<0x0A>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(1500)]
    for t in texts:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == sp.decode(ids), t


def test_spine_test_equals_merging(model):
    codec = sentencepiece_codec.PrefixTableCodec(model)
    rng = random.Random(2)
    pieces = [p for p in codec.ids if len(p) < 6]
    for _ in range(4000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        assert codec.compatible(a, b) == (codec.merged(a + b) == [a, b]), (a, b)


def test_encode_digests(spark, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode_digests(docs(spark, TEXTS), model).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_digests(docs(spark, []), model).count() == 0
    assert sentencepiece_codec.encode_texts(docs(spark, TEXTS[:5]), model).where("decoded = 'The cat sat.'").count() == 1


def test_packing_round_trip(spark, tokenizer_json):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    rows = packing.pack(docs(spark, TEXTS), tokenizer_json).toPandas()
    for i, t in enumerate(TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids)
        for r in own.itertuples():
            part = ids[r.start : r.start + r.length]
            assert r.start == 4096 * r.piece and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 4096
    assert packing.pack(docs(spark, []), tokenizer_json).count() == 0


def test_best_fit_equals_a_plain_search():
    rng = random.Random(4)
    bins, free, made = packing.BestFit(100, 5), {}, 0  # free: places of the open bins
    for _ in range(3000):
        n = rng.randint(1, 100)
        at, offset = bins.place(n)
        fits = [f for f in free.values() if f >= n]
        if fits:
            assert free[at] == min(fits) and offset == 100 - min(fits)
            left = free.pop(at) - n
        else:
            assert at == made and offset == 0
            made, left = made + 1, 100 - n
        now = {b: f for f, some in enumerate(bins.free) for b in some}
        if left and len(free) == 5:  # the fullest closes
            closed = set(free) - set(now)
            assert len(closed) == 1 and free[closed.copy().pop()] == min(free.values())
            free.pop(closed.pop())
        if left:
            free[at] = left
        assert now == free and bins.mask == sum(1 << f for f in set(free.values())) and bins.open == len(free)
    with pytest.raises(ValueError):
        bins.place(101)


def test_word_ids_equal_the_tokenizer(tokenizer_json):
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_str(tokenizer_json), packing.WordIds(tokenizer_json)
    rng = random.Random(1)
    letters = [*"aéÉ́Σßẞİ'st 漢🙂1.,!", *(chr(i) for i in range(0x3100) if chr(i).isspace()), "\x01", "<|endoftext|>"]
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 20)))
        assert next(words.of(pa.array([t]))).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["idiot", "moron", "pathetic", "disgusting", "scum", "idiots"]
    machine = toxicity.Automaton(terms)
    rng = random.Random(3)
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "t", "o"])
        w = "".join(w)
        found = [(e, t) for t, term in enumerate(terms) if (e := edit_distance(w, term)) <= toxicity.errors(term)]
        assert machine.match(w) == (min(found)[::-1] if found else None), w
    stems = toxicity.Automaton(["lowei*", "lost"])
    assert stems.match("loweiche") == (0, 0) and stems.match("lost") == (1, 0) and stems.match("lone") is None


def test_toxicity_learns_and_leaves_clean_texts(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abdeglmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["horribel", "nastig", "vilester"]
    texts, toxic = [], []
    for i in range(900):
        t = [rng.choice(words) for _ in range(60)]
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            t[rng.randint(0, 59)] = rng.choice(bad)
        texts.append(" ".join(t))
    texts += [None, "", "x " * 50_000 + "horribel", "a vilestor b", "they said \"nastig\" today"]
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs(spark, texts), labels).toPandas().set_index("doc_id")
    assert len(got) == len(texts) and got.score.between(0, 1).all()
    assert (got.predicted[: len(toxic)].to_numpy() == np.array(toxic)).mean() > 0.99
    assert (got.held_out.to_numpy() == np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(texts))])).all()
    n = len(toxic)
    assert got.predicted[n] == 0 and got.predicted[n + 1] == 0 and got.predicted[n + 2] == 1 and got.predicted[n + 3] == 1
    assert got.score[n + 4] < got.score[n + 2]  # quoted
    assert toxicity.score(docs(spark, []), labels).count() == 0
    none = toxicity.score(docs(spark, texts[:3]), labels.limit(0)).toPandas()
    assert (none.score == 0).all() and (none.predicted == 0).all()
    assert toxicity.cover([], [], 1.0) == []


def test_toxic_context_is_learned(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abdeglmnorstu") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(900):
        t = [rng.choice(words) for _ in range(40)]
        at = rng.randint(14, 30)
        if i % 2:  # these words say nothing by themselves
            t[:4] = ["you", "fool", "dictionary", "entry"]
        if i % 3 == 0:
            t[at : at + 1] = ["you", "horribel", "fool"]
        elif i % 12 == 1:
            t[at : at + 1] = ["dictionary", "horribel", "entry"]
        rows.append((i, " ".join(t), int(i % 3 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert model.context["dictionary"] < 0 < model.context["you"]
    assert model.score("a b you horribel fool c d") > 0.5 > model.score("a b dictionary horribel entry c d")


def test_toxic_lexicon_has_no_bound(spark):
    bad = [f"{a}{b}xyzq" for a in "bcdfghjklmnprst" for b in "aeiou"] + [f"qzyx{a}{b}" for a in "bcdfghjklmnprst" for b in "aeiouy" * 2]
    bad = sorted(set(bad))[:230]
    rows = [(i * 1000 + k, f"some plain text about {bad[i]} and more {k}", 1) for i in range(len(bad)) for k in range(24)] + [(10**7 + k, f"some plain text about {k % 97} and more", 0) for k in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    # each text once a label: the sample keeps one of near copies, so texts differ in their first words
    table = table.selectExpr("doc_id", "concat(doc_id, ' u', doc_id, ' v', doc_id, ' ', text) as text", "toxic")
    model = toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"), sample=20_000)
    assert sum(model.score(f"some plain text about {w} and more") >= 0.5 for w in bad) > 0.95 * len(bad)


def test_language_id(spark):
    rng = random.Random(8)
    parts = {"xx": ["ba", "do", "ki"], "yy": ["th", "ing", "er"], "zz": ["ño", "ción", "á"]}
    texts, langs = [], []
    for i in range(600):
        lang = rng.choice(list(parts))
        langs.append(lang)
        texts.append(" ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randint(3, 40))))
    texts += [None, "", "123 !", "bado " * 300_000]
    langs += [None, "xx", "yy", None]
    got = language_id.identify(docs(spark, texts, langs)).toPandas().set_index("doc_id").sort_index()
    assert got.lang_pred[600:603].tolist() == ["und"] * 3 and got.lang_pred[603] == "xx"
    assert got.score.between(0, 1).all()
    held = got[:600][got.held_out[:600]]
    assert (held.lang_pred == np.array(langs[:600])[held.index]).mean() > 0.98
    assert (got.held_out.to_numpy() == np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(texts))])).all()
    nothing = language_id.identify(docs(spark, ["abc"], [None])).head()
    assert nothing["lang_pred"] == "und" and nothing["score"] == 0
    assert language_id.identify(docs(spark, [])).count() == 0


def test_language_sample_is_not_cut(spark):
    texts = [f"word{i} of a text" for i in range(4200)]
    rows = docs(spark, texts, ["en", "de"] * 2100)
    learned = [i for i in range(4200) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert 3000 < len(learned) <= language_id.SAMPLE
    got = language_id.training_rows(rows.repartition(5))
    assert len(got) == len(learned)
    again = language_id.training_rows(rows.repartition(2))
    assert all(a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(got, again, strict=True))


def test_gram_slots_do_not_depend_on_blocks(monkeypatch):
    text = "abcdefghij" * 20
    whole = [np.sort(s) for s in language_id.gram_slots(text)]
    monkeypatch.setattr(language_id, "BLOCK", 7)
    cut = np.concatenate(list(language_id.gram_slots(text)))
    assert Counter(cut.tolist()) == Counter(np.concatenate(whole).tolist())


def test_alignment_and_scan(spark):
    a, b = "x a b c y d e".split(), "a b z c d e".split()
    assert license_scan.align(a, b) == [(1, 0), (2, 1), (3, 3), (5, 4), (6, 5)]
    assert [p for p in license_scan.rising([(0, 3), (1, 1), (2, 2), (3, 5), (4, 4)])][:2] == [(1, 1), (2, 2)]
    notice = license_scan.TEMPLATES["Apache-2.0/notice"]
    texts = [None, "", "All rights reserved", f"foo {notice} bar", "a " * 100_000 + notice.replace("may not", "cannot"), "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "rights all"]
    got = license_scan.scan(docs(spark, texts)).toPandas()
    assert got[got.doc_id == 2].license.tolist() == ["All-Rights-Reserved"]
    assert got[got.doc_id == 3].license.tolist() == ["Apache-2.0/notice"] and got[got.doc_id == 3].start.tolist() == [4]
    assert got[got.doc_id == 4].license.tolist() == ["Apache-2.0/notice"] and got[got.doc_id == 4].coverage.iloc[0] > 0.95
    assert got[got.doc_id == 5].license.tolist() == ["CC-BY-NC-4.0/line"] * 2
    assert set(got.doc_id) == {2, 3, 4, 5}
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_scan_equals_alignment_at_every_start(spark):
    known = license_scan.TEMPLATES
    lines = ["Licensed under the Apache License, Version 2.0. Released under the MIT License.", "The MIT License. Released under the MIT License.", "Rights reserved. All rights reserved."]
    got = license_scan.scan(docs(spark, lines)).toPandas()
    assert sorted(zip(got.doc_id, got.license, strict=True)) == [(0, "Apache-2.0/line"), (0, "MIT/line"), (1, "MIT/line"), (2, "All-Rights-Reserved")]
    assert all(c == 1 for c in got.coverage) and lines[1][got[got.doc_id == 1].start.iloc[0] :].startswith("Released")
    chosen = {k: t for k, t in known.items() if k.endswith(("line", "work", "Reserved"))} | {"short": "a b c d e f g h i j", "twice": "to be or not to be that is a to b"}
    scanner = license_scan.Scanner(chosen, 0.85)
    rng = random.Random(4)
    pool = [w for t in chosen.values() for w in license_scan.WORD.findall(t.lower())] + ["lorem", "ipsum"]
    n = 0
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 6)):
            own = license_scan.WORD.findall(rng.choice(list(chosen.values())).lower())
            words += [rng.choice(pool) if rng.random() < 0.05 else w for w in own[rng.randint(0, 3) * (rng.random() < 0.4) : len(own) - rng.randint(0, 3) * (rng.random() < 0.4)]]
            words += rng.choices(pool, k=rng.randint(0, 6))
        spans = [m.span() for m in license_scan.WORD.finditer(" ".join(words))]
        found = []
        for name, own in scanner.words.items():
            for at in range(len(words)):
                if words[at] in own:
                    pairs = license_scan.align(words[at : at + 2 * len(own)], own)
                    if len(pairs) >= 0.85 * len(own):
                        found.append((name, len(pairs) / len(own), spans[at + pairs[0][0]][0], spans[at + pairs[-1][0]][1]))
        want: list = []
        for f in sorted(found, key=lambda f: (-f[1] * len(scanner.words[f[0]]), -f[1], f[0], f[3] - f[2], f[2])):
            if all(f[3] <= k[2] or k[3] <= f[2] for k in want):
                want.append(f)
        assert scanner.scan(" ".join(words)) == sorted(want, key=lambda f: f[2])
        n += len(want)
    assert n > 200


def test_common_subsequence_is_longest():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        pairs = license_scan.common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                n[i][j] = n[i - 1][j - 1] + 1 if x == y else max(n[i - 1][j], n[i][j - 1])
        assert len(pairs) == n[-1][-1]


def test_long_gaps_of_repeated_words_are_aligned():
    rng = random.Random(3)
    b = [w for w in "abcdefghijklmnopqrstuvwxyz" for _ in range(3)]
    rng.shuffle(b)
    a = ["x", *(w for w in b for _ in range(2)), "y"]  # no word is unique in both, 158 by 78 words
    assert [j for _, j in license_scan.align(a, b)] == list(range(len(b)))
    assert len(license_scan.Scanner({"own": " ".join(b)}, 0.85).scan(" ".join(a))) == 1


PAGES = [
    (1, "http://a/x", '<html lang="EN"><head><title> A  b </title><script>var t="</p>";</script></head><body><p>One &amp; two<br>three<!-- <b>no</b> --></p><a class=k href="/q?a=1">l</a></body></html>'),
    (1, "http://a/x", "<p>again"), (1, "http://a/x", "<p>again"), (2, None, "plain < text > &copy;"), (3, "u", None), (None, "u", ""), (4, "u", "<style>x" + "y" * 200_000), (5, "u", "a <b"),
]


@pytest.mark.parametrize("seed", range(4))
def test_license_windows_miss_nothing(seed):
    """Against an alignment from every word of the text on, without the filter of words held."""
    rng = random.Random(seed)
    templates = {"a": "all rights reserved", "b": "released under the mit license", "c": "licensed under the apache license version two", "d": "the the of of the of license license"}
    scanner = license_scan.Scanner(templates, 0.8)
    vocabulary_ = sorted({w for t in templates.values() for w in t.split()}) + ["x", "y"]
    for _ in range(150):
        words = [rng.choice(vocabulary_) for _ in range(rng.randint(0, 40))]
        at = rng.randint(0, len(words))
        words[at:at] = rng.choice(list(templates.values())).split()[rng.randint(0, 1) :]
        text, spans, found = " ".join(words), [], []
        for w in words:
            spans.append((sum(len(x) + 1 for x in words[: len(spans)]), sum(len(x) + 1 for x in words[: len(spans)]) + len(w)))
        for name, t in templates.items():
            own = t.split()
            for k in range(len(words)):
                if words[k] in own:
                    pairs = license_scan.align(words[k : k + 2 * len(own)], own)
                    if len(pairs) >= 0.8 * len(own):
                        found.append((name, len(pairs) / len(own), spans[k + pairs[0][0]][0], spans[k + pairs[-1][0]][1]))
        assert scanner.scan(text) == scanner.best(found), text


def test_license_gaps_are_aligned_exactly():
    rng = random.Random(9)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        pairs = license_scan.common(a, b)
        assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_warc_odd_pages(spark):
    html = "<html lang='de\nx' ><a href='/x'>q</a><a href=/y>r</a><A HREF=\"/z\nInjected: 1\">s</a><a data-href='no'>t</a> &#8364;&eacute;&#x41;&#XE9;&bogus;&amp;lt; &nbsp;x&#0;&#55296; AT&T &"
    rows = [(1, "u", html), (1, "u", "<a href='/x'>q</a>"), (1, "u", "<a href='/x'>q</a>"), (2, None, None), (3, None, "<meta charset='UTF-8'><a class=b href = \"k\" >"), (None, "v\r\nX: y", ""), (4, "w", "<abbr href=q> <a\nhref=z>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    found = con.execute(warc.oracle_sql())
    names = [d[0] for d in found.description]
    got = warc.derivatives(warc.responses(pages))
    assert sorted(tuple(str(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(str, r)) for r in found.fetchall())
    blocks = {(r["page_id"], r["warc_type"]): r["block"] for r in got.where("block like '%Injected%' or block like '%€%'").collect()}
    assert "links: 3\r\noutlink: /x\r\noutlink: /y\r\noutlink: /z%0AInjected: 1\r\n" in blocks[1, "metadata"]
    assert "€éAé&bogus;&lt; x&#0;&#55296; AT&T &" in blocks[1, "conversion"]
    records = got.collect()
    assert len({r["record_id"] for r in records}) == len(records) == 12
    assert "\r\nX: y" not in warc.rendered(got).where("page_id is null").head()["warc"]


def test_warc_of_real_responses(spark):
    rows = [(1, "http://a", "2024-05-01T00:00:00Z", "HTTP/1.1 404 Not Found\r\nX-A: b\r\n\r\n<p>gone</p>\r\n\r\nx"), (2, None, None, "HTTP/1.1 204 No Content\r\n"), (3, "b", None, None)]
    got = {r["page_id"]: r for r in warc.parsed(spark.createDataFrame(rows, "page_id long, target_uri string, date string, http string")).collect()}
    assert set(got) == {1, 2} and got[1]["http_headers"] == "HTTP/1.1 404 Not Found\r\nX-A: b\r\n" and got[1]["payload"] == "<p>gone</p>\r\n\r\nx" and got[1]["date"] == "2024-05-01T00:00:00Z"
    assert got[2]["payload"] == "" and got[2]["date"] == warc.EPOCH
    derived = warc.derivatives(warc.parsed(spark.createDataFrame(rows, "page_id long, target_uri string, date string, http string"))).where("page_id = 1").collect()
    assert {r["refers_to"] for r in derived} == {got[1]["record_id"]} and {r["http_headers"] for r in derived} == {got[1]["http_headers"]}


def test_warc_equals_sql(spark):
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, block string, record_id string")
    got = warc.derivatives(warc.responses(pages)).toPandas()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    want = con.execute(warc.oracle_sql()).df()
    key = ["record_id", "warc_type"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) == 14
    for c in b.columns:
        assert a[c].fillna(-1).tolist() == b[c].fillna(-1).tolist(), c
    text = got[(got.page_id == 1) & (got.warc_type == "conversion")].block.tolist()
    assert "One & two\nthree\nl" in text
    made = warc.rendered(warc.derivatives(warc.responses(pages))).where("page_id = 2 and warc_type = 'conversion'").head()["warc"]
    assert made.startswith("WARC/1.1\r\nWARC-Type: conversion\r\n") and "WARC-Refers-To: <urn:uuid:" in made and "WARC-Source-HTTP-Headers: HTTP/1.1 200 OK; " in made
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{source}/documents.parquet")
    odd = [(None, "a text without a number the and of to in is that it was for on are with", "en", "odd", 1), (10**6, None, "en", "odd", 0), (10**6 + 1, "", "en", "odd", 0), (10**6 + 2, "12345 678", "en", "odd", 9)]
    odd += [(10**6 + 3, "the same row of the text that is there two times in all and with it", "en", "odd", 5)] * 2
    rows.unionByName(spark.createDataFrame(odd, rows.schema)).write.parquet(f"{tmp_path}/documents")
    rows = spark.read.parquet(f"{tmp_path}/documents")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    stage = {name: of for name, of in pipeline.STAGES}

    def after(name, docs):
        out = stage[name](spark, docs, source)
        assert out.columns == rows.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    clean = after("toxicity", rows)
    model = toxicity.learn(rows, spark.read.parquet(f"{source}/labels.parquet"))
    assert sorted(map(key, clean.collect())) == sorted(key(r) for r in rows.collect() if model.score(r["text"] or "") < 0.5)
    sure = after("language_id", clean)
    names = language_id.fit(language_id.training_rows(clean))
    assert sorted(map(key, sure.collect())) == sorted(key(r) for r in clean.collect() if names.predict(r["text"])[0] != "und" and names.predict(r["text"])[1] >= pipeline.SURE)
    kept = after("ngram_join", sure)
    left = sorted(sure.collect(), key=key)
    sets = [set(shingle_hashes(r["text"]).tolist()) for r in left]
    first = list(range(len(left)))
    for _ in left:
        for i in range(len(left)):
            for j in range(i):
                if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                    first[i] = first[j] = min(first[i], first[j])
        if all(first[first[i]] == first[i] for i in range(len(left))):
            break
    assert sorted(map(key, kept.collect())) == sorted(key(left[i]) for i in range(len(left)) if first[i] == i)
    packed = stage["packing"](spark, kept, source).toPandas()
    assert sorted(packed[packed.piece == 0].doc_id.fillna(-1)) == sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect())
    for _, own in packed.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset.to_numpy() == np.concatenate([[0], np.cumsum(own.length)[:-1]])).all() and own.length.sum() <= 4096


def test_pipeline_of_an_empty_table(spark):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").limit(0)
    for _, of in pipeline.STAGES:
        assert of(spark, docs, source).count() == 0


def test_packing_memory_does_not_grow_with_a_batch(tokenizer_json):
    import tracemalloc

    words = packing.WordIds(tokenizer_json)
    texts = pa.array(["the cat sat on a mat " * 400] * 1000)  # 8.4 million characters
    tracemalloc.start()
    n = sum(len(ids) for ids in words.of(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1000 * 400 * 6 and peak < 120e6
