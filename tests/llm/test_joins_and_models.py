import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lexweave.llm import embedding_dedup, lm_scoring, ngram_join, vector_search
from lexweave.llm.components import components
from lexweave.llm.shingles import shingle_hashes


def classes_of(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


def texts_with_copies(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    return texts + [None, "", "  ", "one two", "One  two", "one two three", texts[0], texts[0]]


@pytest.mark.parametrize("block,group", [(192, 768), (4, 8)])
def test_join_equals_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "GROUP", group)
    texts = texts_with_copies()
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, rid string, copies int").repartition(3)
    got = ngram_join.join(rows).toPandas().sort_values("doc_id")
    sets = [set(shingle_hashes(t).tolist()) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 - 1e-9]
    n = Counter(x for pair in linked for x in pair)
    assert got.n_links.tolist() == [n[i] for i in range(len(texts))]
    assert got.class_id.tolist() == classes_of(len(texts), linked)


@pytest.mark.parametrize("n", [2, 3, 40, 2000])
def test_components_of_a_path(spark, n):
    order = list(range(n))
    random.Random(n).shuffle(order)
    edges = [(f"n{order[i]:04}", f"n{order[i + 1]:04}") for i in range(n - 1)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"n{i:04}": "n0000" for i in range(n)} | {"x": "x", "y": "x"}


def test_one_of_each_keeps_a_row_of_repeated_rows(spark, tmp_path):
    text = "a b c d e f g"
    rows = spark.createDataFrame([(3, text, "p"), (3, text, "p"), (1, "other words", "q"), (None, text, "r"), (4, None, "s")], "doc_id long, text string, key string")
    rows.repartition(3).write.parquet(f"{tmp_path}/docs")
    for table in (rows, spark.read.parquet(f"{tmp_path}/docs"), rows.repartition(2)):
        kept = ngram_join.one_of_each(table)
        assert kept.columns == rows.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "other words", "q"), (3, text, "p"), (4, None, "s")]


def test_join_odd_tables(spark):
    schema = "doc_id long, text string"
    assert ngram_join.join(spark.createDataFrame([], schema)).count() == 0
    text = "a b c d e f g"
    rows = ngram_join.classes(spark.createDataFrame([(None, text), (3, text), (3, text), (2, "h" * 50), (1, None)], schema)).collect()
    by_class = Counter((r["class_id"], r["n_links"]) for r in rows)
    assert by_class == {(3, 2): 3, (2, 0): 1, (1, 0): 1}
    assert sum(r["kept"] for r in rows) == 3


def test_shingles_ignore_space_and_case():
    a = shingle_hashes("One two\nthree  four FIVE six")
    assert len(a) == 2 and (a == shingle_hashes("one two three four five six")).all()
    assert len(shingle_hashes("x")) == 1 and len(shingle_hashes(None)) == 0


def test_fewest_equal_is_the_posterior_bound():
    # P(J >= t | m of n equal) under a uniform prior, by numbers
    for k, m in enumerate(ngram_join.fewest_equal(0.8, 1e-6)):
        n = 32 * (k + 1)
        x = (np.arange(200_000) + 0.5) / 200_000
        for equal, enough in ((m, True), (m - 1, False)):
            log = equal * np.log(x) + (n - equal) * np.log1p(-x)
            p = np.exp(log - log.max())
            assert (p[x >= 0.8].sum() / p.sum() >= 1e-6) == enough


def test_components(spark):
    edges = [(i, (i - 1) // 2) for i in range(1, 400)] + [(1000, 1001), (1002, 1001), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(400)) and got[1002] == 1000


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.08, np.repeat(base[:1], 15, 0) + rng.normal(size=(15, 16)) * 0.1, base[:3] * 7])
    return x


@pytest.mark.parametrize("block", [8192, 16])
def test_embedding_links_equal_brute_force(spark, block):
    x = vectors()
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(1000 + i, v, "x") for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    got = embedding_dedup.near_duplicates(table, block=block).toPandas().set_index("vec_id").sort_index()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    linked = [(i, j) for i, j in zip(*np.nonzero(close), strict=True) if j < i]
    assert got.n_links.iloc[: len(x)].tolist() == (close.sum(axis=1) - 1).tolist()
    assert got.component_id.iloc[: len(x)].tolist() == classes_of(len(x), linked)
    assert (got.kept == (got.index == got.component_id)).all()
    assert got.n_links.loc[1000:].tolist() == [0] * 6 + [1, 1] and got.component_id[1007] == 1006
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("d", [3, 64, 2100])
def test_quantisation_bound_holds(d):
    rng = np.random.default_rng(3)
    x = embedding_dedup.unit(rng.normal(size=(60, d)))
    x[30:] = embedding_dedup.unit(x[:30] + 0.01 * rng.normal(size=(30, d)))
    q, s, e = embedding_dedup.quantised(x)
    whole = embedding_dedup.products(q, q)
    assert (whole == q.astype(np.int64) @ q.astype(np.int64).T).all()
    upper = whole * np.outer(s, s) + e[:, None] + e[None, :] * (1 + e[:, None])
    assert (upper >= x @ x.T - 1e-12 * d).all() and (upper <= x @ x.T + 5 * e.max()).all()
    i, j = embedding_dedup.tile_links(x, x, True, 0.9)
    assert {*zip(i.tolist(), j.tolist(), strict=True)} == {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if i < j}


def test_search_recall_and_order(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5000, 32)).astype(np.float32).astype(np.float64)
    x[100:400] = x[100] + rng.normal(size=(300, 32)) * 0.05
    x[41] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9020, [0.0] * 32), (None, x[7].tolist())]
    got = vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=1500).toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 5000, 20))
    hits = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and own.score.is_monotonic_decreasing and q not in set(own.vec_id)
        exact = x @ x[q]
        exact[q] = -np.inf
        known = own[own.vec_id.notna()]
        assert np.allclose(exact[known.vec_id.astype(int)], known.score, rtol=1e-12)
        hits += len(set(np.argsort(-exact)[:20]) & set(known.vec_id))
    assert vector_search.RERANK * 10 < len(x) and hits / len(got) >= 0.9  # under a tenth is ranked exactly
    few = vector_search.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).toPandas()
    assert few.vec_id.tolist() in ([1, 2], [2, 1]) and few["rank"].tolist() == [1, 2]
    assert vector_search.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_search_gives_ties_to_smaller_ids(spark):
    rng = np.random.default_rng(6)
    same = rng.normal(size=33)
    x = [same.tolist()] * 1003 + rng.normal(size=(300, 33)).tolist()
    rows = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string").repartition(5)
    got = vector_search.search(rows, block=400).where("query_id < 1000").orderBy("query_id", "rank").toPandas()
    assert len(got) == 50 * 20
    for q, own in got.groupby("query_id"):
        assert own.vec_id.tolist() == [i for i in range(21) if i != q][:20] and own.score.nunique() == 1
    twice = vector_search.search(spark.createDataFrame([(20, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<double>"))
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in twice.collect()) == [(20, 1, 20), (20, 1, 20), (20, 2, 3), (20, 2, 3)]


def test_search_holds_blocks_in_small_rows(spark, monkeypatch):
    """A block travels part by part, and several groups of queries meet it: the same rows as by looking at all."""
    rng = np.random.default_rng(8)
    x = rng.integers(-9, 10, size=(3000, 16)).astype(float)
    monkeypatch.setattr(vector_search, "PART", 256)
    monkeypatch.setattr(vector_search, "QUERIES", 40)
    sizes = []
    keep = vector_search.written
    monkeypatch.setattr(vector_search, "written", lambda df, name: sizes.append((name, keep(df, name))) or sizes[-1][1])
    got = vector_search.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    (index,) = [df for name, df in sizes if name == "index"]
    held = [r["n"] for r in index.select("n").collect()]
    assert sum(held) == 3000 and max(held) < 400  # one row of 3000 before
    hits = 0
    for q, own in got.groupby("query_id"):
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(3000), -exact))[:20]) & set(own.vec_id))
        assert np.allclose(exact[own.vec_id], own.score)
    assert len(got) == 150 * 20 and hits / len(got) >= 0.99


def lm_texts():
    rng = random.Random(7)
    words = "the of and to in a cat dog sat on mat".split()
    texts = [" ".join(rng.choices(words, range(11, 0, -1), k=rng.randint(1, 30))) for _ in range(150)]
    return texts + [None, "", "THE Cat\tsat", "unseen words here", "the of and " * 20_000]


def lm_formula(texts, ids, prior=lm_scoring.PRIOR):
    """n_tokens, n_known, base_score, score of each text, word by word; and the model's probability of a word after two."""
    tok = lambda t: [*(t or "").lower().split(), ""]
    train = [tok(t) for i, t in zip(ids, texts, strict=True) if zlib.crc32(str(i).encode()) % 5 != 1]
    one, two, three = Counter(w for t in train for w in t), Counter(), Counter()
    n, kinds = sum(one.values()), len(one)
    for t in train:
        h = ["", *t]
        two.update(zip(h, t, strict=False))
        three.update(zip(h, h[1:], t[1:], strict=False))

    def p(h, w):
        if not h:
            return (one[w] + 0.5) / (n + 0.5 * (kinds + 1))
        counts, of = (two[h[0], w], one[h[0]]) if len(h) == 1 else (three[*h, w], two[h])
        k = prior[len(h) - 1]
        return (counts + k * p(h[1:], w)) / (of + k)

    out = []
    for t in texts:
        ws = tok(t)
        full = math.log10(p(("",), ws[0])) + sum(math.log10(p((u, v), w)) for u, v, w in zip(["", *ws], ws, ws[1:], strict=False))
        out.append((len(ws), sum(w in one for w in ws), sum(math.log10(p((), w)) for w in ws), full))
    return out, p, set(one), n


def test_lm_scores_equal_the_formula(spark):
    texts = lm_texts()
    rows = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, base_score double")
    got = lm_scoring.score(rows).toPandas().set_index("doc_id").sort_index()
    want, p, known, n = lm_formula(texts, range(len(texts)))
    for h in [("", "the"), ("the", "of"), ("of", "the"), ("cat", "dog"), ("never", "seen"), ("",)]:
        assert abs(sum(p(h, w) for w in known) + p(h, "\0unknown") - 1) < 1e-9
    assert (got.train_tokens == n).all() and list(zip(got.n_tokens, got.n_known, strict=True)) == [w[:2] for w in want]
    assert np.allclose(got.base_score, [w[2] for w in want], atol=1e-6) and np.allclose(got.score, [w[3] for w in want], atol=1e-6)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]).all()
    assert lm_scoring.score(rows.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(7, 11, 50), (64, 1 << 21, 5), (1 << 21, 40, 1000)])
def test_lm_scores_do_not_depend_on_pieces(spark, sizes):
    texts = [*lm_texts()[:60], None, "", " ", "\x00 \x00", "zig zag zog", "zig zag zog", "x" * 3000, "a b c " * 400, "É\u00a0é\x1cü"]
    tok = [" ".join(lm_scoring.tokens(t or "") and [w.decode() for w in lm_scoring.tokens(t)]) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = lm_scoring.score(rows, sizes=lm_scoring.Sizes(*sizes)).orderBy("doc_id").toPandas()
    # the formula's words are parted by Unicode space: give each word a plain name
    names: dict = {}
    plain = [" ".join(f"w{names.setdefault(w, len(names))}" for w in t.split(" ") if w) for t in tok]
    want, *_ = lm_formula(plain, range(len(texts)))
    assert list(zip(got.n_tokens, got.n_known, strict=True)) == [w[:2] for w in want]
    assert np.allclose(got.base_score, [w[2] for w in want], atol=1e-6) and np.allclose(got.score, [w[3] for w in want], atol=1e-6)


def test_lm_odd_rows(spark):
    untrained = lm_scoring.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).head()
    assert untrained["held_out"] and untrained["train_tokens"] == 0 and untrained["base_score"] == 0 and untrained["score"] == 0
    same = lm_scoring.score(spark.createDataFrame([(4, "a b"), (4, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert len(same) == 3 and len({r["score"] for r in same}) == 1


@pytest.mark.parametrize("kind", ["scales", "heavy", "tight"])
def test_search_finds_the_nearest_of_odd_vectors(kind):
    """Dimensions of different lengths, vectors of different lengths, near copies by the thousand."""
    rng = np.random.default_rng(1)
    n, d = 20_000, 32
    x = rng.normal(size=(n, d))
    if kind == "tight":
        x = np.repeat(x[:4], n // 4, axis=0) + 0.05 * x
    else:
        x = x * np.exp(2 * rng.normal(size=(1, d) if kind == "scales" else (n, 1)))
    model = vector_search.fit(x[rng.choice(n, 4000, False)])
    codes = model.encode(x)
    asked, ids, left, probes = rng.choice(n, 32, False), np.arange(n), vector_search.residuals(model, x, codes), rng.permutation(n)[:256]
    rough, hits = vector_search.scan(model.packed(codes), model.tables(x[asked])), 0
    for r, me in zip(rough, asked, strict=True):
        rows, score = vector_search.best(r, x[me], x, left, ids, ids, me, 20, 400, probes)
        exact = x @ x[me]
        exact[me] = -np.inf
        assert np.allclose(score, exact[rows]) and (np.diff(score) <= 0).all()
        hits += len(set(rows) & set(np.argsort(-exact)[:20]))
    assert hits / (20 * len(asked)) >= 0.98
