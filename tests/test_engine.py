import http.server
import json
import os
import random
import threading
from urllib.parse import parse_qs, urlsplit

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexweave import catalog
from lexweave.functions import bibliography as bib
from lexweave.functions import text as tx
from lexweave.operators import candidates, catalogue, community, evidence, graph, labels, neighbors, quality, retrieval, segments
from lexweave.operators import inventory as op_inventory
from lexweave.plans import candidates as plans_candidates
from lexweave.sources import inventory, notes
from lexweave.streaming import changes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 320  # 40 questions, 8 sources each


def test_words_are_a_set_without_stop_words(spark):
    row = spark.sql("select 'The Straße, a strasse x_y 42!' as t").select(tx.words(F.col("t")).alias("w")).head()
    assert sorted(row["w"]) == ["42", "strasse"]


def test_recall_does_not_depend_on_order(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["civil war onset", "war and peace", "rainfall shocks", "peace talks civil"])], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "civil peace")], "query_id long, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (2, [0.0, 1.0])], "source_id long, vector array<double>")
    by = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    a = retrieval.hybrid_recall(docs, asked, vectors, by).orderBy("rank").collect()
    b = retrieval.hybrid_recall(docs.orderBy(F.desc("doc_id")), asked, vectors, by).orderBy("rank").collect()
    assert a == b and [r["source_id"] for r in a][:1] == [0] and {r["source_id"]: r["route"] for r in a}[2] == "semantic"


@pytest.mark.parametrize("block", [8192, 7])
def test_knn_equals_brute_force_in_any_blocks(spark, block):
    x = np.random.default_rng(1).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist(), [str(i % 3)]) for i, v in enumerate(x)], "source_id long, vector array<double>, groups array<string>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    got = neighbors.knn(df, 5, block=block).toPandas()
    for i, own in got.groupby("source_id"):
        want = [j for j in np.argsort(-s[i]) if s[i, j] > 0][:5]
        assert own.sort_values("rank").target_id.tolist() == want
    scoped = neighbors.scoped_knn(df, 6, block=block).toPandas()
    for i, own in scoped.groupby("source_id"):
        assert len(own) <= 6 and ((own.target_id % 3 == i % 3) == (own.scope == "within_collection")).all()


def test_postings_take_turns(spark):
    rows = [("tag", "x", i, "big") for i in range(90)] + [("tag", "x", 100 + i, "small") for i in range(3)]
    got = candidates.capped_postings(spark.createDataFrame(rows, "kind string, signal string, source_id long, group string"), 10).orderBy("position").collect()
    assert [r["source_id"] for r in got] == [0, 100, 1, 101, 2, 102, 3, 4, 5, 6]


def test_greedy_respects_caps_and_prefers_other_groups(spark):
    rng = random.Random(2)
    pairs = [(a, b, rng.random(), rng.random() < 0.5) for a in range(20) for b in range(a + 1, 20)]
    df = spark.createDataFrame(pairs, "left_id long, right_id long, score double, same_group boolean")
    sizes = spark.createDataFrame([(i, 1 + i % 4) for i in range(20)], "source_id long, size long")
    got = candidates.greedy_degree_cap(df, sizes, cap=3, most=25).toPandas()
    again = candidates.greedy_degree_cap(df.orderBy("score"), sizes, cap=3, most=25).toPandas()
    assert got.equals(again) and len(got) <= 25
    assert max(pd.concat([got.left_id, got.right_id]).value_counts()) <= 3
    first = got.iloc[0]
    options = [p for p in pairs if 0 in p[:2] and not p[3]]
    assert (first.left_id, first.right_id) == max(options, key=lambda p: p[2])[:2]


def all_rounds(pairs, size, cap, most):
    """Brute force over all pairs (left, right, score, same_group)."""
    pairs = sorted(pairs, key=lambda p: (p[3], -p[2], p[0], p[1]))
    degree, out = {}, []
    for _ in range(cap):
        for s in sorted({x for p in pairs for x in p[:2]}, key=lambda s: (size[s], s)):
            for p in pairs:
                if s in p[:2] and p not in out and all(degree.get(x, 0) < cap for x in p[:2]):
                    out.append(p)
                    for x in p[:2]:
                        degree[x] = degree.get(x, 0) + 1
                    break
            if len(out) == most:
                return [p[:3] for p in out]
    return [p[:3] for p in out]


@pytest.mark.parametrize("cap,most", [(2, 4), (2, 9), (3, 50), (1, 6)])
def test_selection_equals_brute_force_over_all_pairs(spark, cap, most):
    rng = random.Random(cap * most)
    ends = {(rng.choice((a, 0, 1)), b) for a in range(2, 40) for b in rng.sample(range(40), 14)}  # 0 and 1: hubs
    pairs = [(a, b, round(rng.random(), 1), rng.random() < 0.7) for a, b in sorted(ends) if a < b]
    size = {i: 1 + i % 3 for i in range(40)}
    df = spark.createDataFrame(pairs, "left_id long, right_id long, score double, same_group boolean").repartition(3)
    got = candidates.greedy_degree_cap(df, spark.createDataFrame([*size.items()], "source_id long, size long"), cap, most).orderBy("position").collect()
    assert [tuple(r)[:3] for r in got] == all_rounds(pairs, size, cap, most)
    scoped = df.withColumn("scope", F.when(F.col("same_group"), "within").otherwise("whole")).drop("same_group")
    got = candidates.scope_balanced_select(scoped, cap, most).orderBy("position").collect()
    assert [tuple(r)[:4] for r in got] == candidates.balanced([(*p[:3], "within" if p[3] else "whole") for p in pairs], cap, most)


def test_selection_queries_take_all_pairs(spark):
    pairs = plans_candidates._scoped(spark, SF).select("left_id", "right_id", "score", "same_group", "scope").toPandas()
    group = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").toPandas().set_index("doc_id").source
    size = group.map(group.value_counts())
    best = {}
    for p in sorted(pairs.itertuples(index=False, name=None), key=lambda p: (p[3], -p[2], p[0], p[1])):
        for x in p[:2]:
            best.setdefault(x, []).append(p)
    got = catalog.QUERIES["greedy_degree_cap"](spark, SF).orderBy("position").collect()
    want = candidates.select_rounds([best[x] for x in sorted(best, key=lambda x: (size[x], x))], 8, 256)
    assert [tuple(r)[:3] for r in got] == [p[:3] for p in want]
    got = catalog.QUERIES["scope_balanced_select"](spark, SF).orderBy("position").collect()
    assert [tuple(r)[:4] for r in got] == candidates.balanced([(*p[:3], p[4]) for p in pairs.itertuples(index=False, name=None)], 8, 256)


def test_balanced_selection_reserves_scopes():
    rows = [(a, b, 1.0 - 0.01 * a, "within") for a in range(6) for b in range(6, 9)] + [(a, b, 0.1, "whole") for a in range(6) for b in range(9, 12)]
    got = candidates.balanced(rows, 2, 8)
    assert len(got) == 8 and sum(r[3] == "whole" for r in got) >= 2
    ends = pd.Series([x for r in got for x in r[:2]]).value_counts()
    assert ends.max() <= 2
    with pytest.raises(ValueError):
        candidates._bounded(type("Big", (), {"count": lambda self: candidates.POOL + 1})())


def test_closure_of_a_cycle_ends(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "node string, parent string")
    assert catalogue.closure(tree).where("node = 'd'").count() == 4


def test_closure_of_a_deep_tree_is_whole(spark):
    n = 24
    tree = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}" if i + 1 < n else None) for i in range(n)], "node string, parent string")
    start = spark.createDataFrame([("n00",)], "node string")
    assert {r["ancestor"] for r in catalogue.closure(tree, start).collect()} == {f"n{i:02}" for i in range(n)}


def test_neighbours_of_dirty_sources_are_those_of_all(spark):
    x = np.random.default_rng(3).normal(size=(40, 6))
    v = spark.createDataFrame([(i, x[i].tolist(), None) for i in range(40)], "source_id long, vector array<double>, groups array<string>")
    dirty = v.where("source_id % 7 = 0")
    got = {(r["source_id"], r["rank"]): r["target_id"] for r in neighbors.lanes(v, 5, False, block=9, asked=dirty).collect()}
    assert got == {(r["source_id"], r["rank"]): r["target_id"] for r in neighbors.knn(v, 5).collect() if r["source_id"] % 7 == 0}


def test_labels_of_string_ids_and_of_many_communities(spark):
    edges = [(f"a{i}", f"a{j}", 1.0) for i in range(4) for j in range(i)] + [(f"b{i}", f"b{j}", 1.0) for i in range(4) for j in range(i)]
    got = {r["node"]: r["label"] for r in community.label_propagation(spark.createDataFrame(edges, "left_id string, right_id string, score double")).collect()}
    assert len({got[f"a{i}"] for i in range(4)}) == 1 and got["a0"] != got["b0"]
    rows = [(c, f"w{c} x{c % 97} y{k}", 1.0 + (c * 7 + k) % 11) for c in range(10_000) for k in range(3)]
    chosen = labels.assign(rows)
    assert len(chosen) == 10_000 and len(set(chosen.values())) == 10_000


def test_labels_are_given_as_by_looking_at_all(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    rows = [(c, " ".join(rng.sample(words, 3)), round(rng.random(), 3)) for c in range(15) for _ in range(6)]
    stop, left, want = set(tx.STOP_WORDS), {}, {}
    for c, p, s in rows:
        left.setdefault(c, []).append((p, s))

    def near(p):
        a, most = set(p.split()) - stop, 0.0
        for q in want.values():
            b = set(q.split()) - stop
            most = max(most, 1.0 if a <= b or b <= a else len(a & b) / len(a | b))
        return most

    while left:
        options = [(-(s * (1 - 0.65 * near(p))), str(c), p, c) for c, o in left.items() for p, s in o if near(p) < 0.8]
        if not options:
            break
        _, _, p, c = min(options)
        want[c] = p
        del left[c]
    assert labels.assign(rows) == want


def test_dense_scores_in_blocks_of_questions(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTORS_SENT", 3)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "source_id long, vector array<double>")
    got = {(r["query_id"], r["source_id"]): r["score"] for r in retrieval.dense_scores(v, v.withColumnRenamed("source_id", "query_id")).collect()}
    assert got == {(a, b): a * b + 1.0 for a in range(10) for b in range(10)}


def test_packets_are_the_largest_that_fit():
    rows = [{"source_id": str(i), "recall_route": "lexical", "start": 7 * i, "text": "é\"x" * (300 * (i + 1))} for i in range(4)]
    for most in (40, 120, 300, 700, 2500, 9000):
        n, cap = evidence.fit(rows, most)
        notes = lambda n, cap: [{"source_id": r["source_id"], "recall_route": r["recall_route"], "text": r["text"][:cap], "excerpt_start": r["start"], "excerpt_end": r["start"] + len(r["text"][:cap])} for r in rows[:n]]
        assert n == max(k for k in range(5) if k == 0 or evidence.packet_size(notes(k, 1)) <= most)
        assert cap == max([c for c in range(1, evidence.EXCERPT + 1) if evidence.packet_size(notes(n, c)) <= most], default=0) if n else n == 0
    with pytest.raises(ValueError):
        evidence.fit(rows, 5)


def test_relations_are_read_from_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text('source_id,target_id,reason\na,b,"two\nlines, ""quoted"""\nc,,\n', encoding="utf-8")
    got = [tuple(r) for r in op_inventory.read_relations(spark, str(tmp_path / "r.csv")).collect()]
    assert got == [("a", "b", 'two\nlines, "quoted"'), ("c", None, None)]


def test_diff_has_one_row_a_change(spark):
    old = spark.createDataFrame([(1, "a", "p"), (2, "a", "p"), (3, "a", "p"), (4, None, "p")], "k int, c string, p string")
    new = spark.createDataFrame([(2, "b", "q"), (3, "a", "q"), (4, None, "p"), (5, "a", "p")], "k int, c string, p string")
    assert {tuple(r) for r in catalogue.snapshot_diff(old, new, "k", "c", "p").collect()} == {(1, "removed"), (2, "changed"), (3, "moved"), (5, "new")}


def test_k_hops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 1)], "source_id long, target_id long")
    seed = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in graph.k_hops(edges, seed, 9, into=False).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {r["node"] for r in graph.k_hops(edges, seed, 1).collect()} == {1, 2, 9}


def test_identifiers(spark):
    row = spark.sql("select '0-306-40615-2' a, '978-0-306-40615-7' b, '0-306-40615-3' c").select(*(bib.isbn(F.col(c)).alias(c) for c in "abc")).head()
    assert row["a"] == row["b"] == "9780306406157" and row["c"] is None


def test_rand_index_bounds(spark):
    same = spark.createDataFrame([(i % 3, (i % 3) + 7) for i in range(30)], "a int, b int")
    assert abs(neighbors.adjusted_rand(same).head()[0] - 1) < 1e-12
    assert neighbors.adjusted_rand(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")).head()[0] == 1


def clique(ids):
    return [(a, b, 1.0) for a in ids for b in ids if a < b]


def test_communities_find_cliques(spark):
    edges = clique(range(5)) + clique(range(10, 15)) + [(4, 10, 0.1)]
    want = {i: 0 for i in range(5)} | {i: 10 for i in range(10, 15)}
    assert community.louvain(edges) == want == community.louvain(edges[::-1])
    df = spark.createDataFrame(edges, "left_id long, right_id long, score double")
    assert len({r["label"] for r in community.label_propagation(df, least=0.5).collect()}) == 2


def test_labels_are_not_alike():
    got = labels.assign([(1, "civil war onset", 1.0), (2, "civil war", 0.9), (2, "peace talks", 0.5), (3, "civil war onset", 0.2)])
    assert got[1] == "civil war onset" and got[2] == "peace talks" and 3 not in got
    x = np.array([[1.0, 0], [1.0, 0.01], [0, 1.0]])
    assert labels.diverse(np.array([1.0, 0.99, 0.5]), x, ["a", "b", "c"], 2) == [0, 2]


def test_chunks_are_lossless(spark):
    texts = ["", "a" * 10, "héllo wörld" * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "source_id int, text string")
    got = segments.lossless_chunks(df, 7).toPandas()
    for i, t in enumerate(texts):
        assert "".join(got[got.source_id == i].sort_values("chunk").text) == t


def test_html_scope():
    assert quality.html_scope("<article>" + "<p>" + "w " * 200 + "</p><p>" + "w " * 200 + "</p></article>") == "article"
    assert quality.html_scope("<div>" + "w " * 600 + "</div><p><p><p>x") == "visible_text"
    assert quality.html_scope("<script>" + "w " * 900 + "</script>") == quality.html_scope(None) == "metadata_only"


def test_notes_and_no_op_writes(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.md").write_text("---\ntitle: T\n---\nSee [[b|x]].")
    (tmp_path / "in/b.md").write_text("no matter")
    got = notes.read_notes(spark, str(tmp_path / "in")).orderBy("path").collect()
    assert [(r["title"], r["links"]) for r in got] == [(None, []), ("T", ["b"])]
    df = spark.range(5)
    assert notes.write_if_changed(df, str(tmp_path / "t")) and not notes.write_if_changed(df.orderBy(F.desc("id")), str(tmp_path / "t")) and notes.write_if_changed(spark.range(6), str(tmp_path / "t"))
    assert notes.decode_bytes("ü".encode("utf-16")) == notes.decode_bytes("ü".encode()) == notes.decode_bytes(b"\xfc") == "ü"


def test_inventory_source(spark):
    items = [{"key": f"K{i}", "version": i} for i in range(23)]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlsplit(self.path).query)
            start, limit = int(q["start"][0]), int(q["limit"][0])
            self.send_response(200)
            self.send_header("Total-Results", str(len(items)))
            self.end_headers()
            self.wfile.write(json.dumps(items[start : start + limit]).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(inventory.Inventory)
    df = spark.read.format("inventory").schema("key string, version int").option("url", f"http://127.0.0.1:{server.server_port}/items").option("page", 10).load()
    assert sorted(r["version"] for r in df.collect()) == list(range(23))
    server.shutdown()
    with pytest.raises(ValueError):
        inventory.Reader(["key"], {"url": "http://example.org/"})


def test_dirty_sources_over_batches_equal_a_recompute(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    rows = [(k % 5, f"{k:04d}", f"f{k % 3}") for k in range(60)]
    for b in range(3):
        pd.DataFrame(rows[b * 20 : b * 20 + 20], columns=["source_id", "at", "fingerprint"]).to_parquet(source / f"{b}.parquet")
    stream = spark.readStream.schema("source_id long, at string, fingerprint string").option("maxFilesPerTrigger", 1).parquet(str(source))
    got = changes.settled(changes.dirty(stream), "append").toPandas().sort_values("changes").groupby("source_id").last()
    want = pd.DataFrame(rows, columns=["source_id", "at", "fingerprint"]).sort_values("at").groupby("source_id").last()
    assert got.fingerprint.tolist() == want.fingerprint.tolist()


def test_knn_keeps_little_and_orders_near_copies(spark):
    """Near copies whose scores differ behind the ninth digit are in the order of their ids, across blocks, as in SQL."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 16))[np.arange(300) % 3] * (1 + 1e-12 * rng.normal(size=(300, 16)))
    v = spark.createDataFrame([(i, u.tolist(), [int(i % 2)]) for i, u in enumerate(x)], "source_id long, vector array<double>, groups array<int>")
    got = neighbors.knn(v, 5, block=40).toPandas()
    for q, own in got.groupby("source_id"):
        assert own.sort_values("rank").target_id.tolist() == [i for i in range(q % 3, 300, 3) if i != q][:5]
    scoped = neighbors.lanes(v, 2, True, block=40).toPandas()
    for (q, lane), own in scoped.groupby(["source_id", "lane"]):
        assert own.sort_values("rank").target_id.tolist() == [i for i in range(q % 3, 300, 3) if i != q and (i % 2 == q % 2) == (lane == "within")][:2]


def test_a_source_is_put_out_once_whatever_the_blocks(spark):
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, u.tolist(), None) for i, u in enumerate(rng.normal(size=(200, 8)))], "source_id long, vector array<double>, groups array<int>")
    seen = []

    def counted(found, k):
        seen.append(found.count())
        return found

    keep, neighbors.best_of = neighbors.best_of, counted
    try:
        neighbors.lanes(v, 3, False, block=10)
    finally:
        neighbors.best_of = keep
    assert seen[0] <= 200 * 3  # k of each block before: 20 times as many


@pytest.mark.parametrize("pool", [0, 40, 100_000])
def test_degree_capped_in_rounds_equals_one_look_in_order(spark, monkeypatch, pool):
    rng = random.Random(6)
    edges = sorted({(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(900)) if a < b})
    rows = [(a, b, float(rng.randrange(12))) for a, b in edges]
    degree, want = {}, []
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if degree.get(a, 0) < 4 and degree.get(b, 0) < 4:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
            want.append((a, b, s))
    monkeypatch.setattr(candidates, "POOL", 100)  # a larger table was an error before
    got = candidates.degree_capped(spark.createDataFrame(rows, "left_id long, right_id long, score double"), 4, pool)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_no_task_orders_a_whole_scope(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, 1000 + i, rng.random(), "one") for i in range(400)]
    windows = []
    keep = candidates.Window.partitionBy
    monkeypatch.setattr(candidates.Window, "partitionBy", staticmethod(lambda *keys: windows.append(keys) or keep(*keys)))
    got = candidates.scope_balanced_select(spark.createDataFrame(rows, "left_id long, right_id long, score double, scope string"), 2, 10)
    assert [r["left_id"] for r in got.orderBy("position").collect()] == [r[0] for r in sorted(rows, key=lambda r: -r[2])[:10]]
    assert windows.index(("scope", "share")) < windows.index(("scope",))


def test_items_without_parent_are_not_joined(spark):
    items = spark.createDataFrame([("a", None, "t", "c", ["x"], 1), ("b", "p", "t", None, ["y", "x"], 1), ("d", "q", "t", "c", [], 1)], "key string, parent string, title string, creator string, collections array<string>, version int")
    parents = spark.createDataFrame([("p", "up", "me")], "key string, title string, creator string")
    got = op_inventory.normalised(items, parents)
    assert sorted(tuple(r)[:4] for r in got.collect()) == [("a", "t", "c", "x"), ("b", "up", "me", "x|y"), ("d", "t", "c", "")]
    assert "isnotnull(parent" in got._jdf.queryExecution().optimizedPlan().toString().lower()


def _partitions(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_large_steps_are_dealt_to_more_tasks(spark, monkeypatch):
    from lexweave import session
    from lexweave.operators import linkage

    monkeypatch.setattr(session, "ROWS", 100)
    spans = spark.createDataFrame([(i % 97, 3 * i, 3 * i + 1) for i in range(2000)], "owner long, start long, end long")
    merged = segments.merge_intervals(spans)
    assert _partitions(merged) > 4 and merged.count() == 2000
    rows = spark.createDataFrame([(i // 10, i) for i in range(600)], "k long, m long")
    pairs, _ = linkage.group_signals(rows, "k", "m", 20)
    assert _partitions(pairs) > 4 and pairs.count() == 60 * 45
    posts = spark.createDataFrame([("term", str(i // 10), i) for i in range(600)], "kind string, signal string, source_id long")
    shared = candidates.shared_signals(posts).groupBy("left_id", "right_id").count()
    assert _partitions(shared) > 4 and shared.count() == 60 * 45


@pytest.mark.parametrize(("wide", "part"), [(64, 1024), (3, 1024), (64, 7), (3, 7)])
def test_group_signals_of_any_size_equal_all_pairs(spark, monkeypatch, wide, part):
    """Members of many keys, groups of many members, repeated rows, nulls: each pair once, with all keys it shares."""
    from lexweave.operators import linkage

    rng = random.Random(9)
    rows = [(rng.randrange(25), rng.randrange(60)) for _ in range(160)] + [(30, m) for m in range(130)] + [(k, 5) for k in range(12)] + [(k, 7) for k in range(12)]
    rows += rows[:20] + [(None, 1), (None, 2), (3, None)]
    monkeypatch.setattr(linkage, "WIDE", wide)
    monkeypatch.setattr(linkage, "PART", part)
    own = {r for r in rows if None not in r}
    want = {}
    for k, a in own:
        for j, b in own:
            if k == j and a < b:
                want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame(rows, "k long, m long")
    pairs, skipped = linkage.group_signals(df, "k", "m")
    got = [tuple(r) for r in pairs.collect()]
    assert skipped is None and len(got) == len(want) and {(a, b): n for a, b, n in got} == want
    few, skipped = linkage.group_signals(df, "k", "m", 20)
    sizes = {}
    for k, m in own:
        sizes.setdefault(k, set()).add(m)
    assert skipped.head()[0] == sum(len(m) > 20 for m in sizes.values()) and few.agg(F.sum("shared")).head()[0] == sum(len(m) * (len(m) - 1) // 2 for m in sizes.values() if len(m) <= 20)


def test_shared_references_move_no_pairs_and_leave_no_group_out(spark, tmp_path):
    spark.createDataFrame([(o, 1) for o in range(150)] + [(o, 2) for o in range(3)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.QUERIES["shared_reference_signals"](spark, str(tmp_path))
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()  # pairs were grouped by a shuffle before
    assert got.count() == 150 * 149 // 2 and got.where("shared = 2").count() == 3  # groups over 100 gave none before


def test_registry_does_not_expand_rows(spark):
    from lexweave.operators import facets

    rows = spark.createDataFrame([("f", "t", "long", 1, 2), ("f", "t", "s", 1, 3), ("f", None, None, None, 2), ("g", "t", "s", 5, None)], "facet string, tag string, label string, source_id int, family int")
    got = facets.registry(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([("f", "t", "s", 2, 1, 2), ("f", None, None, 0, 0, 1), ("g", "t", "s", 1, 1, 0)], key=repr)
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_are_counted_once(spark):
    notes = spark.createDataFrame([(i, "", f"big cats run{i % 3} far") for i in range(9)], "note_id long, title string, body string")
    members = spark.createDataFrame([(i, i % 3) for i in range(9)], "note_id long, community int")
    plan = labels.label_candidates(labels.phrase_weights(notes), members)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # texts were read again for each use of the sums before


def test_no_candidate_is_left_out_and_slices_number_them(spark, monkeypatch):
    from lexweave import session

    notes = spark.createDataFrame([(i, "", " ".join(f"w{i}x{k}" for k in range(300))) for i in range(4)], "note_id long, title string, body string")
    members = spark.createDataFrame([(i, i % 2) for i in range(4)], "note_id long, community int")
    weights = labels.phrase_weights(notes, None)
    whole = sorted(tuple(r) for r in labels.label_candidates(weights, members).collect())
    assert len(whole) == 4 * (299 + 298 + 297)  # 512 of a note, and of these 24 of a community, before
    for c in range(2):
        own = sorted((r for r in whole if r[0] == c), key=lambda r: (-r[2], -r[3], r[1]))
        assert [r[4] for r in own] == list(range(1, len(own) + 1))
    monkeypatch.setattr(session, "ROWS", 200)
    got = labels.label_candidates(weights, members)
    assert sorted(tuple(r) for r in got.collect()) == whole


@pytest.mark.parametrize("pool", [500_000, 320])
def test_labels_in_rounds_are_those_of_all_candidates(spark, monkeypatch, pool):
    """The 24 best of a community are all like another's label: it got none before."""
    rng = random.Random(5)
    rows = [(1, "civil war onset", 9.0)] + [(2, "civil war onset" + f" x{k}", 8.0 - k / 100) for k in range(40)] + [(2, "peace talks", 0.5)]
    rows += [(c, " ".join(rng.sample([f"w{i}" for i in range(8)], 2)) + " z" * (k % 2), rng.randrange(9) / 10) for c in range(3, 9) for k in range(60)]
    rows = sorted({(c, p): (c, p, s) for c, p, s in rows}.values())
    monkeypatch.setattr(labels, "POOL", pool)
    got = {r["community"]: r["label"] for r in labels.assign_labels(spark.createDataFrame(rows, "community long, phrase string, score double")).collect()}
    assert got == labels.assign(rows) and got[2].startswith("peace") and got[1] == "civil war onset"
    assert labels.assign_labels(spark.createDataFrame([], "community long, phrase string, score double")).count() == 0
    monkeypatch.setattr(labels, "POOL", 60)  # no round can look behind the 40: an error, not a cut
    with pytest.raises(ValueError, match="label candidates"):
        labels.assign_labels(spark.createDataFrame(rows, "community long, phrase string, score double"))


def test_display_names_of_odd_letters_equal_sql(spark, duck, tmp_path):
    odd = ["\x0bab c", "\xa0AB C　", "ßab ﬁne", "İSTANBUL İİİİİİ", "ŉab", "ΑΣ ΟΔΥΣΣΕΥΣ", "ᾳx", "ΐ", "ƛambda", "ab\x85c", "plain text"]
    spark.createDataFrame([(i, t) for i, t in enumerate(t for t in odd for _ in (0, 1))], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r["doc_id"]: r["display"] for r in catalog.QUERIES["display_names"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(catalog.ORACLE_SQL["display_names"]).fetchall())


def modularity(edges, part):
    total, inside, degree = sum(w for *_, w in edges), 0.0, {}
    for a, b, w in edges:
        inside += w * (part[a] == part[b])
        for n in (a, b):
            degree[part[n]] = degree.get(part[n], 0.0) + w
    return inside / total - sum((d / (2 * total)) ** 2 for d in degree.values())


def test_louvain_keeps_the_weight_inside_communities():
    """Cliques in rings in a ring: several levels, after which the whole graph is not one community."""
    edges = [(a + 4 * c, b + 4 * c, 1.0) for c in range(256) for a, b, _ in clique(range(4))]
    edges += [(4 * c, 4 * (c // 16 * 16 + (c + 1) % 16) + 1, 0.5) for c in range(256)] + [(64 * r + 2, 64 * ((r + 1) % 16) + 3, 0.1) for r in range(16)]
    part = community.louvain(edges)
    assert len(set(part.values())) > 16 and modularity(edges, part) > 0.9
    assert all(part[4 * c] == part[4 * c + 3] for c in range(256))


def test_louvain_looks_again_where_nodes_would_move(spark):
    """At the end of local moving no node gains by a move, though most were not looked at in each pass."""
    rng = np.random.default_rng(4)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 400, (1600, 2)) if a != b})
    left, right, w = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), rng.random(len(pairs))
    home = np.array(community._homes(left, right, w, 400, 1.0, random.Random(0)))
    degree = np.bincount(left, w, 400) + np.bincount(right, w, 400)
    near = np.zeros((400, 400))
    np.add.at(near, (left, home[right]), w)
    np.add.at(near, (right, home[left]), w)
    mass = np.bincount(home, degree, 400)
    gain = near - degree[:, None] * (mass[None, :] - degree[:, None] * (home[:, None] == np.arange(400))) / degree.sum()
    assert (np.where(near > 0, gain, -1).max(axis=1) <= gain[np.arange(400), home] + 1e-9).all()
    edges = [(a, b, float(x)) for (a, b), x in zip(pairs, w, strict=True)]
    df = spark.createDataFrame(edges, "left_id long, right_id long, score double").repartition(3)
    assert {r["node"]: r["community"] for r in community.louvain_partition(df).collect()} == community.louvain(edges)
    assert community.louvain_partition(df.limit(0)).collect() == []


@pytest.mark.parametrize("cells", [4_000_000, 60])
def test_first_of_many_texts_are_those_of_all_scores(spark, monkeypatch, cells):
    """Ties, null and repeated ids, repeated and wordless questions, in small batches and blocks."""
    monkeypatch.setattr(retrieval, "CELLS", cells)
    rng = random.Random(8)
    some = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "x", "Omega", "rare1", "rare2"]) for _ in range(rng.randint(0, 4)))
    texts = [(f"s{i % 390:03d}" if i % 97 else None, rng.choice([None, "alpha beta", some()])) for i in range(400)]
    docs = spark.createDataFrame(texts, "id string, text string").repartition(3)
    asked = spark.createDataFrame([(f"q{i % 11}", some()) for i in range(12)] + [("none", "the of"), (None, "beta rare1")], "query_id string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        got = [tuple(r) for r in retrieval.lexical_ranked(docs, asked, 5, "id", "text").selectExpr("query_id", "source_id", "round(score, 6)", "rank").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = retrieval.ranked(retrieval.lexical_scores(docs, asked, "id", "text"), 5, digits=9).selectExpr("query_id", "source_id", "round(score, 6)", "rank")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(map(tuple, want.collect()), key=key)


def test_lexical_ranking_moves_no_row_for_each_shared_word(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('alpha beta gamma ', id) AS text")
    asked = spark.range(40).selectExpr("id AS query_id", "'alpha beta gamma' AS text")
    scores = retrieval.lexical_ranked(docs, asked, 2, "doc_id", "text")
    assert "exploded" not in scores._jdf.queryExecution().optimizedPlan().toString() and "Generate" not in scores._jdf.queryExecution().optimizedPlan().toString()
    assert [r["source_id"] for r in scores.where("query_id = 7").orderBy("rank").collect()] == [0, 1]


@pytest.mark.parametrize("cells", [4_000_000, 60])
def test_first_of_many_vectors_are_those_of_all_scores(spark, monkeypatch, cells):
    """Ties, null ids, vectors that are null, short or not finite; then a question of that kind."""
    monkeypatch.setattr(retrieval, "CELLS", cells)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 7)).round(1).astype("f4").tolist()
    odd = {5: None, 6: [1.0], 7: [float("nan")] * 7, 8: [float("inf")] * 7, 9: [None, *[1.0] * 6], 10: [], 11: [1e30] * 7}
    vectors = spark.createDataFrame([(i if i != 40 else None, odd.get(i, x[i % 90])) for i in range(300)], "source_id long, vector array<float>").repartition(3)
    asked = [(f"q{i}", x[-i - 1]) for i in range(13)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        for more in ([], [("null", None)], [("short", [2.0])]):
            by = spark.createDataFrame(asked + more, "query_id string, vector array<float>")
            got, want = retrieval.dense_ranked(vectors, by, 5), retrieval.ranked(retrieval.dense_scores(vectors, by), 5)
            same = lambda df, want=want: sorted(tuple(map(str, r)) for r in df.select(*want.columns).collect())  # noqa: E731  NaN as text
            assert same(got) == same(want)
            assert ("MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()) == (not more)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
