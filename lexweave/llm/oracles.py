"""SQL of those operators that DuckDB can express; too slow for large tables, fine for the driver's comparison."""

LINKS = """
SELECT k.{id}, {extra}CAST(coalesce(c.n, 0) AS BIGINT) AS n_links{kept} FROM {table} k
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) c ON c.a = k.{id} LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY 1) r ON r.a = k.{id}"""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, a FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)""" + LINKS.format(id="doc_id", table="documents", extra="coalesce(r.low, k.doc_id) AS class_id, ", kept="")

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.95),
reach(a, b) AS (SELECT a, a FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)""" + LINKS.format(id="vec_id", table="embeddings", extra="coalesce(r.low, k.vec_id) AS component_id, ", kept=", coalesce(r.low, k.vec_id) = k.vec_id AS kept")
