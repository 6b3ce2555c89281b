"""Linkage queries: identifiers from literal rows, references from the line items of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bibliography as bib
from ..operators import linkage as op
from .registry import register, table

ISBNS = ["0-306-40615-2", "978-0-306-40615-7", "0306406153", "0-8044-2957-X", "9780804429573", "9780804429574", "abc", ""]
DOIS = ["https://doi.org/10.1000/ABC.123.", "doi:10.1234/(x)y)", "10.1234/a(b)", "http://dx.doi.org/10.5555%2Fxyz,", "11.1234/no", "see 10.1000/182; then"]


def literal(values: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(values)) + ") AS t(k, x)"


def rows(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "k int, x string")


def _digit(d: str, i: int) -> str:
    return f"(CASE substr({d}, {i}, 1) WHEN 'x' THEN 10 ELSE coalesce(try_cast(substr({d}, {i}, 1) AS INTEGER), 0) END)"


def _sum(d: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * {_digit(d, i)}" for i, w in enumerate(weights, 1)) + ")"


@register(f"""WITH d AS (SELECT k, lower(regexp_replace(x, '[^0-9Xx]', '', 'g')) AS d FROM {literal(ISBNS)}), s AS (SELECT *, '978' || left(d, 9) AS stem FROM d)
SELECT k, CASE WHEN regexp_matches(d, '^97[89][0-9]{{10}}$') AND {_sum('d', [1, 3] * 6 + [1])} % 10 = 0 THEN d
WHEN regexp_matches(d, '^[0-9]{{9}}[0-9x]$') AND {_sum('d', list(range(10, 0, -1)))} % 11 = 0 THEN stem || CAST((10 - {_sum('stem', [1, 3] * 6)} % 10) % 10 AS VARCHAR) END AS isbn FROM s""")
def isbn_normalize(spark, sf_dir):
    return rows(spark, ISBNS).select("k", bib.isbn(F.col("x")).alias("isbn"))


@register(f"""WITH b AS (SELECT k, regexp_replace(regexp_extract(lower(trim(url_decode(x))), '(10\\.[0-9]{{4,9}}/[^\\s]+)', 1), '[.,;:]+$', '') AS b FROM {literal(DOIS)})
SELECT k, nullif(CASE WHEN b LIKE '%)' AND length(b) - length(replace(b, ')', '')) > length(b) - length(replace(b, '(', '')) THEN left(b, length(b) - 1) ELSE b END, '') AS doi FROM b""")
def doi_normalize(spark, sf_dir):
    return rows(spark, DOIS).select("k", bib.doi(F.col("x")).alias("doi"))


@register("""SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN 'doi:10.1000/' || p_partkey WHEN p_size % 5 = 1 AND p_size % 2 = 0 THEN 'isbn:' || p_partkey
WHEN p_size % 5 = 2 THEN 'item:' || substr(sha256(p_brand), 1, 24) WHEN p_size % 2 = 1 THEN 'title:' || substr(sha256(p_name), 1, 24) END AS work_id FROM part""")
def work_id(spark, sf_dir):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size")
    doi, isbn = F.when(size % 5 == 0, F.concat(F.lit("10.1000/"), k)), F.when(size % 5 == 1, k)
    kind = F.when(size % 2 == 0, "book").otherwise("journalArticle")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), bib.work_id(doi, isbn, kind, F.when(size % 5 == 2, F.col("p_brand")), F.col("p_name")).alias("work_id"))


REFS = """refs AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, CASE WHEN l_linenumber % 3 <> 0 THEN 'id-' || (l_partkey % 97) || CASE WHEN l_suppkey % 9 = 0 THEN '-x' ELSE '' END END AS identifier,
  p_name AS title, p_brand AS author, CAST(1990 + p_size % 10 AS VARCHAR) AS year FROM lineitem JOIN part ON p_partkey = l_partkey),
items AS (SELECT p_partkey AS item, CASE WHEN p_partkey <= 120 THEN 'id-' || p_partkey END AS identifier, p_name AS title, p_brand AS author, CAST(1990 + p_size % 10 AS VARCHAR) AS year FROM part)"""


@register(f"""WITH {REFS},
found AS (SELECT ref_id, count(*) AS n, min(item) AS item, count(*) FILTER (refs.year = items.year) AS agree FROM refs JOIN items USING (identifier) GROUP BY ref_id),
same AS (SELECT ref_id, count(*) AS k, min(i.item) AS m FROM refs JOIN items i USING (title, author, year) WHERE ref_id NOT IN (SELECT ref_id FROM found) GROUP BY ref_id),
s AS (SELECT ref_id, item, m, CASE WHEN n IS NOT NULL AND agree = 0 THEN 'identifier_conflict' WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'matched_identifier' WHEN k > 1 THEN 'ambiguous'
  WHEN k = 1 THEN 'matched_title_author_year' WHEN identifier IS NOT NULL THEN 'external' ELSE 'unresolved' END AS status FROM refs LEFT JOIN found USING (ref_id) LEFT JOIN same USING (ref_id))
SELECT ref_id, status, CASE WHEN status LIKE 'matched%' THEN coalesce(item, m) END AS matched FROM s""")
def reference_match_status(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("author"), (1990 + F.col("p_size") % 10).cast("string").alias("year"))
    line = table(spark, sf_dir, "lineitem")
    named = F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("id-"), (F.col("l_partkey") % 97).cast("string"), F.when(F.col("l_suppkey") % 9 == 0, "-x").otherwise("")))
    refs = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), named.alias("identifier"), F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey").drop("p_partkey")
    items = part.select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") <= 120, F.concat(F.lit("id-"), F.col("p_partkey").cast("string"))).alias("identifier"), "title", "author", "year")
    return op.reference_status(refs, items)


_PAIRS = """own AS (SELECT DISTINCT {key} AS key, {member} AS m FROM {table}), few AS (SELECT key FROM own GROUP BY key HAVING count(*) BETWEEN 2 AND {most})
SELECT a.m AS left_id, b.m AS right_id, count(*) AS shared FROM own a JOIN own b USING (key) WHERE a.m < b.m AND key IN (SELECT key FROM few) GROUP BY ALL"""


@register("""WITH own AS (SELECT DISTINCT l_partkey AS key, l_orderkey AS m FROM lineitem)
SELECT a.m AS left_id, b.m AS right_id, count(*) AS shared FROM own a JOIN own b USING (key) WHERE a.m < b.m GROUP BY ALL""")
def shared_reference_signals(spark, sf_dir):
    return op.group_signals(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey")[0]


@register("WITH " + _PAIRS.format(key="p_name", member="p_partkey", table="part", most=60))
def shared_tag_signals(spark, sf_dir):
    return op.group_signals(table(spark, sf_dir, "part"), "p_name", "p_partkey", 60)[0]


@register("WITH s AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) SELECT count(*) FILTER (n > 100) AS skipped FROM s")
def skipped_groups(spark, sf_dir):
    return op.skipped_groups(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", 100)


@register("""SELECT o_orderkey, coalesce(o_orderstatus = 'F' AND o_totalprice > 50000 AND o_orderpriority LIKE '1%' AND n > 0 AND n = done, false) AS sufficient
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus IN ('F', 'O')) AS done FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def coverage_sufficiency(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count(F.when(F.col("l_linestatus").isin("F", "O"), 1)).alias("done"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    status, scope = F.when(F.col("o_orderstatus") == "F", "succeeded"), F.when(F.col("o_totalprice") > 50000, "full_document")
    return orders.select("o_orderkey", op.sufficient(status, scope, F.when(F.col("o_orderpriority").startswith("1"), "passed"), F.col("done"), F.col("n")).alias("sufficient"))
