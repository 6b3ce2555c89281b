"""Facet queries: a part's brand, type, size and name are its tags in four facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bibliography as bib
from ..operators import facets as op
from .linkage import literal, rows
from .registry import register, table

TAGS = ["Civil Wars", "method/Labour Policies", "Behaviour & Elections", "10.1234/abc", "https://x.org", "12.5", "what is this?", "research", "notes.pdf", "", "ISBN 0-306-40615-2", "one two three four five six seven eight nine"]


def _case(x: str, table_: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table_.items()) + f" ELSE {x} END"


SLUGS = f"""a AS (SELECT k, x, CASE WHEN k % 4 = 3 THEN 'period' ELSE 'method' END AS facet FROM {literal(TAGS)}),
b AS (SELECT *, CASE WHEN contains(lower(x), '/') AND replace(split_part(lower(x), '/', 1), '_', '-') = facet THEN regexp_replace(lower(x), '^[^/]*/', '') ELSE lower(x) END AS l FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(replace(l, '&', ' and '), '’', ''''), '[''`]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM b),
d AS (SELECT *, list_transform(string_split(s, '-'), lambda w: {_case('w', bib.SPELLING)}) AS w FROM c),
slugs AS (SELECT k, x, facet, substr(array_to_string(CASE WHEN facet IN ('geography', 'period', 'data') THEN w ELSE list_append(w[:-2], {_case('w[-1]', bib.PLURAL)}) END, '-'), 1, 80) AS slug FROM d)"""


def _slugs(spark):
    facet = F.when(F.col("k") % 4 == 3, "period").otherwise("method")
    return rows(spark, TAGS).select("k", "x", facet.alias("facet"), bib.slug(F.col("x"), facet).alias("slug"))


@register(f"""WITH {SLUGS} SELECT k, slug, 'subject-tag-' || substr(sha256('{{"facet_type":"' || facet || '","slug":"' || slug || '"}}'), 1, 16) AS tag_id FROM slugs""")
def slug_canonical(spark, sf_dir):
    return _slugs(spark).select("k", "slug", bib.tag_id(F.col("facet"), F.col("slug")).alias("tag_id"))


@register(rf"""WITH {SLUGS} SELECT k, CASE WHEN x = '' OR slug = '' THEN 'empty' WHEN length(x) > 96 OR length(slug) > 80 THEN 'too_long' WHEN regexp_matches(x, '(?i)^(https?|file)://') THEN 'url'
WHEN regexp_matches(x, '(?i)^10\.[0-9]{{4,9}}/[^\s]+$') THEN 'doi' WHEN regexp_matches(x, '^(?:(?i:isbn)(?:-1[03])?:?\s*)?[0-9Xx -]{{10,20}}$') THEN 'bibliographic_identifier' WHEN regexp_matches(x, '^[0-9]+(\.[0-9]+)?$') THEN 'numeric_only'
WHEN len(regexp_extract_all(x, '[A-Za-z0-9]+')) > 8 OR regexp_matches(x, '[?!;]') THEN 'sentence_like' WHEN slug IN ({', '.join(f"'{g}'" for g in bib.BIBLIOGRAPHIC)}) OR regexp_matches(x, '(?i)\.(pdf|epub|docx?)$') THEN 'bibliographic_format'
WHEN slug IN ({', '.join(f"'{g}'" for g in bib.GENERIC)}) THEN 'collection_generic' ELSE '' END AS reason FROM slugs""")
def slug_reject_reason(spark, sf_dir):
    return _slugs(spark).select("k", bib.reject_reason(F.col("x"), F.col("slug")).alias("reason"))


ASSIGNED = """assigned AS (SELECT unnest(['brand', 'type', 'size', 'name']) AS facet, unnest([p_brand, p_type, CAST(p_size AS VARCHAR), p_name]) AS tag, unnest([p_brand, p_type, CAST(p_size AS VARCHAR), p_name]) AS label,
  p_partkey AS source_id, p_partkey % 17 AS family, p_size % 3 <> 0 AS analytical FROM part)"""


def assigned(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    both = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f"p_{f}").cast("string").alias("tag")) for f in ("brand", "type", "size", "name")))).alias("t")
    return part.select(both, F.col("p_partkey").alias("source_id"), (F.col("p_partkey") % 17).alias("family"), (F.col("p_size") % 3 != 0).alias("analytical")).select("t.facet", "t.tag", F.col("t.tag").alias("label"), "source_id", "family", "analytical")


@register(f"WITH {ASSIGNED} SELECT facet, tag, min(label) AS label, count(DISTINCT label) AS variants, count(DISTINCT source_id) AS sources, count(DISTINCT family) AS families FROM assigned GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY facet, tag"))
def tag_registry(spark, sf_dir):
    return op.registry(assigned(spark, sf_dir))


@register(f"WITH {ASSIGNED} SELECT facet, tag, count(DISTINCT family) AS bases, count(DISTINCT family) >= 2 AS active FROM assigned WHERE analytical GROUP BY facet, tag")
def tag_activation(spark, sf_dir):
    return op.active(assigned(spark, sf_dir))


PAIRS = f"""{ASSIGNED}, own AS (SELECT DISTINCT facet, tag, source_id FROM assigned), few AS (SELECT facet, tag FROM own GROUP BY ALL HAVING count(*) BETWEEN 2 AND 100),
pairs AS (SELECT a.source_id AS left_id, b.source_id AS right_id, count(DISTINCT facet) AS facets, count(*) AS shared FROM own a JOIN own b USING (facet, tag) JOIN few USING (facet, tag)
  WHERE a.source_id < b.source_id GROUP BY ALL HAVING count(DISTINCT facet) >= 2)"""


@register(f"WITH {PAIRS} SELECT * FROM pairs")
def two_facet_relations(spark, sf_dir):
    return op.two_facet_relations(assigned(spark, sf_dir), 100)


@register(f"""WITH {PAIRS}, n AS (SELECT source_id, count(*) AS n FROM own GROUP BY 1)
SELECT left_id, right_id, shared, round(shared / greatest(1, least(a.n, b.n))::DOUBLE, 3) AS overlap FROM pairs JOIN n a ON a.source_id = left_id JOIN n b ON b.source_id = right_id""")
def overlap_coefficient(spark, sf_dir):
    rows_ = assigned(spark, sf_dir)
    return op.overlap(op.two_facet_relations(rows_, 100), rows_)


@register(f"""WITH {ASSIGNED}, t AS (SELECT facet, tag, count(DISTINCT source_id) AS sources, count(DISTINCT family) AS families FROM assigned GROUP BY facet, tag), n AS (SELECT count(*) AS n FROM part)
SELECT facet, tag, sources, round((1 - sources / n::DOUBLE) * 50 + least(5, len(regexp_extract_all(tag, '[A-Za-z0-9]+'))) * 8 + greatest(0, 11 - CASE facet WHEN 'brand' THEN 1 WHEN 'type' THEN 3 WHEN 'size' THEN 9 ELSE 5 END) + least(5, families) * 2, 3) AS usefulness FROM t, n""")
def neighborhood_usefulness(spark, sf_dir):
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    priority = F.when(F.col("facet") == "brand", 1).when(F.col("facet") == "type", 3).when(F.col("facet") == "size", 9).otherwise(5)
    tags = op.registry(assigned(spark, sf_dir)).crossJoin(F.broadcast(n))  # one row
    return tags.select("facet", "tag", "sources", op.usefulness(F.col("sources") / F.col("n"), F.size(F.regexp_extract_all("tag", F.lit("[A-Za-z0-9]+"), F.lit(0))), priority, F.col("families")).alias("usefulness"))


EDGES = "edges AS (SELECT l_orderkey % 500 AS source_id, l_partkey % 500 AS target_id, CAST(l_quantity AS DOUBLE) AS strength, l_linenumber <> 1 AS inferred FROM lineitem)"


@register(f"""WITH {EDGES}, best AS (SELECT source_id, target_id, inferred, max(strength) AS strength FROM edges GROUP BY ALL)
SELECT source_id, target_id, inferred, strength, 0 AS rank FROM best WHERE NOT inferred
UNION ALL SELECT source_id, target_id, inferred, strength, row_number() OVER (PARTITION BY source_id ORDER BY strength DESC, target_id) AS rank FROM best WHERE inferred QUALIFY rank <= 8""")
def related_link_rank(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return op.related(line.select((F.col("l_orderkey") % 500).alias("source_id"), (F.col("l_partkey") % 500).alias("target_id"), F.col("l_quantity").cast("double").alias("strength"), (F.col("l_linenumber") != 1).alias("inferred")))


@register("""WITH c AS (SELECT DISTINCT l_orderkey AS source_id, l_partkey AS target_id, CASE WHEN l_linenumber % 2 = 0 THEN 'cites' ELSE 'cited_by' END AS relation_type FROM lineitem)
SELECT * FROM c UNION SELECT target_id, source_id, CASE relation_type WHEN 'cites' THEN 'cited_by' ELSE 'cites' END FROM c""")
def inverse_citation(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return op.with_inverse(line.select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.when(F.col("l_linenumber") % 2 == 0, "cites").otherwise("cited_by").alias("relation_type")))
