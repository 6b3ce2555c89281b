"""Quality and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as op
from .linkage import literal, rows
from .registry import register, table

CLAIMS = ["Turnout decreased by 3.5%", "It grew .5 points, from 1,200 to +1,800", "there was no difference", "results varied; beta = -.25", "the odds ratio was 2", "an 80 percent success rate", "nothing here", "predicted probability of 0.3 increased"]


def _first(x: str, classes: dict, otherwise: str) -> str:
    any_ = lambda terms: " OR ".join(f"contains(lower({x}), '{t}')" for t in terms)
    return "CASE " + " ".join(f"WHEN {any_(terms)} THEN '{name}'" for name, terms in classes.items()) + f" ELSE '{otherwise}' END"


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(0), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@register(rf"SELECT doc_id, CAST(length({_CLEAN}) AS INTEGER) AS chars, CAST(len(regexp_extract_all({_CLEAN}, '[\p{{L}}\p{{N}}_]+')) AS INTEGER) AS words, CAST(len(string_split({_CLEAN}, chr(10))) AS INTEGER) AS lines FROM documents")
def text_metrics(spark, sf_dir):
    c = op.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).alias("chars"), op.word_count(c).alias("words"), F.size(F.split(c, "\n")).alias("lines"))


@register(rf"SELECT doc_id, CASE WHEN length({_CLEAN}) >= 80 AND len(regexp_extract_all({_CLEAN}, '[\p{{L}}\p{{N}}_]+')) >= 8 THEN 'full_document' ELSE 'metadata_only' END AS scope FROM documents")
def adequacy_plain(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", op.plain_text_scope(F.col("text")).alias("scope"))


@register()
def html_adequacy(spark, sf_dir):
    return op.html_adequacy(table(spark, sf_dir, "pages"))


@register("""WITH u AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(l), '[0-9]+', '#', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))
SELECT line, count(*) AS pages FROM u WHERE line <> '' GROUP BY line HAVING count(*) >= 3""")
def repeated_lines(spark, sf_dir):
    return op.repeated_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text"))


@register(f"SELECT k, {_first('x', op.DIRECTIONS, 'not_reported')} AS direction FROM {literal(CLAIMS)}")
def direction_label(spark, sf_dir):
    return rows(spark, CLAIMS).select("k", op.first_class(F.col("x"), op.DIRECTIONS, "not_reported").alias("direction"))


@register(f"SELECT k, {_first('x', op.ESTIMANDS, 'reported_statistic')} AS estimand FROM {literal(CLAIMS)}")
def estimand_type(spark, sf_dir):
    return rows(spark, CLAIMS).select("k", op.first_class(F.col("x"), op.ESTIMANDS, "reported_statistic").alias("estimand"))


@register(rf"""SELECT k, array_to_string(list_transform(regexp_extract_all(x, '[+-]?(?:[0-9][0-9,]*)?\.?[0-9]+%?'), lambda t: regexp_replace(regexp_replace(replace(t, ',', ''), '^\+', ''), '^(-?)\.', '\10.')), ' ') AS numbers FROM {literal(CLAIMS)}""")
def numeric_tokens(spark, sf_dir):
    return rows(spark, CLAIMS).select("k", F.array_join(op.numeric_tokens(F.col("x")), " ").alias("numbers"))


@register(r"""WITH u AS (SELECT item_id AS unit_id, d.doc_id AS source_id, b.text AS quote FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id), n AS (SELECT doc_id AS source_id, text AS excerpt FROM documents WHERE doc_id % 3 <> 0)
SELECT unit_id, bool_or(excerpt IS NOT NULL) AS source_found, bool_or(coalesce(contains(trim(regexp_replace(lower(excerpt), '\s+', ' ', 'g')), trim(regexp_replace(lower(quote), '\s+', ' ', 'g'))), false)) AS passage_found FROM u LEFT JOIN n USING (source_id) GROUP BY unit_id""")
def evidence_recall(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("unit_id"), F.col("text").alias("quote"))
    units = docs.select(F.col("doc_id").alias("source_id"), (F.col("doc_id") % 40).alias("unit_id")).join(items, "unit_id")
    return op.evidence_recall(units, docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("source_id"), F.col("text").alias("excerpt")))


@register("""WITH b AS (SELECT user_id AS task, round(avg(value), 6) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1), c AS (SELECT user_id AS task, round(avg(value), 6) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT count(*) FILTER (c.value > b.value) AS improved, count(*) FILTER (c.value < b.value) AS regressed, count(*) FILTER (c.value = b.value) AS equal, round(avg(c.value - b.value), 4) AS mean FROM b JOIN c USING (task)""")
def paired_delta(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    b, c = (e.where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("task")).agg(F.round(F.avg("value"), 6).alias("value")) for k in (0, 1))
    return op.paired_deltas(b, c).withColumn("mean", F.round("mean", 4))


@register("""WITH r AS (SELECT l_orderkey AS pair, l_suppkey % 5 AS reviewer, CASE l_returnflag WHEN 'N' THEN 'useful' WHEN 'R' THEN 'unsupported' ELSE 'uncertain' END AS label FROM lineitem)
SELECT pair, CASE WHEN count(*) = 2 AND count(DISTINCT label) = 1 THEN min(label) ELSE 'uncertain' END AS label, count(*) = count(DISTINCT reviewer) AS valid FROM r GROUP BY pair""")
def reviewer_consensus(spark, sf_dir):
    label = F.when(F.col("l_returnflag") == "N", "useful").when(F.col("l_returnflag") == "R", "unsupported").otherwise("uncertain")
    return op.consensus(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), (F.col("l_suppkey") % 5).alias("reviewer"), label.alias("label")))


@register("""WITH h AS (SELECT doc_id AS source_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('v1|' || source || '|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source_id, source FROM h WHERE n > 1 AND r <= least(n - 1, greatest(1, ceil(n * 0.2)))""")
def stratified_holdout(spark, sf_dir):
    return op.holdout(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "source"), "source")


@register("""WITH p AS (SELECT event_id, least(0.99, 0.3 + (event_id % 70) / 100.0::DOUBLE) AS top, least(0.3 + (event_id % 70) / 100.0::DOUBLE, 0.99) * (event_id % 5) / 4.0 AS second FROM events)
SELECT event_id, round((top - 0.25) / 0.75, 6) AS confidence, CASE WHEN top = second THEN 'unresolved_tie' WHEN top - second < 0.2 THEN 'defer_margin' WHEN (top - 0.25) / 0.75 < 0.5 THEN 'reject_confidence' ELSE 'accept' END AS decision FROM p""")
def acceptance_policy(spark, sf_dir):
    top = F.least(F.lit(0.99), 0.3 + (F.col("event_id") % 70) / 100.0)
    confidence, decision = op.acceptance(top, top * (F.col("event_id") % 5) / 4.0, 4)
    return table(spark, sf_dir, "events").select("event_id", F.round(confidence, 6).alias("confidence"), decision.alias("decision"))


@register("""WITH e AS (SELECT DISTINCT l_orderkey AS left_id, l_partkey AS right_id, l_partkey % 3 <> 0 AS inferred FROM lineitem), r AS (SELECT l_orderkey AS left_id, l_partkey AS right_id, CASE l_returnflag WHEN 'N' THEN 'useful' WHEN 'R' THEN 'misleading' ELSE 'redundant' END AS verdict FROM lineitem WHERE l_linenumber % 2 = 0),
v AS (SELECT left_id, right_id, CASE WHEN count(*) = 1 THEN min(verdict) END AS verdict FROM r GROUP BY ALL), j AS (SELECT left_id, right_id, verdict, inferred AND coalesce(verdict IN ('redundant', 'misleading'), false) AS bad FROM e LEFT JOIN v USING (left_id, right_id))
SELECT left_id, right_id, NOT bad AS shown, CASE WHEN bad THEN 0 WHEN verdict = 'useful' THEN 2 ELSE 1 END AS priority FROM j""")
def graph_value_filter(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "left_id", "l_partkey": "right_id"})
    verdict = F.when(F.col("l_returnflag") == "N", "useful").when(F.col("l_returnflag") == "R", "misleading").otherwise("redundant")
    return op.graph_value(line.select("left_id", "right_id", (F.col("right_id") % 3 != 0).alias("inferred")).distinct(), line.where("l_linenumber % 2 = 0").select("left_id", "right_id", verdict.alias("verdict")))
