"""Label queries: conversations are notes, their first turn is the title, their number modulo 8 the community."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as op
from . import sql
from .registry import register, table


def _phrases(x: str) -> str:
    t = sql.tokens(x)
    runs = ", ".join(f"CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n} + 2), lambda i: list_slice({t}, i, i + {n - 1})) ELSE [] END" for n in (2, 3, 4))
    runs = f"flatten([{runs}])"
    return f"list_transform(list_filter({runs}, lambda p: NOT list_contains({sql.STOP}, p[1]) AND NOT list_contains({sql.STOP}, p[-1]) AND 2 * len(list_filter(p, lambda w: list_contains({sql.STOP}, w))) <= len(p)), lambda p: array_to_string(p, ' '))"


NOTES = f"""notes AS (SELECT conv_id AS note_id, CASE WHEN turn = 0 THEN text ELSE '' END AS title, text AS body FROM conversations),
raw AS (SELECT note_id, unnest({_phrases('title')}) AS phrase, 1 AS t, 0 AS b FROM notes UNION ALL SELECT note_id, unnest({_phrases('body')}), 0, 1 FROM notes),
sums AS (SELECT note_id, phrase, max(t) AS t, sum(b) AS b FROM raw GROUP BY ALL),
rated AS (SELECT note_id, phrase, 4 * t + ln(1 + b::DOUBLE) AS weight, t = 1 AS titled FROM sums),
weights AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY round(weight, 9) DESC, phrase) AS r FROM rated QUALIFY r <= 512),
members AS (SELECT DISTINCT conv_id AS note_id, conv_id % 8 AS community FROM conversations),
size AS (SELECT community, count(*) AS size FROM members GROUP BY 1),
w AS (SELECT community, phrase, sum(weight) AS w, count(DISTINCT note_id) AS n, count(*) FILTER (titled) AS titles FROM weights JOIN members USING (note_id) GROUP BY ALL),
cov AS (SELECT community, phrase, w, n / size::DOUBLE AS coverage, titles / size::DOUBLE AS titles FROM w JOIN size USING (community)),
comp AS (SELECT a.community, a.phrase, a.w, a.coverage, a.titles, coalesce((SELECT max(b.coverage) FROM cov b WHERE b.phrase = a.phrase AND b.community <> a.community), 0) AS outside FROM cov a)"""

#: The same with all phrases of a note.
WHOLE = NOTES.replace(" QUALIFY r <= 512", "")


def _notes(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    notes = conv.select(F.col("conv_id").alias("note_id"), F.when(F.col("turn") == 0, F.col("text")).otherwise("").alias("title"), F.col("text").alias("body"))
    return notes, conv.select(F.col("conv_id").alias("note_id"), (F.col("conv_id") % 8).alias("community")).distinct()


@register(f"WITH p AS (SELECT conv_id, unnest({_phrases('text')}) AS phrase FROM conversations) SELECT conv_id, phrase, count(*) AS n FROM p GROUP BY ALL")
def phrase_ngrams(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", F.explode(op.phrases(F.col("text"))).alias("phrase")).groupBy("conv_id", "phrase").agg(F.count("*").alias("n"))


@register(f"WITH {NOTES} SELECT note_id, phrase, round(weight, 6) AS weight, titled FROM weights")
def phrase_weights(spark, sf_dir):
    return op.phrase_weights(_notes(spark, sf_dir)[0]).withColumn("weight", F.round("weight", 6))


@register(f"WITH {NOTES} SELECT community, phrase, round(w, 6) AS w, round(coverage, 6) AS coverage, round(outside, 6) AS outside FROM comp")
def competitor_coverage(spark, sf_dir):
    notes, members = _notes(spark, sf_dir)
    r = lambda c: F.round(c, 6).alias(c)
    return op.competitors(op.phrase_weights(notes), members).select("community", "phrase", r("w"), r("coverage"), r("outside"))


@register(f"""WITH {WHOLE}, own AS (SELECT community, sum(w) AS own FROM comp GROUP BY 1), mean AS (SELECT avg(own) AS mean FROM own), tot AS (SELECT phrase, sum(w) AS total FROM comp GROUP BY 1),
d AS (SELECT *, greatest(0, (coverage - outside) / greatest(coverage, 1e-12)) AS dist FROM comp),
s AS (SELECT community, phrase, round(w / own * ln(1 + mean / greatest(total, 1e-12)) * pow(coverage, 1.5) * (1 + titles) * (0.1 + 0.9 * dist) * (1 + 0.08 * (len(string_split(phrase, ' ')) - 2)), 9) AS score, round(coverage, 6) AS coverage
  FROM d JOIN own USING (community) JOIN tot USING (phrase), mean WHERE dist > 0.05)
SELECT community, phrase, score, coverage, row_number() OVER (PARTITION BY community ORDER BY score DESC, coverage DESC, phrase) AS rank FROM s""")
def ctfidf_candidates(spark, sf_dir):
    notes, members = _notes(spark, sf_dir)
    return op.label_candidates(op.phrase_weights(notes, None), members)


@register(f"""WITH t AS (SELECT DISTINCT conv_id % 8 AS community, conv_id, unnest({sql.words('text')}) AS word FROM conversations),
n AS (SELECT community, word, count(*) AS n, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, word) AS rank FROM t GROUP BY ALL QUALIFY rank <= 3)
SELECT community, string_agg(word, ', ' ORDER BY rank) AS label FROM n GROUP BY community""".replace("GROUP BY ALL QUALIFY", "GROUP BY community, word QUALIFY"))
def fallback_label(spark, sf_dir):
    from ..functions import text as tx
    from ..operators.catalogue import top_values

    words = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 8).alias("community"), "conv_id", F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    return top_values(words, "community", "word", 3).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ", ").alias("label"))


@register()
def label_assignment(spark, sf_dir):
    notes, members = _notes(spark, sf_dir)
    return op.assign_labels(op.scored(op.phrase_weights(notes, None), members))


@register()
def mmr_rerank(spark, sf_dir):
    from ..operators import neighbors
    from .neighbors import vectors

    v = vectors(spark, sf_dir)
    near = neighbors.knn(v, 24).select(F.col("source_id").alias("group"), F.col("target_id").alias("item"), F.col("score").alias("relevance"))
    return op.rerank(near.join(v.select(F.col("source_id").alias("item"), "vector"), "item"), "group")
