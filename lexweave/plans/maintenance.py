"""Communities, segments, sources and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import community, neighbors
from ..operators import segments as seg
from ..sources import notes
from ..streaming import changes
from .linkage import rows
from .neighbors import KNN, vectors
from .registry import register, table


@register()
def label_propagation(spark, sf_dir):
    return community.label_propagation(neighbors.fold_edges(neighbors.knn(vectors(spark, sf_dir))))


@register()
def louvain_partition(spark, sf_dir):
    return community.louvain_partition(neighbors.fold_edges(neighbors.knn(vectors(spark, sf_dir))))


@register(f"""WITH {KNN.replace('rank <= 8', 'rank <= 16')}, g AS (SELECT unnest([4, 8, 12, 16]) AS k), f AS (SELECT unnest([0.0, 0.2, 0.3])::DOUBLE AS floor),
pairs AS (SELECT DISTINCT k, floor, least(source_id, target_id) AS l, greatest(source_id, target_id) AS r FROM knn, g, f WHERE rank <= k AND score >= floor),
rev AS (SELECT a.vec_id AS l, b.vec_id AS r, CASE WHEN a.label = b.label THEN 'useful' ELSE 'unsupported' END AS label FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 40),
u AS (SELECT count(*) FILTER (label = 'useful') AS useful FROM rev),
s AS (SELECT k, floor, count(*) FILTER (label = 'useful') AS recovered, count(*) FILTER (label = 'unsupported') AS unsupported, count(*) AS selected FROM pairs LEFT JOIN rev USING (l, r) GROUP BY k, floor)
SELECT k, floor, recovered, useful - recovered AS missed, unsupported, selected, row_number() OVER (ORDER BY unsupported - recovered, selected, k, floor) AS rank FROM s, u""")
def calibration_grid(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    around = v.select(F.col("vec_id").alias("left_id"), F.col("label").alias("a"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 40)).alias("right_id"))
    reviewed = around.join(v.toDF("right_id", "b"), "right_id").select("left_id", "right_id", F.when(F.col("a") == F.col("b"), "useful").otherwise("unsupported").alias("label"))
    return community.calibration_grid(neighbors.knn(vectors(spark, sf_dir), 16), reviewed, [4, 8, 12, 16], [0.0, 0.2, 0.3])


@register("SELECT doc_id AS source_id, CAST(c AS INTEGER) AS chunk, CAST(c * 2000 AS INTEGER) AS start, substr(text, c * 2000 + 1, 2000) AS text FROM documents, LATERAL (SELECT unnest(range(greatest(1, ceil(length(text) / 2000.0)::INT))) AS c)")
def lossless_chunks(spark, sf_dir):
    return seg.lossless_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))


@register(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id AS source_id, CAST(i AS INTEGER) AS "window", array_to_string(list_slice(w, i * 96 + 1, i * 96 + 128), ' ') AS tokens FROM w, LATERAL (SELECT unnest(range(greatest(0, ceil((len(w) - 128) / 96.0)::INT) + 1)) AS i) WHERE len(w) > 0""")
def token_windows(spark, sf_dir):
    return seg.token_windows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))


@register("""WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS occurrence FROM conversations)
SELECT conv_id AS source_id, turn AS start, occurrence, sha256(text || '|' || occurrence) AS chunk_id FROM c""")
def chunk_identity(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("start"), "text")
    return seg.chunk_identity(turns).drop("text")


SPANS = "spans AS (SELECT l_suppkey AS owner, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"


def _spans(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))


@register(f"""WITH {SPANS}, m AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY owner ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s - 1) THEN 1 ELSE 0 END AS fresh FROM spans),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY s, e) AS island FROM m) SELECT owner, min(s) AS start, max(e) AS "end" FROM i GROUP BY owner, island""")
def interval_merge(spark, sf_dir):
    return seg.merge_intervals(_spans(spark, sf_dir))


@register("""WITH spans AS (SELECT l_orderkey AS owner, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 13 AS e FROM lineitem),
l AS (SELECT *, lag(e) OVER (PARTITION BY owner ORDER BY s, e) AS last FROM spans) SELECT owner, bool_and(e > s AND coalesce(last, s) <= s) AS valid FROM l GROUP BY owner""")
def ownership_check(spark, sf_dir):
    start = F.col("l_linenumber") * 10
    return seg.disjoint(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), start.alias("start"), (start + F.col("l_quantity").cast("long") % 13).alias("end")))


@register("""SELECT a.conv_id AS doc, a.turn AS cited, b.turn AS page, a.conv_id * 1000 + a.turn AS claim, length(b.text) AS chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(b.turn - a.turn) <= 1 WHERE a.turn % 2 = 0""")
def fidelity_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    claims = turns.where("page % 2 = 0").select((F.col("doc") * 1000 + F.col("page")).alias("claim"), "doc", "page")
    return seg.near_pages(claims, turns).select("doc", "cited", "page", "claim", F.length("text").cast("long").alias("chars"))


NOTES = ["---\ntitle: \"A note\"\ntags: x\n---\nSee [[Other note|shown]] and [[Third#part]].\n## Findings\nIt grew.\n## Rest\nx", "no matter [[a]]", "---\nkind: y\n---\n"]


@register(f"""WITH n AS (SELECT unnest([0, 1, 2]) AS k, unnest([{', '.join("'" + n.replace("'", "''") + "'" for n in NOTES)}]) AS x),
m AS (SELECT k, x, regexp_extract(x, '(?s)^---\\r?\\n(.*?)\\r?\\n---\\r?\\n', 1) AS matter, regexp_replace(x, '(?s)^---\\r?\\n.*?\\r?\\n---\\r?\\n', '') AS body FROM n)
SELECT CAST(k AS INTEGER) AS k, nullif(regexp_replace(regexp_extract(matter, '(?m)^title:[ \\t]*([^\\n\\r]*)', 1), '^["'']|["'']$', '', 'g'), '') AS title,
array_to_string(list_transform(regexp_extract_all(body, '\\[\\[([^\\]|#]+)', 1), lambda t: trim(t)), ', ') AS links, trim(regexp_extract(body || chr(10) || '## ', '(?s)## Findings[ \\t]*\\r?\\n(.*?)\\n## ', 1)) AS findings FROM m""")
def markdown_scan(spark, sf_dir):
    x = F.col("x")
    b = notes.body(x)
    return rows(spark, NOTES).select("k", notes.field(notes.front_matter(x), "title").alias("title"), F.array_join(notes.wiki_links(b), ", ").alias("links"), notes.section(b, "Findings").alias("findings"))


@register("""SELECT user_id AS source_id, arg_max(props, (ts, props)) AS fingerprint, CAST(1 AS BIGINT) AS changes FROM events WHERE props IS NOT NULL GROUP BY 1""")
def dirty_set_batches(spark, sf_dir):
    stream = changes.stream_of(spark, sf_dir, "events").where("props is not null").select(F.col("user_id").alias("source_id"), F.col("ts").cast("string").alias("at"), F.col("props").alias("fingerprint"))
    return changes.settled(changes.dirty(stream), "append")


@register("""SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    return changes.settled(changes.windows(changes.stream_of(spark, sf_dir, "events")), "complete").select(F.col("start").cast("long").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark, sf_dir):
    return changes.settled(changes.sessions(changes.stream_of(spark, sf_dir, "events")), "complete").select("user_id", F.col("start").cast("long").alias("start"), "n")


KINDS = ["2024-05-01", "2024-05-01T10:00", "true", "12.5", "#a #b", "- x", "plain text"]


@register("SELECT k, CASE WHEN regexp_matches(x, '^(true|false)$') THEN 'checkbox' WHEN regexp_matches(x, '^-?[0-9]+(\\.[0-9]+)?$') THEN 'number' WHEN regexp_matches(x, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date' WHEN regexp_matches(x, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]+$') THEN 'datetime' WHEN regexp_matches(x, '^(#[^ ]+ ?)+$') THEN 'tags' WHEN regexp_matches(x, '^[-*] ') THEN 'list' ELSE 'text' END AS kind FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(KINDS)) + ") AS t(k, x)")
def property_typing(spark, sf_dir):
    x = F.col("x")
    kind = F.when(x.rlike("^(true|false)$"), "checkbox").when(x.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number").when(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date").when(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]+$"), "datetime").when(x.rlike("^(#[^ ]+ ?)+$"), "tags").when(x.rlike("^[-*] "), "list").otherwise("text")
    return rows(spark, KINDS).select("k", kind.alias("kind"))
