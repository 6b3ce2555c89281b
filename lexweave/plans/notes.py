"""Queries of functions on notes: a note is a document's whole text below lines that name its source, pages and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notes_text as nt
from ..functions import text as tx
from ..operators import quality
from . import sql
from .registry import register, table

#: The note of a document, in SQL and as an expression that both engines take.
HEAD = (
    "concat('Methods: ', source, '; ', lang, ', and survey.\n- The rate (p. ', doc_id % 90 + 1, '-', doc_id % 90 + 3, ') was reduced by ', doc_id % 13, '.5% compared with ', source,"
    " '; n = ', n_chars, '. See pp. ', doc_id % 7 + 2, '. It holds when ', lang, ' is used, p < 0.05. Total 1,', CASE WHEN doc_id % 5 = 0 THEN 'O' ELSE '0' END, '20 cases.\n\n \n')"
)
NOTE = f"concat({HEAD}, coalesce(text, ''))"
TITLE = r"trim(regexp_replace(left(split_part(text, chr(10), 1), 1000), '\s+', ' ', 'g'))"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TOKEN_ALL = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+')"


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _notes(spark, sf_dir):
    head = HEAD.replace("\n", "\\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.expr(head), F.coalesce("text", F.lit(""))).alias("note"), "text", "source", "lang")


_TAG = rf"regexp_replace(regexp_replace({STRIP.format(sql.fold('nfc_normalize(' + TITLE + ')'))}, '[\s_/]+', '-', 'g'), '[^\p{{L}}\p{{N}}_-]+', '', 'g')"


@register(f"SELECT doc_id, regexp_replace(regexp_replace({_TAG}, '-+', '-', 'g'), '^-+|-+$', '', 'g') AS tag, array_to_string({TOKEN_ALL.format(sql.fold('nfc_normalize(' + TITLE + ')'))}, ' ') AS norm FROM documents WHERE text IS NOT NULL")
def normalized_tags(spark, sf_dir):
    title = tx.title(F.col("text"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", nt.tag(title).alias("tag"), nt.norm(title).alias("norm"))


@register(f"""SELECT doc_id, len(list_distinct(list_filter(list_slice(regexp_extract_all({sql.fold('left(text, 500)')}, '[\\p{{L}}\\p{{N}}]+'), 1, 40), lambda w: length(w) > 1 AND NOT list_contains({sql.STOP}, w)))) AS n_words FROM documents WHERE text IS NOT NULL""")
def bounded_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(nt.bounded_words(F.col("text"), 500, 40)).cast("long").alias("n_words"))


@register(f"""WITH w AS (SELECT DISTINCT unnest({sql.tokens('text')}) AS word FROM documents)
SELECT CASE WHEN length(word) > 5 AND word LIKE '%ies' THEN left(word, length(word) - 3) || 'y'
  WHEN length(word) > 4 AND word LIKE '%s' AND NOT regexp_matches(word, '(ss|ics|us)$') THEN left(word, length(word) - 1) ELSE word END AS stem, count(*) AS n_words FROM w GROUP BY 1""")
def stems(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("word")).distinct()
    return words.groupBy(nt.stem(F.col("word")).alias("stem")).agg(F.count("*").alias("n_words"))


@register(f"""WITH t AS (SELECT doc_id, {sql.tokens('text')} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_filter(list_distinct(list_slice(w, 1, 6)), lambda x: NOT list_contains({sql.STOP}, x)) AS a, list_filter(list_distinct(list_slice(w, 3, 5)), lambda x: NOT list_contains({sql.STOP}, x)) AS b FROM t)
SELECT doc_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 WHEN len(list_intersect(a, b)) = least(len(a), len(b)) THEN 1
  ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END, 6) AS overlap FROM s""")
def phrase_overlap(spark, sf_dir):
    w = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.tokens(F.col("text")).alias("w"))
    phrase = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    return w.select("doc_id", F.round(nt.phrase_overlap(phrase(1, 6), phrase(3, 3)), 6).alias("overlap"))


_SHOUT = "CASE WHEN doc_id % 2 = 0 THEN upper(replace(t, 'ß', 'ss')) ELSE '* ' || t END"


@register(rf"""WITH t AS (SELECT doc_id, {TITLE} AS t FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, regexp_replace(regexp_replace({_SHOUT}, '\s+', ' ', 'g'), '^[ \-*_`''’"“”]+|[ \-*_`''’"“”]+$', '', 'g') AS d FROM t),
c AS (SELECT doc_id, CASE WHEN d = upper(d) AND d <> lower(d) THEN array_to_string(list_transform(string_split(d, ' '), lambda w: CASE WHEN length(w) <= 4 THEN w ELSE lower(w) END), ' ') ELSE d END AS c FROM d)
SELECT doc_id, upper(substr(c, 1, 1)) || substr(c, 2) AS display FROM c""")
def display_names(spark, sf_dir):
    t = tx.title(F.col("text"))
    shouted = F.when(F.col("doc_id") % 2 == 0, tx.upper(F.replace(t, F.lit("ß"), F.lit("ss")))).otherwise(F.concat(F.lit("* "), t))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", nt.display(shouted).alias("display"))


@register(rf"""WITH t AS (SELECT doc_id, {TITLE} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, lower(regexp_replace(regexp_replace(trim(t), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g')) AS s,
  left(regexp_replace(regexp_replace(regexp_replace(t, '[\\/:*?"<>|\x00-\x1f]+', ' ', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), 120) AS f FROM t)
SELECT doc_id, CASE WHEN s = '' THEN 'item' ELSE left(s, 96) END AS slug, trim(CASE WHEN f = '' THEN 'Untitled' ELSE f END) AS filename FROM s""")
def file_names(spark, sf_dir):
    t = tx.title(F.col("text"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", nt.slugify(t).alias("slug"), nt.safe_filename(t).alias("filename"))


@register(rf"""SELECT doc_id, sha256({STRIP.format(f"regexp_replace(replace({NOTE}, chr(13) || chr(10), chr(10)), chr(10) || '(?:[ \t]*' || chr(10) || ')+', chr(10) || chr(10), 'g')")}) AS fingerprint FROM documents""")
def semantic_fingerprint(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", nt.fingerprint(F.col("note")).alias("fingerprint"))


@register(rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(10) || '-', ' '), '\s+', ' ', 'g'), '^[ \-*]+|[ \-*]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, coalesce(nullif(regexp_extract(t, '^(.*?[.!?])(?:\s|$)', 1), ''), t) AS s FROM t)
SELECT doc_id, CASE WHEN length(s) <= 60 THEN s ELSE rtrim(left(s, 59)) || '…' END AS sentence FROM s""")
def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", nt.first_sentence(F.col("text"), 60).alias("sentence"))


_CUT = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^\s*(?:[-*+]|\d+[.)])\s*', ''), '^\s+|\s+$', '', 'g'), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '\b([pP]{{1,2}}\.)' || chr(1), '\1 ', 'g')"""


@register(rf"""WITH l AS (SELECT doc_id, unnest(string_split({NOTE}, chr(10))) AS line FROM documents),
u AS (SELECT doc_id, unnest(string_split({_CUT}, chr(1))) AS unit FROM l)
SELECT doc_id, count(*) FILTER (trim(unit) <> '') AS n_units, sum(length(regexp_replace(unit, '\s+', '', 'g'))) FILTER (trim(unit) <> '')::BIGINT AS n_signs FROM u GROUP BY doc_id""")
def claim_units(spark, sf_dir):
    units = _notes(spark, sf_dir).select("doc_id", nt.claim_units(F.col("note")).alias("u"))
    signs = F.aggregate("u", F.lit(0).cast("long"), lambda s, x: s + F.length(F.regexp_replace(x, r"\s+", "")))
    return units.select("doc_id", F.size("u").cast("long").alias("n_units"), signs.alias("n_signs"))


@register(rf"""WITH n AS (SELECT doc_id, {NOTE} AS note FROM documents),
v AS (SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_extract(note, '(?im)^(?:[-*]\s*)?(?:\*\*)?(?:method|methods)(?:\*\*)?\s*:\s*(.+)$', 1)), '\.+$', ''), ',(\s*(?:and\s+)?[^,]{{1,80}})$', ';\1') AS v FROM n)
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(v, '[;|]'), lambda p: regexp_replace(p, '^[ \-]+|[ \-]+$', '', 'g')), lambda p: p <> ''), '|') AS methods FROM v""")
def labelled_values(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", F.array_join(nt.labelled_values(F.col("note"), ["method", "methods"]), "|").alias("methods"))


@register("SELECT doc_id, " + ", ".join(rf"coalesce(nullif({STRIP.format(f'regexp_extract({NOTE}, {_quote(p)})')}, ''), 'not_reported') AS {k}" for k, p in nt.PATTERNS.items()) + " FROM documents")
def reported_values(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", *(nt.reported(F.col("note"), k).alias(k) for k in nt.PATTERNS))


@register(f"""WITH p AS (SELECT doc_id, list_transform(regexp_extract_all({NOTE}, {_quote(nt.PAGES)}, 1), lambda x: x::BIGINT) AS a, list_transform(regexp_extract_all({NOTE}, {_quote(nt.PAGES)}, 2), lambda x: TRY_CAST(x AS BIGINT)) AS b FROM documents),
r AS (SELECT doc_id, list_min(a) AS low, greatest(list_max(a), coalesce(list_max(b), 0)) AS high, len(a) AS n FROM p)
SELECT doc_id, CASE WHEN n = 0 THEN '' WHEN low = high THEN 'p. ' || low ELSE 'pages ' || low || '-' || high END AS pages FROM r""")
def page_ranges(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", nt.page_range(F.col("note")).alias("pages"))


@register(rf"""WITH n AS (SELECT doc_id, {NOTE} AS note, coalesce(text, '') AS text FROM documents),
i AS (SELECT doc_id, list_filter(string_split(note, chr(10)), lambda v: regexp_matches(v, '^\s*[-*]\s+\S')) AS b, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))), lambda v: v <> '') AS p FROM n)
SELECT doc_id, len(list_distinct(b)) AS n_bullets, len(list_distinct(p)) AS n_paragraphs FROM i""")
def content_items(spark, sf_dir):
    n = _notes(spark, sf_dir)
    plain = F.filter(nt.content_items(F.coalesce("text", F.lit(""))), lambda v: v != "")
    return n.select("doc_id", F.size(nt.content_items(F.col("note"))).cast("long").alias("n_bullets"), F.size(plain).cast("long").alias("n_paragraphs"))


_SIGNS, _WORDS = r"length(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g'))", r"len(regexp_extract_all({0}, '[\p{{L}}]+(?:[''’][\p{{L}}]+)*'))"
_DAMAGED = r"len(list_filter(regexp_extract_all(replace({0}, ' ', '  '), '(?:^|[^\w,])(~?[0-9O]{{1,3}}(?:,[0-9O]{{3}})+)(?:[^\w,]|,[^0-9O]|,?$)', 1), lambda v: contains(v, 'O') AND regexp_matches(v, '^~|[0-9]'))) > 0"
_SHORT = TITLE.replace("text", "t")


@register(rf"""WITH n AS (SELECT doc_id, {NOTE} AS note, coalesce(text, '') AS t FROM documents), s AS (SELECT *, trim(regexp_replace(left(t, 30), '\s+', ' ', 'g')) AS x FROM n)
SELECT doc_id, {_DAMAGED.format('note')} AS damaged, ({_DAMAGED.format('t')} OR {_SIGNS.format('t')} < 40 OR {_WORDS.format('t')} < 6) AS suspicious,
x <> '' AND NOT ({_DAMAGED.format('x')}) AND NOT regexp_matches(lower(x), '{'|'.join(nt.BOILERPLATE)}') AND {_WORDS.format('x')} > 0 AND ({_WORDS.format('x')} >= 2 OR {_SIGNS.format('x')} >= 8) AS readable FROM s""")
def page_legibility(spark, sf_dir):
    n, text = _notes(spark, sf_dir), F.coalesce("text", F.lit(""))
    return n.select("doc_id", nt.damaged_numeral(F.col("note")).alias("damaged"), nt.suspicious_page(text).alias("suspicious"), nt.readable_short_text(F.left(text, F.lit(30))).alias("readable"))


PREDICATES = ["dc:references", "Is cited-by", "cites", "related", "is_cited_by", "dc:relation", " References ", "isReferencedBy"]


@register(f"""WITH p AS (SELECT doc_id, lower(trim(list_extract({PREDICATES}, CAST(doc_id % {len(PREDICATES)} + 1 AS INTEGER)))) AS p FROM documents), l AS (SELECT regexp_replace(p, '[\\s-]+', '_', 'g') AS p FROM p)
SELECT CASE WHEN list_contains({nt.CITES}, p) OR replace(p, '_', '') IN ('cites', 'references') THEN 'cites'
  WHEN list_contains({nt.CITED_BY}, p) OR replace(p, '_', '') IN ('citedby', 'isreferencedby') THEN 'cited_by' ELSE 'related' END AS relation, count(*) AS n FROM l GROUP BY 1
UNION ALL SELECT 'contradicts', 0""")
def typed_relation_counts(spark, sf_dir):
    """Counts of each type that there can be, zeroes included."""
    of = F.element_at(F.array(*map(F.lit, PREDICATES)), (F.col("doc_id") % len(PREDICATES) + 1).cast("int"))
    counts = table(spark, sf_dir, "documents").groupBy(nt.relation_class(of).alias("relation")).agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([("cites",), ("cited_by",), ("related",), ("contradicts",)], "relation string")
    return kinds.join(counts, "relation", "left").select("relation", F.coalesce("n", F.lit(0)).alias("n"))


@register(rf"""WITH c AS (SELECT doc_id, {HEAD} AS claim, {NOTE} AS page, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, list_distinct(regexp_extract_all(replace({sql.fold('claim')}, 'ß', 'ss'), '\p{{L}}{{5,}}')) AS cw, regexp_extract_all({sql.fold('t')}, '\p{{L}}{{5,}}') AS pw FROM c)
SELECT doc_id, round(0.3 * len(list_intersect(cw, list_distinct(pw))) / len(cw) + 0.7, 6) AS with_numbers, round(len(list_intersect(cw, list_distinct(pw))) / CAST(len(cw) AS DOUBLE), 6) AS by_words FROM k""")
def page_support(spark, sf_dir):
    """A note's own head as the claim and its text as the page; its numbers are all found on the whole note."""
    head = F.expr(HEAD.replace("\n", "\\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", nt.key_words(head).alias("cw"), nt.key_words(F.coalesce("text", F.lit(""))).alias("pw"), quality.numeric_tokens(head).alias("cn"))
    none = F.array().cast("array<string>")
    return rows.select("doc_id", F.round(nt.page_support(F.col("cn"), F.col("cw"), F.col("cn"), F.col("pw")), 6).alias("with_numbers"), F.round(nt.page_support(none, F.col("cw"), none, F.col("pw")), 6).alias("by_words"))
