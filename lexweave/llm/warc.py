"""Operator 4: WARC derivatives. Responses become linked metadata and plain-text conversion records.

Everything is a column expression: no shuffle, no Python, one pass over the pages. Each derivative names the
response it stems from (WARC-Refers-To, its target and its date), keeps the response's HTTP headers and payload
digest, and has a block digest of its own. Identifiers follow from content, so a repeated task gives equal records.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "1970-01-01T00:00:00Z"
#: Pages whose number occurs more than once: up to so many are sent to all tasks, more are joined by a shuffle.
REPEATED_SENT = 100_000

# Elements that are not text, elements that start a line, how attributes are written.
HIDDEN = ("head", "script", "style", "noscript", "template")
LINES = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"
VALUE = r"""("[^"]*"|'[^']*'|[^\s>"']+)"""
HREF, LANG, CHARSET = (
    r"(?i)<a\s(?:[^>]*\s)?href\s*=\s*" + VALUE, r"(?i)<html\s(?:[^>]*?\s)?lang\s*=\s*" + VALUE, r"(?i)<meta\s[^>]*?charset\s*=\s*[\"']?\s*([a-z0-9_-]+)",
)
QUOTES = r"""^["']|["']$"""
#: A character reference at the start of what follows an ampersand; names and their numbers are HTML 4's.
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
NAMES = name2codepoint | {"apos": 39}

#: (pattern, replacement) in order, from markup to text; then references are resolved and spaces collapsed.
MARKUP = [
    (r"(?s)<!--.*?-->", " "),
    *[(rf"(?is)<{e}\b.*?</{e}\s*>", " ") for e in HIDDEN],
    (r"(?is)<(?:script|style)\b.*$", " "),
    (rf"(?i)</?(?:{LINES})\b[^>]*>", "\n"),
    (r"<[!/?a-zA-Z][^>]*>", ""),
    (r"<[!/?a-zA-Z][^>]*$", ""),
]
SPACES = [(r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+", ""), (r"[ \n]+$", "")]


def resolved(x: Column) -> Column:
    """Character references, named or numeric, replaced once, from left to right; those that name no character stay."""
    table = F.create_map(*(F.lit(v) for kv in NAMES.items() for v in kv))

    def code(name: Column) -> Column:
        return F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).otherwise(F.try_element_at(table, name).cast("string")).try_cast("long")

    def sign(s: Column) -> Column:
        good = s["c"].between(1, 0x10FFFF) & ~s["c"].between(0xD800, 0xDFFF)
        own = F.when(s["c"] == 160, " ").otherwise(F.decode(F.unhex(F.lpad(F.hex(s["c"]), 8, "0")), "UTF-32"))
        return F.when(good, F.concat(own, s["p"].substr(F.length(s["n"]) + 2, F.length(s["p"])))).otherwise(F.concat(F.lit("&"), s["p"]))

    def whole(parts: Column) -> Column:
        named = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(p.alias("p"), F.regexp_extract(p, REFERENCE, 1).alias("n")))
        coded = F.transform(named, lambda s: F.struct(s["p"].alias("p"), s["n"].alias("n"), code(s["n"]).alias("c")))
        return F.concat(F.element_at(parts, 1), F.array_join(F.transform(coded, sign), ""))

    # a lambda's variable stands for what would else be worked out each time that it is named
    return F.element_at(F.transform(F.array(F.split(x, "&")), whole), 1)


def escaped(x: Column) -> Column:
    """A value that keeps to its line: line breaks percent-encoded, as in an address."""
    return F.replace(F.replace(x, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def text_of(html: Column) -> Column:
    """The visible text of a page: one line for each block, spaces collapsed, references resolved."""
    for pattern, to in MARKUP:
        html = F.regexp_replace(html, pattern, to)
    html = resolved(html)
    for pattern, to in SPACES:
        html = F.regexp_replace(html, pattern, to)
    return html


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def record_id(*parts: Column) -> Column:
    """A name-based identifier in the form of a UUID."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def parsed(records: DataFrame) -> DataFrame:
    """Response records (page_id, target_uri, date, http: header lines, a blank line, payload) as ``responses`` gives them.

    Headers are kept as they were sent; a record without a blank line has no payload. A null http is no response.
    """
    http = F.col("http").cast("string")
    cut = F.position(F.lit("\r\n\r\n"), http)
    head = F.when(cut > 0, F.substring(http, F.lit(1), cut + 1)).otherwise(http)
    payload = F.when(cut > 0, http.substr(cut + 4, F.length(http))).otherwise("")
    rows = records.where(http.isNotNull()).select("page_id", F.coalesce(F.col("target_uri").cast("string"), F.lit("")).alias("target_uri"), F.coalesce("date", F.lit(EPOCH)).alias("date"), head.alias("http_headers"), payload.alias("payload"))
    return identified(rows.withColumn("payload_digest", digest(F.col("payload"))))


def identified(made: DataFrame) -> DataFrame:
    """Responses with record_id: it follows from the page's number, address and payload; of equal ones it follows from which it is."""
    repeated = made.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select("page_id", F.lit(True).alias("repeated"))
    some = repeated.count()
    if some:
        # only rows of repeated numbers are numbered: a window of rows that are equal, which needs no memory
        hint = F.broadcast(repeated) if some <= REPEATED_SENT else repeated
        same = made.join(hint.withColumnRenamed("page_id", "other"), F.col("page_id").eqNullSafe(F.col("other")), "left").drop("other")
        copies = Window.partitionBy("page_id", "target_uri", "payload_digest").orderBy("date")
        numbered = same.where("repeated").withColumn("copy", F.row_number().over(copies))
        made = same.where("repeated is null").withColumn("copy", F.lit(1)).unionByName(numbered).drop("repeated")
    else:
        made = made.withColumn("copy", F.lit(1))
    copy = F.when(F.col("copy") > 1, F.col("copy").cast("string"))
    return made.withColumn("record_id", record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.col("payload_digest"), copy)).drop("copy")


def responses(pages: DataFrame, date: str = EPOCH) -> DataFrame:
    """Pages as response records: page_id, record_id, target_uri, date, http_headers, payload, payload_digest.

    A page without html has no response; a page without url has an empty target. The table has neither headers nor
    dates, so the headers are those of a plain answer and the date is the caller's; ``parsed`` takes real responses.
    """
    html, uri = F.col("html").cast("string"), F.coalesce(F.col("url").cast("string"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"))
    return identified(pages.where(html.isNotNull()).select("page_id", uri.alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), html.alias("payload"), digest(html).alias("payload_digest")))


def derivatives(found: DataFrame) -> DataFrame:
    """Two records of each response: page_id, warc_type, record_id, refers_to, refers_to_date, target_uri, content_type,
    content_length (bytes), block_digest, payload_digest and http_headers (both the response's), block.

    Repeated responses give records of their own, an empty table none; extra columns are not read. Any text length.
    """
    html = F.col("payload")
    title = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " "))
    bare = lambda v: escaped(F.trim(F.regexp_replace(v, QUOTES, "")))
    links = F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), bare)
    lang = F.lower(bare(F.regexp_extract(html, LANG, 1)))
    charset = F.lower(F.regexp_extract(html, CHARSET, 1))
    fields = F.concat(
        F.lit("title: "), title, F.lit("\r\nlanguage: "), lang, F.lit("\r\ncharset: "), charset,
        F.lit("\r\nlinks: "), F.size(links).cast("string"), F.lit("\r\n"),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), ""),
    )
    each = F.explode(F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=UTF-8").alias("content_type"), text_of(html).alias("block")),
    ))
    rows = found.select("page_id", F.col("record_id").alias("refers_to"), F.col("date").alias("refers_to_date"), "target_uri", "payload_digest", "http_headers", each.alias("made"))
    rows = rows.select("page_id", "refers_to", "refers_to_date", "target_uri", "payload_digest", "http_headers", "made.*")
    return rows.select(
        "page_id", "warc_type", record_id(F.col("warc_type"), F.col("refers_to")).alias("record_id"), "refers_to", "refers_to_date", "target_uri", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), digest(F.col("block")).alias("block_digest"), "payload_digest", "http_headers", "block",
    )


def rendered(records: DataFrame) -> DataFrame:
    """page_id, warc_type, warc: each derivative as the text of a WARC 1.1 record, ready to be written."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    bracketed = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", bracketed("record_id")), line("WARC-Date", F.col("refers_to_date")),
        line("WARC-Target-URI", escaped(F.col("target_uri"))), line("WARC-Refers-To", bracketed("refers_to")), line("WARC-Refers-To-Target-URI", escaped(F.col("target_uri"))), line("WARC-Refers-To-Date", F.col("refers_to_date")),
        line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Source-Payload-Digest", F.col("payload_digest")), line("WARC-Source-HTTP-Headers", F.regexp_replace("http_headers", "\r\n", "; ")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"),
    )
    return records.select("page_id", "warc_type", F.concat(head, F.col("block"), F.lit("\r\n\r\n")).alias("warc"))


def oracle_sql(date: str = EPOCH) -> str:
    """The same records by DuckDB."""
    text = "payload"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    step = lambda x, p, to: f"regexp_replace({x}, {quote(p)}, {'chr(10)' if to == chr(10) else quote(to)}, 'g')"
    for pattern, to in MARKUP:
        text = step(text, pattern, to)
    names, codes = (str(list(v)) for v in (NAMES, NAMES.values()))
    number = f"TRY_CAST(CASE WHEN s.n LIKE '#x%' OR s.n LIKE '#X%' THEN '0x' || substr(s.n, 3) WHEN s.n LIKE '#%' THEN substr(s.n, 2) ELSE CAST({codes}[list_position({names}, s.n)] AS VARCHAR) END AS BIGINT)"
    named = f"list_transform(string_split({text}, '&')[2:], lambda p: {{'p': p, 'n': regexp_extract(p, {quote(REFERENCE)}, 1)}})"
    coded = f"list_transform({named}, lambda s: {{'p': s.p, 'n': s.n, 'c': {number}}})"
    sign = "CASE WHEN s.c = 160 THEN ' ' ELSE chr(CAST(s.c AS INTEGER)) END || substr(s.p, length(s.n) + 2)"
    one = f"CASE WHEN s.c BETWEEN 1 AND 1114111 AND s.c NOT BETWEEN 55296 AND 57343 THEN {sign} ELSE '&' || s.p END"
    text = f"array_to_string(list_prepend(string_split({text}, '&')[1], list_transform({coded}, lambda s: {one})), '')"
    for pattern, to in SPACES:
        text = step(text, pattern, to)
    uuid = lambda h: "'urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    crlf = "chr(13) || chr(10)"
    bare = lambda v: f"replace(replace(trim(regexp_replace({v}, {quote(QUOTES)}, '', 'g')), chr(13), '%0D'), chr(10), '%0A')"
    links = f"list_transform(regexp_extract_all(payload, {quote(HREF)}, 1), lambda x: {bare('x')})"
    return rf"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS target_uri, html AS payload, 'sha256:' || sha256(html) AS payload_digest,
    'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=UTF-8' || {crlf} || 'Content-Length: ' || octet_length(encode(html)) || {crlf} AS http_headers
  FROM pages WHERE html IS NOT NULL),
s AS (
  SELECT *, sha256('response' || chr(10) || coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || target_uri || chr(10) || payload_digest || CASE WHEN k > 1 THEN chr(10) || k ELSE '' END) AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target_uri, payload_digest) AS k FROM r)),
d AS (
  SELECT page_id, target_uri, payload_digest, http_headers, {uuid('h')} AS refers_to, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    'title: ' || trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g')) || {crlf}
    || 'language: ' || lower({bare(f"regexp_extract(payload, {quote(LANG)}, 1)")}) || {crlf}
    || 'charset: ' || lower(regexp_extract(payload, {quote(CHARSET)}, 1)) || {crlf}
    || 'links: ' || len({links}) || {crlf}
    || array_to_string(list_transform({links}, lambda x: 'outlink: ' || x || {crlf}), '') AS block
  FROM s
  UNION ALL
  SELECT page_id, target_uri, payload_digest, http_headers, {uuid('h')}, 'conversion', 'text/plain; charset=UTF-8', {text} FROM s),
i AS (SELECT *, sha256(warc_type || chr(10) || refers_to) AS h FROM d)
SELECT page_id, warc_type, {uuid('h')} AS record_id, refers_to, '{date}' AS refers_to_date, target_uri, content_type,
  CAST(octet_length(encode(block)) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest, http_headers, block
FROM i"""
