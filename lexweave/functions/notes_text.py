"""Functions on notes, claims and labels as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, STOP_WORDS, fold, lower, upper

# Patterns and words of the note format.
PATTERNS = {
    "statistical": (
        r"(?i)(?:\b\d+(?:\.\d+)?\s*(?:%|percent(?:age)?\b)|\bp\s*[<=>]\s*0?\.\d+|\bn\s*=\s*\d+|\b(?:confidence|credible) intervals?\b|\b(?:odds|hazard) ratios?\b|"
        r"\b(?:coefficient|effect size|marginal effect|predicted probability|observed rate|correlation|standard error|standard deviation)s?\b)"
    ),
    "magnitude": (
        r"(?i)(?:-?\d+(?:\.\d+)?\s*(?:%|percent(?:age)?\b)|(?:odds ratio|hazard ratio|coefficient|effect size|marginal effect|predicted probability|observed rate|mean|median)"
        r"\s*(?:of|=|:)?\s*[+\-]?\d+(?:\.\d+)?)"
    ),
    "uncertainty": (
        r"(?i)(?:p\s*[<=>]\s*0?\.\d+|(?:95\s*%\s*)?(?:confidence|credible) interval[^.;]*|standard (?:error|deviation)[^.;]*|statistically (?:significant|insignificant)|uncertain(?:ty)?)"
    ),
    "comparison": (
        r"(?i)(?:compared (?:with|to)[^;(]*|relative to[^;(]*|versus[^;(]*|(?:higher|lower|greater|smaller|larger|fewer)\s+than\s+[^;(]*|"
        r"(?:control|reference|baseline) (?:group|category|period|value)?[^;(]*)"
    ),
    "condition": r"(?i)(?:\b(?:when|where|among|conditional on|only if|only when|for respondents|for cases)\b[^,.;]*)",
}
PAGES = r"(?i)\b(?:PDF\s+)?(?:p{1,2}\.|p{1,2}\s|pages?\s)\s*(\d+)(?:\s*[-–—]\s*(\d+))?\b"
DAMAGED = r"(?<![\w,])~?[0-9O]{1,3}(?:,[0-9O]{3})+(?!\w|,[0-9O])"
ALPHABETIC = r"[\p{L}]+(?:['’][\p{L}]+)*"
BOILERPLATE = ["downloaded from", "download this article", "article download", "access provided by", "access denied", "copyright", "all rights reserved", "watermark", "sage publications"]
CITES = ["cites", "citation", "citations", "references", "reference", "dc:references"]
CITED_BY = ["cited_by", "citedby", "is_cited_by", "isreferencedby", "dc:isreferencedby"]
#: What str.strip takes off; a space, line breaks and tabs are all that Java's \s has.
ENDS = r"^\s+|\s+$"


def compatible(x: Column) -> Column:
    """The text in normalization form KC, by whole Arrow columns: there is no built-in function."""

    @F.arrow_udf("string")
    def normal(values: pa.Array) -> pa.Array:
        if pc.all(pc.string_is_ascii(values)).as_py():
            return values
        return pa.array([v if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())

    return normal(x)


def norm(x: Column) -> Column:
    """Form KC, folded, tokens of letters and digits joined by a space."""
    return F.array_join(F.regexp_extract_all(fold(compatible(x)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def tag(x: Column) -> Column:
    """Form KC, folded; space, _ and / become one hyphen, other signs go."""
    low = F.regexp_replace(fold(compatible(x)), ENDS, "")
    low = F.regexp_replace(F.regexp_replace(low, r"[\s_/]+", "-"), r"[^\p{L}\p{N}_-]+", "")
    return F.regexp_replace(F.regexp_replace(low, "-+", "-"), "^-+|-+$", "")


def bounded_words(x: Column, chars: int, most: int) -> Column:
    """The set of words among the first ``most`` tokens of the first ``chars`` characters."""
    first = F.slice(F.regexp_extract_all(fold(F.substring(x, 1, chars)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, most)
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(first, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def stem(w: Column) -> Column:
    low = F.replace(fold(w), F.lit("’"), F.lit("'"))
    plural = (F.length(low) > 4) & low.endswith("s") & ~low.rlike("(ss|ics|us)$")
    return F.when((F.length(low) > 5) & low.endswith("ies"), F.concat(F.left(low, F.length(low) - 3), F.lit("y"))).when(plural, F.left(low, F.length(low) - 1)).otherwise(low)


def phrase_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two phrases' words without stop words; 1 where one has all of the other's, 0 where one has none."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    x, y = (F.array_except(F.filter(F.split(c, r"\s+"), lambda w: w != ""), stop) for c in (a, b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(both == F.least(F.size(x), F.size(y)), 1.0).otherwise(both / F.size(F.array_union(x, y)))


def display(x: Column) -> Column:
    """One line without signs around it; capitals only become lower case but for short words; the first letter is a capital."""
    one = F.regexp_replace(F.regexp_replace(x, SPACE + "+", " "), "^[ \\-*_`'’\"“”]+|[ \\-*_`'’\"“”]+$", "")
    calm = F.array_join(F.transform(F.split(one, " "), lambda w: F.when(F.length(w) <= 4, w).otherwise(lower(w))), " ")
    one = F.when((one == upper(one)) & (one != lower(one)), calm).otherwise(one)
    return F.concat(upper(F.substring(one, 1, 1)), one.substr(F.lit(2), F.length(one)))


def slugify(x: Column, fallback: str = "item") -> Column:
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, ENDS, ""), "[^A-Za-z0-9._-]+", "-"), "^[-._]+|[-._]+$", ""))
    return F.when(bare == "", fallback).otherwise(F.left(bare, F.lit(96)))


def safe_filename(x: Column, fallback: str = "Untitled") -> Column:
    bare = F.regexp_replace(F.regexp_replace(x, "[\\\\/:*?\"<>|\\x00-\\x1f]+", " "), r"\s+", " ")
    bare = F.left(F.regexp_replace(bare, "^[ .]+|[ .]+$", ""), F.lit(120))
    return F.trim(F.when(bare == "", fallback).otherwise(bare))


def fingerprint(x: Column) -> Column:
    """The hash of a text in which runs of blank lines count as one and space around it does not count."""
    calm = F.regexp_replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), r"\n(?:[ \t]*\n)+", "\n\n")
    return F.sha2(F.regexp_replace(calm, ENDS, ""), 256)


def first_sentence(x: Column, limit: int) -> Column:
    one = F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("\n-"), F.lit(" ")), r"\s+", " "), r"^[ \-*]+|[ \-*]+$", "")
    sentence = F.coalesce(F.nullif(F.regexp_extract(one, r"^(.*?[.!?])(?:\s|$)", 1), F.lit("")), one)
    return F.when(F.length(sentence) <= limit, sentence).otherwise(F.concat(F.rtrim(F.left(sentence, F.lit(limit - 1))), F.lit("…")))


def claim_units(x: Column) -> Column:
    """Sentences of each line, bullets taken off; a capital or a digit begins one, but not after p. or pp."""
    lines = F.transform(F.split(x, r"\r\n|\n|\r"), lambda line: F.regexp_replace(F.regexp_replace(line, r"^\s*(?:[-*+]|\d+[.)])\s*", ""), ENDS, ""))
    parts = F.flatten(F.transform(lines, lambda line: F.split(line, r"(?<=[.!?])(?<!\b[pP]\.)(?<!\b[pP][pP]\.)\s+(?=[A-Z0-9])")))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, ENDS, "")), lambda p: p != "")


def page_support(numbers: Column, words: Column, page_numbers: Column, page_words: Column) -> Column:
    """How far a page backs a claim: 0.7 of its numbers found, 0.3 of its words; of a claim without numbers the words alone."""
    part = lambda own, of: F.when(F.size(own) > 0, F.size(F.array_intersect(own, of)) / F.size(F.array_distinct(own))).otherwise(0.0)
    return F.when(F.size(numbers) > 0, 0.7 * part(numbers, page_numbers) + 0.3 * part(words, page_words)).otherwise(part(words, page_words))


def key_words(x: Column) -> Column:
    """The set of words of five letters or more."""
    return F.array_distinct(F.regexp_extract_all(fold(x), F.lit(r"\p{L}{5,}"), F.lit(0)))


def labelled_values(x: Column, labels: list[str]) -> Column:
    """What lines ``label: a; b`` name, each once: parted by ; or | or a last comma."""
    rows = F.regexp_extract_all(x, F.lit(rf"(?im)^(?:[-*]\s*)?(?:\*\*)?(?:{'|'.join(labels)})(?:\*\*)?\s*:\s*(.+)$"), F.lit(1))
    tidy = F.transform(rows, lambda v: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(v, r"\s+", " ")), r"\.+$", ""), r",(\s*(?:and\s+)?[^,]{1,80})$", ";$1"))
    pieces = F.flatten(F.transform(tidy, lambda v: F.transform(F.split(v, "[;|]"), lambda p: F.regexp_replace(p, r"^[ \-]+|[ \-]+$", ""))))
    return F.array_distinct(F.filter(pieces, lambda p: p != ""))


def reported(x: Column, kind: str) -> Column:
    """The first passage of a kind (see PATTERNS), or not_reported."""
    hit = F.regexp_extract(x, PATTERNS[kind], 0)
    return F.when(hit == "", "not_reported").otherwise(F.regexp_replace(hit, ENDS, ""))


def page_range(x: Column) -> Column:
    """From the least to the greatest page that is named; empty if none is."""
    starts = F.transform(F.regexp_extract_all(x, F.lit(PAGES), F.lit(1)), lambda n: n.cast("long"))
    ends = F.transform(F.regexp_extract_all(x, F.lit(PAGES), F.lit(2)), lambda n: n.try_cast("long"))
    low, high = F.array_min(starts), F.array_max(F.zip_with(starts, ends, lambda a, b: F.coalesce(b, a)))
    return F.when(F.size(starts) == 0, "").when(low == high, F.concat(F.lit("p. "), low.cast("string"))).otherwise(F.concat(F.lit("pages "), low.cast("string"), F.lit("-"), high.cast("string")))


def content_items(x: Column) -> Column:
    """The bullets of a section, or its paragraphs if it has none; each once."""
    once = lambda rows: F.array_distinct(F.filter(rows, lambda v: v != ""))
    bullets = F.transform(F.filter(F.split(x, "\n"), lambda v: v.rlike(r"^\s*[-*]\s+\S")), lambda v: F.regexp_replace(F.regexp_replace(v, r"^[-*]\s+", ""), ENDS, ""))
    paragraphs = F.transform(F.split(x, r"\n\s*\n"), lambda v: F.regexp_replace(F.regexp_replace(v, r"\s+", " "), ENDS, ""))
    return F.when(F.size(bullets) > 0, once(bullets)).otherwise(once(paragraphs))


def damaged_numeral(x: Column) -> Column:
    """Whether a grouped number has a letter O for a digit."""
    return F.exists(F.regexp_extract_all(x, F.lit(DAMAGED), F.lit(0)), lambda v: v.contains("O") & v.rlike("^~|[0-9]"))


def _counts(x: Column) -> tuple[Column, Column]:
    return F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")), F.size(F.regexp_extract_all(x, F.lit(ALPHABETIC), F.lit(0)))


def suspicious_page(x: Column) -> Column:
    signs, words = _counts(x)
    return damaged_numeral(x) | (signs < 40) | (words < 6)


def readable_short_text(x: Column) -> Column:
    one = F.trim(F.regexp_replace(x, r"\s+", " "))
    signs, words = _counts(one)
    boiler = F.lower(one).rlike("|".join(BOILERPLATE))
    return (one != "") & ~damaged_numeral(one) & ~boiler & (words > 0) & ((words >= 2) | (signs >= 8))


def relation_class(x: Column) -> Column:
    low = F.regexp_replace(F.lower(F.trim(x)), r"[\s-]+", "_")
    bare = F.replace(low, F.lit("_"), F.lit(""))
    return F.when(low.isin(CITES) | bare.isin("cites", "references"), "cites").when(low.isin(CITED_BY) | bare.isin("citedby", "isreferencedby"), "cited_by").otherwise("related")
