"""Bibliographic identifiers and tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings and plurals that are made one, and slugs that say nothing.
SPELLING = {
    "behaviour": "behavior", "behaviours": "behaviors", "centre": "center", "centres": "centers", "labour": "labor", "modelling": "modeling",
    "organisational": "organizational", "organisation": "organization", "organisations": "organizations",
}
PLURAL = {
    "arrangements": "arrangement", "cases": "case", "countries": "country", "datasets": "dataset", "mechanisms": "mechanism", "measurements": "measurement", "measures": "measure",
    "methods": "method", "outcomes": "outcome", "participants": "participant", "periods": "period", "populations": "population", "studies": "study", "theories": "theory", "wars": "war",
}
GENERIC = [
    "analysis", "analytical", "article", "book", "case", "conflict", "data", "document", "full-text", "literature", "mechanism", "mediation", "method", "none", "outcome", "paper",
    "peace", "research", "source", "study", "theory", "unknown", "unspecified", "war",
]
BIBLIOGRAPHIC = ["bibliography", "electronic-book", "electronic-books", "journal-article", "journal-articles", "pdf", "peer-reviewed", "reference", "references"]
KEPT_PLURALS = ["geography", "period", "data"]


def doi(x: Column) -> Column:
    """A DOI without resolver, trailing punctuation or an unbalanced closing bracket, lower case; null if it is none."""
    bare = F.regexp_extract(F.lower(F.trim(F.try_url_decode(F.regexp_replace(x, r"\+", "%2B")))), r"(10\.[0-9]{4,9}/[^\s]+)", 1)
    bare = F.regexp_replace(bare, r"[.,;:]+$", "")
    count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
    balanced = F.when(bare.endswith(")") & (count(")") > count("(")), F.left(bare, F.length(bare) - 1)).otherwise(bare)
    return F.nullif(balanced, F.lit(""))


def _check_sum(digits: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        c = F.substring(digits, i, 1)
        total = total + w * F.when(c == "x", 10).otherwise(c.try_cast("int"))
    return total


def isbn(x: Column) -> Column:
    """ISBN-13 digits of a valid ISBN-10 or ISBN-13; null otherwise."""
    d = F.lower(F.regexp_replace(x, r"[^0-9Xx]", ""))
    ten = d.rlike("^[0-9]{9}[0-9x]$") & (_check_sum(d, list(range(10, 0, -1))) % 11 == 0)
    thirteen = d.rlike("^97[89][0-9]{10}$") & (_check_sum(d, [1, 3] * 6 + [1]) % 10 == 0)
    stem = F.concat(F.lit("978"), F.left(d, F.lit(9)))
    last = (10 - _check_sum(stem, [1, 3] * 6) % 10) % 10
    return F.when(thirteen, d).when(ten, F.concat(stem, last.cast("string")))


def year(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"([12][0-9]{3})", 1), F.lit(""))


def work_id(doi_: Column, isbn_: Column, item_type: Column, item: Column, title: Column) -> Column:
    """The first of: DOI, ISBN of a book, the item's hash, the title's hash of an article; else null."""
    return (
        F.when(doi_.isNotNull(), F.concat(F.lit("doi:"), doi_)).when(isbn_.isNotNull() & (item_type == "book"), F.concat(F.lit("isbn:"), isbn_))
        .when(item.isNotNull(), F.concat(F.lit("item:"), F.substring(F.sha2(item, 256), 1, 24))).when((item_type == "journalArticle") & title.isNotNull(), F.concat(F.lit("title:"), F.substring(F.sha2(title, 256), 1, 24)))
    )


def mapped(x: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), x), x)


def slug(x: Column, facet: Column) -> Column:
    """A tag's canonical form: folded, words joined by -, spellings and a last plural made one, at most 80 characters."""
    low = F.lower(x)
    low = F.when(low.contains("/") & (F.replace(F.split_part(low, F.lit("/"), F.lit(1)), F.lit("_"), F.lit("-")) == facet), F.regexp_replace(low, "^[^/]*/", "")).otherwise(low)
    low = F.regexp_replace(F.replace(F.replace(low, F.lit("&"), F.lit(" and ")), F.lit("’"), F.lit("'")), "['`]", "")
    low = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    words = F.transform(F.split(low, "-"), lambda w: mapped(w, SPELLING))
    last = F.element_at(words, -1)
    words = F.when(facet.isin(KEPT_PLURALS), words).otherwise(F.concat(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.array(mapped(last, PLURAL))))
    return F.substring(F.array_join(words, "-"), 1, 80)


def reject_reason(label: Column, slug_: Column) -> Column:
    """Why a tag is no subject: the first reason that holds, or the empty string."""
    words = F.size(F.regexp_extract_all(label, F.lit("[A-Za-z0-9]+"), F.lit(0)))
    return (
        F.when((F.coalesce(label, F.lit("")) == "") | (F.coalesce(slug_, F.lit("")) == ""), "empty").when((F.length(label) > 96) | (F.length(slug_) > 80), "too_long")
        .when(label.rlike("(?i)^(https?|file)://"), "url").when(label.rlike(r"(?i)^10\.[0-9]{4,9}/[^\s]+$"), "doi").when(label.rlike(r"^(?:(?i:isbn)(?:-1[03])?:?\s*)?[0-9Xx -]{10,20}$"), "bibliographic_identifier")
        .when(label.rlike(r"^[0-9]+(\.[0-9]+)?$"), "numeric_only").when((words > 8) | label.rlike("[?!;]"), "sentence_like").when(slug_.isin(BIBLIOGRAPHIC) | label.rlike(r"(?i)\.(pdf|epub|docx?)$"), "bibliographic_format").when(slug_.isin(GENERIC), "collection_generic").otherwise("")
    )


def tag_id(facet: Column, slug_: Column) -> Column:
    return F.concat(F.lit("subject-tag-"), F.substring(F.sha2(F.concat(F.lit('{"facet_type":"'), facet, F.lit('","slug":"'), slug_, F.lit('"}')), 256), 1, 16))
