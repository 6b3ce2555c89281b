"""Predicates on links, anchors and profiles; queues, ledgers, reviews and identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States and kinds that predicates name.
STALE = ["stale", "mismatched", "invalid"]
LIMITED = ["partial_document_atomic_note", "abstract_only_atomic_note", "metadata_only_source_note", "fulltext_available", "limited", "limited_context_only"]
FULL_ENOUGH = ["full_text", "limited_text", "abstract"]
MATCHED = ["matched_identifier", "matched_title_author_year"]
CURRENT = ["current_declared_hashes", "current_profile_hashes"]
EXPLICIT_KINDS = ["cites", "citation", "references", "reference", "manual", "markdown"]
EXPLICIT_LAYERS = ["citation", "manual", "markdown", "reference"]
SOURCE_ROLES = [
    ("meta_analysis", ["meta-analysis", "meta analysis"]), ("literature_review", ["systematic review", "literature review"]), ("theoretical", ["conceptual", "theoretical", "theory-building"]),
    ("methodological", ["methodological", "measurement"]), ("empirical", ["experiment", "randomized", "regression", "survey", "interview", "case study"]),
]
EVIDENCE_ROLES = [
    ("causal", ["causal", "experiment", "quasi_experiment"]), ("mechanism_evidence", ["mechanism", "process_tracing"]), ("associational", ["association", "correlation", "regression", "statistical"]),
    ("descriptive", ["descriptive", "qualitative", "empirical"]),
]
ARGUMENT_ROLES = ["conceptual", "interpretive", "normative", "methodological", "practitioner_guidance"]
HEADING = r"(?i)^(?:references|bibliography|works cited)\s*:?$"
CHAPTER = r"(?i)^(?:#+\s*)?(?:chapter|part|appendix)\b"
DOI = r"(?i)10\.[0-9]{4,9}/[^\s\"<>]+"


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def accepted_link(active: Column, pending: Column, decision: Column, status: Column) -> Column:
    """A link that is active, has no review pending and was accepted; the decision outweighs the status."""
    return F.coalesce(active, F.lit(True)) & ~_true(pending) & _true(F.coalesce(decision, status) == "accepted")


def registry_link(active: Column, contract: Column, decision: Column, decision_status: Column, verification: Column, confidence: Column) -> Column:
    """The registry's own rule: final accepted decisions of the current contract, of others those with a confidence of 0.55 or more."""
    final = _true((decision == "relationship") & (decision_status == "accepted") & (verification == "final"))
    return F.coalesce(active, F.lit(True)) & F.when(contract.eqNullSafe(F.lit("relationship-decision-v11")), final).otherwise(F.coalesce(confidence, F.lit(1.0)) >= 0.55)


def fresh_edge(freshness: Column) -> Column:
    return ~_true(freshness.isin(STALE))


def analytical(eligibility: Column, excluded: Column, declared: Column, status: Column) -> Column:
    known = F.lower(F.coalesce(status, F.lit("analytical"))).isin(LIMITED)
    return F.when(eligibility.isNotNull(), eligibility == "substantive_bounded").when(_true(excluded), False).when(declared.isNotNull(), declared).otherwise(~known)


def substantive_anchor(locator: Column, support: Column) -> Column:
    return (F.trim(F.coalesce(locator, F.lit(""))) != "") & F.coalesce(support, F.lit("supported")).isin("supported", "limited")


def limited_anchor(support: Column, coverage: Column) -> Column:
    return _true(support.isin("supported", "limited")) & _true(coverage.isin(FULL_ENOUGH))


def verified_direct(signal: Column, match: Column, freshness: Column, both_identities: Column) -> Column:
    linked = _true(signal == "direct_reference") & _true(match.isin([*MATCHED, "mapped"]))
    return _true(signal == "related") | (linked & F.when(freshness.isNotNull(), freshness.isin(CURRENT)).otherwise(_true(both_identities)))


def inferred_edge(kind: Column, layer: Column, manual: Column, origin: Column, inferred: Column) -> Column:
    explicit = _true(kind.isin(EXPLICIT_KINDS)) | _true(layer.isin(EXPLICIT_LAYERS)) | _true(manual) | _true(origin.isin("manual", "personal", "user"))
    return ~explicit & (_true(inferred) | _true(kind == "semantic_similarity"))


def first_role(text: Column, roles: list[tuple[str, list[str]]], otherwise: Column) -> Column:
    """The first role any of whose words the text holds."""
    out = otherwise
    for role, words in reversed(roles):
        out = F.when(reduce(lambda a, b: a | b, (text.contains(w) for w in words)), role).otherwise(out)
    return out


def source_role(text: Column) -> Column:
    return first_role(F.lower(text), SOURCE_ROLES, F.lit("analytical_source"))


def evidence_role(kind: Column, statistical: Column) -> Column:
    low = F.replace(F.replace(F.lower(F.trim(kind)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    argument = first_role(low, [(r, [r]) for r in ARGUMENT_ROLES], F.lit("support_unknown"))
    after = F.when(_true(statistical), "associational").otherwise(first_role(low, EVIDENCE_ROLES[3:], argument))
    return first_role(low, EVIDENCE_ROLES[:3], after)


def status_counts(rows: DataFrame, key: str) -> DataFrame:
    """key, processed, context_only, partial, parked of rows (eligibility, coverage, scope, status); a row may count in several."""
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(key).agg(
        F.count("*").alias("processed"), count((F.col("eligibility") == "context_only") | F.col("coverage").isin("abstract", "metadata")).alias("context_only"),
        count(F.col("scope") == "partial_document").alias("partial"), count(F.col("status").isin("parked_for_review", "exhausted")).alias("parked"),
    )


def admitted(pairs: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """pairs (left_id, right_id) that a set of unordered pairs admits; None admits all, an empty set none."""
    if allowed is None:
        return pairs
    names = allowed.select(F.least("left_id", "right_id").alias("lo"), F.greatest("left_id", "right_id").alias("hi")).distinct()
    return pairs.join(names, (F.least("left_id", "right_id") == F.col("lo")) & (F.greatest("left_id", "right_id") == F.col("hi")), "left_semi")


def flipped(queue: DataFrame, resolved: DataFrame) -> DataFrame:
    """Eligible rows (left_id, right_id, eligible, status) become unexamined if they were resolved, and resolved if the pair now is."""
    now = resolved.select("left_id", "right_id").distinct().withColumn("done", F.lit(True))
    status = F.when(F.col("eligible") & F.col("done") & F.col("status").isin("resolved", "unexamined"), "resolved").when(F.col("eligible") & (F.col("status") == "resolved"), "unexamined").otherwise(F.col("status"))
    return queue.join(now, ["left_id", "right_id"], "left").withColumn("status", status).drop("done")


def next_pass(queue: DataFrame, most: int) -> DataFrame:
    """The next ``most`` eligible unexamined pairs, least often selected first, then by rank and ids, so retries rotate."""
    return queue.where(F.col("eligible") & (F.col("status") == "unexamined")).orderBy("selections", "rank", "left_id", "right_id").limit(most)


def point_select(rows: DataFrame, keys: DataFrame, on: list[str], blob: str, most: int) -> DataFrame:
    """Rows of given keys and fingerprints whose blob is at most ``most`` bytes."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi").where(F.octet_length(blob) <= most)


def reservations(ledger: DataFrame, scope: str, order: str, budget: int) -> DataFrame:
    """ledger (amount: settled actual or reserved) with ``granted``: whether the sum up to a request keeps to the scope's budget.

    Requests come in order and each counts, as one that was granted does; a scope's requests are one window.
    """
    running = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ledger.withColumn("spent", F.sum("amount").over(running)).withColumn("granted", F.col("spent") <= budget)


def stage_bounds(reservations_: DataFrame) -> DataFrame:
    """framework, total: the sum of each framework's distinct (stage, amount) reservations, in decimals."""
    return reservations_.select("framework", "stage", F.col("amount").cast("decimal(20,2)").alias("amount")).distinct().groupBy("framework").agg(F.sum("amount").cast("decimal(38,2)").alias("total"), F.count("*").alias("stages"))


def baseline_references(docs: DataFrame, most: int = 10_000) -> DataFrame:
    """doc_id, line, unparsed, doi, fingerprint: the lines under a bibliography heading, up to the next chapter.

    Lines are numbered from 1; blank ones and bare numbers do not count; a DOI is kept where a line has exactly one.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw")).select("doc_id", (F.col("at") + 1).alias("line"), F.trim("raw").alias("text"))
    head = F.regexp_replace("text", "^[# ]+", "").rlike(HEADING)
    state = F.last(F.when(head, True).when(F.col("text").rlike(CHAPTER), False), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line"))
    kept = lines.withColumn("head", head).withColumn("active", state).where(F.col("active") & ~F.col("head") & (F.col("text") != "") & ~F.col("text").rlike("^[0-9]+$"))
    dois = F.regexp_extract_all("text", F.lit(DOI), F.lit(0))
    first = kept.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))).where(F.col("n") <= most)
    return first.select("doc_id", "line", F.left("text", F.lit(512)).alias("unparsed"), F.when(F.size(dois) == 1, dois[0]).alias("doi"), F.sha2("text", 256).alias("fingerprint"))


def author_keys(first: Column, last: Column, name: Column) -> Column:
    """The ways in which a first author may be written: last name, whole name, first and last, last and first."""
    f, x = F.coalesce(first, F.lit("")), F.coalesce(last, F.lit(""))
    ways = F.array(x, F.coalesce(name, F.lit("")), F.concat(f, F.lit(" "), x), F.concat(x, F.lit(", "), f))
    plain = F.transform(F.filter(ways, lambda w: F.regexp_replace(w, "[, ]", "") != ""), lambda w: F.array_join(F.regexp_extract_all(F.lower(w), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "))
    return F.array_sort(F.array_distinct(plain))


def identities(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """instance, library, item, source_id of each identity, and those (with sources) that are bound to more than one source.

    rows: instance, library, keys (item keys, aliases included), source_id. Only what is bound once resolves.
    """
    bound = rows.select("instance", "library", F.explode(F.transform("keys", F.upper)).alias("item"), "source_id").distinct()
    counts = bound.groupBy("instance", "library", "item").agg(F.count("*").alias("sources"), F.min("source_id").alias("source_id"))
    return counts.where("sources = 1").drop("sources"), counts.where("sources > 1").drop("source_id")


def direct_references(refs: DataFrame, known: DataFrame) -> DataFrame:
    """source_id, target_id of references (source_id, instance, library, status, items) whose matched items are known sources."""
    asked = refs.where(F.col("status").isin(MATCHED)).select("source_id", "instance", "library", F.explode(F.transform("items", F.upper)).alias("item"))
    return asked.join(known.withColumnRenamed("source_id", "target_id"), ["instance", "library", "item"]).where("source_id <> target_id").select("source_id", "target_id").distinct()


def related_items(rows: DataFrame, known: DataFrame, host: str) -> DataFrame:
    """source_id, target_id of relations (source_id, instance, library, value): an item key, or an address on ``host``
    of the form /(users|groups)/library/items/key; other addresses name nothing."""
    part = lambda k: F.regexp_extract("value", rf"^[a-z]+://(?:www\.)?{host}/(users|groups)/([^/]+)/items/([^/]+)/?$", k)
    address = F.col("value").contains("://")
    named = rows.select("source_id", "instance", F.when(address, part(2)).otherwise(F.col("library")).alias("library"), F.upper(F.when(address, part(3)).otherwise(F.trim("value"))).alias("item"))
    return named.where("item <> ''").join(known.withColumnRenamed("source_id", "target_id"), ["instance", "library", "item"]).where("source_id <> target_id").select("source_id", "target_id").distinct()


def one_hop(seeds: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """seed, target, relation_id: of each seed the first ``most`` neighbours by accepted links (relation_id, source_id, target_id), either way."""
    both = links.select("relation_id", F.col("source_id").alias("seed"), F.col("target_id").alias("target")).unionByName(links.select("relation_id", F.col("target_id").alias("seed"), F.col("source_id").alias("target")))
    near = both.where("seed <> target").join(seeds.select(F.col("source_id").alias("seed")).distinct(), "seed", "left_semi").distinct()
    order = Window.partitionBy("seed").orderBy("target", "relation_id")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def proposals(tags: DataFrame, normal: Column) -> DataFrame:
    """note_id, original_tag, proposed_tag, proposal_id of tags (note_id, tag) whose normal form is not empty."""
    rows = tags.select("note_id", F.col("tag").alias("original_tag"), normal.alias("proposed_tag")).where("proposed_tag <> ''").distinct()
    key = F.concat_ws("|", F.col("note_id").cast("string"), "original_tag", "proposed_tag")
    return rows.withColumn("proposal_id", F.concat(F.lit("tag-proposal-"), F.substring(F.sha2(key, 256), 1, 12)))


def reviewed(known: DataFrame, decisions: DataFrame) -> DataFrame:
    """proposals with the last decision (proposal_id, decision, at) of each; decisions on unknown proposals are kept too."""
    last = decisions.groupBy("proposal_id").agg(F.max_by("decision", F.struct("at", "decision")).alias("decision"))
    return known.join(last, "proposal_id", "full")


def accepted_tags(rows: DataFrame) -> DataFrame:
    """note_id, tags: each note's accepted tags, sorted."""
    return rows.where("decision = 'accepted' and note_id is not null and proposed_tag <> ''").select("note_id", "proposed_tag").distinct().groupBy("note_id").agg(F.array_sort(F.collect_list("proposed_tag")).alias("tags"))


def relation_ids(links: DataFrame) -> DataFrame:
    """source_id, relations: how many distinct relations a source is an end of; the ids as rows by ``ends``."""
    return ends(links).groupBy("source_id").agg(F.count("*").alias("relations"))


def ends(links: DataFrame) -> DataFrame:
    return links.select("relation_id", F.explode(F.array("source_id", "target_id")).alias("source_id")).distinct()


def affected(changed: DataFrame, links: DataFrame) -> DataFrame:
    """relation_id of relations that a changed source (source_id) is an end of."""
    return ends(links).join(changed.select("source_id").distinct(), "source_id", "left_semi").select("relation_id").distinct()


def distinct_anchors(rows: DataFrame) -> DataFrame:
    """One anchor of each id, the least by (revision_hash, claim)."""
    return rows.groupBy("anchor_id").agg(F.min(F.struct("revision_hash", "claim")).alias("a")).select("anchor_id", "a.*")


def shard_pairs(pairs: DataFrame, shards: DataFrame) -> DataFrame:
    """row_index, reasons of proposed pairs (row_index, left_shard, right_shard, confidence, reason); none means accepted.

    shards: shard_id, literature. A pair is a duplicate if an earlier row names it, either way round.
    """
    side = lambda s: shards.select(F.col("shard_id").alias(f"{s}_shard"), F.col("literature").alias(f"{s}_lit"), F.lit(True).alias(f"{s}_known"))
    first = Window.partitionBy(F.least("left_shard", "right_shard"), F.greatest("left_shard", "right_shard")).orderBy("row_index")
    rows = pairs.withColumn("nth", F.row_number().over(first)).join(side("left"), "left_shard", "left").join(side("right"), "right_shard", "left")
    checks = [
        ("invalid_shard_pair", (F.coalesce("left_shard", F.lit("")) == "") | (F.coalesce("right_shard", F.lit("")) == "") | (F.col("left_shard") == F.col("right_shard"))),
        ("shard_not_in_context", F.col("left_known").isNull() | F.col("right_known").isNull()), ("same_literature_shard_pair", _true(F.col("left_lit") == F.col("right_lit"))),
        ("duplicate_shard_pair", F.col("nth") > 1), ("invalid_confidence", ~_true(F.col("confidence").between(0, 1))), ("bridge_reason_too_vague", F.size(F.filter(F.split(F.coalesce("reason", F.lit("")), r"\s+"), lambda w: w != "")) < 5),
    ]
    return rows.select("row_index", F.array_join(F.array_compact(F.array(*(F.when(c, name) for name, c in checks))), ",").alias("reasons"))


def bounded_values(*fields: Column, most: int, limit: int = 80) -> Column:
    """The first ``most`` values of some fields in order, each once whatever its case, one line of at most ``limit`` characters."""
    one = F.transform(F.filter(F.array(*fields), lambda v: v.isNotNull()), lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))
    cut = F.transform(one, lambda v: F.when(F.length(v) <= limit, v).otherwise(F.concat(F.rtrim(F.left(v, F.lit(limit - 1))), F.lit("…"))))
    kept = F.filter(cut, lambda v: v != "")
    own = F.filter(F.transform(kept, lambda v, i: F.struct(v.alias("v"), (F.array_position(F.transform(kept, F.lower), F.lower(v)) == i + 1).alias("first"))), lambda s: s["first"])
    return F.slice(F.transform(own, lambda s: s["v"]), 1, most)


def pool_order(pools: DataFrame) -> DataFrame:
    """left_id, right_id, place, pool of pairs (pool, left_id, right_id, rank): the first place of each pair by (rank, pool) counts."""
    own = pools.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), F.struct("rank", "pool").alias("at"))
    return own.groupBy("left_id", "right_id").agg(F.min("at").alias("at")).select("left_id", "right_id", "at.rank", "at.pool")


def evidence_union(*parts: DataFrame) -> DataFrame:
    """All rows of some tables of one schema, equal ones once, with the hash that tells them apart."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("evidence", F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)).dropDuplicates(["evidence"])


def corpus_fingerprint(docs: DataFrame, shards: int = 4096) -> DataFrame:
    """One row, fingerprint: a hash of all (id, content hash), by id; ids are cut into ranges of hashes first.

    Each range's hash is made by one task from its sorted rows; the last row hashes at most ``shards`` hashes.
    """
    each = docs.select(F.col("doc_id").cast("string").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).withColumn("shard", F.conv(F.substring(F.sha2("id", 256), 1, 3), 16, 10).cast("int") % shards)
    parts = each.groupBy("shard").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "id", "h"))), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("shard").cast("string"), 4, "0"), "h"))), "\n"), 256).alias("fingerprint"))


def bounded_bucket(pairs: DataFrame, fanout: int) -> DataFrame:
    """The best ``fanout`` pairs (source_id, target_id, score) of each source, by (-score, target)."""
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "target_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fanout)


def options(passages: DataFrame, other: DataFrame, key: str, directional: list[str], symmetric: list[str]) -> DataFrame:
    """key, left_passage, right_passage, relation, direction: what a decision on two sources' passages may be, null options included.

    Passages of a pair are few by contract (12 at most on each side).
    """
    kinds = [(r, d) for r in directional for d in ("forward", "backward")] + [(r, "both") for r in symmetric]
    kinds = F.explode(F.array(*(F.struct(F.lit(r).alias("relation"), F.lit(d).alias("direction")) for r, d in kinds)))
    both = passages.select(key, F.col("passage").alias("left_passage")).join(other.select(key, F.col("passage").alias("right_passage")), key)
    null = F.explode(F.array(*(F.struct(F.lit(r).alias("relation"), F.lit("none").alias("direction")) for r in ("no_relation", "insufficient"))))
    blank = F.lit(None).cast(both.schema["left_passage"].dataType)
    none = passages.select(key).distinct().select(key, blank.alias("left_passage"), blank.alias("right_passage"), null.alias("k")).select(key, "left_passage", "right_passage", "k.*")
    return both.select(key, "left_passage", "right_passage", kinds.alias("k")).select(key, "left_passage", "right_passage", "k.*").unionByName(none)
