"""Queries of predicates, queues, reviews and identities. Orders' lines stand for links, their columns for states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as op
from . import sql
from .registry import register, table

#: Columns of a link, in words that both engines read alike.
LINK = [
    "l_orderkey * 10 + l_linenumber AS relation_id", "l_orderkey AS source_id", "l_partkey AS target_id",
    "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity / 50 END AS confidence",
    "CASE l_suppkey % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN NULL ELSE 'accepted' END AS decision_status", "CASE WHEN l_suppkey % 3 = 0 THEN 'accepted' ELSE 'parked' END AS status",
    "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag <> 'R' END AS active", "l_linenumber = 7 AS pending", "CASE l_partkey % 4 WHEN 0 THEN 'stale' WHEN 1 THEN 'current_profile_hashes' WHEN 2 THEN 'mismatched' END AS freshness",
    "CASE WHEN l_suppkey % 7 = 0 THEN 'relationship-decision-v11' END AS contract", "CASE WHEN l_partkey % 3 = 0 THEN 'relationship' ELSE 'none' END AS decision", "CASE WHEN l_orderkey % 2 = 0 THEN 'final' ELSE 'draft' END AS verification",
    "CASE l_linenumber % 3 WHEN 0 THEN 'related' WHEN 1 THEN 'direct_reference' ELSE 'other' END AS signal", "CASE l_orderkey % 4 WHEN 0 THEN 'matched_identifier' WHEN 1 THEN 'mapped' WHEN 2 THEN 'ambiguous' END AS match",
    "l_suppkey % 2 = 0 AS identified", "CASE l_partkey % 5 WHEN 0 THEN 'cites' WHEN 1 THEN 'semantic_similarity' WHEN 2 THEN 'manual' ELSE 'supports' END AS kind", "CASE l_orderkey % 6 WHEN 0 THEN 'markdown' WHEN 1 THEN 'semantic' END AS layer",
    "l_linenumber = 5 AS manual", "CASE WHEN l_suppkey % 11 = 0 THEN 'user' END AS origin", "l_linestatus = 'O' AS inferred",
]
LINKS = f"links AS (SELECT {', '.join(LINK)} FROM lineitem)"


def _links(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*LINK)


@register(f"""WITH {LINKS} SELECT relation_id, coalesce(active, true) AND NOT pending AND coalesce(coalesce(decision_status, status) = 'accepted', false) AS accepted,
coalesce(active, true) AND CASE WHEN contract IS NOT DISTINCT FROM 'relationship-decision-v11' THEN coalesce(decision = 'relationship' AND decision_status = 'accepted' AND verification = 'final', false) ELSE coalesce(confidence, 1) >= 0.55 END AS registered,
NOT coalesce(freshness IN ('stale', 'mismatched', 'invalid'), false) AS fresh,
signal = 'related' OR (signal = 'direct_reference' AND coalesce(match IN ('matched_identifier', 'matched_title_author_year', 'mapped'), false) AND CASE WHEN freshness IS NOT NULL THEN freshness IN ('current_declared_hashes', 'current_profile_hashes') ELSE identified END) AS verified,
NOT (kind IN ('cites', 'citation', 'references', 'reference', 'manual', 'markdown') OR coalesce(layer IN ('citation', 'manual', 'markdown', 'reference'), false) OR manual OR coalesce(origin IN ('manual', 'personal', 'user'), false)) AND (inferred OR kind = 'semantic_similarity') AS inferred FROM links""")
def link_predicates(spark, sf_dir):
    c = F.col
    return _links(spark, sf_dir).select(
        "relation_id", op.accepted_link(c("active"), c("pending"), c("decision_status"), c("status")).alias("accepted"),
        op.registry_link(c("active"), c("contract"), c("decision"), c("decision_status"), c("verification"), c("confidence")).alias("registered"), op.fresh_edge(c("freshness")).alias("fresh"),
        op.verified_direct(c("signal"), c("match"), c("freshness"), c("identified")).alias("verified"), op.inferred_edge(c("kind"), c("layer"), c("manual"), c("origin"), c("inferred")).alias("inferred"),
    )


PROFILE = [
    "o_orderkey AS profile", "CASE o_orderkey % 4 WHEN 0 THEN 'substantive_bounded' WHEN 1 THEN 'context_only' END AS eligibility", "CASE WHEN o_custkey % 3 = 0 THEN true END AS excluded", "CASE o_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS declared",
    "CASE o_orderstatus WHEN 'F' THEN 'Limited' WHEN 'O' THEN 'analytical' END AS status", "CASE o_orderkey % 3 WHEN 0 THEN 'p. 3' WHEN 1 THEN ' ' END AS locator", "CASE o_custkey % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'limited' WHEN 2 THEN 'contested' END AS support",
    "CASE o_orderkey % 5 WHEN 0 THEN 'abstract' WHEN 1 THEN 'metadata' ELSE 'full_text' END AS coverage", "CASE WHEN o_custkey % 7 = 0 THEN 'partial_document' ELSE 'full_document' END AS scope",
    "CASE o_custkey % 6 WHEN 0 THEN 'parked_for_review' WHEN 1 THEN 'exhausted' ELSE 'done' END AS state", "o_orderpriority AS collection",
]
PROFILES = f"profiles AS (SELECT {', '.join(PROFILE)} FROM orders)"


@register(f"""WITH {PROFILES} SELECT profile, CASE WHEN eligibility IS NOT NULL THEN eligibility = 'substantive_bounded' WHEN excluded THEN false WHEN declared IS NOT NULL THEN declared
  ELSE lower(coalesce(status, 'analytical')) NOT IN ({', '.join(f"'{s}'" for s in op.LIMITED)}) END AS analytical,
trim(coalesce(locator, '')) <> '' AND coalesce(support, 'supported') IN ('supported', 'limited') AS substantive, coalesce(support IN ('supported', 'limited'), false) AND coverage IN ('full_text', 'limited_text', 'abstract') AS supports FROM profiles""")
def profile_predicates(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "orders").selectExpr(*PROFILE)
    return rows.select("profile", op.analytical(c("eligibility"), c("excluded"), c("declared"), c("status")).alias("analytical"), op.substantive_anchor(c("locator"), c("support")).alias("substantive"), op.limited_anchor(c("support"), c("coverage")).alias("supports"))


@register(f"""WITH {PROFILES} SELECT collection, count(*) AS processed, count(*) FILTER (coalesce(eligibility = 'context_only', false) OR coverage IN ('abstract', 'metadata')) AS context_only,
count(*) FILTER (scope = 'partial_document') AS partial, count(*) FILTER (state IN ('parked_for_review', 'exhausted')) AS parked FROM profiles GROUP BY collection""")
def status_routing_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(*PROFILE)
    return op.status_counts(rows.select("collection", "eligibility", "coverage", "scope", F.col("state").alias("status")), "collection")


@register("""WITH p AS (SELECT l_orderkey AS left_id, l_partkey AS right_id FROM lineitem), a AS (SELECT DISTINCT least(l_partkey, l_orderkey) AS lo, greatest(l_partkey, l_orderkey) AS hi FROM lineitem WHERE l_returnflag = 'R')
SELECT left_id, right_id, count(*) AS n FROM p WHERE (least(left_id, right_id), greatest(left_id, right_id)) IN (SELECT (lo, hi) FROM a) GROUP BY ALL""")
def pair_admission(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    allowed = line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("left_id"), F.col("l_orderkey").alias("right_id"))
    return op.admitted(line.select(F.col("l_orderkey").alias("left_id"), F.col("l_partkey").alias("right_id")), allowed).groupBy("left_id", "right_id").agg(F.count("*").alias("n"))


QUEUE = ["l_orderkey AS left_id", "l_linenumber AS right_id", "l_suppkey % 4 <> 0 AS eligible", "CASE l_partkey % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'unexamined' ELSE 'parked' END AS status", "l_partkey % 5 AS selections", "l_suppkey AS rank"]
DONE = "l_orderkey % 6 = 0 AND l_linenumber < 3"


@register(f"""WITH q AS (SELECT {', '.join(QUEUE)} FROM lineitem), d AS (SELECT DISTINCT l_orderkey AS left_id, l_linenumber AS right_id, true AS done FROM lineitem WHERE {DONE})
SELECT left_id, right_id, eligible, CASE WHEN eligible AND done AND status IN ('resolved', 'unexamined') THEN 'resolved' WHEN eligible AND status = 'resolved' THEN 'unexamined' ELSE status END AS status FROM q LEFT JOIN d USING (left_id, right_id)""")
def status_flips(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    resolved = line.where(DONE).select(F.col("l_orderkey").alias("left_id"), F.col("l_linenumber").alias("right_id"))
    return op.flipped(line.selectExpr(*QUEUE), resolved).select("left_id", "right_id", "eligible", "status")


@register(f"""WITH q AS (SELECT {', '.join(QUEUE)} FROM lineitem) SELECT left_id, right_id, selections, rank FROM q WHERE eligible AND status = 'unexamined' ORDER BY selections, rank, left_id, right_id LIMIT 500""")
def pass_rotation(spark, sf_dir):
    """The next 500 pairs: the limit is the feature."""
    return op.next_pass(table(spark, sf_dir, "lineitem").selectExpr(*QUEUE), 500).select("left_id", "right_id", "selections", "rank")


@register(f"WITH q AS (SELECT {', '.join(QUEUE)} FROM lineitem) SELECT status, count(*) FILTER (NOT eligible) AS ineligible FROM q GROUP BY status")
def ineligible_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*QUEUE).groupBy("status").agg(F.count(F.when(~F.col("eligible"), 1)).alias("ineligible"))


@register("""SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND octet_length(encode(text)) <= 1500""")
def point_select(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.point_select(docs, table(spark, sf_dir, "labels"), ["doc_id"], "text", 1500).select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


@register("""WITH r AS (SELECT o_custkey, o_orderkey, CAST(round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice * 1.5 END) AS BIGINT) AS amount FROM orders)
SELECT o_custkey, o_orderkey, CAST(sum(amount) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent, sum(amount) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) <= 900000 AS granted FROM r""")
def spend_reservations(spark, sf_dir):
    amount = F.round(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(F.col("o_totalprice") * 1.5)).cast("long")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", amount.alias("amount"))
    return op.reservations(rows, "o_custkey", "o_orderkey", 900_000).select("o_custkey", "o_orderkey", "spent", "granted")


@register("""SELECT l_returnflag AS framework, CAST(sum(amount) AS DECIMAL(38, 2)) AS total, count(*) AS stages FROM (SELECT DISTINCT l_returnflag, l_linenumber, CAST(l_quantity AS DECIMAL(20, 2)) AS amount FROM lineitem) GROUP BY 1""")
def stage_bounds(spark, sf_dir):
    return op.stage_bounds(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("framework"), F.col("l_linenumber").alias("stage"), F.col("l_quantity").alias("amount")))


_PAPER = "concat(text, '\n# References\n 12 \n', 'Smith, J. doi:10.1000/', doc_id, '\nNo identifier ', source, '\n\nTwo 10.1000/a and 10.1000/b\nChapter 2\nNot a reference ', doc_id, '\nBibliography:\nLast ', lang)"


@register(rf"""WITH t AS (SELECT doc_id, string_split({_PAPER}, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS line, trim(unnest(l)) AS x FROM t),
h AS (SELECT *, regexp_matches(regexp_replace(x, '^[# ]+', ''), '{op.HEADING}') AS head, regexp_matches(x, '{op.CHAPTER}') AS chapter FROM l),
s AS (SELECT *, last_value(CASE WHEN head THEN true WHEN chapter THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS active FROM h),
d AS (SELECT *, regexp_extract_all(x, '(?i)10\.[0-9]{{4,9}}/[^\s"<>]+') AS d FROM s WHERE active AND NOT head AND x <> '' AND NOT regexp_matches(x, '^[0-9]+$'))
SELECT doc_id, line, left(x, 512) AS unparsed, CASE WHEN len(d) = 1 THEN d[1] END AS doi, sha256(x) AS fingerprint FROM d""")
def baseline_references(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.expr(_PAPER.replace("\n", "\\n")).alias("text"))
    return op.baseline_references(docs)


@register(rf"""WITH n AS (SELECT c_custkey, c_mktsegment AS f, c_name AS l FROM customer), w AS (SELECT c_custkey, unnest([l, f || ' ' || l, l || ', ' || f]) AS w FROM n),
k AS (SELECT DISTINCT c_custkey, array_to_string(regexp_extract_all(lower(w), '[\p{{L}}\p{{N}}]+'), ' ') AS k FROM w) SELECT c_custkey, string_agg(k, '|' ORDER BY k) AS keys FROM k GROUP BY 1""")
def first_author_keys(spark, sf_dir):
    keys = op.author_keys(F.col("c_mktsegment"), F.col("c_name"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(keys, "|").alias("keys"))


IDENT = "ids AS (SELECT 'here' AS instance, p_brand AS library, 'k' || p_partkey AS item, p_partkey AS source_id FROM part UNION SELECT 'here', p_brand, 'alias' || (p_partkey // 2), p_partkey FROM part WHERE p_size > 25)"
KNOWN = "known AS (SELECT instance, library, upper(item) AS item, min(source_id) AS source_id FROM ids GROUP BY ALL HAVING count(DISTINCT source_id) = 1)"


def _identities(spark, sf_dir):
    alias = F.when(F.col("p_size") > 25, F.array(F.concat(F.lit("k"), "p_partkey"), F.concat(F.lit("alias"), F.floor(F.col("p_partkey") / 2).cast("long"))))
    keys = F.coalesce(alias, F.array(F.concat(F.lit("k"), "p_partkey")))
    return op.identities(table(spark, sf_dir, "part").select(F.lit("here").alias("instance"), F.col("p_brand").alias("library"), keys.alias("keys"), F.col("p_partkey").alias("source_id")))


@register(f"WITH {IDENT}, {KNOWN} SELECT * FROM known")
def identity_join(spark, sf_dir):
    return _identities(spark, sf_dir)[0].select("instance", "library", "item", "source_id")


@register(f"WITH {IDENT} SELECT instance, library, upper(item) AS item, count(DISTINCT source_id) AS sources FROM ids GROUP BY ALL HAVING count(DISTINCT source_id) > 1")
def identity_conflicts(spark, sf_dir):
    return _identities(spark, sf_dir)[1].select("instance", "library", "item", "sources")


@register(f"""WITH {IDENT}, {KNOWN}, r AS (SELECT l_partkey AS source_id, p_brand AS library, upper('K' || l_suppkey) AS item FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber % 3 <> 0)
SELECT DISTINCT r.source_id, k.source_id AS target_id FROM r JOIN known k USING (library, item) WHERE r.source_id <> k.source_id""")
def direct_reference_join(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    status = F.when(F.col("l_linenumber") % 3 == 0, "ambiguous").otherwise("matched_identifier")
    refs = line.select(F.col("l_partkey").alias("source_id"), F.lit("here").alias("instance"), F.col("p_brand").alias("library"), status.alias("status"), F.array(F.concat(F.lit("k"), "l_suppkey")).alias("items"))
    return op.direct_references(refs, _identities(spark, sf_dir)[0])


_VALUE = "CASE l_linenumber % 4 WHEN 0 THEN 'k' || l_suppkey WHEN 1 THEN 'https://library.example/groups/' || p_brand || '/items/k' || l_suppkey WHEN 2 THEN 'https://other.example/groups/' || p_brand || '/items/k' || l_suppkey ELSE 'https://library.example/users/1/k' || l_suppkey END"


@register(f"""WITH {IDENT}, {KNOWN}, r AS (SELECT l_partkey AS source_id, p_brand AS library, upper('k' || l_suppkey) AS item FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber % 4 < 2)
SELECT DISTINCT r.source_id, k.source_id AS target_id FROM r JOIN known k USING (library, item) WHERE r.source_id <> k.source_id""")
def related_item_join(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = line.select(F.col("l_partkey").alias("source_id"), F.lit("here").alias("instance"), F.col("p_brand").alias("library"), F.expr(_VALUE).alias("value"))
    return op.related_items(rows, _identities(spark, sf_dir)[0], "library.example")


@register(f"""WITH {LINKS}, ok AS (SELECT * FROM links WHERE decision_status = 'accepted'), b AS (SELECT relation_id, source_id AS seed, target_id AS target FROM ok UNION SELECT relation_id, target_id, source_id FROM ok)
SELECT seed, target, relation_id FROM b WHERE seed <> target AND seed IN (SELECT doc_id FROM documents) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY target, relation_id) <= 4""")
def one_hop_expansion(spark, sf_dir):
    seeds = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"))
    return op.one_hop(seeds, _links(spark, sf_dir).where("decision_status = 'accepted'"), 4).select("seed", "target", "relation_id")


_TAGS = "t AS (SELECT doc_id AS note_id, unnest([source, upper(lang), source || ' / ' || lang, '--']) AS tag FROM documents)"
_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(tag)), '[\s_/]+', '-', 'g'), '[^\p{L}\p{N}_-]+', '', 'g'), '-+', '-', 'g'), '-')"
PROPOSED = f"{_TAGS}, p AS (SELECT DISTINCT note_id, tag AS original_tag, {_NORMAL} AS proposed_tag FROM t WHERE {_NORMAL} <> ''), q AS (SELECT *, 'tag-proposal-' || left(sha256(note_id || '|' || original_tag || '|' || proposed_tag), 12) AS proposal_id FROM p)"
DECIDED = f"{PROPOSED}, d AS (SELECT q.*, CASE note_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'parked' END AS decision FROM q)"


def _proposals(spark, sf_dir):
    tags = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.explode(F.array("source", F.upper("lang"), F.concat("source", F.lit(" / "), "lang"), F.lit("--"))).alias("tag"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim("tag")), r"[\s_/]+", "-"), r"[^\p{L}\p{N}_-]+", ""), "-+", "-")
    return op.proposals(tags, F.regexp_replace(plain, "^-+|-+$", ""))


def _decided(spark, sf_dir):
    known = _proposals(spark, sf_dir)
    # each proposal has an older decision too, which the later one replaces
    last = known.where("note_id % 3 < 2").select("proposal_id", F.when(F.col("note_id") % 3 == 0, "accepted").otherwise("parked").alias("decision"), F.lit(2).alias("at"))
    return op.reviewed(known, last.unionByName(last.select("proposal_id", F.lit("rejected").alias("decision"), F.lit(1).alias("at"))))


@register(f"WITH {PROPOSED} SELECT note_id, original_tag, proposed_tag, proposal_id FROM q")
def tag_proposals(spark, sf_dir):
    return _proposals(spark, sf_dir).select("note_id", "original_tag", "proposed_tag", "proposal_id")


@register(f"WITH {DECIDED} SELECT proposed_tag, coalesce(decision, 'open') AS decision, count(*) AS n, count(DISTINCT note_id) AS notes FROM d GROUP BY ALL")
def tag_review_merge(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("proposed_tag", F.coalesce("decision", F.lit("open")).alias("decision")).agg(F.count("*").alias("n"), F.countDistinct("note_id").alias("notes"))


@register(f"WITH {DECIDED} SELECT note_id, string_agg(DISTINCT proposed_tag, '|' ORDER BY proposed_tag) AS tags FROM d WHERE decision = 'accepted' GROUP BY note_id")
def accepted_tags_by_note(spark, sf_dir):
    return op.accepted_tags(_decided(spark, sf_dir)).select("note_id", F.array_join("tags", "|").alias("tags"))


@register(f"WITH {LINKS}, e AS (SELECT DISTINCT relation_id, unnest([source_id, target_id]) AS source_id FROM links) SELECT source_id, count(*) AS relations FROM e GROUP BY 1")
def relationship_ids_per_source(spark, sf_dir):
    return op.relation_ids(_links(spark, sf_dir))


@register(f"WITH {LINKS} SELECT DISTINCT relation_id FROM links WHERE source_id IN (SELECT doc_id FROM labels WHERE quality = 1) OR target_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def affected_graph_ids(spark, sf_dir):
    changed = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("source_id"))
    return op.affected(changed, _links(spark, sf_dir))


_ROLE = "concat(coalesce(text, ''), CASE doc_id % 7 WHEN 0 THEN ' A Meta-Analysis' WHEN 1 THEN ' systematic review of measurement' WHEN 2 THEN ' theory-building' WHEN 3 THEN ' Methodological note' WHEN 4 THEN ' survey data' ELSE '' END)"
_KIND = "CASE doc_id % 8 WHEN 0 THEN 'Quasi-Experiment' WHEN 1 THEN 'process tracing' WHEN 2 THEN 'correlation' WHEN 3 THEN 'qualitative' WHEN 4 THEN 'normative claim' WHEN 5 THEN 'mechanism' ELSE 'other' END"


def _roles(text: str, roles, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains({text}, '{w}')''' for w in words)} THEN '{r}'" for r, words in roles) + f" ELSE {otherwise} END"


_LOW = f"replace(replace(lower(trim({_KIND})), '-', '_'), ' ', '_')"
_ARGUMENT = _roles(_LOW, [(r, [r]) for r in op.ARGUMENT_ROLES], "'support_unknown'")


@register(f"""SELECT doc_id, {_roles(f'lower({_ROLE})', op.SOURCE_ROLES, "'analytical_source'")} AS source_role,
{_roles(_LOW, op.EVIDENCE_ROLES[:3], f"CASE WHEN doc_id % 5 = 0 THEN 'associational' ELSE {_roles(_LOW, op.EVIDENCE_ROLES[3:], _ARGUMENT)} END")} AS evidence_role FROM documents""")
def roles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", op.source_role(F.expr(_ROLE)).alias("source_role"), op.evidence_role(F.expr(_KIND), F.col("doc_id") % 5 == 0).alias("evidence_role"))


@register("SELECT l_orderkey AS anchor_id, arg_min(l_returnflag, (l_returnflag, l_partkey)) AS revision_hash, arg_min(l_partkey, (l_returnflag, l_partkey)) AS claim FROM lineitem GROUP BY 1")
def anchor_dedupe(spark, sf_dir):
    return op.distinct_anchors(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("anchor_id"), F.col("l_returnflag").alias("revision_hash"), F.col("l_partkey").alias("claim")))


_PAIR = ["l_orderkey * 10 + l_linenumber AS row_index", "CASE WHEN l_linenumber = 6 THEN '' ELSE 's' || (l_partkey % 300) END AS left_shard", "'s' || (l_suppkey % 300) AS right_shard", "CASE WHEN l_linenumber = 5 THEN 1.5 WHEN l_linenumber <> 4 THEN l_discount END AS confidence",
         "CASE WHEN l_returnflag = 'R' THEN 'too vague' ELSE 'both study how states end wars' END AS reason"]


@register(f"""WITH p AS (SELECT {', '.join(_PAIR)} FROM lineitem), s AS (SELECT 's' || (p_partkey % 290) AS shard_id, min('l' || (p_partkey % 10)) AS literature FROM part GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY least(left_shard, right_shard), greatest(left_shard, right_shard) ORDER BY row_index) AS nth FROM p)
SELECT row_index, array_to_string(list_filter([CASE WHEN left_shard = '' OR right_shard = '' OR left_shard = right_shard THEN 'invalid_shard_pair' END, CASE WHEN a.shard_id IS NULL OR b.shard_id IS NULL THEN 'shard_not_in_context' END,
CASE WHEN a.literature = b.literature THEN 'same_literature_shard_pair' END, CASE WHEN nth > 1 THEN 'duplicate_shard_pair' END, CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'invalid_confidence' END,
CASE WHEN reason = 'too vague' THEN 'bridge_reason_too_vague' END], lambda x: x IS NOT NULL), ',') AS reasons FROM n LEFT JOIN s a ON a.shard_id = left_shard LEFT JOIN s b ON b.shard_id = right_shard""")
def shard_pair_validation(spark, sf_dir):
    shards = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("s"), F.col("p_partkey") % 290).alias("shard_id")).agg(F.min(F.concat(F.lit("l"), F.col("p_partkey") % 10)).alias("literature"))
    return op.shard_pairs(table(spark, sf_dir, "lineitem").selectExpr(*_PAIR), shards)


@register(r"""WITH v AS (SELECT p_partkey, [p_name, upper(p_name), NULL, p_brand, '  ' || p_type || ' ', p_brand] AS v FROM part),
u AS (SELECT p_partkey, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM v), c AS (SELECT p_partkey, trim(regexp_replace(v, '\s+', ' ', 'g')) AS v, i FROM u WHERE v IS NOT NULL),
f AS (SELECT p_partkey, arg_min(v, i) AS v, min(i) AS i FROM c WHERE v <> '' GROUP BY p_partkey, lower(v)) SELECT p_partkey, array_to_string(list_slice(list(v ORDER BY i), 1, 2), '|') AS values FROM f GROUP BY 1""")
def bounded_profile_values(spark, sf_dir):
    fields = [F.col("p_name"), F.upper("p_name"), F.lit(None).cast("string"), F.col("p_brand"), F.concat(F.lit("  "), "p_type", F.lit(" ")), F.col("p_brand")]
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(op.bounded_values(*fields, most=2), "|").alias("values"))


POOL = ["CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS pool", "l_orderkey AS left_id", "l_partkey AS right_id", "l_suppkey AS rank"]


@register(f"""WITH p AS (SELECT {', '.join(POOL)} FROM lineitem) SELECT least(left_id, right_id) AS left_id, greatest(left_id, right_id) AS right_id, arg_min(rank, (rank, pool)) AS rank, arg_min(pool, (rank, pool)) AS pool FROM p GROUP BY 1, 2""")
def pool_order(spark, sf_dir):
    """The order of the merged pool, which is also how the first of several pools wins a pair."""
    return op.pool_order(table(spark, sf_dir, "lineitem").selectExpr(*POOL))


@register(f"""WITH {sql.POSTS} SELECT count(*) AS n FROM (SELECT doc_id, lang FROM documents UNION SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id, upper(lang) FROM documents)""")
def evidence_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return op.evidence_union(d, d.where("doc_id % 2 = 0"), d.withColumn("lang", F.upper("lang"))).agg(F.count("*").alias("n"))


@register("""WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS id, sha256(coalesce(text, '')) AS h, CAST('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 3) AS INTEGER) AS s FROM documents),
p AS (SELECT s, sha256(string_agg(id || ':' || h, chr(10) ORDER BY id || ':' || h)) AS h FROM e GROUP BY s) SELECT sha256(string_agg(lpad(CAST(s AS VARCHAR), 4, '0') || ':' || h, chr(10) ORDER BY s)) AS fingerprint FROM p""")
def corpus_fingerprint(spark, sf_dir):
    return op.corpus_fingerprint(table(spark, sf_dir, "documents"))


@register("SELECT l_orderkey AS source_id, l_partkey AS target_id, l_quantity AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) AS rank FROM lineitem QUALIFY rank <= 3")
def bounded_bucket(spark, sf_dir):
    return op.bounded_bucket(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_quantity").alias("score")), 3)


DIRECTIONAL, SYMMETRIC = ["supports", "extends", "qualifies", "explains", "applies"], ["contrasts", "agrees", "parallels", "complements"]


@register(f"""WITH a AS (SELECT l_orderkey AS pair, l_linenumber AS passage FROM lineitem WHERE l_linenumber % 2 = 1), b AS (SELECT l_orderkey AS pair, l_linenumber AS passage FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT pair, count(*) AS options, count(*) FILTER (direction = 'none') AS nulls FROM (
  SELECT pair, unnest({[d for _ in DIRECTIONAL for d in ('forward', 'backward')] + ['both'] * len(SYMMETRIC)}) AS direction FROM a JOIN b USING (pair) UNION ALL SELECT pair, unnest(['none', 'none']) FROM (SELECT DISTINCT pair FROM a)) GROUP BY pair""")
def option_enumeration(spark, sf_dir):
    side = lambda r: table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") % 2 == r).select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("passage"))
    return op.options(side(1), side(0), "pair", DIRECTIONAL, SYMMETRIC).groupBy("pair").agg(F.count("*").alias("options"), F.count(F.when(F.col("direction") == "none", 1)).alias("nulls"))
