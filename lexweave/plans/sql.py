"""Pieces of SQL that several queries share; each says what its namesake in lexweave.functions.text says."""

from ..functions.text import STOP_WORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all({fold(x)}, '[\p{{L}}\p{{N}}]+')"


def words(x: str) -> str:
    return f"list_distinct(list_filter({tokens(x)}, lambda w: length(w) > 1 AND NOT list_contains({STOP}, w)))"


POSTS = f"posts AS (SELECT doc_id AS source_id, unnest({words('text')}) AS word FROM documents)"
DF = "df AS (SELECT word, count(*) AS df FROM posts GROUP BY word)"
SCORES = f"""{POSTS}, {DF},
asked AS (SELECT item_id AS query_id, unnest({words('text')}) AS word FROM benchmark),
size AS (SELECT count(*) AS n FROM documents),
scores AS (SELECT query_id, source_id, sum(1 + ln((1 + n) / CAST(1 + df AS DOUBLE))) AS score
  FROM posts JOIN asked USING (word) JOIN df USING (word), size GROUP BY ALL),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, source_id) AS rank FROM scores QUALIFY rank <= 32)"""
DENSE = """
known AS (SELECT vec_id AS source_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
dscores AS (SELECT a.vec_id AS query_id, source_id, list_dot_product(v, a.embedding::DOUBLE[]) AS score FROM known, embeddings a WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM dscores QUALIFY rank <= 32)"""
FUSED = """
routes AS (SELECT query_id, source_id, 'lexical' AS route, rank FROM lexical UNION ALL SELECT query_id, source_id, 'dense', rank FROM dense),
fused AS (SELECT query_id, source_id, sum(1.0::DOUBLE / (60 + rank)) AS score, max(rank) FILTER (route = 'lexical') AS lexical_rank, max(rank) FILTER (route = 'dense') AS dense_rank
  FROM routes GROUP BY ALL)"""
ROUTE = "CASE WHEN lexical_rank IS NOT NULL AND dense_rank IS NOT NULL THEN 'hybrid' WHEN dense_rank IS NOT NULL THEN 'semantic' ELSE 'lexical' END"
