"""Searches that can be called from SQL: table functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sedimenta.functions.text import WORD_PATTERN
from sedimenta.operators.retrieval import B, DEPTH, K1, RRF_K


def register_hybrid_search(spark: SparkSession, relation: str, key: str, name: str = "hybrid_search", text: str = "content", vector: str = "embedding", key_type: str = "BIGINT") -> None:
    """``SELECT * FROM name(query, vector [, limit [, k]])`` over a table or view: key and rrf_score, best first.

    A declarative form of ``retrieval.hybrid_search`` with the same ranks; the ranks are cut before they are
    numbered, so no more than DEPTH rows of an arm are in one task.
    """
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING, query_vector ARRAY<DOUBLE>, max_rows INT DEFAULT 10, rrf_k INT DEFAULT {RRF_K})
RETURNS TABLE ({key} {key_type}, rrf_score DOUBLE)
RETURN WITH
arg AS (SELECT query AS aq, query_vector AS av, max_rows AS am, rrf_k AS ak),
q AS (SELECT explode(array_distinct(regexp_extract_all(lower(aq), r'{WORD_PATTERN}', 0))) AS term FROM arg),
words AS (SELECT {key} AS doc, regexp_extract_all(lower({text}), r'{WORD_PATTERN}', 0) AS w FROM {relation} WHERE {text} IS NOT NULL),
about AS (SELECT count(*) AS n, avg(size(w)) AS avg_len FROM words),
tf AS (SELECT doc, size(w) AS dl, term, size(w) - size(array_remove(w, term)) AS f FROM words CROSS JOIN q WHERE array_contains(w, term)),
df AS (SELECT term, count(*) AS d FROM tf GROUP BY term),
lexical AS (SELECT doc, round(sum(ln(1 + (n - d + 0.5D) / (d + 0.5D)) * f * {K1 + 1} / (f + {K1} * ({1 - B} + {B} * dl / avg_len))), 6) AS score
  FROM tf JOIN df USING (term) CROSS JOIN about GROUP BY doc),
near AS (SELECT {key} AS doc, round(1 - aggregate(zip_with({vector}, av, (a, b) -> double(a) * b), 0D, (s, x) -> s + x)
    / sqrt(aggregate({vector}, 0D, (s, x) -> s + double(x) * x) * aggregate(av, 0D, (s, x) -> s + x * x)), 6) AS distance
  FROM {relation} CROSS JOIN arg WHERE size({vector}) = size(av) AND exists({vector}, x -> x <> 0)),
arms AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS r FROM (SELECT * FROM lexical ORDER BY score DESC, doc LIMIT {DEPTH})
  UNION ALL SELECT doc, row_number() OVER (ORDER BY distance, doc) AS r FROM (SELECT * FROM near ORDER BY distance, doc LIMIT {DEPTH})),
fused AS (SELECT doc, round(sum(1D / (ak + r)), 9) AS rrf_score FROM arms CROSS JOIN arg GROUP BY doc),
numbered AS (SELECT doc, rrf_score, row_number() OVER (ORDER BY rrf_score DESC, doc) AS place FROM fused)
SELECT doc, rrf_score FROM numbered CROSS JOIN arg WHERE place <= am ORDER BY place
""")
