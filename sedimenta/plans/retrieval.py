"""Retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.text import query_terms
from sedimenta.operators import retrieval as R
from sedimenta.operators.postings import PostingsIndex
from sedimenta.operators.search_index import SearchIndex
from sedimenta.operators.sql_functions import register_hybrid_search
from sedimenta.sources.shared import shared_dir
from sedimenta.sources.tables import table

QUERY = "the resolver rejects every stale snapshot before the cache is ready"
DIM = 64


def _vector(df: DataFrame, key: str) -> list[float]:
    """Embedding of the row of smallest id that has a usable one."""
    row = df.select(key, "embedding").where((F.size("embedding") == DIM) & F.exists("embedding", lambda x: x != 0)).orderBy(key).first()
    return [float(x) for x in row["embedding"]] if row else [1.0] * DIM


def _code(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "code_chunks")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _issues(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "github_issues")


#: Indexes of this process by application, tables and name: a query builds the one it needs, later ones use it.
_INDEXES: dict[tuple[str, str, str], tuple[SearchIndex, list[float]]] = {}
_TABLES = {"code_chunks": ("id", ("language", "symbol_kind", "repo_path", "project")), "documents": ("doc_id", ("doc_kind", "project")), "open_issues": ("id", ("repo", "state")), "closed_issues": ("id", ("repo", "state"))}


def _indexed(s: SparkSession, d: str, name: str) -> tuple[SearchIndex, list[float]]:
    """The stored index of a table, and the vector that its queries ask with."""
    at = (s.sparkContext.applicationId, d, name)
    if at not in _INDEXES:
        key, attributes = _TABLES[name]
        source = "github_issues" if name.endswith("issues") else name
        df = table(s, d, source)
        rows = df.where(F.col("state") == name.split("_")[0]) if name.endswith("issues") else df
        index = SearchIndex.build(rows, key, "content", "embedding", f"{shared_dir(s).rstrip('/')}/search-{name}", DIM, attributes)
        _INDEXES[at] = (index, _vector(df.select(key, "embedding"), key))
    return _INDEXES[at]


def search_index_build(s: SparkSession, d: str) -> DataFrame:
    """Builds the index of the code chunks anew; sizes of its parts."""
    index = SearchIndex.build(_code(s, d), "id", "content", "embedding", f"{shared_dir(s).rstrip('/')}/search-build", DIM, _TABLES["code_chunks"][1])
    rows = s.read.schema(index.rows_schema).parquet(f"{index.path}/rows")
    vectors = s.read.parquet(f"{index.path}/leaves")
    return rows.agg(F.count("*").alias("n_rows")).crossJoin(vectors.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_vectors")))


def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    index, vector = _indexed(s, d, "code_chunks")
    return R.search_code(index, QUERY, vector).select("id", "repo_path", "file_path", F.coalesce("start_line", F.lit(0)).alias("first_line"), "language", "rrf_score")


def hybrid_scan(s: SparkSession, d: str) -> DataFrame:
    """The same search without an index."""
    df = _code(s, d)
    return R.search_code(df, QUERY, _vector(df, "id")).select("id", "repo_path", "file_path", F.coalesce("start_line", F.lit(0)).alias("first_line"), "language", "rrf_score")


def hybrid_sql(s: SparkSession, d: str) -> DataFrame:
    """The same search as a table function called from SQL."""
    df = _code(s, d).select("id", "content", "embedding")
    df.createOrReplaceTempView("chunks_to_search")
    register_hybrid_search(s, "chunks_to_search", "id")
    vector = F.array(*[F.lit(x) for x in _vector(df, "id")])
    return s.sql("SELECT id, rrf_score FROM hybrid_search(:query, :vector, 12)", args={"query": QUERY, "vector": vector})


def hybrid_search_filtered(s: SparkSession, d: str) -> DataFrame:
    index, vector = _indexed(s, d, "code_chunks")
    return R.search_code(index, QUERY, vector, language="python", repo_path="%::%").select("id", "repo_path", "language", "rrf_score")


def hybrid_prefiltered(s: SparkSession, d: str) -> DataFrame:
    index, vector = _indexed(s, d, "code_chunks")
    return R.search_code(index, QUERY, vector, language="python", prefilter=True).select("id", "language", "rrf_score")


def bm25_search(s: SparkSession, d: str) -> DataFrame:
    return R.bm25_search(_indexed(s, d, "code_chunks")[0], QUERY).select("id", "file_path", "rrf_score")


def bm25_scan(s: SparkSession, d: str) -> DataFrame:
    """The same search without an index."""
    return R.bm25_search(_code(s, d), QUERY).select("id", "file_path", "rrf_score")


def bm25_indexed(s: SparkSession, d: str) -> DataFrame:
    """The same ranking from an inverted index alone."""
    index = PostingsIndex.build(table(s, d, "code_chunks", "id", "content"), "id", "content", f"{shared_dir(s)}/postings", 8)
    return index.search(QUERY).select(F.col("key").alias("id"), F.col("score").alias("rrf_score"))


def bm25_search_filtered(s: SparkSession, d: str) -> DataFrame:
    return R.bm25_search(_indexed(s, d, "code_chunks")[0], QUERY, language="rust", symbol_kind="function").select("id", "language", "symbol_kind", "rrf_score")


def docs_search(s: SparkSession, d: str) -> DataFrame:
    index, vector = _indexed(s, d, "documents")
    return R.search_docs(index, QUERY, vector, doc_kind="readme").select("doc_id", "doc_kind", "title", "rrf_score")


def entity_union_search(s: SparkSession, d: str) -> DataFrame:
    """Closed issues stand in for pull requests."""
    issues, vector = _indexed(s, d, "open_issues")
    prs, _ = _indexed(s, d, "closed_issues")
    return R.search_issues(issues, prs, QUERY, vector).select("entity_type", "id", "repo", "number", "rrf_score")


def entity_issues_only(s: SparkSession, d: str) -> DataFrame:
    """One kind of entity, in one state: an unknown kind gives nothing, which is joined to it here."""
    issues, vector = _indexed(s, d, "open_issues")
    prs, _ = _indexed(s, d, "closed_issues")
    found = R.search_issues(issues, prs, QUERY, vector, limit=5, entity_type="prs", state="closed")
    none = R.search_issues(issues, prs, QUERY, vector, entity_type="wikis")
    return found.unionByName(none).select("entity_type", "id", "repo", "number", "rrf_score")


def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    return R.corpus_stats(table(s, d, "documents", "content"), "content").select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def term_df(s: SparkSession, d: str) -> DataFrame:
    return R.term_frequencies(table(s, d, "documents", "content"), "content", query_terms(QUERY))


def knn_cosine(s: SparkSession, d: str) -> DataFrame:
    index, vector = _indexed(s, d, "code_chunks")
    found = [(key, rank) for rank, (key, _) in enumerate(index.nearest(vector), 1)]
    return s.createDataFrame(found, "id long, rank int")


def knn_scan(s: SparkSession, d: str) -> DataFrame:
    """The same rows without an index."""
    df = table(s, d, "code_chunks", "id", "embedding")
    return R.vector_arm(df, "id", "embedding", _vector(df, "id"))


def rrf_fuse(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "documents", "doc_id", "content", "embedding")
    arms = [R.bm25_arm(df, "doc_id", "content", QUERY), R.vector_arm(df, "doc_id", "embedding", _vector(df, "doc_id"))]
    return R.fuse(arms, "doc_id")


def list_repos(s: SparkSession, d: str) -> DataFrame:
    return R.repo_summary(table(s, d, "code_chunks", "repo_path", "file_path", "indexed_at"))


def file_reconstruct(s: SparkSession, d: str) -> DataFrame:
    df = R.reconstruct(table(s, d, "code_chunks", "id", "repo_path", "file_path", "chunk_index", "content", "start_line"))
    return df.select("repo_path", "file_path", F.length("source").alias("n_chars"), F.sha2("source", 256).alias("digest"))


QUERIES = {f.__name__: f for f in (
    search_index_build, hybrid_search, hybrid_scan, hybrid_sql, hybrid_search_filtered, hybrid_prefiltered, bm25_search, bm25_scan, bm25_indexed, bm25_search_filtered, docs_search, entity_union_search, entity_issues_only,
    corpus_stats, term_df, knn_cosine, knn_scan, rrf_fuse, list_repos, file_reconstruct,
)}

_TERMS = "[" + ", ".join(f"'{t}'" for t in query_terms(QUERY)) + "]"


def _bm25(name: str, source: str, key: str, where: str = "TRUE", stats_of: str | None = None) -> str:
    """CTEs whose last is ``{name}``: key and score of the rows of source that hold a term."""
    return f"""
{name}_tok AS (SELECT {key} AS k, ({where}) AS w, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS t FROM {source} WHERE content IS NOT NULL),
{name}_n AS (SELECT count(*) AS n, avg(len(t)) AS avg FROM {name}_tok),
{name}_tf AS (SELECT k, w, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM {name}_tok, unnest({_TERMS}) AS u(term)),
{name}_df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM {name}_tf GROUP BY term),
{name} AS (SELECT k, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))), 6) AS score
  FROM {name}_tf JOIN {name}_df USING (term), {name}_n WHERE w GROUP BY k HAVING sum(tf) > 0)"""


def _knn(name: str, source: str, key: str, where: str = "TRUE", vector_of: str | None = None) -> str:
    ok = "CASE WHEN len(embedding) = 64 THEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 ELSE FALSE END"
    return f"""
{name}_q AS (SELECT embedding::DOUBLE[] AS q FROM {vector_of or source} WHERE {ok} ORDER BY {key} LIMIT 1),
{name} AS (SELECT {key} AS k, round(list_cosine_distance(embedding::DOUBLE[], q), 6) AS distance
  FROM (SELECT * FROM {source} WHERE {ok} AND ({where})), {name}_q)"""


def _fused(source: str, key: str, where: str = "TRUE", vector_of: str | None = None, tag: str = "") -> str:
    return f"""{_bm25(f"b{tag}", source, key, where)},{_knn(f"v{tag}", source, key, where, vector_of)},
r{tag} AS (SELECT k, row_number() OVER (ORDER BY score DESC, k) AS rank FROM b{tag} QUALIFY rank <= 60
  UNION ALL SELECT k, row_number() OVER (ORDER BY distance, k) AS rank FROM v{tag} QUALIFY rank <= 60),
f{tag} AS (SELECT k, round(sum(1e0 / (60e0 + rank)), 9) AS rrf_score FROM r{tag} GROUP BY k)"""


def _hybrid(source: str, key: str, columns: str, pre: str = "TRUE", post: str = "TRUE", fetch: int = 10, limit: int = 10) -> str:
    return f"""WITH {_fused(source, key, pre, source)},
top AS (SELECT * FROM f ORDER BY rrf_score DESC, k LIMIT {fetch})
SELECT {columns}, rrf_score FROM top JOIN {source} s ON s.{key} = top.k WHERE {post} ORDER BY rrf_score DESC, {key} LIMIT {limit}"""


ORACLES = {
    "hybrid_search": _hybrid("code_chunks", "id", "id, repo_path, file_path, coalesce(start_line, 0) AS first_line, language"),
    "hybrid_search_filtered": _hybrid("code_chunks", "id", "id, repo_path, language", post="language = 'python' AND repo_path LIKE '%::%'", fetch=30),
    "hybrid_prefiltered": _hybrid("code_chunks", "id", "id, language", pre="language = 'python'", fetch=30),
    "bm25_search": f"WITH {_bm25('b', 'code_chunks', 'id')} SELECT id, file_path, score AS rrf_score FROM b JOIN code_chunks ON id = k ORDER BY score DESC, id LIMIT 10",
    "bm25_indexed": f"WITH {_bm25('b', 'code_chunks', 'id')} SELECT k AS id, score AS rrf_score FROM b ORDER BY score DESC, k LIMIT 10",
    "bm25_search_filtered": f"WITH {_bm25('b', 'code_chunks', 'id', chr(108) + 'anguage = ' + chr(39) + 'rust' + chr(39) + ' AND symbol_kind = ' + chr(39) + 'function' + chr(39))} SELECT id, language, symbol_kind, score AS rrf_score FROM b JOIN code_chunks ON id = k ORDER BY score DESC, id LIMIT 10",
    "docs_search": _hybrid("documents", "doc_id", "doc_id, doc_kind, title", pre="doc_kind = 'readme'", fetch=30),
    "entity_union_search": f"""WITH o AS (SELECT * FROM github_issues WHERE state = 'open'), c AS (SELECT * FROM github_issues WHERE state = 'closed'),
{_fused("o", "id", vector_of="github_issues", tag="1")},{_fused("c", "id", vector_of="github_issues", tag="2")},
a AS (SELECT 'issue' AS entity_type, k, rrf_score FROM (SELECT * FROM f1 ORDER BY rrf_score DESC, k LIMIT 10)
  UNION ALL SELECT 'pr', k, rrf_score FROM (SELECT * FROM f2 ORDER BY rrf_score DESC, k LIMIT 10))
SELECT entity_type, id, repo, number, rrf_score FROM a JOIN github_issues ON id = k ORDER BY rrf_score DESC, entity_type, id LIMIT 10""",
    "corpus_stats": "SELECT count(*) AS n_docs, round(avg(len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'))), 6) AS avg_len FROM documents WHERE content IS NOT NULL",
    "term_df": f"SELECT term, count(*) AS n_docs FROM documents, unnest({_TERMS}) AS u(term) WHERE list_contains(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), term) GROUP BY term",
    "knn_cosine": f"WITH {_knn('v', 'code_chunks', 'id')} SELECT k AS id, row_number() OVER (ORDER BY distance, k) AS rank FROM v QUALIFY rank <= 60",
    "rrf_fuse": f"WITH {_fused('documents', 'doc_id')} SELECT k AS doc_id, rrf_score FROM f",
    "list_repos": "SELECT repo_path, count(*) AS n_chunks, count(DISTINCT file_path) AS n_files, max(indexed_at) AS last_indexed FROM code_chunks GROUP BY repo_path",
    "file_reconstruct": """WITH l AS (SELECT repo_path, file_path, chunk_index, id, greatest(coalesce(start_line, 1), 1) AS s,
    string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), chr(10) || '$', ''), chr(10)) AS ls FROM code_chunks WHERE length(content) > 0),
x AS (SELECT repo_path, file_path, chunk_index, id, s + i - 1 AS n, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l)),
y AS (SELECT *, row_number() OVER (PARTITION BY repo_path, file_path, n ORDER BY chunk_index, id) AS rn FROM x),
z AS (SELECT repo_path, file_path, string_agg(line, chr(10) ORDER BY n) AS source FROM y WHERE rn = 1 GROUP BY ALL)
SELECT repo_path, file_path, length(source) AS n_chars, sha256(source) AS digest FROM z""",
}
ORACLES |= {
    "hybrid_scan": ORACLES["hybrid_search"], "hybrid_sql": _hybrid("code_chunks", "id", "id", fetch=12, limit=12), "bm25_scan": ORACLES["bm25_search"], "knn_scan": ORACLES["knn_cosine"],
    "search_index_build": "SELECT count(*) AS n_rows, count(*) FILTER (CASE WHEN len(embedding) = 64 THEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 ELSE FALSE END) AS n_vectors FROM code_chunks",
    "entity_issues_only": f"""WITH c AS (SELECT * FROM github_issues WHERE state = 'closed'),{_fused("c", "id", vector_of="github_issues")},
a AS (SELECT 'pr' AS entity_type, k, rrf_score FROM f ORDER BY rrf_score DESC, k LIMIT 5)
SELECT entity_type, id, repo, number, rrf_score FROM a JOIN github_issues ON id = k""",
}
