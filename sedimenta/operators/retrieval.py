"""Ranked retrieval: BM25, cosine distance, reciprocal rank fusion and the searches made of them.

The arms rank narrow rows (id and score) and only the fused ids, a bounded number, are joined back to
the wide table. Corpus statistics cover the whole table, filters notwithstanding. Scores are rounded
before they are ranked and ties go to the smaller id, so results do not depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.sources.tables import spread

#: Rows that each arm hands to the fusion.
DEPTH = 60
RRF_K = 60
K1, B = 1.2, 0.75
#: Dimensions up to which a distance is one unrolled expression inside generated code.
UNROLLED = 128


def corpus_stats(df: DataFrame, text: str) -> DataFrame:
    """One row: n_docs (rows with text) and avg_len (tokens)."""
    return df.select(F.size(T.tokens(F.col(text))).alias("dl")).where("dl >= 0").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len"))


def term_frequencies(df: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    """term and n_docs: in how many rows each term occurs (0 rows give no line)."""
    words = F.array_distinct(T.tokens(F.col(text)))
    hit = F.array_intersect(words, F.array(*[F.lit(t) for t in terms]))
    return df.select(F.explode(hit).alias("term")).groupBy("term").agg(F.count("*").alias("n_docs"))


def bm25(df: DataFrame, key: str, text: str, query: str, where: Column | None = None) -> DataFrame:
    """key and score of the rows that hold a term of the query; no term, no row.

    One pass gathers the statistics (a single row), a second scores; both stay in generated code.
    """
    terms = T.query_terms(query)
    if not terms:
        return df.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    # Length and the occurrences of the terms come from two scans of the text, without an array of all its
    # words. They leave a generator, so that no filter on them is moved below it and scans the text again.
    edge = r"[\p{L}\p{N}]"
    hits = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"(?<!{edge})(?:{'|'.join(terms)})(?!{edge})"), F.lit(0))
    found = F.struct(F.coalesce(F.regexp_count(F.col(text), F.lit(T.WORD_PATTERN)), F.lit(-1)).alias("_dl"), hits.alias("_h"))
    narrow = spread(df.select(F.col(key), F.col(text), *([where.alias("_w")] if where is not None else [])))
    tok = narrow.select(F.col(key), F.explode(F.array(found)).alias("_f"), *(["_w"] if where is not None else []))
    tok = tok.select(key, "_f.*", *(["_w"] if where is not None else []))
    tok = tok.select("*", *[(F.size("_h") - F.size(F.array_remove("_h", t))).alias(f"_tf{i}") for i, t in enumerate(terms)])
    stats = tok.where("_dl >= 0").agg(F.count("*").alias("n"), F.avg("_dl").alias("avg"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).first()
    if not stats["n"]:
        return df.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    parts = []
    for i in range(len(terms)):
        n, d = float(stats["n"]), float(stats[f"df{i}"])
        idf = F.log(F.lit(1.0 + (n - d + 0.5) / (d + 0.5)))
        tf = F.col(f"_tf{i}").cast("double")
        norm = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("_dl").cast("double") / F.lit(float(stats["avg"])))
        parts.append(idf * tf * F.lit(K1 + 1.0) / (tf + norm))
    hit = reduce(lambda a, b: a | b, [F.col(f"_tf{i}") > 0 for i in range(len(terms))])
    if where is not None:
        hit = hit & F.coalesce(F.col("_w"), F.lit(False))
    return tok.where(hit).select(key, F.round(reduce(lambda a, b: a + b, parts), 6).alias("score"))


def cosine_distance(vector: str, query: Sequence[float]) -> Column:
    """1 - cosine; null for a vector that is null, all zero or of another length."""
    dim = len(query)
    norm = sum(x * x for x in query) ** 0.5
    if dim <= UNROLLED:
        e = [F.get(F.col(vector), F.lit(i)).cast("double") for i in range(dim)]
        dot = reduce(lambda a, b: a + b, [x * F.lit(float(q)) for x, q in zip(e, query, strict=True)])
        size = F.sqrt(reduce(lambda a, b: a + b, [x * x for x in e]))
        return F.when((F.size(vector) == dim) & (size > 0), F.lit(1.0) - dot / (size * F.lit(norm)))
    return _cosine_udf(query)(F.col(vector))


def _cosine_udf(query: Sequence[float]):
    import numpy as np

    q = np.array(query, float)

    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        at = [i for i, x in enumerate(v) if x is not None and len(x) == len(q)]
        if at:
            m = np.stack([np.asarray(v.iloc[i], float) for i in at])
            size = np.linalg.norm(m, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[at] = np.where(size > 0, 1 - m @ q / (size * np.linalg.norm(q)), np.nan)
        return pd.Series(out).where(~np.isnan(out), None)

    return distance


def ranked(df: DataFrame, key: str, score: Column, n: int) -> DataFrame:
    """key and rank of the first n rows by the order of ``score``, then key: a bounded top, then its numbers."""
    top = df.orderBy(score, key).limit(n)
    return top.select(F.col(key), F.row_number().over(Window.orderBy(score, key)).alias("rank"))


def bm25_arm(df: DataFrame, key: str, text: str, query: str, n: int = DEPTH, where: Column | None = None) -> DataFrame:
    return ranked(bm25(df, key, text, query, where), key, F.desc("score"), n)


def vector_arm(df: DataFrame, key: str, vector: str, query: Sequence[float], n: int = DEPTH, where: Column | None = None) -> DataFrame:
    d = df if where is None else df.where(where)
    d = d.select(key, F.round(cosine_distance(vector, query), 6).alias("distance")).where(F.col("distance").isNotNull())
    return ranked(d, key, F.asc("distance"), n)


def fuse(arms: Sequence[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """key and rrf_score: the sum of 1/(k + rank) over the arms in which a key stands. Keys are unique in an arm."""
    both = reduce(lambda a, b: a.unionByName(b), arms)
    part = F.lit(1.0) / (F.lit(float(k)) + F.col("rank").cast("double"))
    return both.groupBy(key).agg(F.round(F.sum(part), 9).alias("rrf_score"))


def over_fetch(limit: int, filtered: bool) -> int:
    """How many fused rows are taken so that filters after the fusion can still fill the limit."""
    return max(3 * limit, 20) if filtered else limit


def hybrid_search(
    df: DataFrame,
    key: str,
    text: str,
    vector: str,
    query: str,
    query_vector: Sequence[float],
    limit: int = 10,
    k: int = RRF_K,
    where: Column | None = None,
    prefilter: bool = False,
    fetch: int | None = None,
) -> DataFrame:
    """All columns and rrf_score of the best rows by fused BM25 and vector ranks, best first.

    ``where`` is applied after the candidates are chosen (the limit may then not be filled), or before
    either arm ranks with ``prefilter``. An empty table or a query without terms leaves the other arm.
    """
    own = where if prefilter else None
    arms = [bm25_arm(df, key, text, query, DEPTH, own), vector_arm(df, key, vector, query_vector, DEPTH, own)]
    n = fetch if fetch is not None else over_fetch(limit, where is not None)
    best = fuse(arms, key, k).orderBy(F.desc("rrf_score"), key).limit(n)
    # at most 2 * DEPTH ids
    out = df.join(F.broadcast(best), key)
    if where is not None and not prefilter:
        out = out.where(where)
    return out.orderBy(F.desc("rrf_score"), key).limit(limit)


class Indexed(Protocol):
    """What a stored index (``search_index.SearchIndex``) offers instead of a table."""

    def hybrid(self, query: str, vector: Sequence[float], limit: int, k: int, where: Column | None, prefilter: bool, fetch: int | None) -> DataFrame: ...

    def bm25(self, query: str, limit: int, where: Column | None) -> DataFrame: ...


def _hybrid(source: DataFrame | Indexed, key: str, query: str, vector: Sequence[float], limit: int, where: Column | None, prefilter: bool, fetch: int | None = None) -> DataFrame:
    if isinstance(source, DataFrame):
        return hybrid_search(source, key, "content", "embedding", query, vector, limit, where=where, prefilter=prefilter, fetch=fetch)
    return source.hybrid(query, vector, limit, RRF_K, where, prefilter, fetch)


def optional_equal(filters: dict[str, str | None]) -> Column | None:
    """Conjunction of the filters that are given; a null in a filtered column is no match."""
    given = [F.col(c) == F.lit(v) for c, v in filters.items() if v is not None]
    return reduce(lambda a, b: a & b, given) if given else None


def both(*conditions: Column | None) -> Column | None:
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else None


def search_code(df: DataFrame | Indexed, query: str, vector: Sequence[float], limit: int = 10, language: str | None = None, symbol_kind: str | None = None, repo_path: str | None = None, projects: list[str] | None = None, prefilter: bool = False) -> DataFrame:
    """Hybrid search over code chunks, a table or its index; ``repo_path`` is a LIKE pattern."""
    return _hybrid(df, "id", query, vector, limit, _code_filter(language, symbol_kind, repo_path, projects), prefilter)


def _code_filter(language: str | None, symbol_kind: str | None, repo_path: str | None, projects: list[str] | None) -> Column | None:
    return both(
        optional_equal({"language": language, "symbol_kind": symbol_kind}),
        F.col("repo_path").like(repo_path) if repo_path is not None else None,
        T.in_projects(F.col("project"), projects) if projects else None,
    )


def bm25_search(df: DataFrame | Indexed, query: str, limit: int = 10, language: str | None = None, symbol_kind: str | None = None, repo_path: str | None = None, projects: list[str] | None = None) -> DataFrame:
    """BM25 search over code chunks; filters hold before ranking, the score stands in rrf_score."""
    where = _code_filter(language, symbol_kind, repo_path, projects)
    if not isinstance(df, DataFrame):
        return df.bm25(query, limit, where)
    top = bm25(df, "id", "content", query, where).orderBy(F.desc("score"), "id").limit(limit)
    out = df.join(F.broadcast(top.withColumnRenamed("score", "rrf_score")), "id") if limit <= 10_000 else df.join(top.withColumnRenamed("score", "rrf_score"), "id")
    return out.orderBy(F.desc("rrf_score"), "id")


def search_docs(df: DataFrame | Indexed, query: str, vector: Sequence[float], limit: int = 10, doc_kind: str | None = None, projects: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """Hybrid search over documents; filters hold in both arms."""
    where = both(optional_equal({"doc_kind": doc_kind}), T.in_projects(F.col("project"), projects) if projects else None)
    return _hybrid(df, key, query, vector, limit, where, True, max(3 * limit, 20))


def search_issues(issues: DataFrame | Indexed | None, prs: DataFrame | Indexed | None, query: str, vector: Sequence[float], limit: int = 10, repo: str | None = None, state: str | None = None, entity_type: str | None = None) -> DataFrame:
    """Hybrid search over issues and pull requests, each ranked on its own, merged by score (issues first on ties).

    ``entity_type``: ``issues``, ``prs``, None for both; any other value gives nothing.
    """
    where = optional_equal({"repo": repo, "state": state})
    found = []
    for kind, wanted, df in (("issue", "issues", issues), ("pr", "prs", prs)):
        if df is None:
            continue
        one = _hybrid(df, "id", query, vector, limit if entity_type in (None, wanted) else 0, where, True, limit)
        found.append(one.select(F.lit(kind).alias("entity_type"), "id", "repo", "number", "state", "title", "author", "labels", "content", "created_at", "rrf_score"))
    out = reduce(lambda a, b: a.unionByName(b), found)
    return out.orderBy(F.desc("rrf_score"), "entity_type", "id").limit(limit)


def repo_summary(chunks: DataFrame) -> DataFrame:
    """Chunks, files and latest indexing of each repository, latest first."""
    return chunks.groupBy("repo_path").agg(F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("n_files"), F.max("indexed_at").alias("last_indexed")).orderBy(F.desc("last_indexed"), "repo_path")


def file_chunks(chunks: DataFrame, repo_path: str, file_path: str, projects: list[str] | None = None) -> DataFrame:
    """Chunks of one file in order."""
    return chunks.where((F.col("repo_path") == repo_path) & (F.col("file_path") == file_path) & T.in_projects(F.col("project"), projects)).orderBy("chunk_index", "id")


def reconstruct(chunks: DataFrame, keys: Sequence[str] = ("repo_path", "file_path")) -> DataFrame:
    """keys and source of each file, from its overlapping chunks.

    Lines are numbered from a chunk's start_line (1 if null or less); a number that several chunks give is
    taken from the lowest chunk_index, then id; missing numbers are left out.
    """
    chunk = F.struct("chunk_index", "id", F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).alias("s"), "content")
    # contents are shuffled once, whole; lines are only taken apart and put together within a file
    one = chunks.where(F.length("content") > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(chunk)).alias("c"))
    numbered = F.transform("c", lambda c, i: F.transform(F.split(F.regexp_replace(F.regexp_replace(c["content"], "\r\n", "\n"), r"\n\z", ""), "\n"), lambda x, p: F.struct((c["s"] + p).alias("n"), i.alias("o"), x.alias("line"))))
    one = one.select(*keys, F.explode(F.array(F.array_sort(F.flatten(numbered)))).alias("x"))
    first = F.filter("x", lambda e, i: (i == 0) | (F.get(F.col("x"), i - 1)["n"] != e["n"]))
    return one.select(*keys, F.array_join(F.transform(first, lambda e: e["line"]), "\n").alias("source"))
