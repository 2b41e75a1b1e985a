"""The query surface: searches and lookups that return text; failures come back as text too.

Searches are served from the stored indexes of the tables, and scan where none was built for the current version.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import functions as F

from sedimenta import ingest
from sedimenta.functions import report
from sedimenta.ingest import Store
from sedimenta.operators import retrieval as R
from sedimenta.operators.embed import Embedder, Reranker, rerank
from sedimenta.sources import packages
from sedimenta.sources.files import write_reconstructed

POOL = 20


def projects_from_env(value: str | None) -> list[str]:
    return [p for x in (value or "").split(",") if (p := x.strip())]


def _text(f: Callable[..., str]) -> Callable[..., str]:
    def run(*args, **kwargs) -> str:
        try:
            return f(*args, **kwargs)
        except Exception as e:
            return f"{f.__name__} failed: {e}"

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


class Tools:
    def __init__(self, store: Store, embedder: Embedder, projects: list[str] | None = None, reranker: Reranker | None = None, out_dir: str | None = None):
        self.store, self.embedder, self.reranker = store, embedder, reranker
        self.projects = projects_from_env(os.environ.get("PROJECTS")) if projects is None else projects
        self.out_dir = out_dir

    def _vector(self, query: str) -> list[float]:
        return self.embedder([query])[0]

    @_text
    def search_code(self, query: str, limit: int = 10, language: str | None = None, symbol_kind: str | None = None, repo_path: str | None = None) -> str:
        """Hybrid search over code, reranked if a reranker is set."""
        pool = max(limit, POOL) if self.reranker else limit
        rows = R.search_code(self.store.searchable("code_chunks"), query, self._vector(query), pool, language, symbol_kind, repo_path, self.projects)
        if self.reranker:
            got = rerank(rows, query, "content", self.reranker, limit).collect()
            if got and got[0]["rerank_score"] is not None:
                return report.format_chunks(got, [r["rerank_score"] for r in got], "rerank")
            return report.format_chunks(got, label="rrf")
        return report.format_chunks(rows.collect(), label="rrf")

    @_text
    def bm25_search(self, query: str, limit: int = 10, language: str | None = None, symbol_kind: str | None = None, repo_path: str | None = None) -> str:
        return report.format_chunks(R.bm25_search(self.store.searchable("code_chunks"), query, limit, language, symbol_kind, repo_path, self.projects).collect(), label="bm25")

    @_text
    def search_docs(self, query: str, limit: int = 10, doc_kind: str | None = None) -> str:
        return report.format_docs(R.search_docs(self.store.searchable("documents"), query, self._vector(query), limit, doc_kind, self.projects, key="id").collect())

    @_text
    def search_github(self, query: str, limit: int = 10, repo: str | None = None, state: str | None = None, entity_type: str | None = None) -> str:
        df = R.search_issues(self.store.searchable("github_issues"), self.store.searchable("github_prs"), query, self._vector(query), limit, repo, state, entity_type)
        return report.format_issues(df.withColumn("created_at", F.col("created_at").cast("string")).collect())

    @_text
    def list_repos(self) -> str:
        df = self.store.read("code_chunks")
        from sedimenta.functions.text import in_projects

        rows = R.repo_summary(df.where(in_projects(F.col("project"), self.projects))).collect()
        return "\n".join(f"{r.repo_path}: {r.n_chunks} chunks, {r.n_files} files, indexed {r.last_indexed}" for r in rows) or report.NOTHING

    @_text
    def get_file(self, repo_path: str, file_path: str) -> str:
        """Rebuild a file from its chunks; written below the output folder if there is one."""
        chunks = R.file_chunks(self.store.read("code_chunks"), repo_path, file_path, self.projects)
        row = R.reconstruct(chunks).first()
        if row is None:
            return f"No chunks found for {repo_path}/{file_path}"
        return write_reconstructed(row.source, self.out_dir, repo_path, file_path) if self.out_dir else row.source

    @_text
    def fetch_package(self, package: str, version: str, ecosystem: str = "haskell", transport: packages.Transport = packages.http) -> str:
        """Fetch and index a package unless the projects see it already."""
        name = f"{package}-{version}"
        kinds = {"rust": ("rust", ["crates.io"]), "python": ("python", ["pypi"])}
        language, tags = kinds.get(ecosystem, ("haskell", ["chap", "hackage"]))
        paths = [f"{t}::{name}" for t in tags]
        hint = f"\nUse search_code with language={language} to query it."
        if n := ingest.count_chunks(self.store, paths, self.projects):
            return f"Already indexed: {name} ({n} chunks).{hint}"
        before = ingest.count_chunks(self.store, paths)
        project = self.projects[0] if self.projects else None
        fetch = {"rust": packages.fetch_crate, "python": packages.fetch_pypi}.get(ecosystem, packages.fetch_haskell)
        ingest.index_package(self.store, fetch(package, version, transport), self.embedder, project)
        n = ingest.count_chunks(self.store, paths)
        return (f"Added {name} to project '{project}': {n} chunks now visible." if before and project else f"Indexed {name} from {ecosystem}: {n} chunks.") + hint
