"""Command line: ``python -m sedimenta.cli --store DIR COMMAND ...``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sedimenta import ingest, schemas
from sedimenta.operators import store as S
from sedimenta.operators.embed import Embedder, HashEmbedder, HttpEmbedder, ensure_model
from sedimenta.sources import packages
from sedimenta.tools import Tools


def _embedder(args: argparse.Namespace) -> Embedder:
    return HttpEmbedder(args.embed_url, args.embed_model) if args.embed_url else HashEmbedder()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sedimenta")
    p.add_argument("--store", required=True)
    p.add_argument("--embed-url", default=os.environ.get("EMBED_URL"))
    p.add_argument("--embed-model", default=os.environ.get("EMBED_MODEL", ""))
    c = p.add_subparsers(dest="command", required=True)
    for name in ("search", "bm25"):
        s = c.add_parser(name)
        s.add_argument("query")
        s.add_argument("--limit", type=int, default=10)
        for o in ("language", "symbol-kind", "repo-path"):
            s.add_argument(f"--{o}")
    c.add_parser("repos")
    c.add_parser("index")
    for name in ("code", "docs"):
        s = c.add_parser(name)
        s.add_argument("path")
        s.add_argument("--force", action="store_true")
        s.add_argument("--project")
        s.add_argument("--pattern", action="append", default=[])
    for name in ("crate", "hackage", "pypi"):
        s = c.add_parser(name)
        s.add_argument("package")
        s.add_argument("version")
        s.add_argument("--force", action="store_true")
        s.add_argument("--project")
    s = c.add_parser("git")
    s.add_argument("url")
    for o in ("rev", "branch", "tag", "project"):
        s.add_argument(f"--{o}")
    s.add_argument("--force", action="store_true")
    s.add_argument("--no-docs", action="store_true")
    s = c.add_parser("github")
    s.add_argument("repo")
    s.add_argument("--stream", action="append")
    s.add_argument("--force", action="store_true")
    s = c.add_parser("list")
    s.add_argument("--local", action="store_true")
    s.add_argument("--kind")
    s = c.add_parser("prune")
    s.add_argument("what", choices=("repo", "local", "old"))
    s.add_argument("name", nargs="?")
    s.add_argument("--dry-run", action="store_true")
    return p


def main(argv: list[str] | None = None) -> str:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sedimenta").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, embed = ingest.Store(spark, args.store), _embedder(args)
    if args.embed_url and args.command in ("code", "docs", "crate", "hackage", "pypi", "git", "github") and (warning := ensure_model(args.embed_url.split("/api/")[0], args.embed_model)):
        print(warning)
    # commands see all projects and do not rerank
    tools = Tools(store, embed, projects=[])
    if args.command in ("search", "bm25"):
        f = tools.search_code if args.command == "search" else tools.bm25_search
        return f(args.query, args.limit, args.language, args.symbol_kind, args.repo_path)
    if args.command == "repos":
        return tools.list_repos()
    if args.command == "index":
        return "\n".join(f"{n}: {'indexed' if store.refresh_index(n) else 'empty'}" for n in schemas.FILTERS)
    if args.command == "code":
        return str(ingest.index_folder(store, args.path, embed, args.project, args.force, extra=args.pattern))
    if args.command == "docs":
        repo = os.path.realpath(args.path)
        return str(ingest.index_docs(store, ingest.files_.doc_files(spark, repo), repo, embed, args.project, args.force))
    if args.command in ("crate", "hackage", "pypi"):
        fetch = {"crate": packages.fetch_crate, "hackage": packages.fetch_haskell, "pypi": packages.fetch_pypi}[args.command]
        return str(ingest.index_package(store, fetch(args.package, args.version), embed, args.project, args.force))
    if args.command == "git":
        return str(ingest.index_package(store, packages.fetch_git(args.url, args.rev, args.branch, args.tag), embed, args.project, args.force, docs=not args.no_docs))
    if args.command == "github":
        from sedimenta.streaming.sync import pull

        return str(pull(store, args.repo, embed, args.stream, os.environ.get("GITHUB_TOKEN"), force=args.force))
    index = store.read("repo_index")
    if args.command == "list":
        if args.local:
            index = index.where("source_kind = 'local'")
        if args.kind:
            index = index.where(F.col("source_kind") == args.kind)
        return "\n".join(f"{r.source_kind}\t{r.repo_path}\t{r.indexed_at}" for r in index.orderBy(F.desc("indexed_at"), "repo_path").collect())
    if args.what == "repo":
        gone = spark.createDataFrame([(args.name,)], "repo_path string")
    elif args.what == "local":
        gone = index.where("source_kind = 'local'")
    else:
        gone = S.old_versions(index, args.name)
    return str(ingest.prune(store, gone, args.dry_run))


if __name__ == "__main__":
    print(main())
