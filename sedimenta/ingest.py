"""Incremental indexing of files and packages into the stored tables.

A run scans metadata, classifies every file against what is stored, cuts and embeds only what is new or
changed, merges it by key and publishes the table once; readers see the state before or after the run.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta import schemas
from sedimenta.functions import text as T
from sedimenta.operators import chunking as C
from sedimenta.operators import store as S
from sedimenta.operators.embed import Embedder, embed_column
from sedimenta.operators.search_index import SearchIndex
from sedimenta.sources import files as files_
from sedimenta.sources.packages import Package
from sedimenta.sources.shared import Folder, checkpoint


class Store:
    """The stored tables below one folder, each in ``buckets`` parts by repository."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = {n: S.VersionedTable(spark, f"{self.root}/{n}", schemas.schema(n), schemas.PART_BY[n], buckets) for n in schemas.DDL}

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        return self.tables[name].read(only=only)

    def parts(self, name: str, value: str) -> list[int]:
        """The part of a table that rows of one repository (or scope) lie in."""
        return self.tables[name].buckets_of(self.spark.range(1).select(F.lit(value).alias(schemas.PART_BY[name])))

    def change(self, name: str, make: Callable[[DataFrame], DataFrame], only: list[int] | None = None) -> None:
        """Publish ``make`` of the table (of its parts ``only``); no change of another writer is lost."""
        self.tables[name].change(make, only)

    def merge(self, name: str, rows: DataFrame, update: list[str] | None = None, when=None, merge=None) -> None:
        """Upsert ``rows`` (unique by the table's natural key) into the parts of the table that they lie in."""
        only = self.tables[name].buckets_of(rows)
        if only:
            self.change(name, lambda t: S.upsert(t, rows, schemas.KEYS[name], update, merge, when), only)


    def refresh_index(self, name: str) -> SearchIndex | None:
        """The search index of the table's current version, built if there is none; None for an empty table."""
        found = self.index(name)
        if found is not None:
            return found
        version, folder = self.tables[name].version(), Folder(self.spark, f"{self.root}/indexes/{name}")
        table = self.tables[name].read(version)
        dim = table.where(F.size("embedding") > 0).agg(F.max(F.size("embedding"))).first()[0]
        if table.isEmpty():
            return None
        index = SearchIndex.build(table, "id", "content", "embedding", folder.root, dim or 1, schemas.FILTERS[name])
        folder.create(f"names/{version:010d}", index.path)
        # one older index stays for readers that have it open
        for n in folder.names("names")[:-2]:
            folder.delete(folder.text(f"names/{n}").removeprefix(f"{folder.root}/"))
            folder.delete(f"names/{n}")
        return index

    def index(self, name: str) -> SearchIndex | None:
        """The stored search index of the table's current version, None if it was not built."""
        folder, version = Folder(self.spark, f"{self.root}/indexes/{name}"), f"{self.tables[name].version():010d}"
        return SearchIndex(self.spark, folder.text(f"names/{version}")) if version in folder.names("names") else None

    def searchable(self, name: str) -> SearchIndex | DataFrame:
        """The index if there is one of the current version, else the table, which is then scanned."""
        return self.index(name) or self.read(name)


def _now(as_of: str | None) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def _projects(project: str | None) -> Column:
    return (F.array(F.lit(project)) if project else F.lit(None)).cast("array<string>")


def _changed(spark: SparkSession, found: DataFrame, stored: DataFrame, path: str, force: bool) -> DataFrame:
    """Files whose time is new, with text and status; only these are read, hashes settle what times don't.

    Status ``not_text``: the file is no UTF-8 text or can no longer be read.
    """
    keys = ("repo_path", path)
    quick = S.classify(found.withColumn("content_hash", F.lit(None).cast("string")), stored, keys, force)
    some = files_.with_text(quick.where("status <> 'skip_mtime'").drop("status", "content_hash")).withColumn("content_hash", T.content_hash(F.col("text")))
    done = S.classify(some, stored, keys, force)
    return checkpoint(spark, done.withColumn("status", F.when(F.col("text").isNull(), "not_text").otherwise(F.col("status"))))


def _counts(work: DataFrame, found: DataFrame) -> dict[str, int]:
    counts = {r.status: r["count"] for r in work.groupBy("status").count().collect()}
    unchanged = found.count() - sum(counts.values())
    return counts | ({"unchanged": unchanged} if unchanged else {})


def index_code(store: Store, found: DataFrame, repo_path: str, embedder: Embedder, project: str | None = None, force: bool = False, sync_deletes: bool = False, as_of: str | None = None) -> dict[str, int]:
    """Index code files (rel_path, file_mtime, and path or content bytes) as ``repo_path``; returns counts by status.

    Only the part of the table in which the repository lies is read and replaced.
    """
    spark, columns, keys = store.spark, schemas.schema("code_chunks").names, schemas.KEYS["code_chunks"]
    only = store.parts("code_chunks", repo_path)
    own = F.col("repo_path") == repo_path

    def base(table: DataFrame) -> DataFrame:
        return S.delete_where(table, own) if force else table

    f = found.select(F.lit(repo_path).alias("repo_path"), F.col("rel_path").alias("file_path"), "file_mtime", *[c for c in ("path", "content") if c in found.columns])
    work = _changed(spark, f, S.first_chunk_state(base(store.read("code_chunks", only)).where(own)), "file_path", force)
    new = work.where("status IN ('index', 'reindex')").withColumn("k", F.monotonically_increasing_id())
    new = checkpoint(spark, new.withColumn("language", T.language(F.col("file_path"))))
    chunks = C.chunk_code(new, "k", "text", "language")
    rows = chunks.join(new.drop("text", "status"), chunks.key == new.k).withColumn("indexed_at", _now(as_of)).withColumn("project", _projects(project))
    rows = embed_column(rows, "content", embedder)
    # texts are embedded once, also if the change is made again
    rows = checkpoint(spark, rows.withColumn("id", F.xxhash64(*keys)).select(*columns))

    def merged(table: DataFrame) -> DataFrame:
        table = S.touch_mtime(base(table), work.where("status = 'touch'"), ("repo_path", "file_path"))
        if sync_deletes:
            # chunks of files that are gone, and those that a shorter file no longer has
            live = f.select("repo_path", "file_path", F.lit(1).alias("_live"))
            table = table.join(live, ["repo_path", "file_path"], "left").where(~F.coalesce(own & F.col("_live").isNull(), F.lit(False))).select(*columns)
            table = table.join(new.select("repo_path", "file_path"), ["repo_path", "file_path"], "left_anti").select(*columns)
        out = S.upsert(table, rows, keys, [c for c in columns if c not in ("id", *keys)], S.PROJECT_MERGE)
        # files that did not change get the project too
        return _add_project(out, own, project) if project else out

    store.change("code_chunks", merged, only)
    return _counts(work, f)


def _add_project(table: DataFrame, where: Column, project: str) -> DataFrame:
    return table.withColumn("project", F.when(where, T.merge_projects(F.col("project"), _projects(project))).otherwise(F.col("project")))


def index_docs(store: Store, found: DataFrame, repo_path: str, embedder: Embedder, project: str | None = None, force: bool = False, as_of: str | None = None) -> dict[str, int]:
    """Index Markdown files as documents of ``repo_path``; returns counts by status."""
    spark, columns, keys = store.spark, schemas.schema("documents").names, schemas.KEYS["documents"]
    only = store.parts("documents", repo_path)
    own = F.col("repo_path") == repo_path

    def base(table: DataFrame) -> DataFrame:
        return S.delete_where(table, own) if force else table

    f = found.select(F.lit(repo_path).alias("repo_path"), F.col("rel_path").alias("source_path"), "file_mtime", *[c for c in ("path", "content") if c in found.columns])
    state = S.first_chunk_state(base(store.read("documents", only)).where(own), "source_path")
    work = _changed(spark, f, state, "source_path", force)
    new = checkpoint(spark, work.where("status IN ('index', 'reindex')").withColumn("k", F.monotonically_increasing_id()))
    chunks = C.chunk_markdown(new, "k", "text")
    path, text = F.col("source_path"), F.col("text")
    meta = new.select("k", "repo_path", "source_path", "file_mtime", "content_hash", T.doc_kind(path).alias("doc_kind"), T.title(text, path).alias("title"))
    rows = chunks.join(meta, chunks.key == meta.k).withColumn("preview", T.preview(F.col("content")))
    rows = embed_column(rows.withColumn("indexed_at", _now(as_of)).withColumn("project", _projects(project)), "content", embedder)
    rows = checkpoint(spark, rows.withColumn("id", F.xxhash64(*keys)).select(*columns))

    def merged(table: DataFrame) -> DataFrame:
        table = S.touch_mtime(base(table), work.where("status = 'touch'"), ("repo_path", "source_path"))
        return S.upsert(table, rows, keys, [c for c in columns if c not in ("id", *keys)], S.PROJECT_MERGE)

    store.change("documents", merged, only)
    return _counts(work, f)


def record_repo(store: Store, repo_path: str, kind: str, name: str | None = None, version: str | None = None, git_url: str | None = None, git_rev: str | None = None, project: str | None = None, as_of: str | None = None) -> None:
    row = store.spark.range(1).select(
        F.lit(repo_path).alias("repo_path"), F.lit(kind).alias("source_kind"), F.lit(name).cast("string").alias("package_name"), F.lit(version).cast("string").alias("version"),
        F.lit(git_url).cast("string").alias("git_url"), F.lit(git_rev).cast("string").alias("git_rev"), _now(as_of).alias("indexed_at"), _projects(project).alias("project"),
    )
    store.merge("repo_index", row, merge=S.PROJECT_MERGE)


def index_folder(store: Store, root: str, embedder: Embedder, project: str | None = None, force: bool = False, docs: bool = True, extra: list[str] | None = None, as_of: str | None = None) -> dict[str, int]:
    """Index a local folder under its absolute path."""
    repo = os.path.realpath(root)
    counts = index_code(store, files_.code_files(store.spark, repo, extra), repo, embedder, project, force, as_of=as_of)
    if docs:
        index_docs(store, files_.doc_files(store.spark, repo), repo, embedder, project, force, as_of=as_of)
    record_repo(store, repo, "local", project=project, as_of=as_of)
    return counts


def count_chunks(store: Store, repo_paths: list[str], projects: list[str] | None = None) -> int:
    df = store.read("code_chunks").where(F.col("repo_path").isin(*repo_paths))
    return df.where(T.in_projects(F.col("project"), projects)).count()


def index_package(store: Store, package: Package, embedder: Embedder, project: str | None = None, force: bool = False, docs: bool = False, as_of: str | None = None) -> dict[str, int]:
    """Index the files of a fetched package; one that is indexed already only gets the project."""
    if not force and count_chunks(store, [package.repo_path]):
        if project:
            store.change("code_chunks", lambda t: _add_project(t, F.col("repo_path") == package.repo_path, project), store.parts("code_chunks", package.repo_path))
        return {"already_indexed": 1}
    # the archive was unpacked on the driver, so its size is bounded by the driver
    rows = store.spark.createDataFrame([(p, None, b) for p, b in sorted(package.files.items())], "rel_path string, file_mtime long, content binary")
    rel = F.col("rel_path")
    code = rows.where((T.extension(rel).isin(*files_.CODE_EXTENSIONS) | T.basename(rel).isin(*T.CABAL_PROJECTS)) & files_._outside(rel, files_.SKIPPED))
    counts = index_code(store, code, package.repo_path, embedder, project, force, as_of=as_of)
    if docs:
        index_docs(store, rows.where((T.extension(rel) == "md") & files_._outside(rel, files_.DOC_SKIPPED)), package.repo_path, embedder, project, force, as_of=as_of)
    record_repo(store, package.repo_path, package.source_kind, package.name, package.version, package.git_url, package.git_rev, project, as_of)
    return counts


def prune(store: Store, repos: DataFrame, dry_run: bool = False) -> dict[str, int]:
    """Remove repositories (repo_path) from chunks, documents and the index; returns the rows that go."""
    repos = checkpoint(store.spark, repos.select("repo_path").distinct())
    names = ("code_chunks", "documents", "repo_index")
    parts = {n: store.tables[n].buckets_of(repos) for n in names}
    counts = {n: t.first()["n_rows"] for n, t in S.prune({n: store.read(n, parts[n]) for n in names}, repos, dry_run=True).items()}
    if not dry_run:
        for n in names:
            if parts[n]:
                store.change(n, lambda t: S.prune({"t": t}, repos)["t"], parts[n])
    return counts
