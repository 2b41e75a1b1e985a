"""Tables that are changed: keyed upserts, inserts, deletes and their atomic publication.

A table is a folder of numbered versions. A change writes the parts that it touches beside those of the
version it read and then claims the next number, which one writer can do, so readers see the old or the
new table, never a part, a path that is read is never written, and no writer undoes another's change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.functions.text import byte_truncate, merge_projects
from sedimenta.sources.shared import Folder

_TAG = "__in"


def _match(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the greatest by ``order``: what a later delivery leaves of an earlier one."""
    row = F.struct(*[F.col(c) for c in df.columns])
    one = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("r"))
    return one.select("r.*")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Sequence[str] | None = None,
    merge: dict[str, Callable[[Column, Column], Column]] | None = None,
    when: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
) -> DataFrame:
    """Rows of ``target`` after ``source`` was merged into it by ``keys``; both have unique keys.

    New keys are inserted. Of known keys the columns ``update`` (all but the keys by default) take the
    source's values, those in ``merge`` a function of (old, new), if ``when(old, new)`` holds. Columns that
    the source lacks stay (null in new rows). Null key parts match null.
    """
    update = [c for c in source.columns if c not in keys] if update is None else list(update)
    merge = merge or {}
    old = target.select(*[F.col(c) for c in target.columns], F.lit(1).alias("__old"))
    new = source.select(*[F.col(c).alias(c + _TAG) for c in source.columns], F.lit(1).alias("__new"))
    on = reduce(lambda x, y: x & y, [old[k].eqNullSafe(new[k + _TAG]) for k in keys])
    j = old.join(new, on, "full_outer")
    has_old, has_new = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    change = has_old & has_new
    if when is not None:
        change = change & F.coalesce(when(F.col, lambda c: F.col(c + _TAG)), F.lit(False))
    out = []
    for c in target.columns:
        if c not in source.columns:
            out.append(F.col(c))
            continue
        fresh = F.col(c + _TAG)
        if c in merge:
            out.append(F.when(~has_old, merge[c](F.lit(None).cast(target.schema[c].dataType), fresh)).when(change, merge[c](F.col(c), fresh)).otherwise(F.col(c)).alias(c))
        elif c in keys:
            out.append(F.when(has_old, F.col(c)).otherwise(fresh).alias(c))
        else:
            take = change if c in update else F.lit(False)
            out.append(F.when(~has_old | take, fresh).otherwise(F.col(c)).alias(c))
    return j.select(*out)


def hash_differs(old: Callable[[str], Column], new: Callable[[str], Column]) -> Column:
    """Condition of a conditional upsert: the content hash is another one (nulls compare as values)."""
    return ~old("content_hash").eqNullSafe(new("content_hash"))


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` and the rows of ``source`` whose key it lacks."""
    return target.unionByName(source.join(target, _match(source, target, keys), "left_anti"), allowMissingColumns=True)


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Rows that the condition doesn't hold for; an unknown (null) condition keeps a row."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def touch_mtime(target: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Take the file time of ``files`` (keys, content_hash, file_mtime) where the hash is the same and the time is not."""
    f = files.select(*[F.col(k).alias("__" + k) for k in keys], F.col("content_hash").alias("__h"), F.col("file_mtime").alias("__m"))
    on = reduce(lambda x, y: x & y, [target[k].eqNullSafe(f["__" + k]) for k in keys])
    j = target.join(f, on, "left")
    drifted = (F.col("content_hash") == F.col("__h")) & ~F.col("file_mtime").eqNullSafe(F.col("__m"))
    return j.select(*[F.when(drifted, F.col("__m")).otherwise(F.col(c)).alias(c) if c == "file_mtime" else F.col(c) for c in target.columns])


def classify(files: DataFrame, stored: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """status of each file: index, skip_mtime, touch or reindex.

    ``files`` and ``stored`` have the keys, file_mtime and content_hash. Unknown files are indexed; equal
    times (both known) skip; an equal hash asks for a new time only; all else is indexed again. ``force``
    indexes everything.
    """
    s = stored.select(*[F.col(k).alias("__" + k) for k in keys], F.col("file_mtime").alias("__m"), F.col("content_hash").alias("__h"), F.lit(1).alias("__known"))
    on = reduce(lambda x, y: x & y, [files[k].eqNullSafe(s["__" + k]) for k in keys])
    status = (
        F.when(F.lit(force) | F.col("__known").isNull(), "index")
        .when(F.coalesce(F.col("file_mtime") == F.col("__m"), F.lit(False)), "skip_mtime")
        .when(F.coalesce(F.col("content_hash") == F.col("__h"), F.lit(False)), "touch")
        .otherwise("reindex")
    )
    return files.join(s, on, "left").select(*files.columns, status.alias("status"))


def first_chunk_state(chunks: DataFrame, file: str = "file_path") -> DataFrame:
    """repo_path, file, file_mtime and content_hash of each file, from its lowest chunk that has a hash."""
    kept = chunks.where(F.col("content_hash").isNotNull())
    one = kept.groupBy("repo_path", file).agg(F.min_by(F.struct("file_mtime", "content_hash"), F.struct("chunk_index", "id")).alias("s"))
    return one.select("repo_path", file, "s.file_mtime", "s.content_hash")


def old_versions(repo_index: DataFrame, package: str | None = None) -> DataFrame:
    """repo_path of packages of which a later indexed version exists in the same kind of source; equal times are kept."""
    named = repo_index.where(F.col("package_name").isNotNull())
    if package is not None:
        named = named.where(F.col("package_name") == package)
    last = named.groupBy("source_kind", "package_name").agg(F.max("indexed_at").alias("last"))
    return named.join(last, ["source_kind", "package_name"]).where(F.col("indexed_at") < F.col("last")).select("repo_path").orderBy("repo_path")


def prune(tables: dict[str, DataFrame], repos: DataFrame, dry_run: bool = False) -> dict[str, DataFrame]:
    """The tables without the rows of ``repos`` (repo_path); with ``dry_run`` the number of rows that would go, by table."""
    r = repos.select("repo_path").distinct()
    if dry_run:
        return {n: t.join(r, "repo_path", "left_semi").agg(F.count("*").alias("n_rows")) for n, t in tables.items()}
    return {n: t.join(r, "repo_path", "left_anti").select(*t.columns) for n, t in tables.items()}


def set_watermark(state: DataFrame, source: str, scope: str, watermark: str, now: Column) -> DataFrame:
    """sync_state after a successful pull: the new watermark, no errors."""
    row = state.sparkSession.range(1).select(
        F.lit(f"{source}:{scope}").alias("id"), F.lit(source).alias("source_name"), F.lit(scope).alias("scope_key"), F.lit(watermark).alias("watermark"),
        now.alias("last_synced_at"), F.lit(0).alias("error_count"), F.lit(None).cast("string").alias("last_error"), now.alias("updated_at"),
    )
    return upsert(state, row, ("source_name", "scope_key"), ("watermark", "last_synced_at", "error_count", "last_error", "updated_at"))


def record_error(state: DataFrame, source: str, scope: str, error: str, now: Column) -> DataFrame:
    """sync_state after a failed pull: one more error, its text of at most 1000 bytes; the watermark stays."""
    row = state.sparkSession.range(1).select(
        F.lit(f"{source}:{scope}").alias("id"), F.lit(source).alias("source_name"), F.lit(scope).alias("scope_key"), F.lit(1).alias("error_count"),
        byte_truncate(F.lit(error), 1000).alias("last_error"), now.alias("updated_at"),
    )
    add = {"error_count": lambda old, new: F.coalesce(old, F.lit(0)) + new}
    return upsert(state, row, ("source_name", "scope_key"), ("last_error", "updated_at"), add)


def evolve_projects(df: DataFrame) -> DataFrame:
    """The table with ``project`` as a list of strings: added, converted from a string, or as it is."""
    if "project" not in df.columns:
        return df.withColumn("project", F.lit(None).cast("array<string>"))
    if isinstance(df.schema["project"].dataType, T.StringType):
        return df.withColumn("project", F.when(F.col("project").isNotNull(), F.array("project")))
    return df


PROJECT_MERGE = {"project": merge_projects}


class Conflict(RuntimeError):
    """Another writer published in between, or the version is gone by now; nothing was published."""


class VersionedTable:
    """A Parquet table under ``root`` of which parts are replaced, atomically.

    Rows lie in ``buckets`` parts by a hash of the column ``by`` (one part without it). A version is a
    manifest that names the folder of each part. Its name is its number and nothing else, and it is created
    only if no file of that name exists, so of two writers that start from one version one is refused.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, by: str | None = None, buckets: int = 64):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.by, self.buckets = by, buckets if by else 1
        self._folder = Folder(spark, self.root)

    def version(self) -> int:
        """Number of the current version, 0 if there is none."""
        names = self._folder.names("versions")
        return int(names[-1]) if names else 0

    def _manifest(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        try:
            return json.loads(self._folder.text(f"versions/{version:010d}"))
        except Py4JJavaError as e:
            if f"{version:010d}" in self._folder.names("versions"):
                raise
            raise Conflict(f"version {version} of {self.root} is no longer kept") from e

    def bucket(self, by: Column) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(self.buckets)).cast("int") if self.by else F.lit(0)

    def buckets_of(self, values: DataFrame) -> list[int]:
        """The parts that rows with these values of ``by`` lie in: at most ``buckets`` numbers."""
        if not self.by:
            return [0]
        return sorted(r.b for r in values.select(self.bucket(F.col(self.by)).alias("b")).distinct().collect())

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """Rows of a version (the current one if None), of all parts or ``only`` some."""
        parts = self._manifest(self.version() if version is None else version)
        paths = [f"{self.root}/data/{f}/bucket={b}" for b, f in parts.items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _write(self, df: DataFrame) -> dict[str, str]:
        folder = uuid.uuid4().hex
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        rows = rows.withColumn("bucket", self.bucket(F.col(self.by)) if self.by else F.lit(0))
        if self.by:  # AQE splits large parts and joins small ones
            rows = rows.hint("rebalance", "bucket")
        rows.write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        return {n.removeprefix("bucket="): folder for n in self._folder.names(f"data/{folder}")}

    def publish(self, df: DataFrame, base: int | None = None, only: Sequence[int] | None = None, keep: int = 2) -> int:
        """Make ``df`` the rows of the table, or of the parts ``only``, in a version after ``base``.

        ``base`` is the version that ``df`` was made from, the current one if None. If another writer
        published meanwhile, parts that it did not touch are taken over from it; if it touched one of this
        change, Conflict is raised and its table stays. Versions before the last ``keep`` are removed, with
        the data that no later one names. Returns the new version's number.
        """
        base = self.version() if base is None else base
        was = self._manifest(base)
        mine = {str(b) for b in (range(self.buckets) if only is None else only)}
        new = self._write(df)
        if not new.keys() <= mine:
            raise ValueError("rows outside the parts that are replaced")
        while True:
            now = self.version()
            parts = self._manifest(now)
            if any(parts.get(b) != was.get(b) for b in mine):
                for folder in set(new.values()):
                    self._folder.delete(f"data/{folder}")
                raise Conflict(f"version {now} of {self.root} changed the same rows as a change of version {base}")
            kept = {b: f for b, f in parts.items() if b not in mine}
            if self._folder.create(f"versions/{now + 1:010d}", json.dumps(kept | new)):
                break
        self._drop_old(keep)
        return now + 1

    def change(self, make: Callable[[DataFrame], DataFrame], only: Sequence[int] | None = None, tries: int = 5) -> int:
        """Publish ``make`` of the table's rows (of the parts ``only``); made again where another writer was faster."""
        for n in range(tries):
            base = self.version()
            try:
                return self.publish(make(self.read(base, only)), base, only)
            except Conflict:
                if n == tries - 1:
                    raise
        raise AssertionError

    def _drop_old(self, keep: int) -> None:
        numbers = [int(n) for n in self._folder.names("versions")]
        live = {x for n in numbers[-keep:] for x in self._manifest(n).items()}
        folders = {f for _, f in live}
        for n in numbers[:-keep]:
            for b, f in self._manifest(n).items():
                if (b, f) not in live:
                    self._folder.delete(f"data/{f}/bucket={b}" if f in folders else f"data/{f}")
            self._folder.delete(f"versions/{n:010d}")
