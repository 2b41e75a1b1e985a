"""Incremental processing through a work-item ledger.

Every record is a work item with a fingerprint. Its state follows from an append-only log of
lease and completion events: *pending* (no live lease, or the recorded fingerprint is not the
record's present one), *leased* (a live lease) or *done* (recorded by a lease that completed).
A lease that was never completed returns to pending when it expires. The lease number is the
fencing token: a lease of which an item was taken over by a later one can't complete any more.
Output goes to a folder named by the token, so a retried write replaces itself.

The log is a row of numbered files. A step (lease or completion) is decided on all files there are
and takes effect by creating the next number, which one writer can do; whoever comes second reads on
and decides anew. So no two workers get an item, and no stale one publishes.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.sources.shared import Folder

KEY = ("record_table", "scope_key", "item_key")
MARK = ("content_hash", "file_mtime", "updated_at")


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    cond = F.lit(True)
    for k in KEY:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def newest_files(chunks: DataFrame) -> DataFrame:
    """One item for each (repo_path, file_path): the state in its row with the latest indexed_at.

    A null indexed_at is older than any other; equal times are settled by the greater id. Needs
    id, repo_path, file_path, content_hash, file_mtime, indexed_at; other columns are ignored.
    Partial aggregation runs before the shuffle, so a repository with most rows is no hot spot.
    """
    rank = F.struct(F.col("indexed_at").isNotNull(), "indexed_at", "id")
    state = F.struct("content_hash", "file_mtime")
    return (
        chunks.groupBy("repo_path", "file_path")
        .agg(F.max_by(state, rank).alias("s"))
        .select(
            F.lit("code_chunks").alias("record_table"),
            F.col("repo_path").alias("scope_key"),
            F.col("file_path").alias("item_key"),
            F.col("s.content_hash").alias("content_hash"),
            F.col("s.file_mtime").alias("file_mtime"),
            F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        )
    )


def newest_issues(issues: DataFrame) -> DataFrame:
    """One item for each (repo, number): its row with the greatest updated_at, null only if alone.

    Equal times are settled by the later indexed_at, then the greater id.
    """
    rank = F.struct(F.col("updated_at").isNotNull(), "updated_at", F.col("indexed_at").isNotNull(), "indexed_at", "id")
    state = F.struct("content_hash", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))
    return (
        issues.groupBy("repo", "number")
        .agg(F.max_by(state, rank).alias("s"))
        .select(
            F.lit("github_issues").alias("record_table"),
            F.col("repo").alias("scope_key"),
            F.col("number").cast("string").alias("item_key"),
            F.col("s.content_hash").alias("content_hash"),
            F.lit(None).cast("long").alias("file_mtime"),
            F.col("s.updated_at").alias("updated_at"),
        )
    )


def ledger_states(events: DataFrame, leases: DataFrame) -> DataFrame:
    """State of each item that the ledger knows.

    ``events``: KEY, MARK, ``token`` and ``recorded_at``, what a lease wrote down for an item.
    ``leases``: ``token`` and ``lease_state`` (completed, live or expired). An item is done by its
    entry of the greatest completed token (the latest entry of that token); else leased if a live
    lease holds it; else pending. Entries of unknown tokens count as expired. A stale completion is
    refused when it is made (``WorkLedger.complete``), not here. Result: KEY, MARK of the done entry
    (null otherwise), ``work_state``. An item that is done and leased again for a newer state counts
    as leased, by the done entry's marks.
    """
    # one row for each run; the side is small but its size is not assumed: AQE decides on a broadcast
    e = events.select(*KEY, *MARK, "token", "recorded_at").join(leases.select("token", "lease_state"), "token", "left")
    done = F.col("lease_state").eqNullSafe("completed")
    rank = F.struct(done, "token", F.col("recorded_at").isNotNull(), "recorded_at", *MARK)
    return (
        e.groupBy(*KEY)
        .agg(
            F.max_by(F.struct(done.alias("done"), *MARK), rank).alias("last"),
            F.max(F.col("lease_state").eqNullSafe("live")).alias("live"),
        )
        .select(
            *KEY,
            *[F.when(F.col("last.done"), F.col(f"last.{m}")).alias(m) for m in MARK],
            F.when(F.col("live"), "leased").when(F.col("last.done"), "done").otherwise("pending").alias("work_state"),
        )
    )


def _changed(now: DataFrame, was: DataFrame) -> Column:
    either_hash = now.content_hash.isNull() | was.content_hash.isNull()
    by_hash = ~now.content_hash.eqNullSafe(was.content_hash)
    either_time = now.updated_at.isNull() | was.updated_at.isNull()
    return (
        F.when(now.record_table != "code_chunks", F.when(either_time, by_hash).otherwise(now.updated_at > was.updated_at))
        .when(either_hash, ~now.file_mtime.eqNullSafe(was.file_mtime))
        .otherwise(by_hash)
    )


def pending_items(items: DataFrame, states: DataFrame) -> DataFrame:
    """Items that a run has to process: no done entry, or one that differs from the newest row.

    A file differs by content_hash, or by file_mtime where a hash is null; an issue by a later
    updated_at, or by content_hash where a time is null (nulls compare as values there). Items held
    by a live lease are left to their holder. Null key parts match null key parts.
    """
    s = states.alias("s")
    return (
        items.join(s, _same_key(items, states), "left")
        .where(
            states.work_state.isNull()
            | (states.work_state == "pending")
            | ((states.work_state == "done") & _changed(items, states))
        )
        .select(*[items[c] for c in (*KEY, *MARK)])
    )


def recorded_states(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """States from a run log: a run is a lease, its run_id the fencing token.

    A run that succeeded completed its lease; every other run lost it, so what it wrote down is
    pending again.
    """
    events = ledger.select(
        *[F.col(k) for k in KEY],
        "content_hash",
        "file_mtime",
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        F.col("run_id").alias("token"),
        "recorded_at",
    )
    leases = runs.groupBy(F.col("run_id").alias("token")).agg(
        F.when(F.max((F.col("run_state") == "succeeded").cast("int")) == 1, "completed").otherwise("expired").alias("lease_state")
    )
    return ledger_states(events, leases)


def entry_states(events: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """The events with ``entry_state``, how each lease stands to the item it took.

    ``leases``: token, ``completed`` and ``expires_at``. *done*: the lease completed; *fenced*: it did not,
    and a later lease holds the item; *live* or *expired*: the last lease of the item, before its end or
    after it (an unknown end is over). Nothing is joined within an item: its greatest token tells the rest.
    """
    last = events.groupBy(*[F.col(k).alias(f"_{k}") for k in KEY]).agg(F.max("token").alias("_last"))
    ends = leases.select(F.col("token").alias("_token"), F.col("completed").alias("_completed"), F.col("expires_at").alias("_expires"))
    e = events.join(ends, F.col("token") == F.col("_token"), "left")
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    state = (
        F.when(F.coalesce("_completed", F.lit(False)), "done")
        .when(F.col("token") < F.col("_last"), "fenced")
        .when(F.coalesce(F.col("_expires") > now, F.lit(False)), "live")
        .otherwise("expired")
    )
    return e.join(last, same).select(*events.columns, state.alias("entry_state"))


@dataclass
class _Log:
    """The log read up to ``number``: open leases, completed ones and where the items of each lie."""

    number: int = 0
    #: token -> (folder of the items, end of the lease)
    open: dict[int, tuple[str, str]] = field(default_factory=dict)
    #: token -> (folder of the items, folder of the output)
    done: dict[int, tuple[str, str]] = field(default_factory=dict)
    #: folder of the compacted entries of all leases that are not listed with a folder of their own
    base: str | None = None


class WorkLedger:
    """A durable ledger under ``root`` (a folder that all executors share; see ``Folder.create``).

    ``lease`` hands out the pending items under a new token, ``complete`` publishes their output.
    Both may be repeated after a failure at any point, and run in several drivers at once. After every
    ``compact_every`` steps the entries are folded into one row for each item, so reading the ledger takes
    one file and at most that many small ones.
    """

    def __init__(self, spark: SparkSession, root: str, events_schema: T.StructType | None = None, compact_every: int = 32):
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every
        self.schema = events_schema or T.StructType(
            [T.StructField(k, T.StringType()) for k in KEY]
            + [
                T.StructField("content_hash", T.StringType()),
                T.StructField("file_mtime", T.LongType()),
                T.StructField("updated_at", T.TimestampNTZType()),
                T.StructField("recorded_at", T.TimestampType()),
            ]
        )
        self._folder = Folder(spark, self.root)

    def _read(self) -> _Log:
        """The newest snapshot and the steps after it."""
        snapshots = self._folder.names("snapshots")
        log = _Log()
        if snapshots:
            s = json.loads(self._folder.text(f"snapshots/{snapshots[-1]}"))
            log = _Log(int(snapshots[-1]), {int(k): tuple(v) for k, v in s["open"].items()}, {int(k): tuple(v) for k, v in s["done"].items()}, s["base"])
        for name in self._folder.names("log"):
            if int(name) > log.number:
                step = json.loads(self._folder.text(f"log/{name}"))
                if step["step"] == "lease":
                    log.open[int(name)] = (step["items"], step["until"])
                else:
                    items, _ = log.open.pop(step["token"])
                    log.done[step["token"]] = (items, step["output"])
                log.number = int(name)
        return log

    def _append(self, log: _Log, step: dict) -> bool:
        """Make the next step of the log; False if another worker made one since it was read."""
        return self._folder.create(f"log/{log.number + 1:012d}", json.dumps(step))

    def _events(self, log: _Log) -> DataFrame:
        """KEY, MARK, recorded_at and token of the entries that count."""
        full = T.StructType([*self.schema.fields, T.StructField("token", T.LongType())])
        folders = [f for f, _ in [*log.open.values(), *log.done.values()] if f] + ([log.base] if log.base else [])
        if not folders:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(*[f"{self.root}/items/{f}" for f in dict.fromkeys(folders)])

    def _leases(self, log: _Log, now: dt.datetime) -> DataFrame:
        rows = [(t, "live" if dt.datetime.fromisoformat(until) > now else "expired") for t, (_, until) in log.open.items()]
        return self.spark.createDataFrame(rows + [(t, "completed") for t in log.done], "token long, lease_state string")

    def states(self, now: dt.datetime) -> DataFrame:
        """State of every item of the ledger, see ``ledger_states``."""
        log = self._read()
        return ledger_states(self._events(log), self._leases(log, now))

    def lease(self, items: DataFrame, now: dt.datetime, ttl_s: int = 3600) -> tuple[int | None, DataFrame]:
        """Take every pending item for ``ttl_s`` seconds; returns the token and the items, None if there is nothing to do.

        ``items`` has one row for each key. Items that another worker takes meanwhile are left to it.
        """
        while True:
            log = self._read()
            token, folder = log.number + 1, uuid.uuid4().hex
            work = pending_items(items, ledger_states(self._events(log), self._leases(log, now)))
            work = work.withColumn("recorded_at", F.lit(now)).withColumn("token", F.lit(token).cast("long"))
            work.select(*self.schema.names, "token").write.parquet(f"{self.root}/items/{folder}")
            mine = self.spark.read.schema(self.schema).parquet(f"{self.root}/items/{folder}")
            if mine.isEmpty():
                self._folder.delete(f"items/{folder}")
                return None, self.spark.createDataFrame([], self.schema)
            if self._append(log, {"step": "lease", "items": folder, "until": (now + dt.timedelta(seconds=ttl_s)).isoformat()}):
                self._compact()
                return token, mine
            self._folder.delete(f"items/{folder}")

    def complete(self, token: int, output: DataFrame) -> bool:
        """Publish ``output`` for the token; False (nothing published) if a later lease took one of its items over.

        Any number of retries publish one output. It is written below the token's folder before the log
        names it; what a failed attempt left there is never read.
        """
        attempt = f"{token:012d}/{uuid.uuid4().hex}"
        written = False
        while True:
            log = self._read()
            if token in log.done:
                ok = True
            elif token not in log.open or self._fenced(log, token):
                ok = False
            else:
                if not written:
                    output.write.parquet(f"{self.root}/out/{attempt}")
                    written = True
                    continue  # leases may have come while it was written
                if not self._append(log, {"step": "done", "token": token, "output": attempt}):
                    continue
                self._compact()
                return True
            if written:
                self._folder.delete(f"out/{attempt}")
            return ok

    def _fenced(self, log: _Log, token: int) -> bool:
        # tokens grow with the log: without a later lease nobody can have taken an item over
        if max([*log.open, *log.done], default=token) <= token:
            return False
        events = self._events(log)
        mine, later = events.where(F.col("token") == token), events.where(F.col("token") > token)
        return not mine.join(later, _same_key(mine, later), "left_semi").isEmpty()

    def _compact(self) -> None:
        """Fold the entries into one row for each item and lease that still counts."""
        log = self._read()
        names = self._folder.names("snapshots")
        if log.number - (int(names[-1]) if names else 0) < self.compact_every:
            return
        done = self.spark.createDataFrame([(t,) for t in log.done], "token long")
        events = self._events(log)
        # open leases keep their folders; of the completed ones the entry of the greatest token is the item's state
        closed = events.join(done, "token", "left_semi")
        rest = [c for c in events.columns if c not in KEY]
        best = closed.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("token", F.col("recorded_at").isNotNull(), "recorded_at")).alias("e"))
        folder = uuid.uuid4().hex
        best.select(*KEY, "e.*").select(*events.columns).write.parquet(f"{self.root}/items/{folder}")
        state = {"open": log.open, "done": {t: ("", out) for t, (_, out) in log.done.items()}, "base": folder}
        if not self._folder.create(f"snapshots/{log.number:012d}", json.dumps(state)):
            self._folder.delete(f"items/{folder}")

    def output(self, after: int = 0) -> DataFrame | None:
        """Rows that completed leases with a token greater than ``after`` published; an abandoned write is not among them."""
        folders = [out for t, (_, out) in sorted(self._read().done.items()) if t > after]
        return self.spark.read.parquet(*[f"{self.root}/out/{f}" for f in folders]) if folders else None
