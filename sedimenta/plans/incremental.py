"""Queries of incremental processing (problem 2)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import ledger as L
from sedimenta.sources.shared import shared_dir
from sedimenta.sources.tables import table

#: Time at which the first run of ``p2_processed`` looks at the tables.
CUT = "2026-05-20 00:00:00"
#: Hours that the lease of a run in ``p2_entries`` lasts, and after the last start at which it looks.
LEASE_H, LATER_H = 6, 2


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = L.newest_files(table(spark, sf_dir, "code_chunks", "id", "repo_path", "file_path", "content_hash", "file_mtime", "indexed_at"))
    return files.unionByName(L.newest_issues(table(spark, sf_dir, "github_issues", "id", "repo", "number", "content_hash", "updated_at", "indexed_at")))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recorded_states(table(spark, sf_dir, "ingest_ledger"), table(spark, sf_dir, "ingest_runs", "run_id", "run_state"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the records that the next run has to put out."""
    return L.pending_items(_items(spark, sf_dir), _states(spark, sf_dir)).select(*L.KEY)


def p2_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ledger items stand in each state."""
    return _states(spark, sf_dir).groupBy("record_table", "work_state").agg(F.count("*").alias("n_items"))


def p2_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the leases of all runs stand to the items they took, two hours after the last run began."""
    runs = table(spark, sf_dir, "ingest_runs", "run_id", "started_at", "run_state")
    last = runs.agg(F.max("started_at").alias("t")).first()["t"]
    leases = runs.select(F.col("run_id").alias("token"), (F.col("run_state") == "succeeded").alias("completed"), (F.col("started_at") + F.expr(f"INTERVAL {LEASE_H} HOURS")).alias("expires_at"))
    events = table(spark, sf_dir, "ingest_ledger", *L.KEY, "run_id").withColumnRenamed("run_id", "token")
    now = F.lit(last).cast("timestamp_ntz") + F.expr(f"INTERVAL {LATER_H} HOURS")
    return L.entry_states(events, leases, now).groupBy("record_table", "entry_state").agg(F.count("*").alias("n_entries"))


def p2_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a ledger gave out each record: after a lost lease, a run at the cut and one over all rows."""
    files = table(spark, sf_dir, "code_chunks", "id", "repo_path", "file_path", "content_hash", "file_mtime", "indexed_at")
    issues = table(spark, sf_dir, "github_issues", "id", "repo", "number", "content_hash", "updated_at", "indexed_at")
    early = F.col("indexed_at") < F.lit(CUT).cast("timestamp_ntz")
    then = L.newest_files(files.where(early)).unionByName(L.newest_issues(issues.where(early)))
    ledger = L.WorkLedger(spark, f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}")
    now = dt.datetime.fromisoformat(CUT)
    lost, _ = ledger.lease(then, now, 60)
    later = now + dt.timedelta(seconds=61)
    token, work = ledger.lease(then, later, 60)
    if lost is not None and ledger.complete(lost, work):
        raise RuntimeError("a lease that was taken over completed")
    if token is not None:
        ledger.complete(token, work.select(*L.KEY))
    token, work = ledger.lease(_items(spark, sf_dir), later, 60)
    if token is not None:
        ledger.complete(token, work.select(*L.KEY))
    out = ledger.output()
    out = _items(spark, sf_dir).select(*L.KEY) if out is None else out
    return out.groupBy(*L.KEY).agg(F.count("*").alias("n_times"))


QUERIES = {"p2_found": p2_found, "p2_states": p2_states, "p2_entries": p2_entries, "p2_processed": p2_processed}

_DONE = """
done AS (
  SELECT record_table, scope_key, item_key, content_hash, file_mtime, updated_at FROM (
    SELECT l.*, row_number() OVER (PARTITION BY record_table, scope_key, item_key
      ORDER BY l.run_id DESC, recorded_at DESC NULLS LAST, content_hash DESC NULLS LAST,
               file_mtime DESC NULLS LAST, updated_at DESC NULLS LAST) AS rn
    FROM ingest_ledger l
    WHERE l.run_id IN (SELECT run_id FROM ingest_runs WHERE run_state = 'succeeded')) WHERE rn = 1)
"""
ORACLES = {
    "p2_found": f"""
WITH {_DONE},
files AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, file_path
    ORDER BY indexed_at DESC NULLS LAST, id DESC) AS rn FROM code_chunks) WHERE rn = 1),
iss AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, number
    ORDER BY updated_at DESC NULLS LAST, indexed_at DESC NULLS LAST, id DESC) AS rn FROM github_issues) WHERE rn = 1)
SELECT 'code_chunks' AS record_table, f.repo_path AS scope_key, f.file_path AS item_key
FROM files f LEFT JOIN done d ON d.record_table = 'code_chunks'
  AND d.scope_key IS NOT DISTINCT FROM f.repo_path AND d.item_key IS NOT DISTINCT FROM f.file_path
WHERE d.record_table IS NULL OR CASE WHEN f.content_hash IS NULL OR d.content_hash IS NULL
  THEN f.file_mtime IS DISTINCT FROM d.file_mtime ELSE f.content_hash <> d.content_hash END
UNION ALL
SELECT 'github_issues', i.repo, CAST(i.number AS VARCHAR)
FROM iss i LEFT JOIN done d ON d.record_table = 'github_issues'
  AND d.scope_key IS NOT DISTINCT FROM i.repo AND d.item_key IS NOT DISTINCT FROM CAST(i.number AS VARCHAR)
WHERE d.record_table IS NULL OR CASE WHEN i.updated_at IS NULL OR d.updated_at IS NULL
  THEN i.content_hash IS DISTINCT FROM d.content_hash ELSE i.updated_at > d.updated_at END
""",
    "p2_states": f"""
WITH {_DONE},
k AS (SELECT DISTINCT record_table, scope_key, item_key FROM ingest_ledger)
SELECT k.record_table, CASE WHEN d.record_table IS NULL THEN 'pending' ELSE 'done' END AS work_state, count(*) AS n_items
FROM k LEFT JOIN done d ON d.record_table IS NOT DISTINCT FROM k.record_table
  AND d.scope_key IS NOT DISTINCT FROM k.scope_key AND d.item_key IS NOT DISTINCT FROM k.item_key
GROUP BY 1, 2
""",
    "p2_entries": f"""
WITH t AS (SELECT max(started_at) + INTERVAL {LATER_H} HOUR AS now FROM ingest_runs),
l AS (SELECT *, max(run_id) OVER (PARTITION BY record_table, scope_key, item_key) AS last FROM ingest_ledger)
SELECT record_table, CASE WHEN run_state = 'succeeded' THEN 'done' WHEN l.run_id < last THEN 'fenced'
  WHEN started_at + INTERVAL {LEASE_H} HOUR > (SELECT now FROM t) THEN 'live' ELSE 'expired' END AS entry_state, count(*) AS n_entries
FROM l LEFT JOIN ingest_runs USING (run_id) GROUP BY 1, 2
""",
    "p2_processed": f"""
WITH f AS (SELECT repo_path AS s, file_path AS i, first(struct_pack(h := content_hash, m := file_mtime) ORDER BY indexed_at DESC NULLS LAST, id DESC) AS x,
    first(struct_pack(h := content_hash, m := file_mtime) ORDER BY indexed_at DESC NULLS LAST, id DESC) FILTER (indexed_at < TIMESTAMP '{CUT}') AS y
  FROM code_chunks GROUP BY 1, 2),
g AS (SELECT repo AS s, CAST(number AS VARCHAR) AS i, first(struct_pack(h := content_hash, u := updated_at) ORDER BY updated_at DESC NULLS LAST, indexed_at DESC NULLS LAST, id DESC) AS x,
    first(struct_pack(h := content_hash, u := updated_at) ORDER BY updated_at DESC NULLS LAST, indexed_at DESC NULLS LAST, id DESC) FILTER (indexed_at < TIMESTAMP '{CUT}') AS y
  FROM github_issues GROUP BY 1, 2)
SELECT 'code_chunks' AS record_table, s AS scope_key, i AS item_key, 1 + CASE WHEN y IS NULL THEN 0
  WHEN x.h IS NULL OR y.h IS NULL THEN (x.m IS DISTINCT FROM y.m)::INT ELSE (x.h <> y.h)::INT END AS n_times FROM f
UNION ALL
SELECT 'github_issues', s, i, 1 + CASE WHEN y IS NULL THEN 0
  WHEN x.u IS NULL OR y.u IS NULL THEN (x.h IS DISTINCT FROM y.h)::INT ELSE (x.u > y.u)::INT END FROM g
""",
}
