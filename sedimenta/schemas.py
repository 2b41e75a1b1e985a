"""Schemas and natural keys of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_CHUNK = "content STRING, {lines}content_hash STRING, file_mtime BIGINT, embedding ARRAY<FLOAT>, indexed_at TIMESTAMP, project ARRAY<STRING>"
_ISSUE = "id BIGINT, repo STRING, number INT, state STRING, title STRING, body STRING, author STRING, labels STRING, content STRING, created_at TIMESTAMP, updated_at TIMESTAMP, {end} content_hash STRING, embedding ARRAY<FLOAT>, indexed_at TIMESTAMP"

DDL = {
    "code_chunks": "id BIGINT, repo_path STRING, file_path STRING, chunk_index INT, " + _CHUNK.format(lines="start_line INT, end_line INT, language STRING, symbol_kind STRING, "),
    "documents": "id BIGINT, repo_path STRING, source_path STRING, chunk_index INT, doc_kind STRING, title STRING, preview STRING, " + _CHUNK.format(lines=""),
    "github_issues": _ISSUE.format(end="closed_at TIMESTAMP,"),
    "github_prs": _ISSUE.format(end="merged_at TIMESTAMP, base_branch STRING, head_branch STRING,"),
    "github_issue_comments": "id BIGINT, repo STRING, issue_number INT, comment_id BIGINT, author STRING, content STRING, created_at TIMESTAMP, updated_at TIMESTAMP, content_hash STRING, embedding ARRAY<FLOAT>, indexed_at TIMESTAMP",
    "github_pr_comments": "id BIGINT, repo STRING, pr_number INT, comment_id BIGINT, comment_type STRING, author STRING, content STRING, file_path STRING, diff_hunk STRING, created_at TIMESTAMP, updated_at TIMESTAMP, content_hash STRING, embedding ARRAY<FLOAT>, indexed_at TIMESTAMP",
    "repo_index": "repo_path STRING, source_kind STRING, package_name STRING, version STRING, git_url STRING, git_rev STRING, indexed_at TIMESTAMP, project ARRAY<STRING>",
    "sync_state": "id STRING, source_name STRING, scope_key STRING, watermark STRING, last_synced_at TIMESTAMP, error_count INT, last_error STRING, updated_at TIMESTAMP",
}
KEYS = {
    "code_chunks": ("repo_path", "file_path", "chunk_index"),
    "documents": ("repo_path", "source_path", "chunk_index"),
    "github_issues": ("repo", "number"),
    "github_prs": ("repo", "number"),
    "github_issue_comments": ("repo", "comment_id"),
    "github_pr_comments": ("repo", "comment_type", "comment_id"),
    "repo_index": ("repo_path",),
    "sync_state": ("source_name", "scope_key"),
}
#: Column whose hash tells the part of a table that a row lies in.
PART_BY = {n: "scope_key" if n == "sync_state" else k[0] for n, k in KEYS.items()}
#: Columns by which searches filter before they rank.
FILTERS = {
    "code_chunks": ("language", "symbol_kind", "repo_path", "project"),
    "documents": ("doc_kind", "project"),
    "github_issues": ("repo", "state"),
    "github_prs": ("repo", "state"),
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])
