"""Text reports of search results (a handful of rows on the driver)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Row

NOTHING = "No results found."
PREVIEW_BYTES = 600


def _get(row: Row, name: str, default=None):
    d = row.asDict()
    return default if d.get(name) is None else d[name]


def format_chunks(rows: Sequence[Row], scores: Iterable[float] | None = None, label: str = "score") -> str:
    """One block for each chunk: place, kind, score, fenced content."""
    given = list(scores) if scores is not None else []
    parts = []
    for i, r in enumerate(rows):
        score = given[i] if i < len(given) else _get(r, "rrf_score")
        head = f"### {r['repo_path']}:{r['file_path']}:{_get(r, 'start_line', 0)}-{_get(r, 'end_line', 0)}"
        head += f"  [{k}]" if (k := _get(r, "symbol_kind")) else ""
        head += f"  ({label}={score:.4f})" if score is not None else ""
        parts.append(f"{head}\n```{_get(r, 'language', '')}\n{r['content']}\n```")
    return "\n\n".join(parts) or NOTHING


def format_docs(rows: Sequence[Row]) -> str:
    parts = []
    for r in rows:
        head = f"### [{_get(r, 'doc_kind', 'doc')}] {_get(r, 'title', r['source_path'])}  (score={r['rrf_score']:.4f})"
        parts.append(f"{head}\n**Repo:** {r['repo_path']}  **Path:** {r['source_path']}\n\n{r['content']}")
    return "\n\n---\n\n".join(parts) or NOTHING


def format_issues(rows: Sequence[Row]) -> str:
    """Issues and pull requests with the beginning of their bodies; cut at a character, not within one."""
    parts = []
    for r in rows:
        kind = "PR" if r["entity_type"] == "pr" else "Issue"
        head = f"### {kind} #{r['number']}: {r['title']}  [{_get(r, 'state', '?')}]  (score={r['rrf_score']:.4f})"
        head += f"\n**Repo:** {r['repo']}  **Author:** {_get(r, 'author', 'unknown')}  **Created:** {_get(r, 'created_at', '')}"
        head += f"  **Labels:** {x}" if (x := _get(r, "labels", "")) else ""
        content = _get(r, "content", "")
        body = content.split("\n\n", 1)[1] if "\n\n" in content else content
        raw = body.encode()
        shown = raw[:PREVIEW_BYTES].decode(errors="ignore") + "…" if len(raw) > PREVIEW_BYTES else body
        parts.append(f"{head}\n\n{shown}")
    return "\n\n---\n\n".join(parts) or NOTHING
