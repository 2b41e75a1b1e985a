"""Incremental synchronisation of issue trackers, resumable by watermarks.

Each of the four streams of a repository (issues, pull requests and the comments of both) reads items as
JSON, shapes them into rows, merges them by key and only then moves its watermark: a failed run repeats
its items, which the keys absorb. A stream that fails is recorded and does not stop the others.
``follow`` runs the same step on every micro-batch of a Structured Streaming source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedimenta import schemas
from sedimenta.functions import text as T
from sedimenta.ingest import Store
from sedimenta.operators import store as S
from sedimenta.operators.embed import Embedder, embed_column
from sedimenta.sources import rest
from sedimenta.sources.shared import checkpoint

API = "https://api.github.com"
#: A comment of fewer bytes is not kept.
MIN_BYTES = 20
_USER = "user STRUCT<login: STRING>, created_at STRING, updated_at STRING"
_ISSUE = "number BIGINT, state STRING, title STRING, body STRING, labels ARRAY<STRUCT<name: STRING>>, " + _USER


@dataclass(frozen=True)
class Stream:
    table: str
    path: str
    ddl: str
    server_side: bool
    params: dict[str, str]


STREAMS = {
    "issues": Stream("github_issues", "issues", _ISSUE + ", closed_at STRING, pull_request STRUCT<url: STRING>", True, {"state": "all", "sort": "updated", "direction": "asc"}),
    "prs": Stream("github_prs", "pulls", _ISSUE + ", merged_at STRING, base STRUCT<ref: STRING>, head STRUCT<ref: STRING>", False, {"state": "all", "sort": "updated", "direction": "asc"}),
    "issue_comments": Stream("github_issue_comments", "issues/comments", "id BIGINT, body STRING, issue_url STRING, " + _USER, True, {"sort": "updated", "direction": "asc"}),
    "pr_comments": Stream("github_pr_comments", "pulls/comments", "id BIGINT, body STRING, pull_request_url STRING, path STRING, diff_hunk STRING, " + _USER, True, {"sort": "updated", "direction": "asc"}),
}


def _labels() -> Column:
    return F.array_join(F.transform("j.labels", lambda x: x["name"]), ", ")


def shape(items: DataFrame, name: str, repo: str) -> DataFrame:
    """Rows of the stream's table from JSON items: filtered, one for each key (the latest), without embedding.

    Issues that are pull requests, comments of less than MIN_BYTES bytes and comments without a parent
    number drop out. Times that can't be read are null. ``updated_raw`` keeps the item's own time.
    """
    s = STREAMS[name]
    j = items.select(F.from_json("item", s.ddl).alias("j")).where("j IS NOT NULL")
    time = lambda c: T.parse_time(F.col(f"j.{c}")).alias(c)
    common = [F.lit(repo).alias("repo"), F.col("j.user.login").alias("author"), time("created_at"), time("updated_at"), F.col("j.updated_at").alias("updated_raw")]
    if name in ("issues", "prs"):
        if name == "issues":
            j = j.where("j.pull_request IS NULL")
            extra = [time("closed_at"), F.col("j.state").alias("state")]
        else:
            state = F.when(F.col("j.merged_at").isNotNull(), "merged").otherwise(F.col("j.state"))
            extra = [time("merged_at"), F.col("j.base.ref").alias("base_branch"), F.col("j.head.ref").alias("head_branch"), state.alias("state")]
        title = F.coalesce("j.title", F.lit(""))
        rows = j.where("j.number IS NOT NULL").select(*common, *extra, F.col("j.number").cast("int").alias("number"), title.alias("title"), F.col("j.body").alias("body"), _labels().alias("labels"), T.issue_content(title, F.col("j.body")).alias("content"))
    else:
        body = F.coalesce("j.body", F.lit(""))
        j = j.where((F.octet_length(T.strip(body)) >= MIN_BYTES) & F.col("j.id").isNotNull())
        if name == "issue_comments":
            rows = j.select(*common, T.issue_number(F.col("j.issue_url")).cast("int").alias("issue_number"), F.col("j.id").alias("comment_id"), body.alias("content")).where("issue_number IS NOT NULL")
        else:
            content = F.when(F.col("j.path").isNotNull(), F.concat("j.path", F.lit("\n"), body)).otherwise(body)
            rows = j.select(*common, T.issue_number(F.col("j.pull_request_url")).cast("int").alias("pr_number"), F.col("j.id").alias("comment_id"), F.lit("review_comment").alias("comment_type"), F.col("j.path").alias("file_path"), F.col("j.diff_hunk").alias("diff_hunk"), content.alias("content")).where("pr_number IS NOT NULL")
    rows = rows.withColumn("content_hash", T.content_hash(F.col("content")))
    return S.newest(rows, schemas.KEYS[s.table], [F.col("updated_at").isNotNull(), F.col("updated_at"), F.col("content_hash")])


def after(rows: DataFrame, watermark: str | None) -> DataFrame:
    """Rows updated strictly later than the watermark; unknown times pass, and all do without a watermark."""
    if watermark is None:
        return rows
    wm = T.parse_time(F.lit(watermark))
    return rows.where(wm.isNull() | F.col("updated_at").isNull() | (F.col("updated_at") > wm))


def watermark_of(state: DataFrame, scope: str, source: str = "github") -> str | None:
    row = state.where((F.col("source_name") == source) & (F.col("scope_key") == scope)).select("watermark").first()
    return row["watermark"] if row else None


def apply_items(store: Store, repo: str, name: str, items: DataFrame, embedder: Embedder, force: bool = False, now: Column | None = None, always: bool = False) -> int:
    """Merge the items of one stream, then move its watermark; returns the number of rows merged.

    Known rows change only where their content hash differs (``always``: whenever delivered).
    """
    s, scope = STREAMS[name], f"{repo}:{name}"
    now = F.current_timestamp() if now is None else now
    mark = None if force else watermark_of(store.read("sync_state", store.parts("sync_state", scope)), scope)
    rows = shape(items, name, repo)
    if not s.server_side:
        rows = after(rows, mark)
    rows = rows.withColumn("_at", F.col("updated_at"))
    top = rows.agg(F.count("*").alias("n"), F.max_by("updated_raw", "_at").alias("last"), F.max("_at").alias("at")).first()
    if top["n"]:
        table = store.read(s.table)
        keys = schemas.KEYS[s.table]
        full = embed_column(rows, "content", embedder).withColumn("indexed_at", now).withColumn("id", F.xxhash64(*keys))
        full = checkpoint(store.spark, full.select(*table.columns))
        fixed = {"id", "created_at", "base_branch", "head_branch", "indexed_at", *keys}
        store.merge(s.table, full, [c for c in table.columns if c not in fixed], None if always else S.hash_differs)
    if top["last"] is not None:
        old = mark and store.spark.range(1).select((T.parse_time(F.lit(mark)) >= F.lit(top["at"])).alias("x")).first()["x"]
        to = mark if old else top["last"]
        store.change("sync_state", lambda t: S.set_watermark(t, "github", scope, to, now), store.parts("sync_state", scope))
    elif mark is not None:
        store.change("sync_state", lambda t: S.set_watermark(t, "github", scope, mark, now), store.parts("sync_state", scope))
    return int(top["n"])


def pull(store: Store, repo: str, embedder: Embedder, streams: list[str] | None = None, token: str | None = None, transport: str | None = None, force: bool = False) -> dict[str, int | str]:
    """Synchronise the streams of ``owner/name``; the result has a row count, or the error, for each."""
    if repo.count("/") != 1 or not all(repo.split("/")):
        raise ValueError("a repository is named owner/name")
    wanted = list(STREAMS) if not streams or streams == ["all"] else streams
    rest.register(store.spark)
    out: dict[str, int | str] = {}
    for name in wanted:
        s, scope = STREAMS[name], f"{repo}:{name}"
        try:
            mark = None if force else watermark_of(store.read("sync_state", store.parts("sync_state", scope)), scope)
            reader = store.spark.read.format("paged_rest").option("url", f"{API}/repos/{repo}/{s.path}")
            for k, v in s.params.items():
                reader = reader.option(f"param.{k}", v)
            if s.server_side and mark:
                reader = reader.option("param.since", mark)
            for k, v in (("token", token), ("transport", transport)):
                reader = reader.option(k, v) if v else reader
            out[name] = apply_items(store, repo, name, reader.load().select("item"), embedder, force)
        except Exception as e:
            error = out[name] = str(e)
            store.change("sync_state", lambda t: S.record_error(t, "github", scope, error, F.current_timestamp()), store.parts("sync_state", scope))  # noqa: B023
    return out


def follow(store: Store, repo: str, name: str, items: DataFrame, embedder: Embedder, checkpoint_dir: str, on_batch: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Apply a stream of items (a streaming DataFrame with ``item``), all that is there, batch by batch.

    A batch that is delivered again after a failure changes nothing: keys and watermarks absorb it.
    """

    def step(df: DataFrame, epoch: int) -> None:
        n = apply_items(store, repo, name, df, embedder)
        if on_batch:
            on_batch(epoch, n)

    return items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
