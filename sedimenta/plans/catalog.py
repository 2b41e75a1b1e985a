"""Relational, text, chunking and state queries and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.operators import chunking as C
from sedimenta.operators import retrieval as R
from sedimenta.operators import store as S
from sedimenta.operators.embed import rerank, word_overlap
from sedimenta.plans import cases
from sedimenta.sources.tables import table
from sedimenta.streaming import sync

#: Deliveries after these times count as new ones.
CUT, FILE_CUT = "2026-05-23", "2026-05-31 06:00:00"


def doc_classify(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "source_path").select("doc_id", T.doc_kind(F.col("source_path")).alias("kind"))


def language_detect(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "code_chunks", "id", "file_path").select("id", T.language(F.col("file_path")).alias("detected"))


def markdown_title_preview(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "documents", "doc_id", "content", "source_path")
    return df.select("doc_id", T.title(F.col("content"), F.col("source_path")).alias("head"), T.preview(F.col("content")).alias("short"))


def content_hash(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "content", "content_hash").select("doc_id", T.content_hash(F.col("content")).alias("digest"))


def query_sanitise(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "github_issues", "id", "title").select("id", T.sanitise(F.col("title")).alias("query"))


def chunk_lines(s: SparkSession, d: str) -> DataFrame:
    df = C.chunk_lines(table(s, d, "documents", "doc_id", "content"), "doc_id", "content")
    return df.select("doc_id", "chunk_index", "start_line", "end_line", F.sha2("content", 256).alias("digest"))


def chunk_code(s: SparkSession, d: str) -> DataFrame:
    return C.chunk_code(table(s, d, "code_chunks", "id", "content", "language"), "id", "content", "language")


def chunk_markdown(s: SparkSession, d: str) -> DataFrame:
    df = C.chunk_markdown(table(s, d, "documents", "doc_id", "content"), "doc_id", "content")
    return df.select(F.col("key").alias("doc_id"), "chunk_index", F.sha2("content", 256).alias("digest"))


def _cases(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(k, t, lang) for k, (lang, t) in cases.SOURCES.items()], "id long, content string, language string")


def symbols_cases(s: SparkSession, d: str) -> DataFrame:
    """Symbols of one small source in each language, against those written down."""
    return C.symbols(_cases(s), "id", "content", "language").withColumnRenamed("key", "id")


def chunk_code_cases(s: SparkSession, d: str) -> DataFrame:
    """Chunks of the same sources, with a long tail, an oversized symbol and plain text."""
    df = C.chunk_code(_cases(s), "id", "content", "language")
    return df.select(F.col("key").alias("id"), "chunk_index", "start_line", "end_line", F.coalesce("symbol_kind", F.lit("")).alias("kind"))


def repo_index_upsert(s: SparkSession, d: str) -> DataFrame:
    """The index of repositories after the chunks' repositories were merged into it: new metadata, joined projects."""
    p = F.col("repo_path")
    new = table(s, d, "code_chunks", "repo_path", "indexed_at", "project").groupBy("repo_path").agg(F.max("indexed_at").alias("indexed_at"), F.array_distinct(F.flatten(F.collect_set("project"))).alias("project"))
    new = new.select("repo_path", T.source_kind(p, True).alias("source_kind"), T.package_name(p, True).alias("package_name"), "indexed_at", "project")
    out = S.upsert(table(s, d, "repo_index"), new, ("repo_path",), merge=S.PROJECT_MERGE)
    return out.select("repo_path", "source_kind", "package_name", "version", "indexed_at", F.coalesce(F.array_join("project", ","), F.lit("")).alias("projects"))


def evolve_projects(s: SparkSession, d: str) -> DataFrame:
    """A table of before projects were lists, and one of before there were any, brought to the present form."""
    old = table(s, d, "documents", "doc_id", "project").select("doc_id", F.get("project", F.lit(0)).alias("project"))
    both = S.evolve_projects(old).withColumn("form", F.lit("string")).unionByName(S.evolve_projects(old.drop("project")).withColumn("form", F.lit("absent")))
    both = both.unionByName(S.evolve_projects(table(s, d, "documents", "doc_id", "project")).withColumn("form", F.lit("list")))
    return both.select("form", "doc_id", F.coalesce(F.size("project"), F.lit(-1)).alias("n"), F.coalesce(F.get("project", F.lit(0)), F.lit("")).alias("head"))


def file_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks of the file of smallest name in the repository that has most, in order."""
    df = table(s, d, "code_chunks", "id", "repo_path", "file_path", "chunk_index", "project")
    repo = df.groupBy("repo_path").count().orderBy(F.desc("count"), "repo_path").first()
    path = df.where(F.col("repo_path") == repo["repo_path"]).agg(F.min("file_path")).first()[0] if repo else ""
    return R.file_chunks(df, repo["repo_path"] if repo else "", path).select("id", "chunk_index")


def rerank_overlap(s: SparkSession, d: str) -> DataFrame:
    """A pool of issues by date, reranked by the query's words that each holds."""
    pool = table(s, d, "github_issues", "id", "content", "created_at").orderBy(F.desc("created_at"), "id").limit(40)
    out = rerank(pool.withColumn("rrf_score", F.unix_timestamp("created_at").cast("double")), "the cache is stale and the snapshot late", "content", word_overlap, 10)
    return out.select("id", F.round("rerank_score", 6).alias("score"))


def symbols(s: SparkSession, d: str) -> DataFrame:
    return C.symbols(table(s, d, "code_chunks", "id", "content", "language"), "id", "content", "language")


def project_overlap(s: SparkSession, d: str) -> DataFrame:
    """Rows visible to the two projects that most rows name."""
    df = table(s, d, "documents", "doc_id", "project")
    top = [r.p for r in df.select(F.explode("project").alias("p")).where("p IS NOT NULL").groupBy("p").count().orderBy(F.desc("count"), "p").limit(2).collect()]
    return df.where(T.in_projects(F.col("project"), top or ["none"])).select("doc_id")


def project_merge(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "documents", "doc_id", "project", "source")
    extra = F.when(F.col("source").isNotNull(), F.array("source"))
    return df.select("doc_id", F.array_join(T.merge_projects(F.col("project"), extra), ",").alias("projects"))


def _issue_states(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = table(s, d, "github_issues", "id", "repo", "number", "state", "title", "content_hash", "indexed_at")
    order = [F.col("indexed_at"), F.col("id")]
    cut = F.lit(CUT).cast("timestamp_ntz")
    return S.newest(df.where(F.col("indexed_at") < cut), ("repo", "number"), order), S.newest(df.where(F.col("indexed_at") >= cut), ("repo", "number"), order)


def upsert_conditional(s: SparkSession, d: str) -> DataFrame:
    """Issues delivered after the cut merged into those before it, where their hash differs."""
    old, new = _issue_states(s, d)
    return S.upsert(old, new, ("repo", "number"), when=S.hash_differs).select("repo", "number", "state", "content_hash", "id")


def upsert_always(s: SparkSession, d: str) -> DataFrame:
    old, new = _issue_states(s, d)
    return S.upsert(old, new, ("repo", "number"), ("state", "title")).select("repo", "number", "state", "title", "content_hash")


def insert_ignore(s: SparkSession, d: str) -> DataFrame:
    old, new = _issue_states(s, d)
    return S.insert_ignore(old, new, ("repo", "number")).select("repo", "number", "id")


def distinct_on_first(s: SparkSession, d: str) -> DataFrame:
    return S.first_chunk_state(table(s, d, "code_chunks", "id", "repo_path", "file_path", "chunk_index", "file_mtime", "content_hash")).withColumn("file_mtime", F.coalesce("file_mtime", F.lit(-1)))


def _snapshots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = table(s, d, "code_chunks", "id", "repo_path", "file_path", "file_mtime", "content_hash", "indexed_at")
    cut = F.lit(FILE_CUT).cast("timestamp_ntz")
    keys = ("repo_path", "file_path")
    last = lambda x: S.newest(x, keys, [F.col("indexed_at"), F.col("id")])
    return last(df), last(df.where(F.col("indexed_at") < cut))


def incremental_classify(s: SparkSession, d: str) -> DataFrame:
    """Status of every file against what was stored before the cut."""
    now, was = _snapshots(s, d)
    return S.classify(now.select("repo_path", "file_path", "file_mtime", "content_hash"), was, ("repo_path", "file_path")).select("repo_path", "file_path", "status")


def status_counts(s: SparkSession, d: str) -> DataFrame:
    return incremental_classify(s, d).groupBy("status").agg(F.count("*").alias("n_files"))


def touch_mtime(s: SparkSession, d: str) -> DataFrame:
    now, was = _snapshots(s, d)
    return S.touch_mtime(was, now, ("repo_path", "file_path")).select("repo_path", "file_path", F.coalesce("file_mtime", F.lit(-1)).alias("file_mtime"))


def old_versions(s: SparkSession, d: str) -> DataFrame:
    """Each package stands beside an earlier version of a third of them."""
    now = table(s, d, "repo_index", "repo_path", "source_kind", "package_name", "indexed_at")
    was = now.where(F.length("repo_path") % 3 == 0).withColumn("repo_path", F.concat("repo_path", F.lit("-old"))).withColumn("indexed_at", F.col("indexed_at") - F.expr("INTERVAL 1 DAY"))
    return S.old_versions(now.unionByName(was))


def prune_counts(s: SparkSession, d: str) -> DataFrame:
    """Rows of each table that pruning all local repositories would remove."""
    local = table(s, d, "repo_index", "repo_path", "source_kind").where("source_kind = 'local'")
    gone = S.prune({n: table(s, d, n, "repo_path") for n in ("code_chunks", "documents", "repo_index")}, local, dry_run=True)
    return reduce(lambda a, b: a.unionByName(b), [t.select(F.lit(n).alias("table_name"), "n_rows") for n, t in gone.items()])


def prune_rest(s: SparkSession, d: str) -> DataFrame:
    local = table(s, d, "repo_index", "repo_path", "source_kind").where("source_kind = 'local'")
    return S.prune({"c": table(s, d, "code_chunks", "id", "repo_path")}, local)["c"].select("id")


def repo_index_backfill(s: SparkSession, d: str) -> DataFrame:
    p = F.col("repo_path")
    df = table(s, d, "code_chunks", "repo_path", "indexed_at").groupBy("repo_path").agg(F.max("indexed_at").alias("indexed_at"))
    return df.select("repo_path", T.source_kind(p).alias("source_kind"), T.package_name(p).alias("package_name"), T.package_version(p).alias("version"), T.git_url(p).alias("git_url"), T.git_rev(p).alias("git_rev"), "indexed_at")


def entity_counts(s: SparkSession, d: str) -> DataFrame:
    names = ("code_chunks", "documents", "github_issues", "github_issue_comments", "repo_index", "sync_state")
    return reduce(lambda a, b: a.unionByName(b), [table(s, d, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("entity"), "n_rows") for n in names])


def index_listing(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "repo_index", "repo_path", "source_kind", "package_name", "version", "indexed_at").where("source_kind <> 'local'").orderBy(F.desc("indexed_at"), "repo_path")


def sync_status(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sync_state", "source_name", "scope_key", "watermark", "error_count", "last_error", "updated_at").orderBy(F.desc("updated_at"), "scope_key")


def watermark_max(s: SparkSession, d: str) -> DataFrame:
    """Latest watermark by instant of each source, in its own spelling."""
    df = table(s, d, "sync_state", "source_name", "scope_key", "watermark").withColumn("at", T.parse_time(F.col("watermark"))).where("at IS NOT NULL")
    return df.groupBy("source_name").agg(F.max("at").cast("timestamp_ntz").alias("latest"))


def watermark_filter(s: SparkSession, d: str) -> DataFrame:
    """Issues updated after their stream's watermark; unknown times and streams without one pass."""
    marks = table(s, d, "sync_state", "scope_key", "watermark").select(F.regexp_extract("scope_key", "^(.*):issues$", 1).alias("repo"), T.parse_time(F.col("watermark")).cast("timestamp_ntz").alias("wm")).where("repo <> ''")
    df = table(s, d, "github_issues", "id", "repo", "updated_at").join(marks, "repo", "left")
    return df.where("wm IS NULL OR updated_at IS NULL OR updated_at > wm").select("id")


def error_upsert(s: SparkSession, d: str) -> DataFrame:
    state = table(s, d, "sync_state")
    scope = state.orderBy("scope_key").first()["scope_key"]
    out = S.record_error(state, "github", scope, "é" * 700, F.lit("2026-06-02 00:00:00").cast("timestamp_ntz"))
    out = S.record_error(out, "github", "new/one:issues", "boom", F.lit("2026-06-02 00:00:00").cast("timestamp_ntz"))
    return out.select("source_name", "scope_key", "watermark", "error_count", F.coalesce(F.length("last_error"), F.lit(0)).alias("n_error"))


def watermark_upsert(s: SparkSession, d: str) -> DataFrame:
    state = table(s, d, "sync_state")
    scope = state.orderBy("scope_key").first()["scope_key"]
    out = S.set_watermark(state, "github", scope, "2026-06-03T00:00:00Z", F.lit("2026-06-03 00:00:00").cast("timestamp_ntz"))
    return out.select("source_name", "scope_key", "watermark", "error_count", "last_error")


def label_lists(s: SparkSession, d: str) -> DataFrame:
    """Labels as rows and joined again."""
    df = table(s, d, "github_issues", "id", "labels").where("labels IS NOT NULL AND labels <> ''")
    return df.select("id", F.explode(F.split("labels", ", ")).alias("label")).groupBy("label").agg(F.count("*").alias("n_issues"))


def issue_number_parse(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "github_issue_comments", "id", "repo", "issue_number")
    url = F.concat(F.lit("https://api.example/repos/"), "repo", F.lit("/issues/"), F.col("issue_number").cast("string"))
    return df.select("id", T.issue_number(url).alias("number"))


def json_shape_filter(s: SparkSession, d: str) -> DataFrame:
    """Events whose payload has an integer k and no nested object p."""
    df = table(s, d, "events", "event_id", "props")
    j = F.from_json("props", "k INT, p STRUCT<u: STRING>")
    return df.select("event_id", j.alias("j")).where("j.k IS NOT NULL AND j.p IS NULL").select("event_id", F.col("j.k").alias("k"))


def sync_shape(s: SparkSession, d: str) -> DataFrame:
    """Issues as an API delivers them, closed ones with a pull request in them, brought to rows: one for each number."""
    df = table(s, d, "github_issues", "number", "state", "title", "body", "author", "created_at", "updated_at")
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    pull = F.when(F.col("state") == "closed", F.struct(F.lit("https://api.example/pulls/1").alias("url"))).alias("pull_request")
    item = F.struct("number", "state", "title", "body", F.struct(F.col("author").alias("login")).alias("user"), time("created_at"), time("updated_at"), pull)
    out = sync.shape(df.select(F.to_json(item).alias("item")), "issues", "o/r")
    return out.select("repo", "number", "state", "author", "updated_raw", "content_hash")


def like_filter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "code_chunks", "id", "repo_path").where(F.col("repo_path").like("crates.io::%-_.%")).select("id")


def min_length(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "github_issue_comments", "id", "content").where(F.octet_length(T.strip(F.col("content"))) >= 20).select("id")


def null_safe_changes(s: SparkSession, d: str) -> DataFrame:
    """Issues whose newest row has another hash than the oldest."""
    df = table(s, d, "github_issues", "id", "repo", "number", "content_hash", "indexed_at")
    order = F.struct("indexed_at", "id")
    g = df.groupBy("repo", "number").agg(F.struct(F.min_by("content_hash", order).alias("h")).alias("a"), F.struct(F.max_by("content_hash", order).alias("h")).alias("b"))
    return g.where(~F.col("a.h").eqNullSafe(F.col("b.h"))).select("repo", "number")


def package_check(s: SparkSession, d: str) -> DataFrame:
    """Whether a package is indexed at all and how many of its chunks a project sees."""
    df = table(s, d, "code_chunks", "repo_path", "project")
    named = df.where(T.package_name(F.col("repo_path"), pypi=True).isNotNull())
    return named.groupBy("repo_path").agg(F.count("*").alias("n_chunks"), F.sum(F.when(F.size("project") > 0, 1).otherwise(0)).alias("n_scoped"))


def array_insert(s: SparkSession, d: str) -> DataFrame:
    """Parallel arrays of at most a thousand values turned into rows, as a bulk insert takes them batch by batch."""
    df = table(s, d, "repo_index", "repo_path", "source_kind", "version").withColumn("batch", F.floor(F.monotonically_increasing_id() / 1000))
    df = df.groupBy("batch").agg(F.collect_list(F.struct("repo_path", "source_kind", "version")).alias("r"))
    df = df.select(*[F.col(f"r.{c}").alias(c) for c in ("repo_path", "source_kind", "version")])
    return df.select(F.inline(F.arrays_zip("repo_path", "source_kind", "version")))


def issue_contents(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "github_issues", "id", "title", "body")
    return df.select("id", F.sha2(T.issue_content(F.col("title"), F.col("body")), 256).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_classify, language_detect, markdown_title_preview, content_hash, query_sanitise, chunk_lines, chunk_code, chunk_code_cases, chunk_markdown, symbols, symbols_cases, repo_index_upsert, evolve_projects, file_chunks, rerank_overlap, project_overlap, project_merge, upsert_conditional, upsert_always,
        insert_ignore, distinct_on_first, incremental_classify, status_counts, touch_mtime, old_versions, prune_counts, prune_rest, repo_index_backfill, entity_counts, index_listing, sync_status, watermark_max, watermark_filter,
        error_upsert, watermark_upsert, label_lists, issue_number_parse, json_shape_filter, sync_shape, like_filter, min_length, null_safe_changes, package_check, array_insert, issue_contents,
    )
}

_SPACE = "\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def _cut(text: str, limit: int) -> str:
    """SQL: at most ``limit`` bytes of a text, no character cut."""
    return f"CASE WHEN strlen({text}) <= {limit} THEN {text} ELSE left({text}, CAST(list_max(list_filter(range(0, {limit} + 1), lambda n: strlen(left({text}, n)) <= {limit})) AS BIGINT)) END"


def _parts(name: str, source: str, text: str, mark: str, keys: str) -> str:
    """CTEs that cut a text before each line that begins with ``mark`` and has ink before it; ``{name}``: keys, part, content."""
    return f"""
{name}_l AS (SELECT {keys}, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT {keys}, string_split(regexp_replace(replace({text}, chr(13) || chr(10), chr(10)), chr(10) || '$', ''), chr(10)) AS ls FROM {source})),
{name}_f AS (SELECT *, coalesce(max(regexp_matches(line, '[^{_SPACE}]')::INT) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ink FROM {name}_l),
{name}_p AS (SELECT *, sum((starts_with(line, '{mark}') AND ink = 1)::INT) OVER (PARTITION BY {keys} ORDER BY i) AS part FROM {name}_f),
{name} AS (SELECT {keys}, part, string_agg(line || chr(10), '' ORDER BY i) AS content FROM {name}_p GROUP BY ALL HAVING bool_or(regexp_matches(line, '[^{_SPACE}]')))"""


def _written(rows: str, columns: str, kinds: str) -> str:
    quoted = [", ".join(x if k == "n" else f"'{x}'" for x, k in zip(r, kinds, strict=True)) for r in cases.values(rows)]
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in quoted)}) AS t({columns})"


_STATES = f"""
o AS (SELECT * FROM github_issues WHERE indexed_at < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY repo, number ORDER BY indexed_at DESC, id DESC) = 1),
n AS (SELECT * FROM github_issues WHERE indexed_at >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY repo, number ORDER BY indexed_at DESC, id DESC) = 1)"""
_SNAPSHOTS = f"""
n AS (SELECT * FROM code_chunks QUALIFY row_number() OVER (PARTITION BY repo_path, file_path ORDER BY indexed_at DESC, id DESC) = 1),
o AS (SELECT * FROM code_chunks WHERE indexed_at < TIMESTAMP '{FILE_CUT}' QUALIFY row_number() OVER (PARTITION BY repo_path, file_path ORDER BY indexed_at DESC, id DESC) = 1)"""
_CLASSIFY = f"""WITH {_SNAPSHOTS} SELECT n.repo_path, n.file_path, CASE WHEN o.repo_path IS NULL THEN 'index' WHEN n.file_mtime = o.file_mtime THEN 'skip_mtime'
  WHEN n.content_hash = o.content_hash THEN 'touch' ELSE 'reindex' END AS status
  FROM n LEFT JOIN o ON n.repo_path IS NOT DISTINCT FROM o.repo_path AND n.file_path IS NOT DISTINCT FROM o.file_path"""
_BASE = "regexp_extract(file_path, '[^/]*$')"
_PKG = "(starts_with(repo_path, 'hackage::') OR starts_with(repo_path, 'chap::') OR starts_with(repo_path, 'crates.io::'))"
_REST = "regexp_replace(repo_path, '^[^:]+::', '')"
_LANG = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items())

ORACLES = {
    "doc_classify": """WITH p AS (SELECT doc_id, '/' || replace(source_path, '\\', '/') AS p FROM documents)
SELECT doc_id, CASE WHEN ends_with(p, '/AGENTS.md') OR ends_with(p, '/CLAUDE.md') THEN 'agent_instruction'
  WHEN contains(p, '/.agent/workflows/') AND ends_with(p, '.md') THEN 'workflow' WHEN contains(p, '/.agent/skills/') AND ends_with(p, '.md') THEN 'skill'
  WHEN contains(lower(p), '/.agent/sops/') AND ends_with(p, '.md') THEN 'sop' WHEN contains(p, '/.agent/plans/') AND ends_with(p, '.md') THEN 'plan'
  WHEN ends_with(lower(p), '/.agent/readme.md') THEN 'agent_index' WHEN ends_with(lower(p), '/readme.md') THEN 'readme' ELSE 'docs' END AS kind FROM p""",
    "language_detect": f"""SELECT id, CASE WHEN {_BASE} IN ('cabal.project', 'cabal.project.freeze', 'cabal.project.local') THEN 'cabal'
  ELSE CASE lower(regexp_extract({_BASE}, '^.+\\.([^.]*)$', 1)) {_LANG} ELSE 'text' END END AS detected FROM code_chunks""",
    "content_hash": "SELECT doc_id, sha256(content) AS digest FROM documents",
    "query_sanitise": "SELECT id, trim(translate(title, '-+|*~^()\"\\', '          ')) AS query FROM github_issues",
    "chunk_lines": """WITH l AS (SELECT doc_id, string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), chr(10) || '$', ''), chr(10)) AS ls FROM documents WHERE length(content) > 0),
w AS (SELECT doc_id, ls, len(ls) AS n, unnest(range(0, len(ls), 105)) AS i FROM l),
c AS (SELECT doc_id, n, i + 1 AS start_line, least(i + 120, n) AS end_line, array_to_string(ls[i + 1 : i + 120], chr(10)) AS content FROM w),
v AS (SELECT *, coalesce(sum((end_line = n)::INT) OVER (PARTITION BY doc_id ORDER BY start_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM c WHERE regexp_matches(content, '[^\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]') AND strlen(content) <= 8000)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS chunk_index, start_line, end_line, sha256(content) AS digest FROM v WHERE done = 0 QUALIFY chunk_index < 256""",
    "project_overlap": """WITH top AS (SELECT p FROM (SELECT unnest(project) AS p FROM documents) WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 2)
SELECT doc_id FROM documents WHERE list_has_any(project, (SELECT list(p) FROM top))""",
    "project_merge": """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(coalesce(project, []), CASE WHEN source IS NULL THEN [] ELSE [source] END), lambda x: x IS NOT NULL))), ',') AS projects FROM documents""",
    "upsert_conditional": f"""WITH {_STATES} SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.number, n.number) AS number,
  CASE WHEN o.id IS NULL OR (n.id IS NOT NULL AND o.content_hash IS DISTINCT FROM n.content_hash) THEN n.state ELSE o.state END AS state,
  CASE WHEN o.id IS NULL OR (n.id IS NOT NULL AND o.content_hash IS DISTINCT FROM n.content_hash) THEN n.content_hash ELSE o.content_hash END AS content_hash,
  CASE WHEN o.id IS NULL OR (n.id IS NOT NULL AND o.content_hash IS DISTINCT FROM n.content_hash) THEN n.id ELSE o.id END AS id
FROM o FULL JOIN n ON o.repo = n.repo AND o.number = n.number""",
    "upsert_always": f"""WITH {_STATES} SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.number, n.number) AS number, CASE WHEN n.id IS NOT NULL THEN n.state ELSE o.state END AS state,
  CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN o.id IS NULL THEN n.content_hash ELSE o.content_hash END AS content_hash
FROM o FULL JOIN n ON o.repo = n.repo AND o.number = n.number""",
    "insert_ignore": f"WITH {_STATES} SELECT repo, number, id FROM o UNION ALL SELECT repo, number, id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.repo = n.repo AND o.number = n.number)",
    "distinct_on_first": "SELECT repo_path, file_path, coalesce(file_mtime, -1) AS file_mtime, content_hash FROM code_chunks WHERE content_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_path, file_path ORDER BY chunk_index, id) = 1",
    "incremental_classify": _CLASSIFY,
    "status_counts": f"SELECT status, count(*) AS n_files FROM ({_CLASSIFY}) GROUP BY status",
    "touch_mtime": f"""WITH {_SNAPSHOTS} SELECT o.repo_path, o.file_path, coalesce(CASE WHEN o.content_hash = n.content_hash AND o.file_mtime IS DISTINCT FROM n.file_mtime THEN n.file_mtime ELSE o.file_mtime END, -1) AS file_mtime
FROM o LEFT JOIN n ON n.repo_path IS NOT DISTINCT FROM o.repo_path AND n.file_path IS NOT DISTINCT FROM o.file_path""",
    "old_versions": "WITH x AS (SELECT repo_path, source_kind, package_name, indexed_at FROM repo_index UNION ALL SELECT repo_path || '-old', source_kind, package_name, indexed_at - INTERVAL 1 DAY FROM repo_index WHERE length(repo_path) % 3 = 0) SELECT repo_path FROM x r WHERE package_name IS NOT NULL AND indexed_at < (SELECT max(indexed_at) FROM x q WHERE q.source_kind = r.source_kind AND q.package_name = r.package_name)",
    "prune_counts": "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t} WHERE repo_path IN (SELECT repo_path FROM repo_index WHERE source_kind = 'local')" for t in ("code_chunks", "documents", "repo_index")),
    "prune_rest": "SELECT id FROM code_chunks c WHERE NOT EXISTS (SELECT 1 FROM repo_index r WHERE r.source_kind = 'local' AND r.repo_path = c.repo_path)",
    "repo_index_backfill": f"""SELECT repo_path, CASE WHEN starts_with(repo_path, 'hackage::') THEN 'hackage' WHEN starts_with(repo_path, 'chap::') THEN 'chap' WHEN starts_with(repo_path, 'crates.io::') THEN 'crates.io'
  WHEN starts_with(repo_path, 'git::') THEN 'git' ELSE 'local' END AS source_kind,
  CASE WHEN {_PKG} AND regexp_matches({_REST}, '^.*-[0-9]') THEN regexp_extract({_REST}, '^(.*)-[0-9]', 1) END AS package_name,
  CASE WHEN {_PKG} AND regexp_matches({_REST}, '^.*-[0-9]') THEN regexp_extract({_REST}, '^.*-([0-9].*)$', 1) END AS version,
  CASE WHEN starts_with(repo_path, 'git::') THEN regexp_replace(substr(repo_path, 6), '@[^@]+$', '') END AS git_url,
  CASE WHEN starts_with(repo_path, 'git::') AND regexp_matches(repo_path, '@[^@]+$') THEN regexp_extract(repo_path, '@([^@]+)$', 1) END AS git_rev, max(indexed_at) AS indexed_at FROM code_chunks GROUP BY repo_path""",
    "entity_counts": "\nUNION ALL\n".join(f"SELECT '{t}' AS entity, count(*) AS n_rows FROM {t}" for t in ("code_chunks", "documents", "github_issues", "github_issue_comments", "repo_index", "sync_state")),
    "index_listing": "SELECT repo_path, source_kind, package_name, version, indexed_at FROM repo_index WHERE source_kind <> 'local'",
    "sync_status": "SELECT source_name, scope_key, watermark, error_count, last_error, updated_at FROM sync_state",
    "error_upsert": """WITH k AS (SELECT min(scope_key) AS k FROM sync_state)
SELECT source_name, scope_key, watermark, CASE WHEN scope_key = k AND source_name = 'github' THEN error_count + 1 ELSE error_count END AS error_count, CASE WHEN scope_key = k AND source_name = 'github' THEN 500 ELSE coalesce(length(last_error), 0) END AS n_error FROM sync_state, k
UNION ALL SELECT 'github', 'new/one:issues', NULL, 1, 4""",
    "watermark_upsert": """WITH k AS (SELECT min(scope_key) AS k FROM sync_state)
SELECT source_name, scope_key, CASE WHEN scope_key = k THEN '2026-06-03T00:00:00Z' ELSE watermark END AS watermark, CASE WHEN scope_key = k THEN 0 ELSE error_count END AS error_count, CASE WHEN scope_key = k THEN NULL ELSE last_error END AS last_error FROM sync_state, k""",
    "watermark_max": "SELECT source_name, max(strptime(replace(watermark, 'Z', '+00:00'), '%Y-%m-%dT%H:%M:%S%z') AT TIME ZONE 'UTC') AS latest FROM sync_state WHERE watermark IS NOT NULL GROUP BY source_name",
    "watermark_filter": """WITH m AS (SELECT regexp_extract(scope_key, '^(.*):issues$', 1) AS repo, strptime(replace(watermark, 'Z', '+00:00'), '%Y-%m-%dT%H:%M:%S%z') AT TIME ZONE 'UTC' AS wm FROM sync_state)
SELECT id FROM github_issues i LEFT JOIN (SELECT * FROM m WHERE repo <> '') m ON m.repo = i.repo WHERE wm IS NULL OR updated_at IS NULL OR updated_at > wm""",
    "label_lists": "SELECT label, count(*) AS n_issues FROM (SELECT unnest(string_split(labels, ', ')) AS label FROM github_issues WHERE labels IS NOT NULL AND labels <> '') GROUP BY label",
    "issue_number_parse": "SELECT id, CAST(issue_number AS BIGINT) AS number FROM github_issue_comments",
    "json_shape_filter": "SELECT event_id, CAST(regexp_extract(props, '\"k\": (-?[0-9]+)', 1) AS INTEGER) AS k FROM events WHERE regexp_matches(props, '\"k\": -?[0-9]+')",
    "like_filter": "SELECT id FROM code_chunks WHERE repo_path LIKE 'crates.io::%-_.%'",
    "min_length": "SELECT id FROM github_issue_comments WHERE strlen(regexp_replace(regexp_replace(content, '^[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ''), '[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '')) >= 20",
    "null_safe_changes": """WITH x AS (SELECT repo, number, content_hash, row_number() OVER (PARTITION BY repo, number ORDER BY indexed_at, id) AS a, row_number() OVER (PARTITION BY repo, number ORDER BY indexed_at DESC, id DESC) AS z FROM github_issues)
SELECT f.repo, f.number FROM x f JOIN x l ON f.repo = l.repo AND f.number = l.number AND f.a = 1 AND l.z = 1 WHERE f.content_hash IS DISTINCT FROM l.content_hash""",
    "package_check": f"""SELECT repo_path, count(*) AS n_chunks, CAST(sum(CASE WHEN len(project) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_scoped FROM code_chunks
WHERE ({_PKG} OR starts_with(repo_path, 'pypi::')) AND regexp_matches({_REST}, '^.*-[0-9]') GROUP BY repo_path""",
    "issue_contents": """WITH x AS (SELECT id, regexp_replace(regexp_replace(title, '^SP+', ''), 'SP+$', '') AS t, regexp_replace(regexp_replace(coalesce(body, ''), '^SP+', ''), 'SP+$', '') AS b FROM github_issues)
SELECT id, sha256(CASE WHEN b = '' THEN t ELSE t || chr(10) || chr(10) || b END) AS digest FROM x""".replace("SP", "[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"),
    "array_insert": "SELECT repo_path, source_kind, version FROM repo_index",
}
ORACLES |= {
    "markdown_title_preview": f"""SELECT doc_id, CASE WHEN regexp_matches(content, '(?m)^[ \\t]*# ')
    THEN regexp_replace(regexp_replace(regexp_extract(content, '(?m)^[ \\t]*# (.*?)[ \\t\\r]*$', 1), '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '')
    ELSE regexp_replace(regexp_extract(source_path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') END AS head, {_cut("p", 280)} AS short
FROM (SELECT *, trim(regexp_replace(content, '[{_SPACE}]+', ' ', 'g')) AS p FROM documents)""",
    "chunk_markdown": f"""WITH d AS (SELECT doc_id, content FROM documents WHERE length(content) > 0),
small AS (SELECT doc_id, 0 AS a, 0 AS b, content AS c FROM d WHERE strlen(content) <= 4000), big AS (SELECT * FROM d WHERE strlen(content) > 4000),{_parts("x", "big", "content", "## ", "doc_id")},
fit AS (SELECT doc_id, part AS a, 0 AS b, regexp_replace(content, '[{_SPACE}]+$', '') AS c FROM x WHERE strlen(content) <= 4000),
wide AS (SELECT doc_id, part AS a, content FROM x WHERE strlen(content) > 4000),{_parts("y", "wide", "content", "### ", "doc_id, a")},
cut AS (SELECT doc_id, a, part AS b, regexp_replace({_cut("content", 4000)}, '[{_SPACE}]+$', '') AS c FROM y),
everything AS (SELECT * FROM small UNION ALL SELECT * FROM fit UNION ALL SELECT * FROM cut)
SELECT doc_id, chunk_index, sha256(c) AS digest FROM (SELECT doc_id, c, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS INT) AS chunk_index FROM everything)
WHERE strlen(regexp_replace(regexp_replace(c, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '')) >= 50""",
    "symbols_cases": _written(cases.SYMBOLS, "id, name, kind, start_line, end_line", "nssnn"),
    "chunk_code_cases": _written(cases.CHUNKS, "id, chunk_index, start_line, end_line, kind", "nnnns"),
    "repo_index_upsert": f"""WITH n AS (SELECT repo_path, max(indexed_at) AS indexed_at, flatten(list(coalesce(project, []))) AS project FROM code_chunks GROUP BY repo_path),
k AS (SELECT *, CASE WHEN starts_with(repo_path, 'hackage::') THEN 'hackage' WHEN starts_with(repo_path, 'chap::') THEN 'chap' WHEN starts_with(repo_path, 'crates.io::') THEN 'crates.io'
  WHEN starts_with(repo_path, 'git::') THEN 'git' WHEN starts_with(repo_path, 'pypi::') THEN 'pypi' ELSE 'local' END AS source_kind,
  CASE WHEN ({_PKG} OR starts_with(repo_path, 'pypi::')) AND regexp_matches({_REST}, '^.*-[0-9]') THEN regexp_extract({_REST}, '^(.*)-[0-9]', 1) END AS package_name FROM n)
SELECT coalesce(o.repo_path, k.repo_path) AS repo_path, CASE WHEN k.repo_path IS NULL THEN o.source_kind ELSE k.source_kind END AS source_kind, CASE WHEN k.repo_path IS NULL THEN o.package_name ELSE k.package_name END AS package_name, o.version,
  CASE WHEN k.repo_path IS NULL THEN o.indexed_at ELSE k.indexed_at END AS indexed_at,
  coalesce(array_to_string(CASE WHEN k.repo_path IS NULL THEN o.project ELSE list_sort(list_distinct(list_filter(list_concat(coalesce(o.project, []), coalesce(k.project, [])), lambda v: v IS NOT NULL))) END, ','), '') AS projects
FROM repo_index o FULL JOIN k ON o.repo_path = k.repo_path""",
    "evolve_projects": """SELECT 'string' AS form, doc_id, CASE WHEN project[1] IS NULL THEN -1 ELSE 1 END AS n, coalesce(project[1], '') AS head FROM documents
UNION ALL SELECT 'absent', doc_id, -1, '' FROM documents UNION ALL SELECT 'list', doc_id, coalesce(len(project), -1), coalesce(project[1], '') FROM documents""",
    "file_chunks": """WITH r AS (SELECT repo_path FROM code_chunks GROUP BY 1 ORDER BY count(*) DESC, repo_path LIMIT 1), f AS (SELECT min(file_path) AS file_path FROM code_chunks WHERE repo_path = (SELECT repo_path FROM r))
SELECT id, chunk_index FROM code_chunks WHERE repo_path = (SELECT repo_path FROM r) AND file_path = (SELECT file_path FROM f)""",
    "rerank_overlap": f"""WITH p AS (SELECT * FROM github_issues ORDER BY created_at DESC NULLS LAST, id LIMIT 40), q AS (SELECT ['the', 'cache', 'is', 'stale', 'and', 'snapshot', 'late'] AS w)
SELECT id, round(len(list_filter(w, lambda x: list_contains(string_split_regex(lower(content), '[{_SPACE}]+'), x))) / 7.0, 6)::DOUBLE AS score FROM p, q ORDER BY score DESC, created_at DESC NULLS LAST, id LIMIT 10""",
    "sync_shape": f"""WITH x AS (SELECT *, regexp_replace(regexp_replace(title, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '') AS t, regexp_replace(regexp_replace(coalesce(body, ''), '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '') AS b FROM github_issues WHERE state IS DISTINCT FROM 'closed'),
h AS (SELECT *, sha256(CASE WHEN b = '' THEN t ELSE t || chr(10) || chr(10) || b END) AS h, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS u FROM x)
SELECT 'o/r' AS repo, number, state, author, u AS updated_raw, h AS content_hash FROM h QUALIFY row_number() OVER (PARTITION BY number ORDER BY u DESC NULLS LAST, h DESC) = 1""",
}
