"""Text expressions: all built-in column functions, so that they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters with a meaning in full-text query syntax.
QUERY_SYNTAX = "-+|*~^()\"\\"

#: Language of a file by its lower-case extension.
LANGUAGES = {
    "hs": "haskell", "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "nix": "nix", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "ml": "ocaml", "mli": "ocaml", "c": "c",
    "h": "c", "cpp": "cpp", "hpp": "cpp", "sql": "sql", "tex": "latex", "sh": "bash", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json",
    "cabal": "cabal",
}
#: Project files of one build tool, by their whole name.
CABAL_PROJECTS = ("cabal.project", "cabal.project.freeze", "cabal.project.local")

WORD_PATTERN = r"[\p{L}\p{N}]+"


def sanitise(query: Column) -> Column:
    """The query with syntax characters turned into spaces, trimmed."""
    return F.trim(F.translate(query, QUERY_SYNTAX, " " * len(QUERY_SYNTAX)))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null for null, empty for a text without any."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a query, in order, as ``tokens`` cuts them."""
    import regex

    return list(dict.fromkeys(regex.findall(WORD_PATTERN, query.lower())))


def collapse(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def byte_truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, never cutting a character: the longest of four cuts that is valid."""
    raw = F.encode(text, "utf-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, limit - i).cast("string")) for i in range(min(4, limit))]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.when(text.isNotNull(), F.coalesce(*cuts, F.lit(""))))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension of the last path part, '' if it has none (a leading dot is no extension)."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def language(path: Column) -> Column:
    """Language by file name: whole names first, then the extension, else ``text``."""
    by_extension = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(basename(path).isin(*CABAL_PROJECTS), "cabal").otherwise(F.coalesce(F.try_element_at(by_extension, extension(path)), F.lit("text")))


def doc_kind(path: Column) -> Column:
    """Kind of a documentation file by its path below the repository; the first rule that holds decides."""
    p = F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")))
    low, md = F.lower(p), p.endswith(".md")
    agent = lambda folder: p.contains(f"/.agent/{folder}/") & md
    return (
        F.when(p.endswith("/AGENTS.md") | p.endswith("/CLAUDE.md"), "agent_instruction")
        .when(agent("workflows"), "workflow")
        .when(agent("skills"), "skill")
        .when(low.contains("/.agent/sops/") & md, "sop")
        .when(agent("plans"), "plan")
        .when(low.endswith("/.agent/readme.md"), "agent_index")
        .when(low.endswith("/readme.md"), "readme")
        .otherwise("docs")
    )


def title(text: Column, path: Column) -> Column:
    """First line that starts with one hash sign and a blank, else the file's stem."""
    stem = F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
    head = F.regexp_extract(text, r"(?m)^[ \t]*# (.*?)[ \t\r]*$", 1)
    return F.when(F.regexp_like(text, F.lit(r"(?m)^[ \t]*# ")), strip(head)).otherwise(stem)


def preview(text: Column, limit: int = 280) -> Column:
    return byte_truncate(collapse(text), limit)


def content_hash(text: Column) -> Column:
    """SHA-256 in hexadecimal digits of the UTF-8 bytes."""
    return F.sha2(F.encode(text, "utf-8"), 256)


def issue_content(title_: Column, body: Column) -> Column:
    """Title, a blank line and the trimmed body; the title alone if the body is null or blank."""
    b = strip(F.coalesce(body, F.lit("")))
    t = strip(title_)
    return F.when(b == "", t).otherwise(F.concat(t, F.lit("\n\n"), b))


def parse_time(text: Column) -> Column:
    """RFC 3339 time as a timestamp, null if it is none."""
    return F.try_to_timestamp(text)


def source_kind(repo_path: Column, pypi: bool = False) -> Column:
    """Kind of source by the tag before ``::``; without ``pypi`` such paths count as local."""
    out = F.when(F.lit(False), "")
    for k in ("hackage", "chap", "crates.io", "git") + (("pypi",) if pypi else ()):
        out = out.when(repo_path.startswith(f"{k}::"), k)
    return out.otherwise("local")


def package_name(repo_path: Column, pypi: bool = False) -> Column:
    """Package of a registry path, null for others and where no version follows."""
    return _package_part(repo_path, r"^(.*)-[0-9]", pypi)


def package_version(repo_path: Column, pypi: bool = False) -> Column:
    return _package_part(repo_path, r"^.*-([0-9].*)$", pypi)


def _package_part(repo_path: Column, pattern: str, pypi: bool) -> Column:
    rest = F.regexp_replace(repo_path, r"^[^:]+::", "")
    registry = source_kind(repo_path, pypi).isin("hackage", "chap", "crates.io", "pypi")
    return F.when(registry & F.regexp_like(rest, F.lit(pattern)), F.regexp_extract(rest, pattern, 1))


def git_url(repo_path: Column) -> Column:
    return F.when(repo_path.startswith("git::"), F.regexp_replace(F.substring(repo_path, 6, 1 << 30), r"@[^@]+$", ""))


def git_rev(repo_path: Column) -> Column:
    pattern = r"@([^@]+)$"
    return F.when(repo_path.startswith("git::") & F.regexp_like(repo_path, F.lit(pattern)), F.regexp_extract(repo_path, pattern, 1))


def merge_projects(a: Column, b: Column) -> Column:
    """Sorted union of two lists of projects without nulls, null if there is none."""
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_compact(F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))))
    return F.when(F.size(both) > 0, both)


def in_projects(column: Column, projects: list[str] | None) -> Column:
    """Whether a row is visible to the projects; all rows without projects, none with a null list."""
    if not projects:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(column, F.array(*[F.lit(p) for p in projects])), F.lit(False))


def issue_number(url: Column) -> Column:
    """Number at the end of an API address, null if there is none."""
    return F.substring_index(url, "/", -1).try_cast("long")
