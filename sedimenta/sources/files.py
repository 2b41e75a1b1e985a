"""Source and documentation files below a folder.

A scan lists paths, sizes and times and reads no file; ``with_text`` then reads the files that are left
after folder rules, ignore rules and stored times have been applied.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.text import CABAL_PROJECTS, extension
from sedimenta.sources.tables import spread

# Extensions of code files, and names of folders that are not entered.
CODE_EXTENSIONS = [
    "hs", "rs", "py", "ts", "tsx", "js", "jsx", "nix", "go", "java", "scala", "ml", "mli", "c", "cpp", "h", "hpp", "sql", "sh", "toml", "yaml", "yml", "json", "tex", "cabal",
]
SKIPPED = ["target", "dist", "build", "__pycache__", ".stack-work", "vendor", ".cache", "result", ".direnv", "coverage", ".next", "out", "node_modules", ".git"]
DOC_SKIPPED = ["target", "dist", "build", "__pycache__", ".stack-work", ".git", ".direnv", "node_modules"]


def _ignore_regex(line: str, folder: str) -> tuple[str, bool] | None:
    """(pattern over relative paths, whether it ignores) of a line of an ignore file in ``folder``."""
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    ignore = not line.startswith("!")
    line = line.lstrip("!").replace("\\#", "#")
    only_folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out, i = "", 0
    line = line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
        elif line.startswith("**", i):
            out += ".*"
            i += 2
        elif line[i] == "*":
            out += "[^/]*"
            i += 1
        elif line[i] == "?":
            out += "[^/]"
            i += 1
        elif line[i] == "[" and "]" in line[i:]:
            j = line.index("]", i + 1)
            out += "[" + line[i + 1 : j].replace("!", "^", 1) + "]"
            i = j + 1
        else:
            out += re.escape(line[i])
            i += 1
    prefix = re.escape(folder + "/") if folder else ""
    head = "" if anchored else "(?:.*/)?"
    return f"^{prefix}{head}{out}{'/.*' if only_folder else '(?:/.*)?'}$", ignore


def ignore_rules(listed: DataFrame, root: str) -> list[tuple[str, bool]]:
    """Rules of the ignore files below ``root``, those of upper folders first; skipped folders have none."""
    rel = F.col("rel_path")
    named = F.substring_index(rel, "/", -1).isin(".gitignore", ".ignore") & _outside(rel, SKIPPED)
    rules: list[tuple[str, bool]] = []
    for path in sorted((r.rel_path for r in listed.where(named).select("rel_path").collect()), key=lambda p: (os.path.dirname(p).split("/"), p)):
        with open(os.path.join(root, path), errors="replace") as f:
            rules += [r for line in f if (r := _ignore_regex(line, os.path.dirname(path)))]
    return rules


def ignored(rel: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the rules leave a path out; the last one that matches decides."""
    if not rules:
        return F.lit(False)

    @F.pandas_udf("boolean")
    def verdict(paths: pd.Series) -> pd.Series:
        last_first = [(re.compile(p), v) for p, v in reversed(rules)]
        return paths.map(lambda x: next((v for p, v in last_first if p.search(x)), False))

    return verdict(rel)


def scan(spark: SparkSession, root: str, skip: list[str] | None = None) -> DataFrame:
    """rel_path, size, file_mtime (nanoseconds) and path of all files below a folder, hidden ones included.

    Folders named in ``skip`` are not entered. The driver lists the upper folders until there are several
    for each core, tasks walk what is below them; symbolic links to folders are not followed.
    """
    base, leave = os.path.abspath(root), frozenset(skip or ())
    wanted = 8 * spark.sparkContext.defaultParallelism
    tops, level = [], [base]
    while level and len(tops) + len(level) < wanted:
        # the files of a listed folder are its own row, its folders come next
        tops += [(d, False) for d in level]
        level = [e.path for d in level for e in _entries(d) if e.is_dir(follow_symlinks=False) and e.name not in leave]
    tops += [(d, True) for d in level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            out: list[tuple] = []
            while todo:
                folder, deep = todo.pop()
                for e in _entries(folder):
                    if e.is_dir(follow_symlinks=False):
                        if deep and e.name not in leave:
                            todo.append((e.path, True))
                    elif e.is_file():
                        st = e.stat()
                        out.append((os.path.relpath(e.path, base), st.st_size, st.st_mtime_ns, e.path))
                if out and (len(out) > 10_000 or not todo):
                    cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=["rel_path", "size", "file_mtime", "path"])
                    out = []

    rows = spark.createDataFrame(tops, "folder string, deep boolean").repartition(min(len(tops), wanted))
    return rows.mapInArrow(run, "rel_path string, size long, file_mtime long, path string")


def _entries(folder: str) -> list[os.DirEntry]:
    """Entries of a folder whose names are text; none if it is gone or may not be read."""
    try:
        with os.scandir(folder) as found:
            return [e for e in found if e.name.isprintable()]
    except OSError:
        return []


def _outside(rel: Column, folders: list[str]) -> Column:
    return ~rel.rlike("(?:^|/)(?:" + "|".join(re.escape(n) for n in folders) + ")(?:/|$)")


def _glob(pattern: str) -> str:
    return "^" + re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", ".*").replace(r"\?", ".") + "$"


def code_files(spark: SparkSession, root: str, extra: list[str] | None = None) -> DataFrame:
    """Code files: known extensions and project files, and paths that match an ``extra`` glob."""
    df = scan(spark, root, SKIPPED)
    rel = F.col("rel_path")
    wanted = extension(rel).isin(*CODE_EXTENSIONS) | F.substring_index(rel, "/", -1).isin(*CABAL_PROJECTS)
    for p in extra or []:
        wanted = wanted | rel.rlike(_glob(p))
    return df.where(wanted).where(~ignored(rel, ignore_rules(df, root)))


def doc_files(spark: SparkSession, root: str) -> DataFrame:
    df, rel = scan(spark, root, DOC_SKIPPED), F.col("rel_path")
    return df.where(extension(rel) == "md").where(~ignored(rel, ignore_rules(df, root)))


def with_text(files: DataFrame) -> DataFrame:
    """With ``text`` instead of ``content``, or of ``path``, whose file is read here and nowhere before.

    The text is null where the bytes are not valid UTF-8 or the file can no longer be read.
    """
    if "content" not in files.columns:
        kept = [c for c in files.columns if c != "path"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 100):
                    part = batch.slice(i, 100)
                    read = []
                    for p in part.column(len(kept)).to_pylist():
                        try:
                            with open(p, "rb") as f:
                                read.append(f.read())
                        except OSError:
                            read.append(None)
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(read, pa.binary())], names=[*kept, "content"])

        rows = spread(files.select(*kept, "path"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
        files = rows.mapInArrow(run, f"{schema}, content binary")
    return files.withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).drop("content")


def write_reconstructed(source: str, root: str, repo_path: str, file_path: str) -> str:
    """Write a rebuilt file below ``root`` and return its path; a path that leads out of it is refused."""
    safe = repo_path.replace("::", "__").replace(":", "_").replace("/", "_")
    base = os.path.realpath(os.path.join(root, safe))
    to = os.path.realpath(os.path.join(base, file_path))
    if os.path.isabs(file_path) or os.path.commonpath([base, to]) != base or to == base or safe in ("", ".", ".."):
        raise ValueError(f"unsafe path: {file_path}")
    os.makedirs(os.path.dirname(to), exist_ok=True)
    with open(to, "w") as f:
        f.write(source)
    return to
