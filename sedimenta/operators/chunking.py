"""Cutting files into chunks: line windows, symbols and Markdown sections.

Line windows are one native expression; symbol and Markdown chunks are made in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.symbols import extract_symbols, split_lines
from sedimenta.sources.tables import spread

WINDOW, OVERLAP = 120, 15
STEP = WINDOW - OVERLAP
MAX_BYTES = 8000
MAX_CHUNKS = 256
MARKDOWN_MAX, MARKDOWN_MIN = 4000, 50
#: Languages whose files are cut by symbols.
SYMBOL_LANGUAGES = frozenset("typescript javascript python rust haskell latex nix c cpp java kotlin".split())

Chunk = tuple[int, str, int, int, str | None]


def line_windows(lines: list[str]) -> list[Chunk]:
    """(index, content, first line, last line, None) of overlapping windows; blank and oversized ones are skipped."""
    out: list[Chunk] = []
    i = 0
    while i < len(lines) and len(out) < MAX_CHUNKS:
        end = min(i + WINDOW, len(lines))
        text = "\n".join(lines[i:end])
        if text.strip() and len(text.encode()) <= MAX_BYTES:
            out.append((len(out), text, i + 1, end, None))
            if end == len(lines):
                break
        i += STEP
    return out


def make_chunks(source: str, language: str | None) -> list[Chunk]:
    """Symbols of a source, and line windows over a long tail that they leave; windows alone without symbols."""
    lines = split_lines(source)
    symbols = extract_symbols(source, language) if language in SYMBOL_LANGUAGES else []
    if not symbols:
        return line_windows(lines)
    out: list[Chunk] = [(i, s.content, s.start_line, s.end_line, s.kind) for i, s in enumerate(symbols[:MAX_CHUNKS])]
    covered = max(s.end_line for s in symbols)
    if covered + 2 * WINDOW < len(lines):
        for i in range(max(0, covered - OVERLAP), len(lines), STEP):
            if len(out) >= MAX_CHUNKS:
                break
            end = min(i + WINDOW, len(lines))
            text = "\n".join(lines[i:end])
            if text.strip() and len(text.encode()) <= MAX_BYTES:
                out.append((len(out), text, i + 1, end, None))
    return out


def _cut(text: str, limit: int) -> str:
    return text.encode()[:limit].decode(errors="ignore")


def _sections(text: str, mark: str) -> list[str]:
    """Parts that begin at lines starting with ``mark``; each line ends with a line feed."""
    parts: list[str] = []
    now: list[str] = []
    for line in split_lines(text):
        if line.startswith(mark) and any(x.strip() for x in now):
            parts.append("".join(now))
            now = []
        now.append(line + "\n")
    if any(x.strip() for x in now):
        parts.append("".join(now))
    return parts or [text]


def markdown_chunks(source: str) -> list[str]:
    """The whole text if it fits, else its second-level sections; oversized ones by third level, cut to size.

    What a third-level section has beyond MARKDOWN_MAX bytes is left out, as the reading side expects; text that
    must be kept whole is to be cut by a splitter of training text.
    """
    if len(source.encode()) <= MARKDOWN_MAX:
        return [source]
    out = []
    for part in _sections(source, "## "):
        if not part.strip():
            continue
        if len(part.encode()) <= MARKDOWN_MAX:
            out.append(part.rstrip())
        else:
            out += [_cut(sub, MARKDOWN_MAX).rstrip() for sub in _sections(part, "### ") if sub.strip()]
    return out or [_cut(source, MARKDOWN_MAX)]


def chunk_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk_index, content, start_line, end_line: line windows of every row, without Python.

    A null or empty text has none. A window counts only if no counted window before it reached the end.
    """
    lines = F.split(F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), r"\n\z", ""), "\n", -1)
    base = df.where(F.length(text) > 0).select(F.col(key), lines.alias("ls"))
    window = lambda i: F.struct((i + 1).alias("start_line"), F.least(i + WINDOW, F.size("ls")).alias("end_line"), F.array_join(F.slice("ls", i + 1, WINDOW), "\n").alias("content"))
    w = base.select(key, F.size("ls").alias("n"), F.transform(F.sequence(F.lit(0), F.size("ls") - 1, F.lit(STEP)), window).alias("w"))
    usable = F.filter("w", lambda x: x["content"].rlike(r"(?U)\S") & (F.octet_length(x["content"]) <= MAX_BYTES))
    w = w.select(key, "n", F.explode(F.array(usable)).alias("w"))
    # all that end before the last line, and the first that reaches it; windows are numbered within their row
    open_, closed = F.filter("w", lambda x: x["end_line"] < F.col("n")), F.filter("w", lambda x: x["end_line"] == F.col("n"))
    w = w.select(key, F.posexplode(F.slice(F.concat(open_, F.slice(closed, 1, 1)), 1, MAX_CHUNKS)).alias("chunk_index", "x"))
    return w.select(key, "chunk_index", "x.content", "x.start_line", "x.end_line")


def _batches(df: DataFrame, make, columns: list[Column], schema: str, kinds: list[pa.DataType], names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for made in make(*row):
                    for col, v in zip(out, made, strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return spread(df.select(*columns)).mapInArrow(run, schema)


def chunk_code(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """key (as bigint), chunk_index, content, start_line, end_line, symbol_kind of every row's chunks."""
    names = ["key", "chunk_index", "content", "start_line", "end_line", "symbol_kind"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    cols = [F.col(key).cast("long").alias("key"), F.col(text).alias("t"), F.col(language).alias("l")]
    return _batches(df.where(F.length(text) > 0), lambda k, t, lang: [(k, *c) for c in make_chunks(t, lang)], cols, "key long, chunk_index int, content string, start_line int, end_line int, symbol_kind string", kinds, names)


def chunk_markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    """key (as bigint), chunk_index and content; chunks of less than MARKDOWN_MIN trimmed bytes are left out, indices stay."""
    keep = lambda k, t: [(k, i, c) for i, c in enumerate(markdown_chunks(t)) if len(c.strip().encode()) >= MARKDOWN_MIN]
    cols = [F.col(key).cast("long").alias("key"), F.col(text).alias("t")]
    return _batches(df.where(F.length(text) > 0), keep, cols, "key long, chunk_index int, content string", [pa.int64(), pa.int32(), pa.string()], ["key", "chunk_index", "content"])


def symbols(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """key (as bigint), name, kind, start_line, end_line of every row's symbols."""
    make = lambda k, t, lang: [(k, s.name, s.kind, s.start_line, s.end_line) for s in extract_symbols(t, lang or "")]
    cols = [F.col(key).cast("long").alias("key"), F.col(text).alias("t"), F.col(language).alias("l")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    return _batches(df.where(F.length(text) > 0), make, cols, "key long, name string, kind string, start_line int, end_line int", kinds, ["key", "name", "kind", "start_line", "end_line"])
