"""Splitting oversized items at natural boundaries, with an overlap, by pointer doubling.

A text of more than ``limit`` UTF-8 bytes is cut into pieces of at most ``limit`` bytes. A cut lies
at the most natural boundary in the second half of what still fits: after a blank line, a line, a
sentence, white space, else between two characters. The next piece starts at the most natural boundary
that is between half of ``overlap`` and all of it before the cut, the earliest of its rank; where there is
none, at the first character in reach. So consecutive pieces share at least half of the overlap and at
most all of it, and the pieces without their overlaps add up to the text.

All boundaries get their successor (the cut of the piece that starts there, less the overlap) in one
vectorised pass; squaring the successor table doubles the steps it spans, so the greedy cuts that are
reachable from the start come out in logarithmically many passes, without walking piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.sources.tables import table

LIMITS = {"code_chunks": 8000, "documents": 4000}
OVERLAP = 200
#: Bytes of a text whose successor tables stand in memory at a time, some 60 bytes for each.
SEGMENT = 4_000_000
_SENTENCE = np.isin(np.arange(256), list(b".!?;:"))


def boundaries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut is allowed and the rank of each: 4 blank line, 3 line, 2 sentence, 1 space, 0 character."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    rank = np.full(n + 1, -1, np.int8)
    rank[:n][(b & 0xC0) != 0x80] = 0
    rank[n] = 4
    space = (b == 32) | (b == 9)
    newline = b == 10
    after = np.zeros(n + 1, bool)
    after[1:] = space
    rank[after] = 1
    if n > 1:
        after[:] = False
        after[2:] = space[1:] & _SENTENCE[b[:-1]]
        rank[after] = 2
    # an ideographic full stop ends a sentence without a space
    if n > 2:
        after[:] = False
        after[3:] = (b[:-2] == 0xE3) & (b[1:-1] == 0x80) & (b[2:] == 0x82)
        rank[after] = 2
    after[:] = False
    after[1:] = newline
    rank[after] = 3
    if n > 1:
        bare = b != 13
        before = np.zeros(n, bool)
        before[1:] = newline[:-1]
        if not bare.all():  # a blank line of CRLF text
            before[2:] |= newline[:-2] & ~bare[1:-1]
        after[:] = False
        after[1:] = newline & before
        rank[after] = 4
    at = np.flatnonzero(rank >= 0)
    return at, rank[at]


def _latest(at: np.ndarray, rank: np.ndarray, level: int) -> np.ndarray:
    """For each boundary index the latest index at or before it with at least that rank, -1 if none."""
    idx = np.where(rank >= level, np.arange(len(at)), -1)
    return np.maximum.accumulate(idx)


def successors(at: np.ndarray, rank: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each boundary the cut of the piece that starts there, and the start of the piece after it (as indices)."""
    n = len(at)
    i = np.arange(n)
    far = np.searchsorted(at, at + limit, "right") - 1
    cut = np.maximum(far, np.minimum(i + 1, n - 1))
    least = at + max(limit // 2, overlap + 4)
    chosen = far == n - 1
    for level in (4, 3, 2, 1):
        c = _latest(at, rank, level)[far]
        take = ~chosen & (c >= 0) & (at[np.maximum(c, 0)] >= least)
        cut[take] = c[take]
        chosen |= take
    # the next start: the most natural boundary in the far half of the overlap's range, the earliest of that rank
    low = np.searchsorted(at, at[cut] - overlap, "left")
    low = np.maximum(low, np.minimum(i + 1, n - 1))
    nxt = np.minimum(low, cut)
    near = at[cut] - (overlap + 1) // 2
    done = np.zeros(n, bool)
    for level in (4, 3, 2, 1):
        first = np.where(rank >= level, i, n)
        first = np.minimum.accumulate(first[::-1])[::-1][low]
        take = ~done & (first < cut) & (at[np.minimum(first, n - 1)] <= near)
        nxt[take] = first[take]
        done |= take
    nxt[cut == n - 1] = n - 1
    return cut, nxt


def starts(nxt: np.ndarray) -> np.ndarray:
    """Indices reachable from 0 along ``nxt``, whose last element is its own successor."""
    n = len(nxt)
    reached = np.zeros(n, bool)
    reached[0] = True
    count, jump = 1, nxt
    while True:
        reached[jump[reached]] = True
        now = int(reached.sum())
        if now == count:
            break
        count, jump = now, jump[jump]
    reached[n - 1] = n == 1
    return np.flatnonzero(reached)


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces of a text as (start byte, end byte, piece). A text within the limit is its only piece; an empty one has none.

    A long text is taken in segments; the pieces are those of the whole text.
    """
    if limit < 8 or overlap < 0 or overlap * 2 > limit:
        raise ValueError("the limit must be at least 8 bytes and twice the overlap")
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return []
    if len(data) <= limit:
        return [(0, len(data), text)]
    out: list[tuple[int, int, str]] = []
    start = 0
    while True:
        # a segment begins where a piece does, with the few bytes before it that tell what boundary that is
        low, high = max(0, start - 4), min(len(data), start + max(SEGMENT, 4 * limit))
        at, rank = boundaries(data[low:high])
        k = int(np.searchsorted(at, start - low))
        at, rank = at[k:], rank[k:]
        cut, nxt = successors(at, rank, limit, overlap)
        s = starts(nxt)
        # pieces that may reach the end of the segment are cut in the next one
        sure = len(s) if high == len(data) else int(np.searchsorted(at[s] + limit, high - low))
        for a in s[:sure]:
            x, y = low + int(at[a]), low + int(at[cut[a]])
            out.append((x, y, data[x:y].decode("utf-8", "surrogatepass")))
        if high == len(data):
            return out
        start = low + int(at[nxt[s[sure - 1]]])


def split_oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every row whose text has more than ``limit`` bytes: key, piece_index, start_byte, end_byte, piece.

    Null and empty texts and texts within the limit give no row (they need no splitting). Repeated
    keys are split each on its own. Only the key and the text leave the table, so other columns,
    whatever their names, don't matter. The size filter runs in the scan's stage; only oversized
    texts reach Python, in bounded batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, (a, b, piece) in enumerate(split(t, limit, overlap)):
                    for col, v in zip(cols, (k, n, a, b, piece), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                names=["key", "piece_index", "start_byte", "end_byte", "piece"],
            )

    big = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    return big.mapInArrow(run, "key long, piece_index int, start_byte long, end_byte long, piece string")


def _of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = "doc_id" if name == "documents" else "id"
    return split_oversized(table(spark, sf_dir, name, key, "content"), key, "content", LIMITS[name]).withColumn("record_table", F.lit(name))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized rows of both tables."""
    both = _of(spark, sf_dir, "code_chunks").unionByName(_of(spark, sf_dir, "documents"))
    return both.select("record_table", F.col("key").alias("record_id"), "piece_index", "start_byte", "end_byte", "piece")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that had to be split: those of which a second piece came out."""
    return p6_pieces(spark, sf_dir).where(F.col("piece_index") == 1).select("record_table", "record_id")


def p6_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split row the bytes that its pieces end at, and whether they are within the limit, in order, and leave nothing out."""
    p = p6_pieces(spark, sf_dir).groupBy("record_table", "record_id").agg(F.array_sort(F.collect_list(F.struct("piece_index", "start_byte", "end_byte", F.octet_length("piece").alias("n")))).alias("p"))
    limit = F.when(F.col("record_table") == "documents", LIMITS["documents"]).otherwise(LIMITS["code_chunks"])
    sized = F.forall("p", lambda x: (x["end_byte"] - x["start_byte"] == x["n"]) & (x["n"] <= limit))
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: (b["start_byte"] > a["start_byte"]) & (b["start_byte"] <= a["end_byte"]) & (a["end_byte"] - b["start_byte"] <= OVERLAP) & (b["end_byte"] > a["end_byte"]))
    whole = sized & F.forall(pairs, lambda x: x) & (F.get("p", F.lit(0))["start_byte"] == 0)
    return p.select("record_table", "record_id", F.element_at("p", -1)["end_byte"].alias("n_bytes"), whole.alias("whole"))


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces, "p6_cover": p6_cover}
ORACLES = {
    "p6_cover": "\nUNION ALL\n".join(
        f"SELECT '{t}' AS record_table, {'doc_id' if t == 'documents' else 'id'} AS record_id, CAST(strlen(content) AS BIGINT) AS n_bytes, TRUE AS whole FROM {t} WHERE strlen(content) > {n}"
        for t, n in LIMITS.items()
    ),
    "p6_found": "\nUNION ALL\n".join(
        f"SELECT '{t}' AS record_table, {'doc_id' if t == 'documents' else 'id'} AS record_id FROM {t} WHERE strlen(content) > {n}"
        for t, n in LIMITS.items()
    ),
}
