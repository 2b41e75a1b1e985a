"""Evaluation texts that leaked into a corpus, found with an FM-index for each shard.

Words are runs of letters and digits after markup is taken off, look-alike characters are made one
and case is folded. The items' words are the alphabet; every other word of the corpus is a separator,
and stretches of fewer than ``least`` known words cannot hold a passage, so they leave before the
index is built. Over what remains of a shard (a bounded number of words) stand a suffix array, the
Burrows-Wheeler transform, a wavelet tree that counts symbols in prefixes of it, and a sample of the
suffix positions.

Every run of ``least`` words of an item is a phrase. All phrases search backward together, one word a
step; the rows of a phrase's range walk back to a sampled suffix, which tells the document and the
word. Occurrences that touch are merged into one span of an item in a document.
"""

from __future__ import annotations

import html
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.lookalikes import INVISIBLE, canonical
from sedimenta.sources.shared import put_shared_file, shared_dir
from sedimenta.sources.tables import spread, table

#: Consecutive words that make a leak.
LEAST = 16
#: Known words that one index holds; a shard with more is indexed in several parts.
INDEX_WORDS = 400_000
#: Every so many-th position of the text is kept for locating.
SAMPLE = 16
#: Characters of documents with known words that a shard holds at most.
INDEX_CHARS = 32_000_000
#: Phrases that are searched at a time.
PHRASES = 200_000

_BREAKING = re.compile(r"</?(?:br|p|div|li|ul|ol|td|th|tr|table|h[1-6]|hr|pre|blockquote|dd|dt|dl|section|article)\b[^<>]*>|<!--|-->", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_LINK = re.compile(r"\]\([^()\s]*(?:\s+\"[^\"]*\")?\)|\]\[[^\[\]\n]*\]|\[\[[^\[\]|\n]*\||\[(?:https?|ftp)://[^\s\]]*|\{\{[^{}|\n]*\|")
_TEX = re.compile(r"\\(?:begin|end|label|ref|cite|url|includegraphics)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}|\\href\{[^{}\n]*\}|\\[A-Za-z]+\*?")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_WORDS = re.compile(r"[^\W_]+")
_RAW_WORD = re.compile(f"(?:[^\\W_]|(?<=\\w)[\\u0300-\\u036f{INVISIBLE}])+")


def _kept(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text without markup, and where each stretch of it stood: (position in the result, in the text)."""
    cuts: list[tuple[int, int, str]] = []
    if "<" in text:
        cuts += [(m.start(), m.end(), " ") for m in _BREAKING.finditer(text)]
        cuts += [(m.start(), m.end(), "") for m in _TAG.finditer(text)]
    if "[" in text or "{{" in text:
        cuts += [(m.start(), m.end(), " ") for m in _LINK.finditer(text)]
    if "\\" in text:
        cuts += [(m.start(), m.end(), " ") for m in _TEX.finditer(text)]
    if "&" in text:
        cuts += [(m.start(), m.end(), html.unescape(m.group())) for m in _ENTITY.finditer(text)]
    if not cuts:
        return text, [(0, 0)]
    out, where, at, n = [], [], 0, 0
    for a, b, put in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if a < at:
            continue
        where.append((n, at))
        out += [text[at:a], put]
        n += a - at + len(put)
        at = b
    where.append((n, at))
    out.append(text[at:])
    return "".join(out), where


def words(text: str) -> list[str]:
    """The words of a text as they are compared."""
    return _WORDS.findall(canonical(_kept(text)[0]).casefold())


def word_places(text: str) -> list[tuple[int, int]]:
    """Where each word of ``words(text)`` stands in the text itself (start, end)."""
    plain, where = _kept(text)
    at = np.array([w[0] for w in where])
    back = np.array([w[1] for w in where])

    def place(p: int) -> int:
        k = int(np.searchsorted(at, p, "right")) - 1
        return int(back[k] + p - at[k])

    spans = [(m.start(), m.end()) for m in _RAW_WORD.finditer(plain)]
    return [(place(a), place(b - 1) + 1) for a, b in spans]


class FMIndex:
    """Counts and places of phrases in a sequence of symbols 1..sigma-1 that ends with its only 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        sa = _suffix_array(text)
        sampled = sa % SAMPLE == 0
        sampled[0] = True
        self._fill(text[sa - 1], sampled, sa[sampled], sigma)

    @classmethod
    def restore(cls, bwt: np.ndarray, packed: np.ndarray, sample: np.ndarray, sigma: int) -> FMIndex:
        """The index from its transform and sampled positions."""
        one = cls.__new__(cls)
        one._fill(bwt, np.unpackbits(packed, count=len(bwt)).astype(bool), sample, sigma)
        return one

    def _fill(self, bwt: np.ndarray, sampled: np.ndarray, sample: np.ndarray, sigma: int) -> None:
        n = self.n = len(bwt)
        self.c = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(bwt, minlength=sigma), out=self.c[1:])
        # wavelet tree, level by level: a stable partition by one bit, with the count of ones before each place
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        seq = bwt
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[n]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.bwt = bwt
        self.sampled_before = np.zeros(n + 1, np.int32)
        np.cumsum(sampled, out=self.sampled_before[1:])
        self.sampled = sampled
        self.sample = sample

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.bits):
            ones, zeros = self.ones[k], self.zeros[k]
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (lo, hi) of the suffixes that begin with each phrase (a row of the matrix)."""
        m, width = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for k in range(width - 1, -1, -1):
            s = phrases[live, k]
            a = self.c[s] + self.rank(s, lo[live])
            b = self.c[s] + self.rank(s, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
            if not len(live):
                break
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row's suffix, by walking back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            s = self.bwt[rows[live]]
            rows[live] = self.c[s] + self.rank(s, rows[live])
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.sample[self.sampled_before[rows]] + steps


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last position is smaller than all others."""
    n = len(text)
    rank = text.astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + second
        sa = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[sa[1:]] = np.cumsum(key[sa[1:]] != key[sa[:-1]])
        rank = new
        if int(rank[sa[-1]]) == n - 1:
            return sa
        k *= 2
        if k >= n:
            return sa


class Items:
    """The items as symbols of one alphabet, the words of all of them; kept in a file that workers map.

    Symbols 0 and 1 are left to the index. An item of fewer than ``least`` words can't leak and is left out.
    """

    def __init__(self, vocabulary: dict[str, int], symbols: np.ndarray, starts: np.ndarray, ids: np.ndarray, least: int):
        self.vocabulary, self.symbols, self.starts, self.ids, self.least = vocabulary, symbols, starts, ids, least

    @classmethod
    def of(cls, items: Iterable[tuple[int, str]], least: int) -> Items:
        vocabulary: dict[str, int] = {}
        symbols, starts, ids = array("i"), array("q", [0]), array("q")
        for item, text in items:
            w = words(text)
            if len(w) >= least:
                symbols.extend(vocabulary.setdefault(x, len(vocabulary) + 2) for x in w)
                starts.append(len(symbols))
                ids.append(item)
        return cls(vocabulary, np.array(symbols, np.int32), np.array(starts, np.int64), np.array(ids, np.int64), least)

    @property
    def sigma(self) -> int:
        return len(self.vocabulary) + 2

    def save(self) -> bytes:
        known = "\n".join(self.vocabulary).encode()
        head = np.array([len(known), len(self.symbols), len(self.ids), self.least], np.int64)
        pad = b"\0" * (-len(known) % 8)
        return b"".join([head.tobytes(), known, pad, self.starts.tobytes(), self.ids.tobytes(), self.symbols.tobytes()])

    @classmethod
    def open(cls, path: str) -> Items:
        raw = np.memmap(path, np.uint8, "r")
        size, n, m, least = (int(x) for x in raw[:32].view(np.int64))
        known = bytes(raw[32 : 32 + size]).decode().split("\n") if size else []
        at = 32 + size + -size % 8
        starts, at = raw[at : at + 8 * (m + 1)].view(np.int64), at + 8 * (m + 1)
        ids, at = raw[at : at + 8 * m].view(np.int64), at + 8 * m
        return cls({w: i + 2 for i, w in enumerate(known)}, raw[at : at + 4 * n].view(np.int32), starts, ids, least)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All runs of ``least`` words (rows of a matrix) with the number of their item, PHRASES at a time."""
        if not len(self.ids):
            return
        runs = np.lib.stride_tricks.sliding_window_view(self.symbols, self.least)
        for i in range(0, len(runs), PHRASES):
            at = np.arange(i, min(len(runs), i + PHRASES))
            item = np.searchsorted(self.starts, at, "right") - 1
            inside = at + self.least <= self.starts[item + 1]
            yield runs[at[inside]], item[inside]


class Searcher:
    """Finds the passages of the items in shards of a corpus."""

    def __init__(self, items: Items):
        self.items, self.least = items, items.least

    def known_runs(self, text: str) -> list[tuple[int, np.ndarray]]:
        """Stretches of at least ``least`` known words: (number of the first word, their symbols)."""
        get = self.items.vocabulary.get
        w = words(text)
        if len(w) < self.least:
            return []
        ids = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.least
        return [(int(a), ids[a:b]) for a, b in zip(begin[long], end[long], strict=True)]

    def find(self, runs: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int, int]]:
        """(document, item, first word, end word) of merged passages; runs: (document, first word, symbols)."""
        if not runs or not len(self.items.ids):
            return []
        lengths = np.array([len(r[2]) + 1 for r in runs])
        begin = np.cumsum(lengths) - lengths
        text = np.ones(int(lengths.sum()) + 1, np.int64)  # 1 separates stretches, 0 ends the text
        text[-1] = 0
        for b, (_, _, ids) in zip(begin.tolist(), runs, strict=True):
            text[b : b + len(ids)] = ids
        hits = list(locate_phrases(FMIndex(text, self.items.sigma), self.items.blocks()))
        if not hits:
            return []
        place, item = (np.concatenate(x) for x in zip(*hits, strict=True))
        run = np.searchsorted(begin, place, "right") - 1
        doc = np.array([x[0] for x in runs], np.int64)[run]
        start = np.array([x[1] for x in runs], np.int64)[run] + place - begin[run]
        return merged(doc, self.items.ids[item], start, self.least)


def locate_phrases(index: FMIndex, blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the phrases in the index's text, and the item of each."""
    for phrases, item in blocks:
        lo, hi = index.search(phrases)
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        if len(which):
            first = np.cumsum(count) - count
            yield index.locate(np.repeat(lo, count) + np.arange(len(which)) - first[which]), item[which]


def merged(doc: np.ndarray, item: np.ndarray, start: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """(document, item, first word, end word) of occurrences of an item that touch or overlap, as one."""
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + least)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return list(zip(doc[at].tolist(), item[at].tolist(), start[at].tolist(), (start[last] + least).tolist(), strict=True))


_SCHEMA = "key long, item_id long, first_word int, end_word int, start_char int, end_char int"


def _shared_items(items: DataFrame, item_key: str, item_text: str, least: int) -> str:
    """Write the items, which pass through the driver one by one, to the shared folder; returns the file's name."""
    chosen = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.length("t") > 0)
    return put_shared_file(items.sparkSession, Items.of(((r.i, r.t) for r in chosen.toLocalIterator()), least).save(), ".items")


def leaked_spans(corpus: DataFrame, items: DataFrame, key: str, text: str, item_key: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """Every passage of at least ``least`` consecutive words of an item in a document.

    Result: key, item_id, first_word, end_word (numbers of words of the document), start_char, end_char
    (the span to remove in the text as it is stored). Null and empty texts hold nothing; an item of
    fewer words can't leak; documents that occur again are reported each; with several equal items each
    is reported. The items are a stated query set: they pass through the driver to a file of 4 bytes a word
    and their different words, which workers map. The corpus is read once, whatever the number of items: each
    shard's index is built once and searched for all of them. No document is shuffled.
    """
    name = _shared_items(items, item_key, item_text, least)
    kept = spread(corpus.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))).where(F.length("text") >= 2 * least - 1)
    return kept.mapInArrow(_scan(name), _SCHEMA)


def _scan(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(Items.open(SparkFiles.get(name)))
        runs: list[tuple[int, int, np.ndarray]] = []
        texts: dict[int, str] = {}
        keys: list[int] = []
        held = chars = 0

        def flush() -> pa.RecordBatch:
            nonlocal runs, texts, keys, held, chars
            out = []
            places: dict[int, list[tuple[int, int]]] = {}
            for doc, item, a, b in searcher.find(runs):
                if doc not in places:
                    places = {doc: word_places(texts[doc])}  # passages come by document
                p = places[doc]
                inside = b <= len(p)
                out.append((keys[doc], item, a, b, p[a][0] if inside else None, p[b - 1][1] if inside else None))
            runs, texts, keys, held, chars = [], {}, [], 0, 0
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)],
                names=["key", "item_id", "first_word", "end_word", "start_char", "end_char"],
            )

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = searcher.known_runs(t)
                    if own:
                        texts[len(keys)] = t
                        runs += [(len(keys), a, ids) for a, ids in own]
                        keys.append(k)
                        held += sum(len(ids) for _, ids in own)
                        chars += len(t)
                    if held >= INDEX_WORDS or chars >= INDEX_CHARS:
                        yield flush()
        if runs:
            yield flush()

    return run


class ShardIndexes:
    """FM-indexes of a corpus kept at ``path``: evaluation sets that come later are searched without its texts.

    A shard is a bounded number of documents of a partition. Its alphabet are hashes of its words; the rows
    are key, first place of each document, alphabet and the index's arrays. Only documents with text have one.
    """

    SCHEMA = "n_docs int, keys binary, begins binary, words binary, transform binary, sampled binary, sample binary"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, corpus: DataFrame, key: str, text: str, path: str) -> ShardIndexes:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys: list[int] = []
            hashes: list[np.ndarray] = []
            held = 0

            def flush() -> pa.RecordBatch:
                nonlocal keys, hashes, held
                begins = np.cumsum([0] + [len(h) + 1 for h in hashes])[:-1]
                alphabet, symbols = np.unique(np.concatenate(hashes), return_inverse=True)
                flat = np.ones(held + len(hashes) + 1, np.int64)
                flat[-1] = 0
                at = 0
                for b, h in zip(begins.tolist(), hashes, strict=True):
                    flat[b : b + len(h)] = symbols[at : at + len(h)] + 2
                    at += len(h)
                index = FMIndex(flat, len(alphabet) + 2)
                row = [len(keys), np.array(keys, np.int64).tobytes(), begins.astype(np.int64).tobytes(), alphabet.tobytes(), index.bwt.astype(np.int32).tobytes(), np.packbits(index.sampled).tobytes(), index.sample.astype(np.int32).tobytes()]
                keys, hashes, held = [], [], 0
                return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *[pa.array([x], pa.binary()) for x in row[1:]]], names=["n_docs", "keys", "begins", "words", "transform", "sampled", "sample"])

            for batch in batches:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    w = words(t)
                    if w:
                        keys.append(k)
                        hashes.append(np.array([xxhash.xxh3_64_intdigest(x) for x in w], np.uint64))
                        held += len(w)
                        if held >= INDEX_WORDS:
                            yield flush()
            if keys:
                yield flush()

        kept = spread(corpus.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))).where(F.length("text") > 0)
        kept.mapInArrow(run, cls.SCHEMA).write.mode("overwrite").parquet(path)
        return cls(corpus.sparkSession, path)

    def search(self, items: DataFrame, item_key: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
        """key, item_id, first_word, end_word: as ``leaked_spans`` without the characters' places."""
        name = _shared_items(items, item_key, item_text, least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            them = Items.open(SparkFiles.get(name))
            hashed = np.array([0, 0] + [xxhash.xxh3_64_intdigest(w) for w in them.vocabulary], np.uint64)
            for batch in batches:
                for r in batch.to_pylist():
                    alphabet = np.frombuffer(r["words"], np.uint64)
                    at = np.minimum(np.searchsorted(alphabet, hashed), len(alphabet) - 1)
                    # symbols of this shard; -1: no document of it has the word
                    local = np.where(alphabet[at] == hashed, at + 2, -1)
                    index = FMIndex.restore(np.frombuffer(r["transform"], np.int32).astype(np.int64), np.frombuffer(r["sampled"], np.uint8), np.frombuffer(r["sample"], np.int32).astype(np.int64), len(alphabet) + 2)

                    def known(local=local) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                        for phrases, item in them.blocks():
                            mine = local[phrases]
                            ok = (mine >= 0).all(axis=1)
                            yield mine[ok], item[ok]

                    hits = list(locate_phrases(index, known()))
                    if not hits:
                        continue
                    place, item = (np.concatenate(x) for x in zip(*hits, strict=True))
                    begins, keys = np.frombuffer(r["begins"], np.int64), np.frombuffer(r["keys"], np.int64)
                    doc = np.searchsorted(begins, place, "right") - 1
                    cols = list(zip(*merged(doc, them.ids[item], place - begins[doc], them.least), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[list(cols[0])]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["key", "item_id", "first_word", "end_word"])

        return self.spark.read.schema(self.SCHEMA).parquet(self.path).mapInArrow(run, "key long, item_id long, first_word int, end_word int")


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents that quote an evaluation item."""
    spans = leaked_spans(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"), "doc_id", "text")
    return spans.withColumnRenamed("key", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items that leaked into them."""
    return p8_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of ``p8_found`` from stored indexes of the documents."""
    index = ShardIndexes.build(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}")
    return index.search(table(spark, sf_dir, "eval_items", "item_id", "text")).select(F.col("key").alias("doc_id"), "item_id").distinct()


QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans, "p8_indexed": p8_indexed}
ORACLES: dict[str, str] = {}
