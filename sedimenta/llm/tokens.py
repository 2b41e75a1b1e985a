"""Encoding a corpus with a public byte-level BPE vocabulary.

Frequent words are compiled into a minimal acyclic transducer: an automaton over bytes in which
equal suffixes share their states. Every state carries the number of words below it, so walking a
word yields its rank among the sorted words, and the rank leads to the word's ids in two flat
arrays. The whole lexicon is one file of flat arrays that the workers map into memory. Words that
are not in it get their ids by exact merging under the vocabulary's ranks; the lexicon only saves
time and never changes an id.

A batch's distinct words walk the automaton together, one byte a step, in numpy.
"""

from __future__ import annotations

import base64
import io
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.sources.shared import checkpoint, put_shared_file
from sedimenta.sources.tables import spread, table

#: Folder of the public vocabularies; a parameter of the operator.
VOCABULARIES = "/opt/tokenizers"
#: The most frequent words that are compiled; bounds the lexicon's size (about 4 MB), not the result.
LEXICON_WORDS = 50_000
#: Distinct words with their ids that a worker keeps; it starts anew beyond that.
CACHE_WORDS = 150_000
#: Fixed value: the pattern by which the vocabulary's tokenizer cuts text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(name: str, folder: str = VOCABULARIES) -> dict[bytes, int]:
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of least rank is merged (leftmost first) until none is known."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 400:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    big = 1 << 60
    pair = [get(parts[i] + parts[i + 1], big) for i in range(len(parts) - 1)]
    while pair:
        low = min(pair)
        if low == big:
            break
        i = pair.index(low)
        parts[i] += parts.pop(i + 1)
        del pair[i]
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], big)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], big)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a very long word, with a heap, so that the time stays near linear in its length."""
    import heapq

    n = len(word)
    part = [word[i : i + 1] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = nxt[i]
        if not part[i] or j >= n or part[i] + part[j] != joined:
            continue
        part[i], part[j] = joined, b""
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for a in (prv[i], i):
            if a >= 0 and nxt[a] < n and (r := ranks.get(part[a] + part[nxt[a]])) is not None:
                heapq.heappush(heap, (r, a, part[a] + part[nxt[a]]))
    return [ranks[p] for p in part if p]


class Transducer:
    """A minimal acyclic automaton of words with id outputs, in flat arrays.

    State s owns the edges first[s]:first[s+1], sorted by byte; an edge has its byte, its target and
    the number of words that precede it in its state; final[s] tells whether a word ends in s.
    """

    NAMES = ("first", "byte", "target", "skip", "final", "out_at", "out")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for n in self.NAMES:
            setattr(self, n, arrays[n])
        # an edge is found by (state, byte) in one sorted array
        states = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first))
        self.edge_key = states * 256 + self.byte

    @classmethod
    def build(cls, words: list[bytes], ids: list[list[int]]) -> Transducer:
        """Compile distinct sorted words by incremental minimisation (words arrive in order)."""
        known: dict[tuple, int] = {}
        edges: list[list[tuple[int, int]]] = []
        final: list[bool] = []
        below: list[int] = []
        path: list[tuple[list, bool]] = [([], False)]  # open states along the last word

        def close(down_to: int, last: bytes) -> None:
            while len(path) > down_to + 1:
                own, fin = path.pop()
                sig = (fin, tuple(own))
                s = known.get(sig)
                if s is None:
                    s = known[sig] = len(edges)
                    edges.append(own)
                    final.append(fin)
                    below.append(int(fin) + sum(below[t] for _, t in own))
                path[-1][0].append((last[len(path) - 1], s))

        last = b""
        for w in words:
            common = len(os.path.commonprefix([last, w]))
            close(common, last)
            while len(path) <= len(w):
                path.append(([], False))
            path[-1] = (path[-1][0], True)
            last = w
        close(0, last)
        edges.append(path[0][0])
        final.append(path[0][1])
        first, byte, target, skip = [0], [], [], []
        for own, fin in zip(edges, final, strict=True):
            seen = int(fin)
            for b, t in own:
                byte.append(b)
                target.append(t)
                skip.append(seen)
                seen += below[t]
            first.append(len(byte))
        out_at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=out_at[1:])
        return cls(
            {
                "first": np.array(first, np.int64),
                "byte": np.array(byte, np.int64),
                "target": np.array(target, np.int64),
                "skip": np.array(skip, np.int64),
                "final": np.array(final, bool),
                "out_at": out_at,
                "out": np.array([y for x in ids for y in x], np.int32),
            }
        )

    def save(self) -> bytes:
        """One file: each array with its own header, 64-byte aligned, so that all can be mapped in place."""
        out = io.BytesIO()
        for n in self.NAMES:
            np.lib.format.write_array(out, np.ascontiguousarray(getattr(self, n)))
        return out.getvalue()

    @classmethod
    def open(cls, path: str) -> Transducer:
        """Map a saved lexicon: the arrays are views of the file, shared by all workers of a machine."""
        raw = np.memmap(path, np.uint8, "r")
        arrays, at = {}, 0
        with open(path, "rb") as f:
            for n in cls.NAMES:
                f.seek(at)
                np.lib.format.read_magic(f)
                shape, _, kind = np.lib.format.read_array_header_1_0(f)
                start = f.tell()
                at = start + int(np.prod(shape)) * kind.itemsize
                arrays[n] = raw[start:at].view(kind)
        return cls(arrays)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word among the compiled ones, -1 for a word that is not compiled."""
        n = len(words)
        got = np.full(n, -1, np.int64)
        if not n or not len(self.byte):
            return got
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        state = np.full(n, len(self.first) - 2, np.int64)
        rank = np.zeros(n, np.int64)
        live = np.flatnonzero(lengths > 0)
        step = 0
        while len(live):
            key = state[live] * 256 + flat[begin[live] + step]
            e = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            ok = self.edge_key[e] == key
            live, e = live[ok], e[ok]
            rank[live] += self.skip[e]
            state[live] = self.target[e]
            step += 1
            ended = lengths[live] == step
            end = live[ended]
            end = end[self.final[state[end]]]
            got[end] = rank[end]
            live = live[~ended]
        return got


class Encoder:
    """Ids of texts by lexicon and exact merging."""

    def __init__(self, ranks: dict[bytes, int], lexicon: Transducer | None):
        import regex

        self.find = regex.compile(PATTERN).findall
        self.bpe, self.lexicon = ranks, lexicon
        self.known: dict[str, np.ndarray] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        raw = [w.encode("utf-8", "replace") for w in words]
        at = self.lexicon.ranks(raw) if self.lexicon else np.full(len(raw), -1)
        for w, r, k in zip(words, raw, at.tolist(), strict=True):
            if k >= 0:
                self.known[w] = self.lexicon.out[self.lexicon.out_at[k] : self.lexicon.out_at[k + 1]].tolist()
            else:
                self.known[w] = merge_word(r, self.bpe)

    def encode(self, texts: list[str | None]) -> pa.Array:
        """A list of ids for each text; empty for an empty or null text."""
        offsets, out = [0], []
        words_of = [self.find(t) if t else [] for t in texts]
        new = set().union(*words_of).difference(self.known)
        if new:
            self._learn(list(new))
            if not self.known.keys() >= new or len(self.known) == len(new):  # the cache began anew
                self._learn(list(set().union(*words_of).difference(self.known)))
        known = self.known
        for words in words_of:
            for w in words:
                out += known[w]
            offsets.append(len(out))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(out, np.int32)))


def count_words(df: DataFrame, text: str, least: int = 2) -> DataFrame:
    """Occurrences of each word over all texts, counted within partitions before the shuffle.

    A word that occurs less than ``least`` times in a partition's input is left out there: such words
    are not frequent, and the lexicon's choice has no influence on any id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(PATTERN).findall
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            kept = [(w, n) for w, n in seen.items() if n >= least and len(w) <= 64]
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(find(t))
            if len(seen) > 300_000:
                yield flush()
        yield flush()

    return spread(df.select(F.col(text))).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counted: DataFrame, words: int) -> list[str]:
    """At most ``words`` of the most frequent words (of ``count_words``), all that reach the driver.

    Counts are summed by steps of a sixteenth of a power of two, some hundred rows; the highest steps that
    hold no more than ``words`` together are taken whole, so no partition sends more than its share.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r.step, r.n_words) for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("n_words")).collect()), reverse=True)
    total, least = 0, None
    for at, n in sizes:
        if total + n > words:
            break
        total, least = total + n, at
    if least is None:
        return []
    return [r.word for r in counted.where(step >= least).select("word").collect()]


def build_lexicon(spark: SparkSession, df: DataFrame, text: str, ranks: dict[bytes, int], words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all texts; returns the name of the file that all workers can open.

    At most ``words`` rows come to the driver.
    """
    counted = checkpoint(spark, count_words(df, text))
    lex = sorted({w.encode("utf-8", "replace") for w in frequent_words(counted, words)})
    return put_shared_file(spark, Transducer.build(lex, [merge_word(w, ranks) for w in lex]).save(), ".lexicon")


_ENCODERS: dict[tuple, Encoder] = {}


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES) -> DataFrame:
    """key and ids (a list of integers, without special tokens) of every row.

    A null or empty text has an empty list; texts of any length are encoded whole; repeated rows
    are encoded each. The key's type is kept, other columns are not read.
    """
    spark = df.sparkSession
    name = build_lexicon(spark, df, text, read_ranks(vocabulary, folder))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (name, vocabulary) not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name, vocabulary] = Encoder(read_ranks(vocabulary, folder), Transducer.open(SparkFiles.get(name)))
        enc = _ENCODERS[name, vocabulary]
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), enc.encode(part.column(1).to_pylist())], names=["key", "ids"])

    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document's text."""
    return encode_column(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids}
ORACLES: dict[str, str] = {}
