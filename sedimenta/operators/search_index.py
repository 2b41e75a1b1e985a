"""A stored index of a table for hybrid search: postings, vectors in leaves, and rows by key.

A query reads the postings of its terms, the leaves of vectors that can hold one of the nearest, and the rows
it returns; nothing scans the table. Both arms are exact, so results equal those of the scans in
``retrieval``. Vectors lie in leaves of a k-means partition, each with the angle of its farthest member: a
leaf whose nearest possible member is farther than the n-th row found is not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.operators import retrieval as R
from sedimenta.operators.postings import PostingsIndex
from sedimenta.sources.tables import spread

#: Vectors that the leaves' centres are fitted on at most; every vector is filed.
SAMPLE_ROWS = 20_000
#: Rows of a leaf, and leaves at most (their centres are read by the driver).
LEAF_ROWS, MAX_LEAVES = 4_000, 4_096
#: Rows of a file of the rows by key.
FILE_ROWS = 50_000


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _centres(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        label = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


class SearchIndex:
    """An index below ``path``; ``build`` writes it whole, the constructor opens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.postings = PostingsIndex(spark, f"{path}/words")
        about = spark.read.parquet(f"{path}/about").first()
        self.key, self.dim, self.attributes = about["key"], about["dim"], list(about["attributes"])
        self._schema = about["vector_schema"]
        self.rows_schema = about["rows_schema"]
        # at most MAX_LEAVES rows
        leaves = spark.read.schema("leaf int, n long, radius double, centre array<double>").parquet(f"{path}/leaves").orderBy("leaf").collect()
        self._leaf = np.array([r.leaf for r in leaves], np.int64)
        self._size = np.array([r.n for r in leaves], np.int64)
        self._radius = np.array([r.radius for r in leaves])
        self._centre = np.array([r.centre for r in leaves]).reshape(len(leaves), self.dim)

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, vector: str, root: str, dim: int, attributes: Sequence[str] = (), buckets: int | None = None) -> SearchIndex:
        """Index every row of ``df``; ``attributes`` are the columns that a search may filter by before it ranks."""
        spark = df.sparkSession
        path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        cores = spark.sparkContext.defaultParallelism
        PostingsIndex.build(df.select(key, text), key, text, f"{path}/words", buckets or min(256, max(8, cores)), fixed=True)
        names = [c for c in attributes if c != key]
        usable = spread(df.select(F.col(key).alias("key"), F.col(vector).alias("vec"), *names)).where((F.size("vec") == dim) & F.exists("vec", lambda x: x != 0))
        n = usable.count()
        some = usable.select("key", "vec")
        if n > SAMPLE_ROWS:
            some = some.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * SAMPLE_ROWS / n))
        x = np.array([r.vec for r in some.orderBy("key").collect()], float).reshape(-1, dim)
        centres = _centres(_unit(x), max(1, min(MAX_LEAVES, n // LEAF_ROWS))) if len(x) else np.zeros((0, dim))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = _unit(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))
                s = q @ centres.T
                leaf = s.argmax(1)
                angle = np.arccos(np.clip(s[np.arange(len(s)), leaf], -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32()), pa.array(angle)], names=[*b.schema.names, "leaf", "angle"])

        schema = T.StructType([*usable.schema.fields, T.StructField("leaf", T.IntegerType()), T.StructField("angle", T.DoubleType())])
        placed = usable.mapInArrow(place, schema).hint("rebalance", "leaf")
        placed.write.partitionBy("leaf").parquet(f"{path}/vectors")
        kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        stored = spark.read.schema(kept).parquet(f"{path}/vectors")
        sizes = {r.leaf: (r.n, r.radius) for r in stored.groupBy("leaf").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
        leaves = [(i, *sizes[i], [float(v) for v in centres[i]]) for i in sorted(sizes)]
        spark.createDataFrame(leaves, "leaf int, n long, radius double, centre array<double>").coalesce(1).write.parquet(f"{path}/leaves")
        rest = df.drop(vector)
        total = rest.select(key).count()
        rest.repartitionByRange(max(1, total // FILE_ROWS), key).sortWithinPartitions(key).write.parquet(f"{path}/rows")
        rows = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
        spark.createDataFrame([(key, dim, names, kept, rows)], "key string, dim int, attributes array<string>, vector_schema string, rows_schema string").coalesce(1).write.parquet(f"{path}/about")
        return cls(spark, path)

    def _attributes(self) -> DataFrame:
        return self.spark.read.schema(self.rows_schema).parquet(f"{self.path}/rows").select(self.key, *self.attributes)

    def words(self, query: str, n: int = R.DEPTH, where: Column | None = None) -> list[tuple]:
        """(key, score) of the best rows by BM25; rows that ``where`` leaves out don't rank."""
        scores = self.postings.scores(query)
        if where is not None:
            scores = scores.join(self._attributes().where(where).select(F.col(self.key).alias("key")), "key", "left_semi")
        return [(r["key"], r["score"]) for r in scores.orderBy(F.desc("score"), "key").limit(n).collect()]

    def nearest(self, query: Sequence[float], n: int = R.DEPTH, where: Column | None = None) -> list[tuple]:
        """(key, distance) of the n nearest rows, the distance rounded to six digits."""
        if len(query) != self.dim or not any(query) or not len(self._leaf):
            return []
        q = _unit(np.array([query], float))[0]
        away = np.arccos(np.clip(self._centre @ q, -1, 1))
        order = np.argsort(away, kind="stable")
        # first the nearest leaves that hold enough rows, then all that can hold a nearer one
        enough = int(np.searchsorted(np.cumsum(self._size[order]), 4 * n)) + 1
        first, rest = order[:enough], order[enough:]
        found = self._top(first, query, n, where)
        if len(rest):
            least = 1 - np.cos(np.maximum(0, away[rest] - self._radius[rest]))
            reach = found[n - 1][1] if len(found) >= n else 2.0
            found = sorted(found + self._top(rest[least <= reach + 1e-5], query, n, where), key=lambda r: (r[1], r[0]))[:n]
        return found

    def _top(self, leaves: np.ndarray, query: Sequence[float], n: int, where: Column | None) -> list[tuple]:
        if not len(leaves):
            return []
        df = self.spark.read.schema(self._schema).parquet(f"{self.path}/vectors").where(F.col("leaf").isin([int(x) for x in self._leaf[leaves]]))
        if where is not None:
            df = df.where(where)
        q = np.array(query, float)
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                d = np.round(1 - m @ q / (np.linalg.norm(m, axis=1) * np.linalg.norm(q)), 6)
                # the n nearest of a batch, with all that tie with the last of them
                at = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1]) if len(d) > n else np.arange(len(d))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(d[at])], names=["key", "distance"])

        kind = df.schema["key"].dataType.simpleString()
        d = df.select("key", "vec").mapInArrow(run, f"key {kind}, distance double")
        return [(r["key"], r["distance"]) for r in d.orderBy("distance", "key").limit(n).collect()]

    def rows(self, keys: Sequence) -> DataFrame:
        """The rows of some keys, by filters that reach the files (which are sorted by key)."""
        df = self.spark.read.schema(self.rows_schema).parquet(f"{self.path}/rows")
        if not keys:
            return df.limit(0)
        return df.where(reduce(lambda a, b: a | b, [F.col(self.key) == F.lit(k) for k in keys]))

    def _scored(self, best: list[tuple], where: Column | None, limit: int) -> DataFrame:
        kind = self.spark.createDataFrame([], self.rows_schema).schema[self.key].dataType.simpleString()
        score = self.spark.createDataFrame(best, f"`{self.key}` {kind}, rrf_score double")
        out = self.rows([k for k, _ in best]).join(F.broadcast(score), self.key)
        if where is not None:
            out = out.where(where)
        return out.orderBy(F.desc("rrf_score"), self.key).limit(limit)

    def bm25(self, query: str, limit: int = 10, where: Column | None = None) -> DataFrame:
        """Rows (without vectors) by BM25, the score in rrf_score, best first."""
        return self._scored(self.words(query, limit, where), None, limit)

    def hybrid(self, query: str, vector: Sequence[float], limit: int = 10, k: int = R.RRF_K, where: Column | None = None, prefilter: bool = False, fetch: int | None = None) -> DataFrame:
        """As ``retrieval.hybrid_search``, without the vectors; with ``prefilter`` the filter may use the attributes only."""
        if limit <= 0:
            return self._scored([], None, 0)
        own = where if prefilter else None
        score: dict = {}
        for arm in (self.words(query, R.DEPTH, own), self.nearest(vector, R.DEPTH, own)):
            for rank, (key, _) in enumerate(arm, 1):
                score[key] = score.get(key, 0.0) + 1.0 / (k + rank)
        best = sorted(((key, round(s, 9)) for key, s in score.items()), key=lambda x: (-x[1], x[0]))
        n = fetch if fetch is not None else R.over_fetch(limit, where is not None)
        return self._scored(best[:n], None if prefilter else where, limit)
