"""Embedding texts and reranking rows by pluggable models.

An embedder maps a list of texts to vectors of one length, a reranker a query and texts to scores. Both
run inside Arrow batches, so a model is set up once in a worker and called for many rows at a time.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a reranker takes at most; searches return far fewer.
MAX_POOL = 1000

Embedder = Callable[[list[str]], list[list[float]]]
Reranker = Callable[[str, list[str]], list[float]]


class HashEmbedder:
    """Deterministic vectors of words by hashing, for tests and offline use; equal texts have equal vectors."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in (t or "").lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "big") % self.dim] += 1.0 if h[4] & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


class HttpEmbedder:
    """A model server's batch interface, with retries on timeouts and failed connections only."""

    def __init__(self, url: str, model: str, timeout: float = 120, retries: int = 5, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep):
        self.url, self.model, self.timeout, self.retries, self.wait, self.sleep = url, model, timeout, retries, wait, sleep

    def _post(self, body: bytes) -> bytes:
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return r.read()

    def __call__(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        for attempt in range(self.retries + 1):
            try:
                vectors = json.loads(self._post(body))["embeddings"]
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                return vectors
            except urllib.error.HTTPError:
                raise
            except (TimeoutError, ConnectionError, urllib.error.URLError):
                if attempt == self.retries:
                    raise
                self.sleep(self.wait * 2**attempt)
        raise AssertionError


class HttpReranker(HttpEmbedder):
    """A cross-encoder behind a server: texts are scored with the query, results come as (index, relevance_score)."""

    def __call__(self, query: str, texts: list[str]) -> list[float]:  # type: ignore[override]
        got = json.loads(self._post(json.dumps({"model": self.model, "query": query, "documents": texts}).encode()))["results"]
        score = {r["index"]: float(r["relevance_score"]) for r in got}
        return [score[i] for i in range(len(texts))]


def ensure_model(host: str, model: str, call: Callable[[str, dict | None], dict] | None = None) -> str:
    """Make a model server ready: probe with one text, fetch the model if it has none, say where it runs.

    ``call`` sends a body (or reads, without one) and returns the answer. Result: "" or a warning that the
    model does not run on a GPU; an error of the probe after the model was fetched is raised.
    """
    call = call or _call
    probe = {"model": model, "input": ["ready"]}
    try:
        call(f"{host}/api/embed", probe)
    except urllib.error.HTTPError as e:
        if e.code != 404:
            raise
        call(f"{host}/api/pull", {"model": model, "stream": False})
        call(f"{host}/api/embed", probe)
    try:
        running = call(f"{host}/api/ps", None).get("models") or []
    except (OSError, ValueError):
        return ""
    mine = [m for m in running if str(m.get("name", "")).startswith(model)]
    return f"{model} does not run on a GPU; indexing will be slow" if mine and not any(m.get("size_vram") for m in mine) else ""


def _call(url: str, body: dict | None) -> dict:
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=600) as r:
        return json.loads(r.read())


def embed_column(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding", batch: int = 16) -> DataFrame:
    """``df`` with the vector of each text; a null text has none. ``batch`` texts go to the model at a time."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            got: list = [None] * len(s)
            at = [i for i, t in enumerate(s) if t is not None]
            for k in range(0, len(at), batch):
                some = at[k : k + batch]
                for i, v in zip(some, embedder([s.iloc[j] for j in some]), strict=True):
                    got[i] = [float(x) for x in v]
            yield pd.Series(got)

    return df.withColumn(out, vectors(F.col(text)))


def word_overlap(query: str, texts: list[str]) -> list[float]:
    """A lexical reranker: share of the query's words that a text holds."""
    q = set(query.lower().split())
    return [len(q & set((t or "").lower().split())) / len(q) if q else 0.0 for t in texts]


def rerank(df: DataFrame, query: str, text: str, reranker: Reranker | None, limit: int, order: Sequence[str] = ("rrf_score",), key: str = "id") -> DataFrame:
    """The best ``limit`` rows by the reranker's score, its ties and its failure settled by the order before.

    ``df`` is a bounded pool (a search result). Without a reranker, or when it fails, the pool's own order counts.
    """
    before = [F.desc(c) for c in order]
    if reranker is None:
        return df.orderBy(*before, key).limit(limit)

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        try:
            return pd.Series([float(x) for x in reranker(query, s.tolist())])
        except Exception:
            return pd.Series([None] * len(s), dtype="float64")

    # the pool is what a search returned: all of it is scored in one call
    return df.orderBy(*before, key).limit(MAX_POOL).coalesce(1).withColumn("rerank_score", score(F.col(text))).orderBy(F.desc_nulls_last("rerank_score"), *before, key).limit(limit)
