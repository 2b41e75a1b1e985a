"""Most similar vectors by the cells of a k-means tree: exact lists, or lists of a wanted recall.

The tree is fitted on a bounded sample (``SAMPLE_ROWS``); every vector is filed in one leaf.

Exact lists (a recall of 1, as in all queries of this module) take the leaves as cells of a flat partition: a
vector is filed with the centre of greatest product, and a query goes to every cell that can hold a vector within
its reach, by the distance of the border between that cell and its own. With a least cosine the reach is its chord,
or half of it where all rows search, as one of two rows is within half their distance of the border. Otherwise
the reach is the distance of the k-th best row of the query's own cell, found in a first pass. So the centres
settle how much is read and never what is found.

For a recall below 1, a query keeps a priority queue of bins ordered by similarity to their centres: the best bin is taken out, an
inner bin puts its children in, a leaf is visited. How far a query goes is calibrated: on queries of
the sample, whose true neighbours are known by brute force over the sample, the visits are widened
(more leaves, and leaves whose border with the first one lies further away) until the recall asked for
is reached. All queries of a batch traverse the tree together.

Vectors and visits meet by leaf, in blocks of a bounded size: a leaf with many vectors is spread over
several blocks and its queries go to each; a block hands on the k best of each query. Where the bounded
sample can't give a large table leaves of the usual size, each leaf gets a tree of its own on the executors.
Rows with the same vector are one class: of its members the k + 1 smallest ids can be in a list of k, so the
others are not filed and take their list from one that is.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.sources.shared import checkpoint
from sedimenta.sources.tables import table

DIM = 64
K = 5
#: Rows that the tree is fitted on at most; the index itself holds every row.
SAMPLE_ROWS = 40_000
#: Queries of the sample by which the number of leaves to visit is calibrated.
CALIBRATION_QUERIES = 500
BRANCHING = 12
#: Vectors that a leaf should hold, and a block of a leaf at most.
LEAF_ROWS, BLOCK_ROWS = 600, 4096
#: Large classes of equal vectors (12 bytes each) up to which their hashes are broadcast.
HEAVY_CLASSES = 100_000
#: What single-precision products of unit vectors can be wrong by, with a wide margin.
SLACK = 1e-5
#: Rows that the tree of one leaf is fitted on in a table that needs two levels, and rows placed in it at a time.
SUB_SAMPLE, GROUP_ROWS = 4_000, 20_000
#: Sampled vectors that a leaf needs at least, so that the tree follows the data and not the sample.
LEAF_SAMPLE = 6


@dataclass
class Tree:
    """Nodes in one array: unit centres; the children of a node stand together; a leaf has its number."""

    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Labels 0..k-1 of spherical k-means on unit vectors."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = (x @ c.T).argmax(1)
        for j in range(k):
            own = x[label == j]
            v = own.sum(0) if len(own) else x[rng.integers(len(x))]
            c[j] = v / max(float(np.linalg.norm(v)), 1e-12)
    return (x @ c.T).argmax(1)


def build_tree(x: np.ndarray, leaves: int, branching: int = BRANCHING, seed: int = 7) -> Tree:
    """Split the sample's largest bin again and again until there are about ``leaves`` bins."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[np.ndarray, list[int]]] = []

    def centre(rows: np.ndarray) -> np.ndarray:
        v = x[rows].sum(0) if len(rows) else np.ones(x.shape[1], x.dtype)
        return v / max(float(np.linalg.norm(v)), 1e-12)

    nodes.append((centre(np.arange(len(x))), []))
    heap = [(-len(x), 0, np.arange(len(x)))]
    n_leaves = 1
    while n_leaves < leaves and heap:
        size, node, rows = heapq.heappop(heap)
        k = min(branching, leaves - n_leaves + 1, -size // LEAF_SAMPLE)
        if k < 2:
            continue
        label = _k_means(x[rows], k, rng)
        groups = [rows[label == j] for j in range(k) if (label == j).any()]
        if len(groups) < 2:
            continue
        for g in groups:
            nodes[node][1].append(len(nodes))
            heapq.heappush(heap, (-len(g), len(nodes), g))
            nodes.append((centre(g), []))
        n_leaves += len(groups) - 1
    first = np.array([c[0] if c else 0 for _, c in nodes], np.int64)
    count = np.array([len(c) for _, c in nodes], np.int64)
    leaf = np.where(count == 0, np.cumsum(count == 0) - 1, -1)
    return Tree(np.array([c for c, _ in nodes], np.float32), first, count, leaf)


def best_bins(tree: Tree, q: np.ndarray, visits: int) -> np.ndarray:
    """Leaves of each query in best-bin-first order: a matrix of ``visits`` columns, -1 where there are no more."""
    n = len(q)
    visits = min(visits, tree.leaves)
    out = np.full((n, visits), -1, np.int64)
    got = np.zeros(n, np.int64)
    width = int(tree.count.max()) + 1
    # the queue of each query: nodes and similarities; a taken place holds -inf and is used again
    node = np.zeros((n, width), np.int64)
    sim = np.full((n, width), -np.inf, np.float32)
    sim[:, 0] = 1
    live = np.arange(n)
    lanes = np.arange(int(tree.count.max()))
    while len(live):
        best = sim[live].argmax(1)
        value = sim[live, best]
        live, best = live[value > -np.inf], best[value > -np.inf]
        if not len(live):
            break
        top = node[live, best]
        sim[live, best] = -np.inf
        is_leaf = tree.count[top] == 0
        at = live[is_leaf]
        out[at, got[at]] = tree.leaf[top[is_leaf]]
        got[at] += 1
        rows, parents = live[~is_leaf], top[~is_leaf]
        if len(rows):
            child = tree.first[parents][:, None] + lanes
            there = lanes < tree.count[parents][:, None]
            child = np.where(there, child, 0)
            s = np.einsum("nd,nkd->nk", q[rows], tree.centre[child])
            s[~there] = -np.inf
            free = (sim[rows] == -np.inf).sum(1).min()
            if free < len(lanes):
                grow = len(lanes) - int(free)
                node = np.hstack([node, np.zeros((n, grow), np.int64)])
                sim = np.hstack([sim, np.full((n, grow), -np.inf, np.float32)])
            # free places first, in order
            place = np.argsort(sim[rows] != -np.inf, axis=1, kind="stable")[:, : len(lanes)]
            node[rows[:, None], place] = child
            sim[rows[:, None], place] = s
        live = live[got[live] < visits]
    return out


def gaps(tree: Tree, q: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Distance of each query to the border between its first leaf and each leaf of its list (0 on the far side)."""
    centre = tree.centre[np.flatnonzero(tree.count == 0)]
    own = centre[bins[:, 0]]
    out = np.full(bins.shape, np.inf, np.float32)
    near = np.einsum("nd,nd->n", q, own)
    for j in range(bins.shape[1]):
        at = np.flatnonzero(bins[:, j] >= 0)
        c = centre[bins[at, j]]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nd->n", own[at], c), 1e-9))
        out[at, j] = np.maximum(0, (near[at] - np.einsum("nd,nd->n", q[at], c)) / between)
    out[:, 0] = 0
    return out


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float, least: float | None, symmetric: bool) -> tuple[int, float]:
    """How many leaves a query visits at most, and up to which distance of their border.

    Chosen so that the wanted recall is reached on queries of the sample. With ``least``, only
    neighbours of at least that cosine count, and the queries are sampled vectors turned to just that
    cosine, the hardest case. With ``symmetric``, both rows of a pair search, and one of them has to
    find the other.
    """
    rng = np.random.default_rng(11)
    n = min(CALIBRATION_QUERIES, len(x))
    at = rng.choice(len(x), n, replace=False)
    if least is not None:
        noise = rng.standard_normal((n, x.shape[1])).astype(np.float32)
        noise -= (noise * x[at]).sum(1, keepdims=True) * x[at]
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        q = least * x[at] + np.float32(np.sqrt(1 - least**2)) * noise
        truth = at[:, None]
    else:
        q = x[at]
        s = q @ x.T
        s[np.arange(n), at] = -2
        m = min(k, len(x) - 1)
        truth = np.argpartition(-s, m - 1, axis=1)[:, :m]
    home = best_bins(tree, x, 1)[:, 0]

    def needed(queries: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = best_bins(tree, queries, tree.leaves)
        gap = gaps(tree, queries, order)
        rank = np.full((len(queries), tree.leaves), tree.leaves - 1, np.int64)
        far = np.full((len(queries), tree.leaves), 2, np.float32)
        rows, cols = np.nonzero(order >= 0)
        rank[rows, order[rows, cols]] = cols
        far[rows, order[rows, cols]] = gap[rows, cols]
        return np.take_along_axis(rank, target, 1), np.take_along_axis(far, target, 1)

    rank, far = needed(q, home[truth])
    if symmetric:
        r, f = needed(x[at], best_bins(tree, q, 1))
        better = f < far
        rank, far = np.where(better, r, rank), np.where(better, f, far)
    # widen the borders first; then as few leaves as the neighbours within them need
    missed = (1 - recall) / 2
    margin = float(np.quantile(far, 1 - missed, method="higher"))
    inside = rank[far <= margin]
    return int(np.quantile(inside, 1 - missed, method="higher")) + 1, margin


def _repeat(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as ``times`` says, with a running number."""
    r = np.repeat(np.arange(len(times)), times)
    return r, np.arange(len(r)) - (np.cumsum(times) - times)[r]


def _vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """key and vec of the rows that take part: the right length, no null or infinite element, not all zero."""
    kept = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("vec")).where(F.size("vec") == dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), dim)
            with np.errstate(over="ignore", invalid="ignore"):
                ok = np.isfinite(m).all(1) & (np.abs(m).max(axis=1, initial=0) > 0)
            if ok.all():
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(bytes, m)), pa.binary())], names=["key", "vec"])
            elif ok.any():
                at = np.flatnonzero(ok)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([m[i].tobytes() for i in at], pa.binary())], names=["key", "vec"])

    return kept.mapInArrow(run, "key long, vec binary")


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _floats(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)


def _unit(m: np.ndarray, as_type: type = np.float32) -> np.ndarray:
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(as_type, copy=False)


def _classes(vectors: DataFrame, k: int) -> tuple[DataFrame, int, DataFrame | None]:
    """The rows to file, their number, and of the other rows the member of their class that speaks for them.

    Of each class of equal vectors the k + 1 rows of smallest id are filed: no other row of it can be in a
    list of k. Classes are counted by two hashes, so vectors are shuffled only where large classes exist.
    """
    h = vectors.withColumn("h", F.xxhash64("vec")).withColumn("g", F.hash("vec"))
    classes = h.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("key").alias("speaker"))
    large = F.col("n") > k + 1
    total, many = classes.agg(F.sum(F.when(~large, F.col("n")).otherwise(k + 1)), F.sum(large.cast("int"))).first()
    if not many:
        return vectors, int(total or 0), None
    heavy = classes.where(large).select("h", "g", "speaker")
    if many <= HEAVY_CLASSES:
        heavy = F.broadcast(heavy)
    # the first rows of each class are picked within partitions before they are shuffled
    few = h.join(heavy, ["h", "g"]).withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("key"))).where(F.col("r") <= k + 1)
    last = few.groupBy("h", "g").agg(F.max("key").alias("last"))
    if many <= HEAVY_CLASSES:
        last = F.broadcast(last)
    rest = h.drop("vec").join(heavy, ["h", "g"]).join(last, ["h", "g"]).where(F.col("key") > F.col("last")).select("key", "speaker")
    return h.join(heavy, ["h", "g"], "left_anti").select("key", "vec").unionByName(few.select("key", "vec")), int(total), rest


def _sample(df: DataFrame, rows: int, n: int, dim: int) -> np.ndarray:
    """At most about ``rows`` vectors, chosen by a hash of the key: the same at every run."""
    if n > rows:
        df = df.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    got = [bytes(r.vec) for r in df.select("key", "vec").orderBy("key").collect()]
    return _unit(np.frombuffer(b"".join(got), np.float32).reshape(-1, dim)) if got else np.zeros((0, dim), np.float32)


@dataclass
class Plan:
    """A tree and how it is used: leaves that a query visits, the border it goes to, the grid of each leaf."""

    tree: Tree
    visits: int
    margin: float
    blocks: np.ndarray
    askers: np.ndarray
    share: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, n: int, k: int, recall: float, least: float | None, symmetric: bool) -> Plan:
        """For ``n`` vectors, of which ``x`` is a sample."""
        tree = build_tree(x, max(1, min(n // LEAF_ROWS, len(x) // LEAF_SAMPLE)))
        visits, margin = calibrate(tree, x, k, recall, least, symmetric)
        # a leaf's vectors come in blocks, as many as the sample says; its visitors, in blocks too, go to each
        share = np.bincount(best_bins(tree, x, 1)[:, 0], minlength=tree.leaves) * (n / len(x))
        blocks = np.maximum(1, np.ceil(share / BLOCK_ROWS)).astype(np.int64)
        return cls(tree, visits, margin, blocks, np.maximum(1, np.ceil(share / (2 * BLOCK_ROWS))).astype(np.int64), share)

    def leaves_of(self, q: np.ndarray, wide: bool) -> np.ndarray:
        bins = best_bins(self.tree, q, self.visits if wide else 1)
        if wide:
            bins[gaps(self.tree, q, bins) > self.margin] = -1
        return bins

    def places(self, q: np.ndarray, asks: np.ndarray, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, leaf and whether it is the row's own, for each leaf that a row goes to."""
        bins = self.leaves_of(q, bool(asks.any()))
        bins[~asks, 1:] = -1
        rows, cols = np.nonzero(bins >= 0)
        return rows, bins[rows, cols], cols == 0


@dataclass
class Cells:
    """Unit centres of a flat partition and the grid of each cell; whatever the centres are, nothing in reach is missed."""

    centre: np.ndarray
    blocks: np.ndarray
    askers: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, n: int, rows: int, reach: float | None, queries: int) -> Cells:
        """For ``n`` vectors, of which ``x`` is a sample, in cells of about ``rows``; without ``reach`` the queries may go to all."""
        tree = build_tree(x, max(1, min(n // rows, len(x) // LEAF_SAMPLE)))
        one = np.ones(int((tree.count == 0).sum()), np.int64)
        cells = cls(tree.centre[tree.count == 0], one, one)
        # grids keep what meets at once bounded; they have no part in what is found
        _, leaf, home = cells.places(x, np.ones(len(x), bool), np.full(len(x), reach or 0.0))
        share = np.bincount(leaf[home], minlength=len(one)) * (n / len(x))
        asking = np.full(len(one), queries) if reach is None else np.bincount(leaf, minlength=len(one)) * (n / len(x))
        cells.blocks = np.maximum(1, np.ceil(share / (8 * BLOCK_ROWS))).astype(np.int64)
        cells.askers = np.maximum(1, np.ceil(asking / (16 * BLOCK_ROWS))).astype(np.int64)
        return cells

    def places(self, q: np.ndarray, asks: np.ndarray, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``Plan.places``: the own cell, and for those who ask each cell whose border is within reach.

        For q of cell i and x of cell j, (q - x)(c_i - c_j) is at most their distance times that of the centres, and
        the products of x alone add nothing below 0: with more than that between the products of q, x is out of reach.
        """
        c, square = self.centre, (self.centre**2).sum(1)
        out = []
        for i in range(0, len(q), 512):
            s = q[i : i + 512] @ c.T
            at = np.arange(len(s))
            home = s.argmax(1)
            there = np.zeros(s.shape, bool)
            if asks[i : i + 512].any():
                between = np.sqrt(np.maximum(square[home][:, None] + square - 2 * (c[home] @ c.T), 0) + SLACK)
                there = (s[at, home][:, None] - s <= reach[i : i + 512][:, None] * between + SLACK) & asks[i : i + 512][:, None]
            there[at, home] = True
            rows, leaf = np.nonzero(there)
            out.append((rows + i, leaf, leaf == home[rows]))
        return tuple(np.concatenate(o) for o in zip(*out, strict=True))


_PAIRS = "q long, x long, cosine double"
_PLACED = "top long, leaf long, block long, asker long, key long, vec binary, data boolean, query boolean"
_NAMES = ["top", "leaf", "block", "asker", "key", "vec", "data", "query"]


def _grid(plan: Plan | Cells, top: int, keys: pa.Array, vecs: pa.Array, files: np.ndarray, asks: np.ndarray, dim: int, reach: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of ``_PLACED``: where each vector is filed (``files``) and where it asks (``asks``)."""
    rows, leaf, home = plan.places(_unit(_floats(vecs, dim)), asks, reach)
    # the grid of a leaf: vectors are filed in one row of it, visitors ask in one column
    key = keys.to_numpy()[rows]
    mine_b, mine_a = key % plan.blocks[leaf], key // 7 % plan.askers[leaf]
    filed = home & files[rows]
    ra, ja = _repeat(np.where(asks[rows], plan.blocks[leaf], 0))
    rf, jf = _repeat(np.where(filed, plan.askers[leaf], 0))
    twice = asks[rows][rf] & (jf == mine_a[rf])  # the cell where a row asks and is filed stands once
    rf, jf = rf[~twice], jf[~twice]
    r = np.concatenate([ra, rf])
    block, asker = np.concatenate([ja, mine_b[rf]]), np.concatenate([mine_a[ra], jf])
    query = np.concatenate([np.ones(len(ra), bool), np.zeros(len(rf), bool)])
    data = np.concatenate([filed[ra] & (ja == mine_b[ra]), np.ones(len(rf), bool)])
    at = pa.array(rows[r])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(r), top, np.int64)), pa.array(leaf[r]), pa.array(block), pa.array(asker), keys.take(at), vecs.take(at), pa.array(data), pa.array(query)], names=_NAMES)


def _meet(dim: int, k: int, least: float | None, both: bool = False):
    """The k best of the filed vectors for each asking one of a cell, of equal cosines (to six digits) the smaller ids.

    With ``both`` also the k best asking ones for each filed vector, as a pair found once then stands in two lists.
    """

    def best(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the m greatest of each row, of equal ones the first."""
        bits = max(1, s.shape[1].bit_length())
        place = np.arange(s.shape[1] - 1, -1, -1, dtype=np.int64)
        # cosine and place in one number, so that ties are settled before anything is cut
        c = np.argpartition(-((s << bits) + place), m - 1, axis=1)[:, :m] if m < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
        return np.repeat(np.arange(len(s)), c.shape[1]), c.ravel()

    def run(t: pa.Table) -> pa.Table:
        data, query, keys = (t.column(c).to_numpy() for c in ("data", "query", "key"))
        v = _unit(_floats(t.column("vec"), dim), np.float64)
        order, asking = (np.flatnonzero(p)[np.argsort(keys[p], kind="stable")] for p in (data, query))
        dk, dv, qk, qv = keys[order], v[order], keys[asking], v[asking]
        rough = dv.astype(np.float32).T
        out_q, out_x, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        m = min(k + 1, len(dk))
        step = max(16, 2_000_000 // max(1, len(dk)))
        for i in range(0, len(qk) if len(dk) else 0, step):
            part = qv[i : i + step]
            # single precision leaves few pairs for the exact cosines, unless many are alike
            s = part.astype(np.float32) @ rough
            floor = np.partition(s, len(dk) - m, axis=1)[:, len(dk) - m, None] if least is None else least
            near = s >= floor - SLACK
            if np.count_nonzero(near) <= 8 * m * (len(part) + (len(dk) if both else 0)):
                r, c = np.nonzero(near)
            else:
                s = np.rint((part @ dv.T) * 1e6).astype(np.int64)
                r, c = best(s, m)
                if both:
                    c2, r2 = best(s.T, k + 1)
                    r, c = np.divmod(np.unique(np.concatenate([r * len(dk) + c, r2 * len(dk) + c2])), len(dk))
            s = np.rint(np.einsum("nd,nd->n", part[r], dv[c]) * 1e6).astype(np.int64)
            ok = (qk[i + r] != dk[c]) & (s >= (-(10**7) if least is None else round(least * 1e6)))
            r, c, s = r[ok], c[ok], s[ok]
            out_q.append(qk[i + r])
            out_x.append(dk[c])
            out_s.append(s / 1e6)
        return pa.table({"q": pa.array(np.concatenate(out_q)), "x": pa.array(np.concatenate(out_x)), "cosine": pa.array(np.concatenate(out_s))})

    return run


def _second_level(filed: DataFrame, placed: DataFrame, top: Plan, dim: int, k: int, recall: float, least: float | None, symmetric: bool) -> DataFrame:
    """Places (``_PLACED``) below the leaves of a tree that is too small for the table.

    Every leaf of the first tree gets a tree of its own, fitted where its rows are on a bounded sample of
    them and calibrated on it, so leaves keep their size however large the table is. Trees and rows meet by
    leaf, a large leaf's rows in several groups, each with the leaf's tree.
    """
    share, rate = top.share, np.minimum(1.0, SUB_SAMPLE / np.maximum(top.share, 1))
    salts = np.maximum(1, np.ceil(share / GROUP_ROWS)).astype(np.int64)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                leaf = top.leaves_of(_unit(_floats(part.column(1), dim)), False)[:, 0]
                # a multiplicative hash of the key, the same at every run
                u = (part.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2**53
                at = np.flatnonzero(u < rate[leaf])
                yield pa.RecordBatch.from_arrays([pa.array(leaf[at]), part.column(1).take(pa.array(at))], names=["top", "vec"])

    def fit(t: pa.Table) -> pa.Table:
        leaf = t.column("top")[0].as_py()
        x = _unit(_floats(t.column("vec"), dim))
        plan = Plan.fit(x, max(int(share[leaf]), len(x)), k, recall, least, symmetric) if len(x) > 1 else None
        blob = pickle.dumps(plan)
        n = int(salts[leaf])
        return pa.table({"top": pa.array([leaf] * n, pa.int64()), "salt": pa.array(range(n), pa.int64()), "plan": pa.array([blob] * n, pa.binary())})

    plans = checkpoint(filed.sparkSession, filed.mapInArrow(thin, "top long, vec binary").groupBy("top").applyInArrow(fit, "top long, salt long, plan binary"))
    one = Plan(build_tree(np.ones((1, dim), np.float32) / dim**0.5, 1), 1, 2.0, np.ones(1, np.int64), np.ones(1, np.int64), np.ones(1))

    def below(rows: pa.Table, plan: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.schema([(n, k) for n, k in zip(_NAMES, [pa.int64()] * 5 + [pa.binary()] + [pa.bool_()] * 2, strict=True)]).empty_table()
        # a leaf without sampled rows has few: they stay together
        p = (pickle.loads(plan.column("plan")[0].as_py()) if plan.num_rows else None) or one
        leaf = rows.column("top")[0].as_py()
        rows = rows.combine_chunks()
        parts = []
        for i in range(0, rows.num_rows, 4096):
            t = rows.slice(i, 4096)
            keys, vecs = (t.column(c).combine_chunks() for c in ("key", "vec"))
            parts.append(_grid(p, leaf, keys, vecs, t.column("data").to_numpy(), t.column("query").to_numpy(), dim))
        return pa.Table.from_batches(parts)

    counts = F.element_at(F.lit(salts.tolist()), (F.col("leaf") + 1).cast("int"))
    rows = placed.select(F.col("leaf").alias("top"), F.pmod(F.col("key"), counts).alias("salt"), "key", "vec", "data", "query")
    return rows.groupBy("top", "salt").cogroup(plans.groupBy("top", "salt")).applyInArrow(below, _PLACED)


def search(
    df: DataFrame,
    key: str,
    vector: str,
    k: int = K,
    dim: int = DIM,
    queries: DataFrame | None = None,
    least: float | None = None,
    recall: float = 0.95,
    mutual: bool = False,
    sample_rows: int | None = None,
) -> DataFrame:
    """The k most similar rows of each query row: q, x, cosine (to six digits), rank.

    ``queries`` (rows of ``df``; all of them if None) have the same columns. With ``least``, only
    neighbours of at least that cosine are given. Rows whose vector is null, of another length, all zero
    or not finite take no part. Equal cosines are ordered by the smaller id; a row is no neighbour of
    its own id. An empty table gives no rows. Ids are taken to be unique. With ``mutual`` only pairs that
    stand in both lists are wanted: one of the two rows has to find the other, and rows that can be in
    nobody's list get none. ``sample_rows`` bounds the sample that the first tree is fitted on. With a
    ``recall`` of 1 the lists are exact, whatever the sample.
    """
    spark = df.sparkSession
    vectors = _vectors(df, key, vector, dim)
    filed, n, rest = _classes(vectors, k)
    both = queries is None
    if n < 2:
        return spark.createDataFrame([], _PAIRS + ", rank int")
    x = _sample(filed, sample_rows or SAMPLE_ROWS, n, dim)
    if recall >= 1:
        asked = filed if both else _vectors(queries, key, vector, dim)
        pairs = _exact(filed, None if both else asked, x, n, n if both else queries.count(), k, dim, least)
        return _lists(pairs, k, None if not both or mutual else rest)
    if len(x) < 2:
        return spark.createDataFrame([], _PAIRS + ", rank int")
    symmetric = mutual and both and least is not None
    # where the sample has too few rows for the leaves that the table needs, the leaves are split again
    deep = n // LEAF_ROWS > 2 * (len(x) // LEAF_SAMPLE)
    part = recall**0.5 if deep else recall
    plan = Plan.fit(x, n, k, part, least, symmetric)
    del x
    if deep:
        plan.blocks[:], plan.askers[:] = 1, 1

    def place(file: bool, ask: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    t = b.slice(i, 4096)
                    yield _grid(plan, 0, t.column(0), t.column(1), np.full(t.num_rows, file), np.full(t.num_rows, ask), dim)

        return run

    if both:
        # every row is filed in its first leaf and visits the others: one row serves both purposes
        rows = filed.mapInArrow(place(True, True), _PLACED)
    else:
        rows = filed.mapInArrow(place(True, False), _PLACED).unionByName(_vectors(queries, key, vector, dim).mapInArrow(place(False, True), _PLACED))
    if deep:
        rows = _second_level(filed, rows, plan, dim, k, part, least, symmetric)
    pairs = rows.groupBy("top", "leaf", "block", "asker").applyInArrow(_meet(dim, k, least, symmetric), _PAIRS)
    return _lists(_both_ways(pairs) if symmetric else pairs, k, None if not both or mutual else rest)


def _both_ways(pairs: DataFrame) -> DataFrame:
    swapped = pairs.select(F.col("x").alias("q"), F.col("q").alias("x"), "cosine")
    return pairs.unionByName(swapped).groupBy("q", "x").agg(F.max("cosine").alias("cosine"))


def _lists(pairs: DataFrame, k: int, rest: DataFrame | None = None) -> DataFrame:
    """The k best of each query, and the lists of the rows that were not filed (``rest``)."""
    order = Window.partitionBy("q").orderBy(F.desc("cosine"), "x")
    lists = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if rest is None:
        return lists
    return lists.unionByName(_spoken_for(checkpoint(pairs.sparkSession, lists), rest, k))


def _cell_rows(queries: int) -> int:
    """Rows of a cell to which many of the queries go: about as many rows are copied on either side."""
    return max(BLOCK_ROWS, min(queries, 8 * BLOCK_ROWS))


def _exact(filed: DataFrame, asked: DataFrame | None, x: np.ndarray, n: int, queries: int, k: int, dim: int, least: float | None) -> DataFrame:
    """Pairs with all entries of the exact lists; without ``asked``, all filed rows ask."""
    both = asked is None
    # six digits count: a cosine that rounds to the least one is still wanted
    chord = None if least is None else float(np.sqrt(2 - 2 * (max(least, -1.0) - 1e-6))) / (2 if both else 1)
    if not len(x):
        x = np.full((1, dim), dim**-0.5, np.float32)
    cells = Cells.fit(x, n, BLOCK_ROWS if least is not None else _cell_rows(queries), chord, queries)

    def place(file: bool, ask: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    t = b.slice(i, 4096)
                    reach = t.column(2).to_numpy() if t.num_columns > 2 else np.full(t.num_rows, chord or 0.0)
                    yield _grid(cells, 0, t.column(0), t.column(1), np.full(t.num_rows, file), np.full(t.num_rows, ask), dim, reach)

        return run

    def meet(rows: DataFrame, twice: bool) -> DataFrame:
        return rows.groupBy("top", "leaf", "block", "asker").applyInArrow(_meet(dim, k, least, twice), _PAIRS)

    once = filed.mapInArrow(place(True, True), _PLACED) if both else filed.mapInArrow(place(True, False), _PLACED).unionByName(asked.mapInArrow(place(False, True), _PLACED))
    if least is not None:
        pairs = meet(once, both)
        return _both_ways(pairs) if both else pairs
    # the k-th best row of its own cell bounds how far a query has to go
    own = _lists(meet(once, False), k).groupBy("q").agg(F.count("*").alias("n"), F.min("cosine").alias("kth"))
    far = own.where(F.col("n") == k).select(F.col("q").alias("key"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("kth") - 1e-6))).alias("reach"))
    asking = (filed if both else asked).join(far, "key", "left").select("key", "vec", F.coalesce("reach", F.lit(2.0)).alias("reach"))
    return meet(filed.mapInArrow(place(True, False), _PLACED).unionByName(asking.mapInArrow(place(False, True), _PLACED)), False)


def _spoken_for(lists: DataFrame, rest: DataFrame, k: int) -> DataFrame:
    """Lists of the rows that were not filed: the list of the row that speaks for them, and that row itself.

    Their k + 1 filed equals have smaller ids, so nothing else can come in; a list is one row while it is joined.
    """
    names = rest.select(F.col("speaker").alias("q")).distinct()
    entry = F.struct((-F.col("cosine")).alias("far"), "x")
    own = F.struct(F.lit(-1.0).alias("far"), F.col("q").alias("x"))
    one = lists.join(names, "q", "left_semi").groupBy("q").agg(F.collect_list(entry).alias("l"))
    one = one.select(F.col("q").alias("speaker"), F.slice(F.array_sort(F.concat("l", F.array(own))), 1, k).alias("l"))
    each = rest.join(one, "speaker").select(F.col("key").alias("q"), F.posexplode("l"))
    return each.select("q", F.col("col.x").alias("x"), (-F.col("col.far")).alias("cosine"), (F.col("pos") + 1).cast("int").alias("rank"))


def brute_force(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int = K, dim: int = DIM, block: int | None = None) -> DataFrame:
    """The exact lists (as ``search``) of the query rows: each block of rows meets each of at most about ``block`` queries."""
    n, m = df.count(), queries.count()
    blocks, askers = -(-n // _cell_rows(m)) or 1, -(-m // (block or 16 * BLOCK_ROWS)) or 1
    part = lambda count: F.pmod(F.xxhash64("key"), F.lit(count))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    filed = _vectors(df, key, vector, dim).select(part(blocks).alias("block"), each(askers).alias("asker"), "key", "vec", F.lit(True).alias("data"), F.lit(False).alias("query"))
    asked = _vectors(queries, key, vector, dim).select(each(blocks).alias("block"), part(askers).alias("asker"), "key", "vec", F.lit(False).alias("data"), F.lit(True).alias("query"))
    return _lists(filed.unionByName(asked).groupBy("block", "asker").applyInArrow(_meet(dim, k, None), _PAIRS), k)


def recall_of(lists: DataFrame, exact: DataFrame, counted: Column | None = None) -> DataFrame:
    """One row: n_queries of ``exact`` (those that are ``counted``, if given) and the share of all its entries that ``lists`` has."""
    hit = exact.select("q", "x").join(lists.select("q", "x", F.lit(1).alias("hit")), ["q", "x"], "left")
    q = F.col("q") if counted is None else F.when(counted, F.col("q"))
    return hit.agg(F.countDistinct(q).alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


TABLES = {"code_chunks": "id", "documents": "doc_id", "github_issues": "id"}


def mutual_pairs(df: DataFrame, key: str, vector: str, k: int = K, least: float = 0.95) -> DataFrame:
    """id_a < id_b of which each is among the other's k most similar rows, with a cosine of at least ``least``."""
    near = search(df, key, vector, k, least=least, recall=1.0, mutual=True)
    a = near.select(F.least("q", "x").alias("id_a"), F.greatest("q", "x").alias("id_b"), "q")
    return a.groupBy("id_a", "id_b").agg(F.count("*").alias("n")).where("n = 2").select("id_a", "id_b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual near neighbours within each of the three tables."""
    out = None
    for name, key in TABLES.items():
        one = mutual_pairs(table(spark, sf_dir, name, key, "embedding"), key, "embedding").select(F.lit(name).alias("record_table"), "id_a", "id_b")
        out = one if out is None else out.unionByName(one)
    return out


def _asking(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key) % 50 == 0)


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar rows, among all rows, of every row whose id is divisible by 50."""
    out = None
    for name, key in TABLES.items():
        df = table(spark, sf_dir, name, key, "embedding")
        one = search(df, key, "embedding", queries=_asking(df, key), recall=1.0)
        one = one.select(F.lit(name).alias("record_table"), F.col("q").alias("id"), F.col("x").alias("neighbour_id"), "rank", "cosine")
        out = one if out is None else out.unionByName(one)
    return out


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the lists of ``p5_neighbours`` have at least 90 % of the true entries, by brute force for all of its queries.

    ``n_queries`` counts, as the SQL does, those whose id is divisible by 200.
    """
    out = None
    for name, key in TABLES.items():
        df = table(spark, sf_dir, name, key, "embedding")
        some = _asking(df, key)
        one = recall_of(search(df, key, "embedding", queries=some, recall=1.0), brute_force(df, key, "embedding", some), F.col("q") % 200 == 0)
        one = one.select(F.lit(name).alias("record_table"), "n_queries", (F.coalesce("recall", F.lit(1.0)) >= 0.9).alias("enough"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours, "p5_recall": p5_recall}
_USABLE = "CASE WHEN len(embedding) = 64 THEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 ELSE FALSE END"
ORACLES: dict[str, str] = {
    "p5_recall": " UNION ALL ".join(f"SELECT '{n}' AS record_table, count(*) FILTER ({_USABLE} AND {k} % 200 = 0) AS n_queries, TRUE AS enough FROM {n}" for n, k in TABLES.items()),
}
