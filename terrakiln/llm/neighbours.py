"""Approximate nearest neighbours (op8): few stable projections, a kd-tree over them, and a chi-square stopping test.

Vectors are scaled to length 1, so that the nearest by cosine is the nearest by distance d, and projected by DIMS Gaussian
directions: the squared distance in the projection is d ** 2 times a chi-square variable of DIMS degrees. One kd-tree of
the projected space, fitted on a sample of at most SAMPLE vectors of each dimension (chosen by a hash of their ids), deals
all rows to its leaves, of about LEAF rows; the leaves' boxes are those of all their rows. A query first verifies the rows
of the FIRST leaves nearest to it on the original values. With d, the distance of the k-th best found so far, a nearer row
in a leaf at squared distance x or more would have come to lie there with probability 1 - psi(x / d ** 2) at most; leaves
where psi >= CONFIDENCE are never visited. All others, nearest or not, are verified in the second round, which returns
only what is as near as the first round's k-th.

A leaf with more than BLOCK rows is split by a hash of the id, queries come in chunks of about CHUNK. Equal vectors of a
part are one, with their k + 1 smallest ids, so a vector that a third of all rows share costs no more than any other and
ties go to the smaller id. On vectors without any structure (the synthetic ones) the test rules out about half of the
leaves; the rest is exact search by matrix products.

Scores: dot(a, b) / (|a| |b|) in double precision, summed in numpy's fixed order for a row, so equal vectors score equally.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no part;
only vectors of one dimension are compared; rows with one id count once, with their best score; fewer than k candidates
are returned as they are; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, lean, release, stored, table

K, DIMS, CONFIDENCE = 5, 16, 0.95
SAMPLE, LEAF, FIRST = 32_768, 1024, 3
BLOCK, CHUNK, SEED = 16_384, 20_000, 5
#: Queries multiplied with a part at a time, and how far a score by matrix product can be from the exact one.
TOGETHER, SLACK = 256, 1e-9


def chi_square(x: float, m: int) -> float:
    """The chance that a chi-square variable of m (even) degrees is at most x."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_at(p: float, m: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def projection(dimension: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimension, dims))


class Tree:
    """A complete kd-tree: node i splits its axis at its cut and has children 2i + 1 and 2i + 2."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        own = {0: np.arange(len(points))}
        for i in range(2**depth - 1):
            mine = own.pop(i)
            if len(mine):
                self.axis[i] = int(np.argmax(np.ptp(points[mine], axis=0)))
                self.cut[i] = np.median(points[mine, self.axis[i]])
            beyond = points[mine, self.axis[i]] > self.cut[i]
            own[2 * i + 1], own[2 * i + 2] = mine[~beyond], mine[beyond]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.axis[node]] > self.cut[node])
        return node - (2**self.depth - 1)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances at least, of each point from each box."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        p = points[:, j, None]
        off = np.maximum(np.maximum(low[:, j] - p, p - high[:, j]), 0)
        out += off * off
    return out


class Part:
    """The vectors of a leaf, or of a share of it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)])
        starts = np.flatnonzero(new)
        self.ids = [np.unique(ids[a:b])[: k + 1].tolist() for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
        self.vectors = vectors[starts]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.units, self.k = self.vectors / self.norms[:, None], k

    def search(self, owns: list[int], queries: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(query, id, score) of the k best ids of each query that score at least `least`."""
        norms = np.sqrt((queries * queries).sum(1))
        for a in range(0, len(queries), TOGETHER):
            rough = (queries[a : a + TOGETHER] / norms[a : a + TOGETHER, None]) @ self.units.T
            # a query's own id may take one of the first places, an id of several vectors several
            for i, row in enumerate(rough, a):
                take = self.k + 1
                while True:
                    floor = least[i] - SLACK
                    if take < len(row):
                        floor = max(floor, np.partition(row, len(row) - take)[len(row) - take] - 2 * SLACK)
                    near = np.flatnonzero(row >= floor)
                    scores = (self.vectors[near] * queries[i]).sum(1) / (self.norms[near] * norms[i])
                    best: dict[int, float] = {}
                    for s, j in sorted((-s, j) for s, n in zip(scores.tolist(), near.tolist(), strict=True) for j in self.ids[n] if j != owns[i]):
                        best.setdefault(j, -s)
                    if len(best) >= self.k or take >= len(row) or floor <= least[i] - SLACK:
                        break
                    take *= 2
                for j, s in list(best.items())[: self.k]:
                    if s >= least[i]:
                        yield owns[i], j, s


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(k: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        if data.num_rows and queries.num_rows:
            part = Part(data.column("vec_id").to_numpy(), _matrix(data.column("v"), data.num_rows), k)
            least = queries.column("least").to_numpy()
            rows = list(part.search(queries.column("vec_id").to_pylist(), _matrix(queries.column("v"), queries.num_rows), least))
        give_back()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 3, _OUT, strict=True)], schema=_OUT)

    return run


def _projected(batch: pa.RecordBatch, column: str, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places in the batch, projected unit vectors)."""
    sizes = np.array(batch.column("dim").to_pylist(), np.int64)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        v = _matrix(batch.column(column).take(pa.array(at)), len(at))
        yield dim, at, (v / np.sqrt((v * v).sum(1, keepdims=True))) @ projection(dim, dims)


def _place(sent, dims: int):
    """Adds leaf and p (projected)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for batch in batches:
            leaf, projected = np.zeros(batch.num_rows, np.int32), np.zeros((batch.num_rows, dims))
            for dim, at, p in _projected(batch, "v", dims):
                projected[at] = p
                leaf[at] = trees[dim].leaf(p)
            p = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dims), pa.array(projected.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), p], [*batch.schema.names, "leaf", "p"])

    return run


def _visits(sent, first: int, again: bool, bound: float, dims: int):
    """The parts of leaves that a query visits: its `first` nearest leaves; again: all others that the test doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = sent.value  # by dimension: leaves, low, high, shares
        for batch in batches:
            least = batch.column("least").to_numpy()
            rows, leaves, shares = [], [], []
            points = _matrix(batch.column("p"), batch.num_rows)
            sizes = np.array(batch.column("dim").to_pylist(), np.int64)
            for dim in np.unique(sizes).tolist():
                numbers, low, high, parts = boxes[dim]
                for a in range(0, batch.num_rows, 512):
                    own = np.flatnonzero(sizes[a : a + 512] == dim) + a
                    x = box_distances(points[own], low, high)
                    place = np.argsort(np.argsort(x, 1, kind="stable"), 1, kind="stable")
                    go = (place >= first) & (x <= bound * np.maximum(2 - 2 * least[own, None], 1e-12)) if again else place < first
                    for i, j in zip(*np.nonzero(go), strict=True):
                        rows += [own[i]] * parts[j]
                        leaves += [numbers[j]] * parts[j]
                        shares += range(parts[j])
            kept = batch.select(["vec_id", "v", "dim", "least", "chunk"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(leaves, pa.int32()), pa.array(shares, pa.int32())], [*kept.schema.names, "leaf", "share"])

    return run


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: of all found, the k best ids of each query."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, dims: int = DIMS, leaf: int = LEAF, block: int = BLOCK, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors (vec_id, embedding) to each row where is_query holds."""
    sc = vectors.sparkSession.sparkContext
    whole = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("embedding")), F.lit(False)))
    rows = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim"), is_query.alias("q"))
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    drawn = F.pmod(F.xxhash64("vec_id", F.lit("tree")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    held = defaultdict(list)
    for dim, n in sizes.items():  # about half the bound is drawn, never more than the bound is taken
        held[dim] = [r.v for r in rows.where((F.col("dim") == dim) & (drawn < min(1.0, sample / 2 / n))).select("v").limit(sample).collect()]
    trees = {}
    for dim, n in sizes.items():
        v = np.array(held[dim], float).reshape(-1, dim)
        depth = max(0, round(math.log2(max(1, min(n / leaf, len(v) / 8)))))
        trees[dim] = Tree((v / np.sqrt((v * v).sum(1, keepdims=True))) @ projection(dim, dims), depth)
    placed = stored(rows.mapInArrow(lean(_place(sc.broadcast(trees), dims)), "vec_id long, v array<double>, dim int, q boolean, leaf int, p array<double>"))
    ends = [f(F.get("p", F.lit(j))).alias(f"{n}{j}") for n, f in (("a", F.min), ("b", F.max)) for j in range(dims)]
    boxes = defaultdict(lambda: ([], [], [], []))
    facts = placed.groupBy("dim", "leaf").agg(F.count("*").alias("n"), F.count_if("q").alias("n_q"), *ends).orderBy("dim", "leaf").collect()  # a row per leaf
    for r in facts:
        for own, value in zip(boxes[r.dim], (r.leaf, [r[f"a{j}"] for j in range(dims)], [r[f"b{j}"] for j in range(dims)], -(-r.n // block)), strict=True):
            own.append(value)
    sent = sc.broadcast({dim: (leaves, np.array(low), np.array(high), parts) for dim, (leaves, low, high, parts) in boxes.items()})
    n_chunks = max(1, -(-sum(r.n_q for r in facts) // chunk))
    shares = F.broadcast(vectors.sparkSession.createDataFrame([(d, x, p) for d, (leaves, _, _, parts) in boxes.items() for x, p in zip(leaves, parts, strict=True)], "_dim int, _leaf int, parts int"))
    shared = placed.join(shares, (F.col("dim") == F.col("_dim")) & (F.col("leaf") == F.col("_leaf")))
    mixed = F.xxhash64("vec_id")
    data = shared.select("vec_id", "v", "dim", "leaf", F.pmod(mixed, F.col("parts")).cast("int").alias("share"), F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"))
    queries = placed.where("q").select("vec_id", "v", "dim", "p", F.pmod(mixed, F.lit(n_chunks)).cast("int").alias("chunk"))
    keys, bound = ["dim", "leaf", "share", "chunk"], chi_square_at(CONFIDENCE, dims)

    def verified(asked: DataFrame, again: bool) -> DataFrame:
        visits = asked.mapInArrow(lean(_visits(sent, FIRST, again, bound, dims)), "vec_id long, v array<double>, dim int, least double, chunk int, leaf int, share int")
        return data.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score double")

    first = stored(_best(verified(queries.withColumn("least", F.lit(-2.0)), False), k))
    least = first.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("_s"))
    asked = queries.join(least, F.col("vec_id") == F.col("_q"), "left").withColumn("least", F.coalesce("_s", F.lit(-2.0))).drop("_q", "_s")
    out = stored(_best(first.select("query_id", "vec_id", "score").union(verified(asked, True)), k))
    release(placed, first)
    return out


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
