"""Approximate nearest neighbours over stable projections.

Vectors are projected to a few dimensions by Gaussian (2-stable) weights, so
the squared projected distance over the squared distance is chi-square.  The
projections are indexed by kd-trees: a shallow one, fitted on a bounded sample,
deals all vectors to cells, and each cell has its own.  A query meets projected
neighbours in order of their distance and verifies them until the next one's
distance makes it improbable, by the chi-square distribution, that a nearer
vector was missed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.storage import stored

#: Points in a bucket of a cell's tree.
BUCKET = 256
RESULT = "key long, query_id long, vec_id long, score double"


def chi_square_quantile(p: float, freedom: int) -> float:
    """The quantile for an even number of degrees of freedom, by bisection."""

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Deal:
    """The shallow tree: which cell a projection belongs to, and which cells
    lie within a distance."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.splits: list[tuple[int, float] | None] = []
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        dims = sample.shape[1]
        self.root = self._grow(sample, leaves, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.lows, self.highs = (np.stack(x) for x in zip(*self.boxes, strict=True))

    def _grow(self, points: np.ndarray, leaves: int, low: np.ndarray, high: np.ndarray):
        if leaves <= 1 or len(points) < 2 or np.ptp(points, axis=0).max() == 0:
            self.boxes.append((low, high))
            return len(self.boxes) - 1
        axis = int(np.ptp(points, axis=0).argmax())
        at = float(np.median(points[:, axis]))
        if not (points[:, axis] >= at).any() or not (points[:, axis] < at).any():
            at = float(points[:, axis].mean())
        left_high, right_low = high.copy(), low.copy()
        left_high[axis] = right_low[axis] = at
        side = points[:, axis] < at
        return (axis, at, self._grow(points[side], leaves // 2, low, left_high), self._grow(points[~side], leaves - leaves // 2, right_low, high))

    def leaf(self, point: np.ndarray) -> int:
        node = self.root
        while isinstance(node, tuple):
            node = node[2] if point[node[0]] < node[1] else node[3]
        return node

    def within(self, point: np.ndarray, square: float) -> list[int]:
        d = np.maximum(self.lows - point, 0) + np.maximum(point - self.highs, 0)
        return np.flatnonzero((d * d).sum(axis=1) <= square).tolist()


def gap(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """The squared distance from a point to a box."""
    d = np.maximum(low - point, 0) + np.maximum(point - high, 0)
    return float((d * d).sum())


class CellTree:
    """A kd-tree over the projections of one cell with bounding boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray):
        self.ids, self.vectors, self.projected = ids, vectors, projected
        self.root = self._grow(np.arange(len(ids)))

    def _grow(self, rows: np.ndarray):
        points = self.projected[rows]
        low, high = points.min(axis=0), points.max(axis=0)
        if len(rows) <= BUCKET or (high == low).all():
            return (low, high, rows, None, None)
        order = np.argsort(points[:, int((high - low).argmax())], kind="stable")
        half = len(rows) // 2
        return (low, high, None, self._grow(rows[order[:half]]), self._grow(rows[order[half:]]))

    def search(self, own: int, vector: np.ndarray, point: np.ndarray, k: int, limit: float, bound: float):
        """The ``k`` nearest verified (squared distance, id); ``bound`` is a
        squared distance within which ``k`` are known to lie."""
        best_d, best_i = np.empty(0), np.empty(0, dtype=np.int64)
        reach, tick = bound, 0
        heap = [(gap(point, self.root[0], self.root[1]), tick, self.root)]
        while heap:
            near, _, (low, high, rows, left, right) = heapq.heappop(heap)
            if near > limit * reach:
                break
            if rows is None:
                for child in (left, right):
                    tick += 1
                    heapq.heappush(heap, (gap(point, child[0], child[1]), tick, child))
                continue
            if reach < np.inf:
                diff = self.projected[rows] - point
                rows = rows[(diff * diff).sum(axis=1) <= limit * reach]
            for lo in range(0, len(rows), 8192):
                part = rows[lo : lo + 8192]
                part = part[self.ids[part] != own]
                diff = self.vectors[part] - vector
                best_d = np.concatenate([best_d, (diff * diff).sum(axis=1)])
                best_i = np.concatenate([best_i, self.ids[part]])
                order = np.lexsort((best_i, best_d))[:k]
                best_d, best_i = best_d[order], best_i[order]
            if len(best_d) == k:
                reach = min(reach, float(best_d[-1]))
        return best_d, best_i


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Vectors that are not null or zero and have no null or non-finite part."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    confidence: float = 0.99,
    dims: int = 8,
    seed: int = 7,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    cell_rows: int = 4_000,
    max_leaves: int = 4096,
    sample_rows: int = 20_000,
    block_queries: int = 5_000,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (Euclidean, double):
    the ``k`` nearest of all other rows to each row that ``is_query`` (a
    condition) selects, ties to the smaller id.

    Each of a query's true neighbours is found with a probability of at least
    ``confidence``.  The dealing tree is fitted on at most about
    ``sample_rows`` vectors; every vector is indexed.  Leaves with more than
    ``cell_rows`` vectors, such as those of copies, are split by a hash of the
    id; queries come in blocks of ``block_queries``.  A first round in a query's
    own cell bounds its k-th distance, a second visits the cells within reach.
    Unusable vectors (see ``usable``) and rows without id take no part.
    Distances are between vectors of a length, so each length is a space of its
    own.  Rows with the query's id are not its candidates; repeated rows are
    candidates of their own.  Each query row, a repeated one or one of several
    under an id too, has ranks from 1 of its own.  Empty tables, or none left
    to search, give an empty table; other columns play no part.
    """
    if dims % 2:
        raise ValueError("dims must be even")
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q")), "v").where(F.col("id").isNotNull())
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("v")).alias("longest")).first()
    total, longest = sizes["rows"], sizes["longest"]
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    weights = np.random.default_rng(seed).standard_normal((longest, dims))
    limit = chi_square_quantile(confidence, dims)

    # one tree deals the vectors of all lengths, by projections with the first weights; a leaf's number tells the length too
    rate = min(1.0, sample_rows / total)
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < rate * 1_000_000).select("v").limit(2 * sample_rows)
    sample = np.array([np.array(r["v"]) @ weights[: len(r["v"])] for r in picked.toLocalIterator()]).reshape(-1, dims)
    deal = Deal(sample, min(max_leaves, max(1, math.ceil(total / cell_rows))))
    many = len(deal.boxes)

    @F.pandas_udf("p array<double>, leaf long")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            p = [x @ weights[: len(x)] for x in v] if v.map(len).nunique() > 1 else list((np.stack(v) if len(v) else np.empty((0, longest))) @ weights[: len(v.iloc[0]) if len(v) else longest])
            yield pd.DataFrame({"p": p, "leaf": [len(x) * many + deal.leaf(y) for x, y in zip(v, p, strict=True)]})

    placed = stored(rows.withColumn("x", project("v")).select(F.monotonically_increasing_id().alias("key"), "id", "v", F.coalesce("q", F.lit(False)).alias("q"), "x.p", "x.leaf"), "projections")
    filled = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
    parts = F.element_at(F.create_map(*(F.lit(x) for leaf, n in filled.items() for x in (leaf, math.ceil(n / cell_rows)))), F.col("leaf"))
    part_of = F.pmod(F.xxhash64("id"), parts).cast("int")
    queries = placed.where("q").select("key", "id", "v", "p", "leaf")

    def met(asked: DataFrame, find, schema: str) -> DataFrame:
        """Candidates and queries by cell and block of queries."""
        busy = {r["leaf"]: r["count"] for r in asked.groupBy("leaf").count().collect()}
        if not busy:
            return spark.createDataFrame([], schema)
        blocks = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for leaf, n in busy.items() for x in (leaf, math.ceil(n / block_queries)))), F.col("leaf")), F.lit(0))
        cands = placed.select("id", "v", "p", "leaf", part_of.alias("part"), F.explode(F.sequence(F.lit(1), blocks)).alias("block")).where(blocks > 0)
        asked = asked.withColumn("block", (F.pmod(F.xxhash64("key", F.lit(1)), blocks) + 1).cast("int"))
        cell = ["leaf", "part", "block"]
        return asked.groupBy(*cell).cogroup(cands.groupBy(*cell)).applyInPandas(find, schema)

    def tree(c: pd.DataFrame) -> CellTree:
        return CellTree(c["id"].to_numpy(np.int64), np.stack(c["v"]), np.stack(c["p"]))

    def bound(asked: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(c):
            index = tree(c)
            for key, i, v, p in zip(asked["key"], asked["id"], asked["v"], asked["p"], strict=True):
                d, _ = index.search(i, np.asarray(v), np.asarray(p), k, limit, np.inf)
                found.append((key, i, v, p, float(d[-1]) if len(d) == k else None))
        return pd.DataFrame(found, columns=["key", "id", "v", "p", "bound"])

    home = queries.withColumn("part", part_of)
    bounded = stored(met(home, bound, "key long, id long, v array<double>, p array<double>, bound double"), "bounds")

    @F.pandas_udf("array<long>")
    def reach(points: pd.Series, bounds: pd.Series, lengths: pd.Series) -> pd.Series:
        every = range(many)
        near = [every if b is None or np.isnan(b) else deal.within(np.asarray(p), limit * b) for p, b in zip(points, bounds, strict=True)]
        return pd.Series([[n * many + i for i in x] for x, n in zip(near, lengths, strict=True)])

    sent = bounded.withColumn("leaf", F.explode(reach("p", "bound", F.size("v"))))
    sent = stored(sent.where(F.coalesce(parts, F.lit(0)) > 0).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), "routes")

    def verify(asked: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(c):
            index = tree(c)
            for key, i, v, p, b in zip(asked["key"], asked["id"], asked["v"], asked["p"], asked["bound"], strict=True):
                d, ids = index.search(i, np.asarray(v), np.asarray(p), k, limit, np.inf if b is None or np.isnan(b) else b)
                out += [(key, i, int(j), math.sqrt(x)) for x, j in zip(d, ids, strict=True)]
        return pd.DataFrame(out, columns=["key", "query_id", "vec_id", "score"])

    best = F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))
    return met(sent, verify, RESULT).withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
