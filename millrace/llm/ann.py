"""Approximate nearest neighbours in a low-dimensional stable projection, indexed by kd-trees.

Vectors are projected by a Gaussian matrix (2-stable) to `m` dimensions. A bounded sample fits the top of a kd-tree
over the projections, whose leaves are the regions; every row is indexed in its region, and a region with more rows
than a group may hold is dealt into several groups, each with a kd-tree of its own. The projected squared distance
of a neighbour at distance d is d^2 times a chi-square variable of m degrees. So a search takes projected neighbours
in ascending order, leaf by leaf, verifies them on the original vectors, and stops when the next one's projected
squared distance is beyond d_k^2 times the `confidence` quantile: each neighbour nearer than d_k would have come
before with that probability. Regions that the test already rules out by the k-th distance to the sample, an upper
bound of d_k, are never visited. Each block of queries meets a group's rows once, so the rows are copied once for every
`query_rows` queries. Projections of equal vectors differ in the last bits between matrix products of
different shape, so each test allows for rounding: at distance 0 copies still pass.

Rows that take part: see vectors.taking_part (null, zero, ragged and non-finite vectors do not). Repeated rows count
once; ties go to the smaller id; with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship
from .vectors import blocks_of, dealt, every, matrix, taking_part

DIMENSIONS, CONFIDENCE, SAMPLE_ROWS, GROUP_ROWS, QUERY_ROWS, LEAF_ROWS, SEED = 16, 0.95, 4096, 8192, 16384, 128, 11
ROUNDING = 1e-9  # of the squared norm of a query's projection


def chi_square_quantile(p: float, m: int) -> float:
    """Of an even number of degrees, by bisection of the closed form of its distribution."""

    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def kd_leaves(points: np.ndarray, leaf_rows: int) -> list[np.ndarray]:
    """Row numbers of each leaf; cuts at the median of the widest dimension."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf_rows:
            leaves.append(rows)
            continue
        own = points[rows]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        half = len(rows) // 2
        order = np.argpartition(own[:, axis], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return leaves


class Regions:
    """The top of the tree, fitted on the sample: cuts, and the box of each region."""

    def __init__(self, points: np.ndarray, n: int) -> None:
        m = points.shape[1]
        self.cuts: list[tuple] = []  # axis, value, left, right; a region as -1 - its number
        self.low, self.high = [], []

        def grow(rows: np.ndarray, want: int, low: np.ndarray, high: np.ndarray) -> int:
            own = points[rows]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(rows) else 0
            value = float(np.median(own[:, axis])) if len(rows) else 0.0
            left = rows[own[:, axis] < value] if len(rows) else rows
            if want <= 1 or len(rows) < 16 or not len(left):
                self.low.append(low)
                self.high.append(high)
                return -len(self.low)
            at = len(self.cuts)
            self.cuts.append(())
            split = value
            lows, highs = low.copy(), high.copy()
            highs[axis], lows[axis] = split, split
            a = grow(left, want // 2, low, highs)
            b = grow(rows[own[:, axis] >= value], want // 2, lows, high)
            self.cuts[at] = (axis, split, a, b)
            return at

        inf = np.full(m, np.inf)
        self.root = grow(np.arange(len(points)), 1 << max(0, (n - 1).bit_length()), -inf, inf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), self.root)
        for at, (axis, value, a, b) in enumerate(self.cuts):  # a cut comes before those below it
            here = np.flatnonzero(node == at)
            node[here] = np.where(points[here, axis] < value, a, b)
        return -1 - node

    def squared_distance(self, points: np.ndarray) -> np.ndarray:
        """Of each point to each region's box."""
        out = np.empty((len(points), len(self.low)))
        for k, p in enumerate(points):
            gap = np.maximum(np.maximum(self.low - p, p - self.high), 0)
            out[k] = (gap**2).sum(axis=1)
        return out


def search_group(query_ids, queries, bounds, ids, vectors, gaussian, k: int, quantile: float):
    """(query id, id, distance) of the k nearest that each query finds among the group's rows."""
    out = []
    points = vectors @ gaussian
    leaves = kd_leaves(points, LEAF_ROWS)
    low = np.array([points[r].min(axis=0) for r in leaves])
    high = np.array([points[r].max(axis=0) for r in leaves])
    own = queries @ gaussian
    slacks = ROUNDING * (own**2).sum(axis=1)
    for q, vec, bound, p, slack in zip(query_ids, queries, bounds, own, slacks):
        gap = np.maximum(np.maximum(low - p, p - high), 0)
        near = (gap**2).sum(axis=1)
        limit = bound
        kept_d, kept_i = np.zeros(0), np.zeros(0, np.int64)
        for leaf in np.argsort(near, kind="stable"):
            if near[leaf] > limit * limit * quantile + slack:
                break  # the chi-square test holds for all that is left
            rows = leaves[leaf]
            rows = rows[((points[rows] - p) ** 2).sum(axis=1) <= limit * limit * quantile + slack]
            rows = rows[ids[rows] != q]
            if not len(rows):
                continue
            d = np.sqrt(((vectors[rows] - vec) ** 2).sum(axis=1))
            kept_d, kept_i = np.concatenate([kept_d, d]), np.concatenate([kept_i, ids[rows]])
            if len(kept_d) > k:
                order = np.lexsort((kept_i, kept_d))[:k]
                kept_d, kept_i = kept_d[order], kept_i[order]
            if len(kept_d) == k:
                limit = min(limit, kept_d.max())
        out.append((np.full(len(kept_d), q), kept_i, kept_d))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", m: int = DIMENSIONS, confidence: float = CONFIDENCE, sample_rows: int = SAMPLE_ROWS, group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query (on column `id`) holds, its k nearest found."""
    spark = df.sparkSession
    ship(spark)
    rows = materialize(taking_part(df, id_col, vec_col, allow_zero=False), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    sample = rows.orderBy(F.xxhash64("id", "vec")).limit(sample_rows).toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample_ids, sample = sample["id"].to_numpy(np.int64), np.array(sample["vec"].tolist(), dtype=np.float64).reshape(len(sample), -1)
    gaussian = np.random.default_rng(seed).standard_normal((sample.shape[1], m))
    regions = Regions(sample @ gaussian, blocks_of(n, group_rows))
    quantile = chi_square_quantile(confidence, m)

    def place(batches):
        for b in batches:
            vec = matrix(b.column(1))
            region = regions.of(vec @ gaussian) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region, pa.int32())], ["id", "vec", "region"])

    placed = rows.mapInArrow(place, "id long, vec array<double>, region int")
    sizes = dict(placed.groupBy("region").count().collect())  # a row per region, at most a quarter of the sample's rows
    parts = {int(r): blocks_of(c, group_rows) for r, c in sizes.items()}
    query_blocks = blocks_of(n_queries, query_rows)

    def visit(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, vec = b.column(0).to_numpy(), matrix(b.column(1))
            bounds = np.full(len(ids), np.inf)
            for i in range(len(ids)):
                d = np.sqrt(((sample - vec[i]) ** 2).sum(axis=1))[sample_ids != ids[i]]
                if len(d) >= k:
                    bounds[i] = np.partition(d, k - 1)[k - 1]
            points = vec @ gaussian
            near = regions.squared_distance(points) <= (bounds**2 * quantile + ROUNDING * (points**2).sum(axis=1))[:, None]
            at, region = np.nonzero(near)
            copies = np.array([parts.get(int(r), 0) for r in region], dtype=np.int64)
            part = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            at, region = np.repeat(at, copies), np.repeat(region, copies)
            for j in range(0, len(at), 4096):
                s = slice(j, j + 4096)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(region[s], pa.int32()), pa.array(part[s], pa.int32()), b.column(0).take(pa.array(at[s])), b.column(1).take(pa.array(at[s])), pa.array(bounds[at[s]])],
                    ["region", "part", "id", "vec", "bound"],
                )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = not left.num_rows or not right.num_rows
        got = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)] if empty else search_group(
            left["id"].to_numpy(), matrix(left["vec"]), left["bound"].to_numpy(), right["id"].to_numpy(), matrix(right["vec"]), gaussian, k, quantile)
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.float64())})

    queries = rows.where(is_query).mapInArrow(visit, "region int, part int, id long, vec array<double>, bound double")
    queries = queries.withColumn("block", dealt("block", query_blocks, seed))
    counts = F.create_map(*[F.lit(x) for item in parts.items() for x in item]) if parts else F.create_map(F.lit(0), F.lit(1))
    part = F.pmod(F.xxhash64("id", "vec", F.lit(seed + 1)), F.element_at(counts, F.col("region"))).cast("int").alias("part")
    candidates = placed.select("region", part, "id", "vec", every("block", query_blocks))
    keys = ["region", "part", "block"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
