"""Exact top-k inner products by multi-resolution segment statistics.

For vectors of equal length the inner product follows from norms and the Euclidean distance, and over a segment of
length L the squared distance is at least L * ((difference of means)^2 + (difference of deviations)^2). So
`sum over segments of L * (mean * mean + deviation * deviation)` is never below the inner product. A search bounds
all pairs of a block with few long segments; pairs that cannot reach the k-th best of the rows that look best leave, and
the others are bounded again with shorter segments, of two components. Each query then computes exact products of the
rows with the highest bounds, which raises its k-th best product, and goes on with those whose bound still reaches it. The queries, a stated share of the rows, meet all rows in blocks of bounded
size on both sides, each pair of blocks a group of its own.

Components become floor(64 * x). Rows that take part: see vectors.taking_part (zero vectors do, null, ragged and
non-finite ones do not, nor do vectors with a component that 64 * x makes infinite). Products are exact whole numbers;
one beyond a long is given, and ranked, as the nearest long. Repeated rows count once; ties go to the smaller id; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship
from .vectors import blocks_of, dealt, every, matrix, taking_part

CANDIDATE_ROWS, QUERY_ROWS, SCALE, RESOLUTIONS, CHUNK = 16384, 16384, 64, (8, 32), 64
LONGS = np.iinfo(np.int64)


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) * mean and sqrt(L) * deviation of each segment: their products sum to the bound."""
    out = []
    for part in np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1])):
        own, root = x[:, part], np.sqrt(len(part))
        mean = own.mean(axis=1)
        out += [root * mean, root * np.sqrt(np.maximum(((own - mean[:, None]) ** 2).mean(axis=1), 0))]
    return np.stack(out, axis=1)


def exact_type(x: np.ndarray, y: np.ndarray):
    """The shortest kind of number in which every product sum of whole numbers is exact; else Python's integers."""
    most = max(1.0, np.abs(x).max(initial=0)) * max(1.0, np.abs(y).max(initial=0)) * x.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact products as longs, those beyond a long as the nearest one."""
    if rows.dtype == object:
        return np.array([min(max(int(p), LONGS.min), LONGS.max) for p in rows @ query], np.int64)
    return (rows @ query).astype(np.int64)


def search_block(query_ids, queries, ids, rows, k: int, counts: dict | None = None):
    """(query id, id, product) of each query's k best among the block's rows; both sides hold whole numbers.

    `counts`, where given, collects the number of pairs that each level leaves, and of exact products.
    """
    counts = {} if counts is None else counts
    tally = lambda name, n: counts.__setitem__(name, counts.get(name, 0) + int(n))
    kind = exact_type(queries, rows)
    whole = np.vectorize(int, otypes=[object]) if kind is object else lambda x: x.astype(kind)
    queries_x, rows_x = whole(queries), whole(rows)
    short = kind is np.float32
    with np.errstate(over="ignore", invalid="ignore"):
        levels = [[segment_features(x, s).astype(kind if short else np.float64) for x in (queries, rows)] for s in RESOLUTIONS]
        # rounding of a bound is far below this share of the product of norms
        slack = 1 + (1e-4 if short else 1e-9) * np.sqrt((queries**2).sum(axis=1)) * np.sqrt((rows**2).sum(axis=1).max(initial=0))
        slack = np.nan_to_num(slack, nan=np.inf, posinf=np.inf)

    def bounds(level: int, q: slice, some: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            out = levels[level][0][q] @ levels[level][1][some].T
            return out if short else np.nan_to_num(out, nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def kth_best(found: np.ndarray, before: float) -> float:
        return max(before, float(np.partition(found, len(found) - k)[-k])) if len(found) >= k else before

    out = []
    for j in range(0, len(queries), CHUNK):
        q = slice(j, j + CHUNK)
        bound = bounds(0, q, slice(None))
        bound[query_ids[q][:, None] == ids[None, :]] = -np.inf
        tally("pairs", bound.size)
        near = np.arange(len(ids))
        limit = np.full(len(bound), -np.inf)
        for level in range(len(RESOLUTIONS)):
            if level:
                bound = bounds(level, q, near)
                bound[~alive] = -np.inf
            if len(near) > 2 * k:  # what looks best at this resolution gives a first k-th best
                for i, seeds in enumerate(np.argpartition(bound, len(near) - 2 * k, axis=1)[:, -2 * k :]):
                    limit[i] = kth_best(products(rows_x[near[seeds[bound[i, seeds] > -np.inf]]], queries_x[j + i]), limit[i])
            alive = (bound > -np.inf) & (bound >= (limit - slack[q])[:, None])
            tally(f"left by {RESOLUTIONS[level]} segments", alive.sum())
            used = alive.any(axis=0)
            if not used.all():
                near, alive, bound = near[used], alive[:, used], bound[:, used]
        for i in range(len(bound)):
            left = np.flatnonzero(alive[i])
            found, scores, size = [], np.zeros(0, np.int64), 8 * k
            while len(left):
                own = bound[i, left]
                first = np.argpartition(own, len(own) - size)[-size:] if len(own) > size else np.arange(len(own))
                part = near[left[first]]
                found.append(part)
                scores = np.append(scores, products(rows_x[part], queries_x[j + i]))
                limit[i] = kth_best(scores, limit[i])
                rest = own >= limit[i] - slack[j + i]
                rest[first] = False
                left, size = left[rest], 64 * size
            tally("exact products", len(scores))
            if found:
                found = ids[np.concatenate(found)]
                best = np.lexsort((found, ~scores))[:k] if len(scores) < 8 * k else _best(found, scores, k)
                out.append((np.full(len(best), query_ids[j + i]), found[best], scores[best]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, without sorting the others."""
    near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[-k])
    return near[np.lexsort((ids[near], ~scores[near]))[:k]]


def top_products(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query (on column `id`) holds, its k highest products."""
    ship(df.sparkSession)
    rows = materialize(taking_part(df, id_col, vec_col, allow_zero=True), "vectors")
    rows = rows.where(F.forall("vec", lambda x: F.abs(x * SCALE) < float("inf")))
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    c_blocks, q_blocks = blocks_of(n, candidate_rows), blocks_of(n_queries, query_rows)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            whole = [np.floor(SCALE * matrix(t["vec"])) for t in (left, right)]
            got = search_block(left["id"].to_numpy(), whole[0], right["id"].to_numpy(), whole[1], k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(x, pa.int64()) for x in got))))

    queries = rows.where(is_query).select("id", "vec", dealt("q", q_blocks, 1), every("c", c_blocks))
    candidates = rows.select("id", "vec", every("q", q_blocks), dealt("c", c_blocks, 2))
    found = queries.groupBy("c", "q").cogroup(candidates.groupBy("c", "q")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows in DuckDB SQL, all pairs.
ORACLE = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
           where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
      from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20"""
