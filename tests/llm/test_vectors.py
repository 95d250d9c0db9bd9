"""The vector searches against brute force: recall, exact products, and rows that take no part."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, queries, topk

SF = "/root/testdata/sf0.01"


def brute(df, step, k, score):
    rows = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in df.collect()]
    ids, mat = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    out = {}
    for i, v in rows:
        if i % step == 0:
            s = score(mat, v)
            out[i] = [(int(j), float(x)) for j, x in sorted(((j, x) for j, x in zip(ids, s) if j != i), key=lambda p: (p[1], p[0]))[:k]]
    return out


def euclid(mat, v):
    return np.sqrt(((mat - v) ** 2).sum(axis=1))


@pytest.mark.parametrize("group_rows,query_rows", [(8192, 4096), (64, 2)])
def test_recall_of_nearest(spark, group_rows, query_rows):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute(df, 20, 10, euclid)
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, group_rows=group_rows, query_rows=query_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    exact = {(q, i): s for q, v in brute(df, 20, 500, euclid).items() for i, s in v}
    assert all(s == pytest.approx(exact[q, i], rel=1e-14) for q, v in got.items() for i, s in v)


@pytest.mark.parametrize("group_rows,query_rows", [(8192, 4096), (8192, 3), (64, 1)])
def test_nearest_among_copies(spark, group_rows, query_rows):
    draw = np.random.default_rng(5).standard_normal((480, 64)).astype(np.float32)
    draw[::3] = draw[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw)], "vec_id long, embedding array<float>")
    want = brute(df, 20, 10, euclid)
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, group_rows=group_rows, query_rows=query_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    assert all(got[q] == want[q] for q in want if q % 60 == 0)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 9 * len(want)


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert ann.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)


def awkward(spark):
    rows = [(0, [0.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (100, [1.0, 0.1]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [-3.0, 2.5])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("rank", F.lit(1))


def test_rows_that_take_no_part(spark):
    df = awkward(spark)
    got = sorted(map(tuple, ann.nearest(df, F.col("id") % 20 == 0).collect()))
    assert [(q, r, v) for q, r, v, _ in got] == [(20, 1, 9), (20, 2, 10), (20, 3, 100), (20, 4, 11), (100, 1, 9), (100, 2, 10), (100, 3, 20), (100, 4, 11)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_products(df, F.col("id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9, 0), (0, 2, 10, 0), (0, 3, 11, 0), (20, 1, 9, 4096), (20, 2, 10, 4096), (20, 3, 100, 4096), (100, 1, 9, 4096), (100, 2, 10, 4096), (100, 3, 20, 4096)]
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert topk.top_products(df.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("blocks", [(8192, 2048), (100, 7)])
def test_top_products_equal_sql(spark, blocks):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(con.sql(queries.ORACLE["op7_top_products"]).fetchall())
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert sorted(map(tuple, topk.top_products(df, F.col("id") % 20 == 0, candidate_rows=blocks[0], query_rows=blocks[1]).collect())) == want


def test_products_beyond_doubles():
    rows = np.array([[2.0**40, 1.0], [2.0**40 - 1, 3.0], [1.0, 1.0]])
    got = topk.search_block(np.array([9]), np.array([[2.0**20, 1.0]]), np.array([1, 2, 3]), rows, 2)
    assert [x.tolist() for x in got] == [[9, 9], [1, 2], [2**60 + 1, 2**60 - 2**20 + 3]]


def test_bounds_leave_pairs_out():
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((20, 64)) * 60
    rows = np.floor(centres[draw.integers(0, 20, 3000)] + draw.standard_normal((3000, 64)) * 20)
    ids, counts = np.arange(3000), {}
    qs, found, scores = topk.search_block(ids[::20], rows[::20], ids, rows, 20, counts)
    for q in ids[::20]:
        own = [(-int(rows[q] @ rows[i]), i) for i in ids if i != q]
        assert [(-s, i) for s, i in sorted(own)[:20]] == list(zip(scores[qs == q].tolist(), found[qs == q].tolist()))
    assert counts["pairs"] == 150 * 3000
    assert counts["left by 8 segments"] >= counts["left by 32 segments"] >= counts["exact products"]
    assert counts["exact products"] < counts["pairs"] / 4


def test_products_of_large_components(spark):
    rows = [(0, [1e20, 1.0]), (20, [1e300, -1e300]), (40, [1e307, 1.0]), (1, [1e20, -2.0]), (2, [-1e20, 1.0]), (3, [1.0, 1.0]), (60, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_products(df, F.col("id") % 20 == 0, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    most = 2**63 - 1
    assert got == {0: [(1, most), (3, most), (20, most)], 20: [(0, most), (1, most), (3, 0)], 60: [(0, 0), (1, 0), (2, 0)]}
