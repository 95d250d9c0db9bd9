"""Distances block by block against the column expressions on every pair, also of odd vectors; plans without a fold a pair."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators import neighbours, pairwise
from millrace.plans import registry

NAN, INF = float("nan"), float("inf")
ODD = [[1.0, 2.0], [1.0, 2.0], [1.0], [], None, [None, 2.0], [NAN, 1.0], [INF, 1.0], [-INF, 0.0], [1e200, 3.0], [0.0, 0.0], [1.0, 2.0, 3.0]]
SF = "/root/testdata/sf0.001"


@pytest.fixture(params=[(1024, 4096, 1 << 15), (5, 7, 9)])
def sizes(request, monkeypatch):
    for name, n in zip(("QUERY_ROWS", "CANDIDATE_ROWS", "CELLS"), request.param):
        monkeypatch.setattr(pairwise, name, n)


@pytest.fixture
def odd(spark):
    draw = np.random.default_rng(4)
    rows = ODD + [[float(x) for x in draw.integers(-2, 3, 2)] for _ in range(30)]
    return spark.createDataFrame(list(enumerate(rows)) + [(None, [1.0, 1.0])], "id long, vec array<double>")


def plain(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


@pytest.mark.parametrize("p", [1, 2, 3, 2.5, INF])
def test_distances_equal_columns(odd, sizes, p):
    q = odd.where("id % 2 = 0")
    want = neighbours.pairs(q, odd).select("query_id", "id", F.round(vectors.distance(F.col("q"), F.col("v"), p), 6).alias("dist"))
    assert plain(neighbours.distances(q, odd, p, 6).collect()) == plain(want.collect())


@pytest.mark.parametrize("k", [1, 4, 100])
def test_nearest_and_page_with_nulls_last(odd, sizes, k):
    q = odd.where("id % 3 = 1")
    d = neighbours.pairs(q, odd).select("query_id", "id", F.round(vectors.distance(F.col("q"), F.col("v")), 9).alias("dist"))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("dist"), "id")))
    assert plain(neighbours.nearest(q, odd, k).collect()) == plain(d.where(F.col("rank") <= k).collect())
    assert plain(neighbours.page(q, odd, 2, k).collect()) == plain(d.where((F.col("rank") > 2 * k) & (F.col("rank") <= 3 * k)).collect())


def test_angle_equals_columns(odd, sizes):
    angle = lambda a, b: 1 - F.try_divide(vectors.dot(a, b), vectors.norm(a) * vectors.norm(b))
    want = neighbours.nearest_by(odd, odd, angle, 5).collect()
    assert plain(neighbours.nearest_by_blocks(odd, odd, pairwise.by_angle(), 5).collect()) == plain(want)


@pytest.mark.parametrize("rows", [8192, 40])
def test_buckets_lose_no_pair_and_repeat_none(spark, monkeypatch, rows):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(pairwise, "BUCKET_ROWS", rows)
    draw = np.random.default_rng(7)
    x = draw.integers(-3, 4, (150, 4)) / 2
    points = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)] + [(900, None)], "id long, vec array<double>")
    q = points.where("id % 5 = 0")
    for tables, bucket in ((4, 0.3), (6, 3.0)):
        ready = points.where("vec is not null").select("id", "vec", array_to_vector("vec").alias("features"))
        model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=3).fit(ready)
        near = model.approxSimilarityJoin(ready.where("id % 5 = 0"), ready, 1e9, distCol="d")
        d = near.select(F.col("datasetA.id").alias("query_id"), F.col("datasetB.id").alias("id"), F.round(vectors.distance(F.col("datasetA.vec"), F.col("datasetB.vec")), 9).alias("dist")).where("query_id <> id")
        for k in (1, 9, 1000):
            got = neighbours.approximate(q, points, k, tables, bucket).collect()
            assert plain(got) == plain(neighbours.ranked(d, k).collect())


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e5, 1e160])
def test_limit_keeps_the_nearest(scale):
    draw = np.random.default_rng(5)
    x = draw.integers(-2, 3, (1500, 6)) * scale  # many copies and equal distances
    x[700:] += draw.normal(size=(800, 6)) * scale / 7
    full = np.ones(len(x), bool)
    v = pairwise.Block(np.arange(1500)[::-1], x, np.full(1500, 6), full, full)
    q = v.rows(slice(0, 40))
    buckets = draw.integers(0, 3, (1500, 3))
    got = pairwise.nearest_in_bucket(q, v, buckets[:40], buckets, 2, 7)
    got = [tuple(r.values()) for batch in got for r in batch.to_pylist()]
    want = []
    dist, _ = pairwise.by_norm()(q, v)
    for i in range(40):
        own = [(dist[i, j], v.ids[j]) for j in range(1500) if v.ids[j] != q.ids[i] and (buckets[i, :2] != buckets[j, :2]).all()]
        want += [(q.ids[i], j, d) for d, j in sorted(own)[:7]]
    assert got == want


def test_no_join_a_bucket(spark):
    plan = registry.QUERIES["knn_lsh"](spark, SF)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan


def test_rounding_as_sql():
    import duckdb

    draw = np.random.default_rng(2)
    x = np.concatenate([draw.random(2000) * 3, np.arange(0, 64) / 2**7, [-0.5, -2.5e-7, 1e300, INF]])
    for digits in (0, 6, 9):
        want = duckdb.execute(f"select list_transform(?::double[], lambda v: round(v, {digits}))", [x.tolist()]).fetchone()[0]
        assert pairwise.rounded(x, digits).tolist() == want


@pytest.mark.parametrize("name", ["l1_dist", "l2_dist", "linf_dist", "lp_dist", "knn_exact", "knn_page", "knn_by_angle"])
def test_no_fold_a_pair(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "aggregate(" not in plan and "FlatMapCoGroupsInArrow" in plan
