"""Exact, radius, paged and approximate nearest neighbours of a stated query set.

Distances by a norm are taken block by block (pairwise), and the first k of each pair of blocks are kept before the
final rank. For distances and products that the caller gives as columns, queries are copied to every part of the
candidates, which are dealt by a hash into as many parts as there are shuffle partitions: an equi join on the part,
each task holding a share of the candidates. Spark broadcasts the queries only where they are below its threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import vectors
from . import pairwise


def pairs(queries: DataFrame, candidates: DataFrame, parts: int | None = None) -> DataFrame:
    """query_id, q, id, v: every query with every candidate but itself; both hold id (long) and vec."""
    parts = parts or int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    c = candidates.select("id", F.col("vec").alias("v"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    return q.join(c, "part").where("query_id <> id").drop("part")


def ranked(found: DataFrame, k: int | None = None, first: int = 1) -> DataFrame:
    """Rank by distance, equal ones by id, null ones last; rows of ranks first .. first + k - 1."""
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("dist"), "id")))
    return out if k is None else out.where((F.col("rank") >= first) & (F.col("rank") < first + k))


def distances(queries: DataFrame, candidates: DataFrame, p: float = 2, digits: int = 9) -> DataFrame:
    return pairwise.met(queries, candidates, pairwise.by_norm(p, digits))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 1, p: float = 2) -> DataFrame:
    return page(queries, candidates, 0, k, p)


def nearest_by(queries: DataFrame, candidates: DataFrame, distance: Callable[[Column, Column], Column], k: int = 1, digits: int = 9) -> DataFrame:
    """The k nearest by the caller's own distance of two array columns; a null distance takes no part."""
    found = pairs(queries, candidates).select("query_id", "id", F.round(distance(F.col("q"), F.col("v")), digits).alias("dist"))
    return ranked(found.where("dist is not null"), k)


def nearest_by_blocks(queries: DataFrame, candidates: DataFrame, distance: pairwise.Distance, k: int = 1) -> DataFrame:
    """The same by the caller's own distance of two blocks of vectors, as matrices; an unknown distance takes no part."""
    return ranked(pairwise.met(queries, candidates, distance, pairwise.nearest_of(k, nulls=False)), k)


def added(points: DataFrame, more: DataFrame, name: str = "added") -> tuple[DataFrame, Observation]:
    """The points with more of them; the observation tells how many were added once an action has run."""
    seen = Observation(name)
    return points.unionByName(more.observe(seen, F.count(F.lit(1)).alias("points"))), seen


def within(queries: DataFrame, candidates: DataFrame, radius: float, p: float = 2) -> DataFrame:
    """All strictly nearer than the radius."""
    return distances(queries, candidates, p).where(F.col("dist") < radius)


def page(queries: DataFrame, candidates: DataFrame, number: int, size: int, p: float = 2) -> DataFrame:
    """The incremental cursor: the neighbours of the number-th page."""
    found = pairwise.met(queries, candidates, pairwise.by_norm(p), pairwise.nearest_of((number + 1) * size))
    return ranked(found, size, number * size + 1)


def approximate(queries: DataFrame, candidates: DataFrame, k: int = 1, tables: int = 16, bucket: float = 0.5, seed: int = 3) -> DataFrame:
    """Candidates that share a bucket of random projections, ranked by exact distance; null vectors take no part.

    Rows meet by table and bucket, in blocks; a pair that shares several buckets is taken in the first of their tables.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def ready(df: DataFrame) -> DataFrame:
        return df.where("vec is not null").select("id", "vec", array_to_vector("vec").alias("features"))

    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(ready(candidates))

    def hashed(df: DataFrame) -> DataFrame:
        hashes = F.array(*(vector_to_array(F.col("hashes")[t])[0] for t in range(tables)))
        return model.transform(ready(df)).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), hashes.alias("buckets"))

    return ranked(pairwise.met_by_bucket(hashed(queries), hashed(candidates), k), k)


def bounding_box(df: DataFrame) -> DataFrame:
    """dim, low, high over all vectors."""
    return df.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def assign(points: DataFrame, centres: DataFrame) -> DataFrame:
    """id, vec, cluster, dist: the nearest of a small set of centres (cluster, centre), equal ones by number.

    Centres travel as one array in a one-row table, so points are neither shuffled nor paired row by row.
    """
    all_centres = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("centres"))
    d = F.transform("centres", lambda c: F.struct(F.round(vectors.distance(F.col("vec"), c["centre"]), 9).alias("dist"), c["cluster"].alias("cluster")))
    best = F.array_min(d)
    rows = points.crossJoin(F.broadcast(all_centres)).withColumn("best", best)  # one row: k centres
    return rows.select("id", "vec", F.col("best.cluster").alias("cluster"), F.col("best.dist").alias("dist"))


def recentre(assigned: DataFrame, digits: int = 9) -> DataFrame:
    """cluster, centre: the mean of each cluster; clusters without points are gone."""
    means = assigned.select("cluster", F.posexplode("vec").alias("dim", "x")).groupBy("cluster", "dim").agg(F.round(F.avg("x"), digits).alias("m"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centre"))


def kmeans(points: DataFrame, seeds: DataFrame, rounds: int = 50) -> DataFrame:
    """Assignments at the fixed point, or after `rounds`; only the k centres come to the driver."""
    spark = points.sparkSession
    centres = [tuple(r) for r in seeds.select("cluster", "centre").orderBy("cluster").collect()]
    schema = "cluster long, centre array<double>"
    for _ in range(rounds):
        table = spark.createDataFrame(centres, schema)
        after = [tuple(r) for r in recentre(assign(points, table)).select("cluster", "centre").orderBy("cluster").collect()]
        if after == centres:
            break
        centres = after
    return assign(points, spark.createDataFrame(centres, schema))


def most_used(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n most frequent values, equal counts by value."""
    return df.groupBy(value).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), value).limit(n)
