"""Predicted selectors: from the colours of neighbouring pixels, and from the nearest of a few typical blocks.

Blocks are (block, word): sixteen 2-bit selectors, pixel 0 in the lowest bits. Clusters are learnt from the distinct
words with their counts; sums are integers, so centres do not depend on how the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..session import spread, written
from .blocks import ORDER, selectors_of, word_of


def with_neighbours(px: DataFrame, width: int, columns: list[str]) -> DataFrame:
    """px (p, x, ... in rows of `width`) with structs left, up and diag of the named columns, null outside the image.

    Every pixel is sent to the places that see it, so one shuffle by place does it at any width and height.
    """
    others = [c for c in px.columns if c != "p"]
    own, seen = F.struct(*others), F.struct(*columns)
    last = F.col("x") == width - 1
    roles = ((0, "own", None), (1, "left", last), (width, "up", None), (width + 1, "diag", last))
    sent = [F.struct((F.col("p") + step).alias("p"), *((own if r == role == "own" else seen if r == role else F.lit(None)).alias(r) for _, r, _ in roles), (F.lit(False) if outside is None else outside).alias("outside")) for step, role, outside in roles]
    rows = px.select(F.inline(F.array(*sent))).where("not outside")
    met = rows.groupBy("p").agg(*(F.max(r).alias(r) for _, r, _ in roles)).where("own is not null")
    return met.select("p", "own.*", "left", "up", "diag")


def by_colour(px: DataFrame, width: int, chunk: int = 16) -> DataFrame:
    """p, sym: a pixel's selector less the one nearest to its predicted colour, or as it is at a chunk's upper and left sides.

    px holds p, x, y, ep1, ep2, sel in rows of `width`.
    """
    colours = color.pick(color.block_palette(F.col("ep1"), F.col("ep2")), F.col("sel"))
    near = with_neighbours(px.withColumns(dict(zip("rgb", colours))), width, ["r", "g", "b"])
    guess = {"guess_" + c: color.predict_med(F.col("diag")[c], F.col("up")[c], F.col("left")[c]) for c in "rgb"}
    near = near.withColumns(guess).withColumn("palette", F.array(*(F.array(*c[:3]) for c in color.block_palette(F.col("ep1"), F.col("ep2")))))
    colors = [tuple(F.col("palette")[k][c] for c in range(3)) for k in range(4)]
    delta = color.selector_delta(color.nearest_selector(colors, tuple(F.col(c) for c in guess)), F.col("sel"))
    first = (F.col("x") % chunk == 0) | (F.col("y") % chunk == 0)
    return near.select("p", F.when(first, F.col("sel")).otherwise(delta).cast("int").alias("sym"))


def block_distance(a: Column, b: Column) -> Column:
    """Squared distance of two arrays of selectors by their places between the endpoints."""
    order = F.array(*map(F.lit, color.SELECTOR_ORDER))
    at = lambda s: F.element_at(order, s.cast("int") + 1)
    return F.aggregate(F.zip_with(a, b, lambda x, y: (at(x) - at(y)) * (at(x) - at(y))), F.lit(0), lambda s, e: s + e)


def _nearest(points: np.ndarray, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of the centre sums / sizes nearest to each point, equal ones the first; products are of whole numbers."""
    square = (sums * sums).sum(axis=1) / sizes
    return ((square - 2 * (points.astype(np.float64) @ sums.T.astype(np.float64))) / sizes).argmin(axis=1)


def block_clusters(blocks: DataFrame, n: int = 256, rounds: int = 1000) -> np.ndarray:
    """(clusters, 16) rounded centres of the blocks' selectors: k-means from the n most used words to its fixed point.

    Equal counts go by word, equal distances to the earlier cluster; a cluster that loses all blocks goes. Each round
    is one stage without a shuffle and sends 17 whole numbers a cluster and task to the driver. No blocks give no
    clusters; `rounds` only guards the loop, which raises if it does not end.
    """
    uses = written(blocks.where("word is not null").groupBy("word").agg(F.count("*").alias("uses")), "block-words")
    seeds = [r.word for r in uses.orderBy(F.desc("uses"), "word").limit(n).collect()]
    if not seeds:
        return np.zeros((0, 16), np.int64)
    sums, sizes = selectors_of(np.array(seeds)), np.ones(len(seeds), np.int64)
    points = _packed(uses).persist()
    try:
        return _fixed_point(points, sums, sizes, rounds)
    finally:
        points.unpersist()


def _packed(uses: DataFrame) -> RDD:
    """The words and their uses as bytes, a pair of them for some thousands of words, over all cores."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b[c].to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("word", "uses")], ["word", "uses"])

    return spread(uses).mapInArrow(run, "word binary, uses binary").rdd.map(tuple)


def _partial(points: Iterable[tuple[bytes, bytes]], sums: np.ndarray, sizes: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Of some points the sums and sizes by nearest centre; `step` points at a time, so that their distances stay in the cache."""
    n = len(sums)
    total, count = np.zeros((n, 16)), np.zeros(n)
    for raw in points:
        words, uses = (np.frombuffer(x, np.int64) for x in raw)
        for k in range(0, len(words), step):
            sel, weight = selectors_of(words[k : k + step]), uses[k : k + step]
            own = _nearest(sel, sums, sizes)
            count += np.bincount(own, weight, n)
            total += np.stack([np.bincount(own, sel[:, j] * weight, n) for j in range(16)], axis=1)
    return total.astype(np.int64), count.astype(np.int64)


def _fixed_point(points: RDD, sums: np.ndarray, sizes: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        found = points.mapPartitions(lambda rows, sums=sums, sizes=sizes: [_partial(rows, sums, sizes)]).collect()
        sums_after, sizes_after = sum(f[0] for f in found), sum(f[1] for f in found)
        kept = np.flatnonzero(sizes_after)
        sums_after, sizes_after = sums_after[kept], sizes_after[kept]
        if len(kept) == len(sums) and (sums_after * sizes[:, None] == sums * sizes_after[:, None]).all():
            return (2 * sums_after + sizes_after[:, None]) // (2 * sizes_after[:, None])
        sums, sizes = sums_after, sizes_after
    raise RuntimeError(f"no fixed point in {rounds} rounds")


def _placed(points: np.ndarray, places: np.ndarray, step: int = 1024) -> np.ndarray:
    """Number of the places nearest to each point, equal ones the first; whole numbers, exact in double precision."""
    across, square = 2.0 * places.T, (places * places).sum(axis=1).astype(np.float64)
    own = [(square - points[k : k + step].astype(np.float64) @ across).argmin(axis=1) for k in range(0, len(points), step)]
    return np.concatenate([np.zeros(0, np.int64), *own])


def by_cluster(blocks: DataFrame, centres: np.ndarray) -> DataFrame:
    """block, cluster, delta: the nearest centre of each block, and its selectors less that one's, as a word.

    Distances are squared, by places between the endpoints; equal ones go to the earlier centre. Without centres there
    are no rows.
    """

    places = ORDER[centres]

    def run(batches):
        for b in batches:
            words, number = np.unique(b["word"].to_numpy(), return_inverse=True)
            points = ORDER[selectors_of(words)]
            own = _placed(points, places)
            delta = word_of((points + 4 - places[own]) % 4)
            yield pa.RecordBatch.from_arrays([b["block"], pa.array(own[number], pa.int32()), pa.array(delta[number])], ["block", "cluster", "delta"])

    rows = blocks.where("word is not null").select(F.col("block").cast("long"), F.col("word").cast("long"))
    if not len(centres):
        rows = rows.limit(0)
    return rows.mapInArrow(run, "block long, cluster int, delta long")
