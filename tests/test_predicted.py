"""Predicted selectors and typical blocks against plain loops; bit writer, chunks, 16-bit stream, caller's distance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import bits, grid
from millrace.operators import blocks as B
from millrace.operators import entropy, neighbours, prediction

PLACE = [0, 3, 1, 2]


def plain_clusters(words: list[int], n: int) -> list[list[int]]:
    """From the n most used words, with exact fractions, to the fixed point."""
    from fractions import Fraction

    points = [[(w >> 2 * k) & 3 for k in range(16)] for w in words]
    uses = sorted(set(words), key=lambda w: (-words.count(w), w))[:n]
    centres = [[Fraction((w >> 2 * k) & 3) for k in range(16)] for w in uses]
    while True:
        own = [min(range(len(centres)), key=lambda c: (sum((x - y) ** 2 for x, y in zip(p, centres[c])), c)) for p in points]
        after = []
        for c in range(len(centres)):
            mine = [p for p, o in zip(points, own) if o == c]
            if mine:
                after.append([Fraction(sum(col), len(mine)) for col in zip(*mine)])
        if after == centres:
            return [[int(v + Fraction(1, 2)) for v in c] for c in centres]
        centres = after


@pytest.mark.parametrize("n", [1, 3, 8])
def test_clusters_equal_a_plain_loop(spark, n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 4, (5, 16))
    noisy = np.where(rng.random((60, 16)) < 0.15, rng.integers(0, 4, (60, 16)), base[rng.integers(0, 5, 60)])
    words = [int(w) for w in B.word_of(noisy)] + [7, 7, 7]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)] + [(99, None)], "block long, word long").repartition(3)
    centres = prediction.block_clusters(df, n)
    want = plain_clusters(words, n)
    assert centres.tolist() == want
    got = {r.block: (r.cluster, r.delta) for r in prediction.by_cluster(df, centres).collect()}
    assert set(got) == set(range(len(words)))
    for block, w in enumerate(words):
        sel = [(w >> 2 * k) & 3 for k in range(16)]
        dist = [sum((PLACE[a] - PLACE[b]) ** 2 for a, b in zip(sel, c)) for c in want]
        cluster = dist.index(min(dist))
        delta = sum(((PLACE[a] + 4 - PLACE[b]) % 4) << 2 * k for k, (a, b) in enumerate(zip(sel, want[cluster])))
        assert got[block] == (cluster, delta)


def test_a_round_of_clusters_is_one_stage(spark):
    words = B.word_of(np.random.default_rng(6).integers(0, 4, (900, 16)))
    df = spark.createDataFrame([(k, int(w)) for k, w in enumerate(words)], "block long, word long")
    points, rounds = B.selectors_of(np.sort(words)), 0
    sums, sizes = points[:30], np.ones(30, np.int64)
    while True:
        rounds += 1
        own = prediction._nearest(points, sums, sizes)
        after = [points[own == c].sum(axis=0) for c in range(30)]
        if (np.array(after) * sizes[:, None] == sums * np.bincount(own, minlength=30)[:, None]).all():
            break
        sums, sizes = np.array(after), np.bincount(own, minlength=30)
    spark.sparkContext.setJobGroup("clusters", "")
    prediction.block_clusters(df, 30)
    tracker = spark.sparkContext.statusTracker()
    stages = sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("clusters"))
    spark.sparkContext.setJobGroup("other", "")
    assert rounds > 8 and stages < 2 * rounds + 12


@pytest.mark.parametrize("n", [0, 1, 7, 50])
def test_nearest_places_piece_by_piece(n):
    draw = np.random.default_rng(n)
    points, places = draw.integers(0, 4, (n, 16)), draw.integers(0, 4, (5, 16))
    places = np.concatenate([places, places])  # equal ones
    want = [min(range(10), key=lambda c: (int(((p - places[c]) ** 2).sum()), c)) for p in points]
    assert prediction._placed(points, places, step=7).tolist() == want


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "block long, word long")
    assert prediction.block_clusters(none, 4).shape == (0, 16)
    assert prediction.by_cluster(none, prediction.block_clusters(none, 4)).count() == 0


def test_neighbours_stop_at_the_sides(spark):
    px = spark.createDataFrame([(p, p % 3, p * 10) for p in range(6)], "p long, x int, v int")
    rows = {r.p: [None if s is None else s.v for s in (r.left, r.up, r.diag)] for r in prediction.with_neighbours(px, 3, ["v"]).collect()}
    assert rows == {0: [None] * 3, 1: [0, None, None], 2: [10, None, None], 3: [None, 0, None], 4: [30, 10, 0], 5: [40, 20, 10]}


def test_bit_writer_goldens(spark):
    # The first bytes and the lengths of three programs
    programs = {"words": [(0xBEEF, 16), (0xDEAD, 16)], "widths": [(k, k + 1) for k in range(10)], "ones": [(1, 1), (3, 2), (7, 3), (15, 4), (31, 5), (1, 1), (255, 8), (63, 6)], "none": [], "high": [(0xFF01, 4)]}
    want = {"words": "EFBEADDE", "ones": "FFFFFF3F", "none": "", "high": "01"}
    df = spark.createDataFrame(list(programs.items()), "name string, steps array<struct<val:long,nbits:int>>")
    got = {r.name: r.h for r in df.select("name", F.hex(bits.write_bits(F.col("steps"))).alias("h")).collect()}
    assert got["widths"].startswith("D290C2") and len(got["widths"]) == 14
    assert {k: got[k] for k in want} == want
    assert spark.createDataFrame([(None,)], "steps array<struct<val:long,nbits:int>>").select(bits.write_bits(F.col("steps"))).first()[0] is None


def test_chunks_cover_uneven_images(spark):
    at = lambda w, h, a, b: [tuple(r) for r in spark.range(1).select(F.inline(grid.chunks(F.lit(w), F.lit(h), a, b))).collect()]
    assert at(5, 3, 4, 2) == [(0, 0, 0), (1, 4, 0), (2, 0, 2), (3, 4, 2)]
    assert at(0, 3, 4, 2) == []


@pytest.mark.parametrize("n", [1, 8192, 8193, entropy.SHORT_LIMIT])
def test_short_stream_of_many_groups(n):
    rng = np.random.default_rng(n)
    v = np.where(rng.random(n) < 0.1, rng.integers(-32768, 32768, n), rng.integers(-9, 9, n))
    raw = entropy.encode_short_stream(v)
    back = entropy.decode_short_stream(raw)
    assert (back[:n] == v).all() and not back[n:].any()
    assert len(raw) == entropy.short_header(raw)[2] + entropy.short_header(raw)[1].sum()


def test_short_stream_refuses_what_does_not_fit():
    for bad in ([], [40000], np.zeros(entropy.SHORT_LIMIT + 1)):
        with pytest.raises(ValueError):
            entropy.encode_short_stream(np.array(bad))


def test_options_are_filled():
    assert (entropy.Options.filled((2, 1, 1)).b, entropy.Options.filled((2, 1, 1)).k) == (2, 1)
    with pytest.raises(ValueError):
        entropy.Options.filled((4,))


def test_callers_distance_and_observed_addition(spark):
    points = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, vec array<double>")
    far = lambda a, b: -F.abs(a[0] - b[0])
    rows = neighbours.nearest_by(points.where("id = 0"), points, far, k=5).orderBy("rank").collect()
    assert [(r.id, r.dist) for r in rows] == [(1, -3.0), (2, 0.0)]
    both, seen = neighbours.added(points, spark.createDataFrame([(9, [1.0, 1.0])], "id long, vec array<double>"), "more")
    assert both.count() == 5 and seen.get == {"points": 1}
