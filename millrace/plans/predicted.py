"""Queries on compressed blocks: palettes, predicted selectors, typical blocks, chunks; with their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits, color, grid
from ..operators import entropy, neighbours, pairwise, prediction
from . import carriers as C
from .catalogue import query

# The raster as compressed blocks: the first pixel's word and another one as endpoints, the words' low bits as selectors.
DXT = "firsts as (select *, ((y // 4) * 16 + x // 4)::int as block, (y % 4) * 4 + x % 4 as k, w % 4 as sel, max(case when x % 4 = 0 and y % 4 = 0 then w end) over (partition by y // 4, x // 4) as ep1 from px), dxt as (select p, x, y, block, k, sel, ep1, (ep1 * 31 + 7) % 65536 as ep2 from firsts)"


def _dxt(spark, sf):
    px = C.pixels(spark, sf, 16)
    px = px.select("p", "x", "y", "w", grid.block_number(F.col("x"), F.col("y"), C.WIDTH).alias("block"), grid.place_in_block(F.col("x"), F.col("y")).alias("k"), (F.col("w") % 4).alias("sel"))
    px = px.withColumn("ep1", F.max(F.when(F.col("k") == 0, F.col("w"))).over(Window.partitionBy("block")))
    return px.select("p", "x", "y", "block", "k", "sel", "ep1", ((F.col("ep1") * 31 + 7) % 65536).alias("ep2"))


def _words(spark, sf):
    """block, word."""
    s = _dxt(spark, sf).groupBy("block").agg(F.sum(F.col("sel").cast("long") * F.element_at(F.array(*(F.lit(4**k).cast("long") for k in range(16))), F.col("k") + 1)).alias("word"))
    return s.select(F.col("block").cast("long"), "word")


WORDS = DXT + ", words as (select block, sum(sel::bigint << (2 * k)::int)::bigint as word from dxt group by block)"

_WIDE = {"r": "({e} >> 11 << 3) | ({e} >> 13)", "g": "((({e} >> 5) & 63) << 2) | (({e} >> 9) & 3)", "b": "(({e} & 31) << 3) | (({e} >> 2) & 7)"}
_ENDS = ", ".join(f"({_WIDE[c].format(e=e)})::int as {c}{n}" for c in "rgb" for n, e in ((0, "ep1"), (1, "ep2")))
_THIRDS = ", ".join(f"case when ep1 > ep2 then (2 * {c}0 + {c}1) // 3 else ({c}0 + {c}1) // 2 end as {c}2, case when ep1 > ep2 then ({c}0 + 2 * {c}1) // 3 else 0 end as {c}3" for c in "rgb")
_PICKED = ", ".join(f"[{c}0, {c}1, {c}2, {c}3][sel + 1] as {c}" for c in "rgb")
SHOWN = DXT + f", ends as (select *, {_ENDS} from dxt), pal as (select *, {_THIRDS}, case when ep1 > ep2 then 255 else 0 end as a3 from ends), shown as (select *, {_PICKED}, case when sel = 3 then a3 else 255 end as a from pal)"


@query("px:16", SHOWN + "; select p, r, g, b, a from shown")
def decode_rgba(spark, sf):
    """Every pixel's colour with its alpha."""
    px = _dxt(spark, sf)
    colours = color.pick(color.block_palette(F.col("ep1"), F.col("ep2")), F.col("sel"))
    return px.select("p", *(c.cast("int").alias(n) for c, n in zip(colours, "rgba")))


@query("px:16", SHOWN + "; select block, r0, g0, b0, 255 as a0, r1, g1, b1, 255 as a1 from shown where k = 0")
def endpoint_images(spark, sf):
    """The two endpoint planes as RGBA, a pixel a block."""
    ends = color.block_palette(F.col("ep1"), F.col("ep2"))[:2]
    return _dxt(spark, sf).where("k = 0").select("block", *(v.cast("int").alias(f"{c}{n}") for n, end in enumerate(ends) for c, v in zip("rgba", end)))


_NEAR = ", ".join(f"lag({c}) over (partition by y order by x) as l{c}, lag({c}) over (partition by x order by y) as u{c}" for c in "rgb")
_DIAG = ", ".join(f"lag(u{c}) over (partition by y order by x) as d{c}" for c in "rgb")
_GUESS = ", ".join(f"case when d{c} >= greatest(l{c}, u{c}) then least(l{c}, u{c}) when d{c} <= least(l{c}, u{c}) then greatest(l{c}, u{c}) else l{c} + u{c} - d{c} end as g{c}" for c in "rgb")
_DISTS = ", ".join("+".join(f"({c}{n} - g{c}) * ({c}{n} - g{c})" for c in "rgb") for n in range(4))
SPATIAL = SHOWN + f", n1 as (select *, {_NEAR} from shown), n2 as (select *, {_DIAG} from n1), n3 as (select *, {_GUESS} from n2), n4 as (select *, [{_DISTS}] as e from n3), n5 as (select *, case when e[4] = list_min(e) then 3 when e[3] = list_min(e) then 2 when e[2] = list_min(e) then 1 else 0 end as best from n4), spatial as (select p, (case when x % 16 = 0 or y % 16 = 0 then sel else ([0, 3, 1, 2][sel + 1] + 4 - [0, 3, 1, 2][best + 1]) % 4 end)::int as sym from n5)"


@query("px:16", SPATIAL + "; select p, sym from spatial")
def predict_indices_spatial(spark, sf):
    return prediction.by_colour(_dxt(spark, sf).select("p", "x", "y", "ep1", "ep2", "sel"), C.WIDTH)


@query("px:16", SPATIAL + "; select (p // 256)::bigint as coder, (p % 256)::int as place, sym from spatial")
def predict_indices_linear(spark, sf):
    """The predicted symbols in the order in which coders of 256 symbols take them."""
    p = F.col("p")
    return predict_indices_spatial(spark, sf).select(F.expr("p div 256").alias("coder"), (p % 256).cast("int").alias("place"), "sym")


CLUSTERS = 256


@query()
def block_kmeans(spark, sf):
    """Typical blocks: the rounded centres of the selector words' clusters, as words."""
    centres = prediction.block_clusters(_words(spark, sf), CLUSTERS)
    rows = [(k, int(w)) for k, w in enumerate(prediction.word_of(centres))]
    return spark.createDataFrame(rows, "cluster int, word long")


@query()
def predict_indices_nearest(spark, sf):
    """Every block's selectors less those of the nearest typical block."""
    words = _words(spark, sf)
    return prediction.by_cluster(words, prediction.block_clusters(words, CLUSTERS))


_ORDERED = "[[0, 3, 1, 2][((w.word >> (2 * k)::int) & 3)::int + 1] - [0, 3, 1, 2][((v.word >> (2 * k)::int) & 3)::int + 1] for k in range(16)]"


@query("px:16", WORDS + f", d as (select w.block, {_ORDERED} as d from words w join words v on v.block = w.block - 1); select block, list_sum([e * e for e in d])::int as dist from d")
def block_distances(spark, sf):
    """Squared distance of every block's selectors to those of the block before it."""
    sel = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.expr("word").bitwiseAND(3))
    sel = F.array(*(F.shiftright("word", 2 * k).bitwiseAND(3) for k in range(16)))
    w = _words(spark, sf).select("block", sel.alias("a"))
    before = w.select((F.col("block") + 1).alias("block"), F.col("a").alias("b"))
    return w.join(before, "block").select(F.col("block").cast("int"), prediction.block_distance(F.col("a"), F.col("b")).alias("dist"))


@query("px:16", WORDS + "; select block, word, count(*) over (partition by word) as uses from words")
def own_word_count(spark, sf):
    """Every block with the number of blocks that have its selector word: counts are taken first, then looked up."""
    w = _words(spark, sf).select(F.col("block").cast("int"), "word")
    return w.join(w.groupBy("word").agg(F.count("*").alias("uses")), "word").select("block", "word", "uses")


IMAGE_BLOCKS = 1024


@query("px:16", WORDS + f", f as (select block, word, block // {IMAGE_BLOCKS} as image, min(block) over (partition by block // {IMAGE_BLOCKS}, word) as first from words), n as (select *, dense_rank() over (partition by image order by first) - 1 as number from f); select block::int as block, image::bigint as image, word, number::int as number, (number - lag(number, 1, 0) over (partition by image order by block) + 128)::int as delta from n")
def palette_numbers(spark, sf):
    """Each image's selector words numbered in the order of their first use, and the numbers' differences from block to block."""
    image = Window.partitionBy("image")
    w = _words(spark, sf).withColumn("image", F.expr(f"block div {IMAGE_BLOCKS}"))
    w = w.withColumn("first", F.min("block").over(Window.partitionBy("image", "word")))
    w = w.withColumn("number", F.dense_rank().over(image.orderBy("first")) - 1)
    delta = F.col("number") - F.lag("number", 1, 0).over(image.orderBy("block")) + 128
    return w.select(F.col("block").cast("int"), "image", "word", "number", delta.alias("delta"))


@query("px:16", "h as (select max(y) + 1 as h from px); select n::int as n, (n % 4 * 16)::int as x, (n // 4 * 16)::int as y from (select unnest(generate_series(0, h // 16 * 4 - 1)) as n from h)")
def chunk_order(spark, sf):
    """The corners of the raster's 16x16 chunks in their order."""
    size = C.pixels(spark, sf, 16).agg((F.max("y") + 1).alias("h"))
    return size.select(F.inline(grid.chunks(F.lit(C.WIDTH), F.col("h"), 16, 16)))


@query("px", "select p, w >> 12 as r, (w >> 8) & 15 as g, (w >> 4) & 15 as b, w & 15 as a, (w % 65536)::int as word from px")
def unpack4444(spark, sf):
    """Four 4-bit channels of a word, and the word that they make again."""
    rows = C.pixels(spark, sf).select("p", *(v.alias(c) for c, v in zip("rgba", bits.unpack_msb(F.col("w"), [4] * 4))))
    return rows.select("p", *"rgba", bits.pack_msb([F.col(c) for c in "rgba"], [4] * 4).alias("word"))


@query("px", "select p, 'r' as plane, w >> 12 as v from px union all select p, 'g', (w >> 8) & 15 from px union all select p, 'b', (w >> 4) & 15 from px union all select p, 'a', w & 15 from px")
def plane_split4(spark, sf):
    rows = C.pixels(spark, sf).select("p", *(v.alias(c) for c, v in zip("rgba", bits.unpack_msb(F.col("w"), [4] * 4))))
    return rows.selectExpr("p", "stack(4, 'r', r, 'g', g, 'b', b, 'a', a) as (plane, v)")


_FIELDS = "(w & 7) | ((w & 31) << 3) | ((w & 4095) << 8)"


@query("px", f"select p, upper(lpad(to_hex(({_FIELDS}) & 255), 2, '0') || lpad(to_hex((({_FIELDS}) >> 8) & 255), 2, '0') || lpad(to_hex((({_FIELDS}) >> 16) & 255), 2, '0')) as bytes from px")
def bit_writer(spark, sf):
    """Fields of 3, 5 and 12 bits written one after another, as hexadecimal bytes."""
    step = lambda n: F.struct((F.col("w") % 2**n).cast("long").alias("val"), F.lit(n).alias("nbits"))
    return C.pixels(spark, sf).select("p", F.hex(bits.write_bits(F.array(step(3), step(5), step(12)))).alias("bytes"))


_ANGLE = "round(1 - list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(q.vec, lambda v: v * v))) * sqrt(list_sum(list_transform(c.vec, lambda v: v * v)))), 9)"


@query("pts", f"d as (select q.id as query_id, c.id as id, {_ANGLE} as dist from pts q join pts c on c.id <> q.id where q.id % 20 = 0); select query_id, id, dist, row_number() over (partition by query_id order by dist, id)::int as rank from d where dist is not null qualify rank <= 3")
def knn_by_angle(spark, sf):
    """The three nearest by a distance that the caller gives: one less the cosine."""
    points = C.points(spark, sf)
    return neighbours.nearest_by_blocks(points.where("id % 20 = 0"), points, pairwise.by_angle(), k=3)


PART = entropy.SHORT_LIMIT
SHORTS = f"v as (select (p // {PART})::bigint as part, r - g as v from rgb), c as (select part, count(*) as n, count(*) filter (where abs(v) > 127) as aside, (count(*) + 8191) // 8192 as groups from v group by part)"


@query("px rgb", SHORTS + "; select part, n, aside, groups, 516 + 2 * aside + 2 * groups as head_bytes, true as ok from c")
def short_stream(spark, sf):
    """Colour differences through the coder of 16-bit values and back: the header's fields, and whether all is whole."""

    def f(key, t):
        v = t.sort_by("p")["v"].to_numpy()
        raw = entropy.encode_short_stream(v)
        aside, groups, head = entropy.short_header(raw)
        ok = bool((entropy.decode_short_stream(raw)[: len(v)] == v).all())
        return pa.table({"part": [key[0].as_py()], "n": pa.array([len(v)], pa.int64()), "aside": pa.array([len(aside)], pa.int64()), "groups": pa.array([len(groups)], pa.int64()), "head_bytes": pa.array([head], pa.int64()), "ok": [ok]})

    rows = C.colours(spark, sf).select(F.expr(f"p div {PART}").alias("part"), "p", (F.col("r") - F.col("g")).cast("long").alias("v"))
    return rows.groupBy("part").applyInArrow(f, "part long, n long, aside long, groups long, head_bytes long, ok boolean")
