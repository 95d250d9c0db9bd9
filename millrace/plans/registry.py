"""Queries of the codec operators with the SQL of the same rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, color, grid, transforms, vectors
from ..operators import blocks, codec, entropy, frequency, neighbours, prediction, scans
from ..session import spread, written
from ..sources import textures
from ..streaming import streams
from . import carriers as C
from . import files, predicted  # noqa: F401  (they register their queries)
from .catalogue import ORACLE, QUERIES, query


# -- symbol statistics ------------------------------------------------------------------------------------------------

COUNTS = "counts as (select lang as stream, sym, count(*) as cnt from symbols group by all)"
FREQ = COUNTS + """,
shares as (select *, ((cnt * 2048)::float::double / sum(cnt) over (partition by stream)::float::double)::float as f from counts),
rounded as (select *, greatest(1, case when f::double * f::double <= floor(f) * (floor(f) + 1) then floor(f) else floor(f) + 1 end)::bigint as share from shares),
errors as (select *, (2048 - sum(share) over (partition by stream))::bigint as error from rounded),
steps as (select stream, sym, cnt, share, error, sign(error)::int as s, unnest(generate_series(0, abs(error) - 1)) as j from errors where error <> 0),
costs as (select *, round(cnt * log2((share + s * j) / (share + s * j + s)::double), 9) as cost from steps where s > 0 or share + s * j > 1),
picked as (select * from costs qualify row_number() over (partition by stream order by cost, sym, j) <= abs(error)),
freq as (select r.stream, r.sym, (r.share + coalesce((select sum(s) from picked p where p.stream = r.stream and p.sym = r.sym), 0))::bigint as freq from errors r),
cum as (select *, coalesce(sum(freq) over (partition by stream order by sym rows between unbounded preceding and 1 preceding), 0)::bigint as cum from freq)"""


def _counts(spark, sf):
    return frequency.text_counts(C.table(spark, sf, "documents"), "lang", "text")


def _freq(spark, sf):
    return frequency.apportion(_counts(spark, sf))


@query("symbols", COUNTS + "; select * from counts")
def sym_hist(spark, sf):
    return _counts(spark, sf)


@query("symbols", COUNTS + "; select *, row_number() over (partition by stream order by cnt desc, sym) as r from counts qualify r <= 16")
def sym_topn(spark, sf):
    r = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("cnt"), "sym"))
    return _counts(spark, sf).withColumn("r", r.cast("long")).where("r <= 16")


@query("symbols", COUNTS + "; select stream, count(*) as n, count(*) filter (where cnt > 1) as repeated, min(sym) as least, max(sym) as most from counts group by stream")
def sym_dups(spark, sf):
    c = _counts(spark, sf)
    return c.groupBy("stream").agg(F.count("*").alias("n"), F.count(F.when(F.col("cnt") > 1, 1)).alias("repeated"), F.min("sym").alias("least"), F.max("sym").alias("most"))


@query("symbols", FREQ + "; select * from freq")
def freq_normalize(spark, sf):
    return _freq(spark, sf)


@query("symbols", FREQ + "; select * from cum")
def freq_cumulative(spark, sf):
    return frequency.cumulative(_freq(spark, sf))


@query("symbols", FREQ + "; select stream, unnest(generate_series(cum, cum + freq - 1))::bigint as slot, sym, freq, cum from cum where freq > 0")
def slot_table(spark, sf):
    return frequency.slots(frequency.cumulative(_freq(spark, sf)))


@query("symbols", FREQ + "; select e.event_id, c.sym, c.freq, (e.event_id % 2048 - c.cum)::bigint as rest from events e join cum c on c.stream = 'en' and e.event_id % 2048 >= c.cum and e.event_id % 2048 < c.cum + c.freq")
def slot_lookup(spark, sf):
    t = slot_table(spark, sf).where("stream = 'en'")
    e = C.table(spark, sf, "events").select("event_id", (F.col("event_id") % 2048).cast("long").alias("slot"))
    return e.join(t, "slot").select("event_id", "sym", "freq", (F.col("slot") - F.col("cum")).alias("rest"))


@query("symbols", COUNTS + ", p as (select *, cnt / sum(cnt) over (partition by stream) as p from counts); select stream, sum(cnt)::bigint as n, round(sum(-p * log2(p)), 6) as bits from p group by stream")
def entropy_bits(spark, sf):
    return frequency.entropy(_counts(spark, sf))


@query("symbols", FREQ + "; select stream, round(11.0::double - sum(freq * log2(freq)) / 2048, 6) as bits from freq group by stream")
def coded_bits(spark, sf):
    return frequency.coded_bits(_freq(spark, sf))


# -- scans ------------------------------------------------------------------------------------------------------------

U, T = ["user_id"], ["ts", "event_id"]
DELTA = "d as (select *, (v - lag(v, 1, 0) over (partition by user_id order by ts, event_id) + 128)::bigint as delta from seqs)"


def _deltas(spark, sf):
    s = C.sequences(spark, sf)
    return s.withColumn("delta", scans.delta(s, "v", U, T))


@query("seqs", DELTA + "; select user_id, event_id, delta from d")
def delta_encode(spark, sf):
    return _deltas(spark, sf).select("user_id", "event_id", "delta")


@query("seqs", "select user_id, event_id, v as back from seqs")
def delta_decode(spark, sf):
    return _deltas(spark, sf).select("user_id", "event_id", scans.undelta("delta", U, T).alias("back"))


@query("seqs", "select user_id, event_id, (v % 16) as sym, (row_number() over (partition by user_id, v % 16 order by ts, event_id) - 1)::bigint as nth from seqs")
def occurrence_no(spark, sf):
    s = C.sequences(spark, sf).withColumn("sym", F.col("v") % 16)
    return s.select("user_id", "event_id", "sym", scans.occurrence(U, "sym", T).cast("long").alias("nth"))


@query("seqs", "select user_id, event_id, round(avg(v) over (partition by user_id order by ts, event_id rows between 7 preceding and current row), 6) as mean8 from seqs")
def rolling_mean8(spark, sf):
    return C.sequences(spark, sf).select("user_id", "event_id", F.round(scans.rolling_mean("v", U, T), 6).alias("mean8"))


@query("seqs", "n as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n from seqs), h as (select *, case when i % 2 = 1 then v - (lag(v) over w + coalesce(lead(v) over w, lag(v) over w)) // 2 end as high from n window w as (partition by user_id order by i)), l as (select *, coalesce(lag(high) over w, lead(high) over w, -1) + coalesce(lead(high) over w, lag(high) over w, -1) as near from h window w as (partition by user_id order by i)); select user_id, (i % 2)::int as band, (i // 2)::bigint as at, (case when i % 2 = 1 then high else v + (near + 2) // 4 end)::bigint as coef from l")
def wavelet1d_fwd(spark, sf):
    s = C.sequences(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy(*U).orderBy(*T)) - 1)
    return scans.lifted(s, "v", U, "i")


@query("seqs", "select user_id, count(*) as n, 0::bigint as bad from seqs group by user_id")
def wavelet1d_inv(spark, sf):
    s = C.sequences(spark, sf).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "v"))), lambda x: x["v"].cast("int")).alias("a"))
    back = transforms.inverse(transforms.forward(F.col("a")))
    bad = F.size(F.filter(F.zip_with("a", back, lambda x, y: x.eqNullSafe(y)), lambda same: ~same))
    return s.select("user_id", F.size("a").cast("long").alias("n"), bad.cast("long").alias("bad"))


# -- bits -------------------------------------------------------------------------------------------------------------


@query("px", "select p, w >> 11 as r, (w >> 5) & 63 as g, w & 31 as b from px")
def unpack565(spark, sf):
    r, g, b = color.unpack565(F.col("w"))
    return C.pixels(spark, sf).select("p", r.alias("r"), g.alias("g"), b.alias("b"))


@query("px", "select p, w as word from px")
def pack565(spark, sf):
    return C.pixels(spark, sf).select("p", color.pack565(*color.unpack565(F.col("w"))).alias("word"))


@query("px rgb", "select p, ((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3) as word from rgb")
def truncate565(spark, sf):
    return C.colours(spark, sf).select("p", color.truncate565(F.col("r"), F.col("g"), F.col("b")).alias("word"))


@query("px", "select p, (w & 1) as b1, ((w >> 1) & 7) as b3, ((w >> 4) & 15) as b4, ((w >> 8) & 255) as b8 from px")
def bit_fields(spark, sf):
    b8, b4, b3, b1 = bits.unpack_msb(F.col("w"), [8, 4, 3, 1])
    return C.pixels(spark, sf).select("p", b1.alias("b1"), b3.alias("b3"), b4.alias("b4"), b8.alias("b8"))


@query("px", "select y, (sum((w % 4)::bigint << (2 * (15 - x % 16))))::bigint as word, (x // 16)::int as part, sum((w % 4)::bigint << (2 * (x % 16)))::bigint as lsb from px group by y, x // 16")
def bit_pack(spark, sf):
    px = C.pixels(spark, sf).withColumn("part", color.quotient(F.col("x"), 16)).withColumn("v", (F.col("w") % 4).cast("long"))
    msb = F.sum(F.expr("shiftleft(v, 2 * (15 - x % 16))"))
    lsb = F.sum(F.expr("shiftleft(v, 2 * (x % 16))"))
    return px.groupBy("y", "part").agg(msb.alias("word"), lsb.alias("lsb"))


@query("px", "select p, case when w % 64 >= 32 then w % 64 - 64 else w % 64 end as s6, case when w % 128 >= 64 then w % 128 - 128 else w % 128 end as s7, case when w % 256 >= 128 then w % 256 - 256 else w % 256 end as s8 from px")
def sign_extend(spark, sf):
    w = F.col("w")
    return C.pixels(spark, sf).select("p", *(bits.sign_extend(w % (1 << n), n).alias(f"s{n}") for n in (6, 7, 8)))


@query("px", "select p, (case when w % 256 >= 128 then w % 256 - 256 else w % 256 end) + 128 as u8 from px")
def bias_unsigned(spark, sf):
    return C.pixels(spark, sf).select("p", bits.to_unsigned(bits.sign_extend(F.col("w") % 256, 8), 8).alias("u8"))


@query("px", "select p, (" + " | ".join(f"(((p >> {2 * k}) & 1) << {k})" for k in range(16)) + ")::int as i, (" + " | ".join(f"(((p >> {2 * k + 1}) & 1) << {k})" for k in range(16)) + ")::int as j from px")
def morton_decode(spark, sf):
    i, j = bits.morton_decode(F.col("p"))
    return C.pixels(spark, sf).select("p", i.alias("i"), j.alias("j"))


@query("px", "select p, (case when w > 0 then length(bin(w::bigint)) - 1 else 0 end)::int as lg from px")
def int_log2(spark, sf):
    return C.pixels(spark, sf).select("p", bits.int_log2(F.col("w")).alias("lg"))


@query("px", "select p, (w + p * 65536)::bigint as back from px")
def little_endian_round_trip(spark, sf):
    word = (F.col("w") + F.col("p") * 65536).cast("long")
    return C.pixels(spark, sf).select("p", bits.little_endian(bits.to_little_endian(word, 8), 0, 8).alias("back"))


# -- colour -----------------------------------------------------------------------------------------------------------

C565 = "c as (select p, w >> 11 as r, (w >> 5) & 63 as g, w & 31 as b from px)"
YCC = C565 + ", t as (select *, r + b + (b >> 4) as t from c), q as (select p, (t + (g - t) // 2)::int as y, r - b as co, g - t as cg from t)"


def _three(df, values, names):
    return df.select("p", *(v.cast("int").alias(n) for v, n in zip(values, names)))


@query("px", C565 + "; select p, (r << 3) | (r >> 2) as r, (g << 2) | (g >> 4) as g, (b << 3) | (b >> 2) as b from c")
def expand565(spark, sf):
    return _three(C.pixels(spark, sf), color.expand565(*color.unpack565(F.col("w"))), "rgb")


@query("px", YCC + "; select * from q")
def ycocg_fwd(spark, sf):
    return _three(C.pixels(spark, sf), color.ycocg667(*color.unpack565(F.col("w"))), ("y", "co", "cg"))


@query("px", C565 + "; select * from c")
def ycocg_roundtrip(spark, sf):
    return _three(C.pixels(spark, sf), color.rgb565_of_ycocg(*color.ycocg667(*color.unpack565(F.col("w")))), "rgb")


def _clamped(x: str) -> str:
    return f"floor(greatest(0.0::double, least(255.0::double, {x} + 0.5::double)))::int"


YCRCB = f"l as (select *, 0.299::double * r + 0.587::double * g + 0.114::double * b as l from rgb), yc as (select p, {_clamped('l')} as y, {_clamped('((r - l) * 0.713::double + 128.0::double)')} as cr, {_clamped('((b - l) * 0.564::double + 128.0::double)')} as cb from l)"


@query("px rgb", YCRCB + "; select * from yc")
def ycrcb_fwd(spark, sf):
    return _three(C.colours(spark, sf), color.ycrcb(F.col("r"), F.col("g"), F.col("b")), ("y", "cr", "cb"))


@query("px rgb", YCRCB + f"; select p, {_clamped('(y + 1.403::double * (cr - 128.0::double))')} as r, {_clamped('(y - 0.714::double * (cr - 128.0::double) - 0.344::double * (cb - 128.0::double))')} as g, {_clamped('(y + 1.773::double * (cb - 128.0::double))')} as b from yc")
def ycrcb_inv(spark, sf):
    return _three(ycrcb_fwd(spark, sf), color.rgb_of_ycrcb(F.col("y"), F.col("cr"), F.col("cb")), "rgb")


@query("px rgb", "select p, (r + g + b) // 3 as gray, (r * 2 + g) // 3 as mix, 85 * (b % 4) as two_bit from rgb")
def gray_and_lerp(spark, sf):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return C.colours(spark, sf).select("p", color.gray(r, g, b).alias("gray"), color.lerp(r, g, 1, 3).alias("mix"), (85 * (b % 4)).alias("two_bit"))


@query("px rgb", "select p, r, g, b from rgb")
def drop_alpha(spark, sf):
    px = C.colours(spark, sf).select("p", F.struct("r", "g", "b", F.lit(255).alias("a")).alias("px"))
    return px.withColumn("px", F.col("px").dropFields("a")).select("p", "px.*")


@query("px", "s as (select p, w % 256 as v from px), t as (select *, v & 248 as base, case when v & 248 = 0 then 0 else (v & 248) - 4 end as low, (v & 248) + 4 as high from s), u as (select p, v, base | (base >> 5) as base, low | (low >> 5) as low, high | (high >> 5) as high from t); select p, case when abs(v - base) <= abs(v - high) then case when abs(v - base) < abs(v - low) then base else low end else high end as five from u")
def snap_five_bits(spark, sf):
    return C.pixels(spark, sf).select("p", color.snap(F.col("w") % 256, 5).alias("five"))


NEAR = "n as (select *, coalesce(lag(r) over (partition by y order by x), 0) as l, coalesce(lag(r) over (partition by x order by y), 0) as u from rgb), m as (select *, coalesce(lag(u) over (partition by y order by x), 0) as d from n)"


def _near(spark, sf):
    px = prediction.with_neighbours(C.colours(spark, sf), C.WIDTH, ["r"])
    return px.select("p", "r", *(F.coalesce(F.col(n)["r"], F.lit(0)).alias(c) for c, n in (("l", "left"), ("u", "up"), ("d", "diag"))))


@query("px rgb", NEAR + "; select p, case when d >= greatest(l, u) then least(l, u) when d <= least(l, u) then greatest(l, u) else l + u - d end as guess from m")
def predict_med(spark, sf):
    return _near(spark, sf).select("p", color.predict_med(F.col("d"), F.col("u"), F.col("l")).alias("guess"))


@query("px rgb", NEAR + ", g as (select *, abs(d - u) as dx, abs(abs(d - u) - abs(d - l)) as gap, l + u as pair, case when abs(d - u) < abs(d - l) then l else u end as nearer from m); select p, least(255, greatest(0, case when gap >= 64 then nearer when gap >= 10 then (2 * nearer + pair) // 4 when gap >= 4 or dx >= 4 then pair // 2 else pair - d end)) as guess from g")
def predict_gradients(spark, sf):
    return _near(spark, sf).select("p", color.predict_by_gradients(F.col("d"), F.col("u"), F.col("l")).alias("guess"))


@query("px", "select p, ([0, 3, 1, 2][w % 4 + 1] + 4 - [0, 3, 1, 2][(w // 4) % 4 + 1]) % 4 as delta from px")
def selector_delta(spark, sf):
    return C.pixels(spark, sf).select("p", color.selector_delta(color.quotient(F.col("w"), 4) % 4, F.col("w") % 4).alias("delta"))


@query("px rgb", "k as (select p, [r * r + g * g + b * b, (r - 255) * (r - 255) + (g - 255) * (g - 255) + (b - 255) * (b - 255), (r - 85) * (r - 85) + (g - 85) * (g - 85) + (b - 85) * (b - 85), (r - 170) * (r - 170) + (g - 170) * (g - 170) + (b - 170) * (b - 170)] as d from rgb); select p, case when d[4] = list_min(d) then 3 when d[3] = list_min(d) then 2 when d[2] = list_min(d) then 1 else 0 end as sel from k")
def predict_selector(spark, sf):
    levels = [tuple(F.lit(v) for _ in range(3)) for v in (0, 255, 85, 170)]
    return C.colours(spark, sf).select("p", color.nearest_selector(levels, (F.col("r"), F.col("g"), F.col("b"))).alias("sel"))


# -- grids ------------------------------------------------------------------------------------------------------------


@query("px", "select p, ((y // 32) * 64 * 32 + (x // 32) * 1024 + (y % 32) * 32 + x % 32)::int as place, w from px")
def tile_order(spark, sf):
    return C.pixels(spark, sf).select("p", grid.tile_position(F.col("x"), F.col("y"), C.WIDTH, 32).alias("place"), "w")


@query("px", "select (y // 64)::int as tile, x as ty, y % 64 as tx, w from px")
def transpose_tile(spark, sf):
    return C.pixels(spark, sf).select(color.quotient(F.col("y"), 64).alias("tile"), F.col("x").alias("ty"), (F.col("y") % 64).alias("tx"), "w")


@query("px rgb", "select p, 'r' as plane, r as v from rgb union all select p, 'g', g from rgb union all select p, 'b', b from rgb")
def plane_split(spark, sf):
    return C.colours(spark, sf).selectExpr("p", "stack(3, 'r', r, 'g', g, 'b', b) as (plane, v)")


@query("px rgb", "n as (select count(*) as n from rgb); select p::bigint as pos, r as v from rgb union all select p + n, g from rgb, n union all select p + 2 * n, b from rgb, n")
def plane_concat(spark, sf):
    px = C.colours(spark, sf)
    one = px.agg(F.count("*").alias("n"))
    rows = px.crossJoin(F.broadcast(one))  # one row
    return rows.selectExpr("stack(3, p, r, p + n, g, p + 2 * n, b) as (pos, v)")


@query("px", "n as (select count(*) as n from px); select p as pos, w % 256 as v from px union all select unnest(generate_series(n, (n + 8191) // 8192 * 8192 - 1))::bigint, 0 from n where n % 8192 <> 0")
def pad_stream(spark, sf):
    px = C.pixels(spark, sf).select(F.col("p").alias("pos"), (F.col("w") % 256).alias("v"))
    n = px.agg(F.count("*").alias("n")).where("n % 8192 <> 0")
    rest = n.select(F.explode(F.sequence("n", (F.ceil(F.col("n") / 8192) * 8192 - 1).cast("long"))).alias("pos"), F.lit(0).alias("v"))
    return px.unionAll(rest)


@query("px rgb", "select ((y // 4) * 16 + x // 4)::int as block, (y % 4) * 4 + x % 4 as k, r, g, b from rgb")
def block_gather(spark, sf):
    return _gathered(C.colours(spark, sf))


def _gathered(px):
    x, y = F.col("x"), F.col("y")
    return px.select(grid.block_number(x, y, C.WIDTH).alias("block"), grid.place_in_block(x, y).alias("k"), "r", "g", "b")


# -- blocks and metrics -----------------------------------------------------------------------------------------------

BLK = "blk as (select ((y // 4) * 16 + x // 4)::int as block, (y % 4) * 4 + x % 4 as k, r, g, b, r * 7 % 4 as sel from rgb)"


def _blocks(spark, sf):
    return block_gather(spark, sf).withColumn("sel", F.col("r") * 7 % 4)


@query("px rgb", BLK + "; select block, min(r) as rmin, max(r) as rmax, min(g) as gmin, max(g) as gmax, min(b) as bmin, max(b) as bmax, ((sum(r) + 8)::bigint >> 4)::bigint as rmean from blk group by block")
def block_minmax(spark, sf):
    ends = [f(c).alias(f"{c}{n}") for c in "rgb" for f, n in ((F.min, "min"), (F.max, "max"))]
    return _blocks(spark, sf).groupBy("block").agg(*ends, F.shiftright(F.sum("r") + 8, 4).alias("rmean"))


MEAN = BLK + ", mean as (select block, (sum(r) + 8)::bigint >> 4 as mr, (sum(g) + 8)::bigint >> 4 as mg, (sum(b) + 8)::bigint >> 4 as mb from blk group by block)"


@query("px rgb", MEAN + "; select block, sum((r - mr) * (r - mr))::bigint as rr, sum((r - mr) * (g - mg))::bigint as rg, sum((r - mr) * (b - mb))::bigint as rb, sum((g - mg) * (g - mg))::bigint as gg, sum((g - mg) * (b - mb))::bigint as gb, sum((b - mb) * (b - mb))::bigint as bb from blk join mean using (block) group by block")
def block_cov(spark, sf):
    per = Window.partitionBy("block")
    rows = _blocks(spark, sf).select("block", *((F.col(c) - F.shiftright(F.sum(c).over(per) + 8, 4)).alias(c) for c in "rgb"))
    return rows.groupBy("block").agg(*(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("rr", "rg", "rb", "gg", "gb", "bb")))


@query("px rgb", MEAN + "; select block, (sum((r - mr) * (r - mr) + (g - mg) * (g - mg) + (b - mb) * (b - mb)) // 48)::bigint as err from blk join mean using (block) group by block")
def block_mse(spark, sf):
    per = Window.partitionBy("block")
    square = sum(((F.col(c) - F.col("m" + c)) * (F.col(c) - F.col("m" + c)) for c in "rgb"), F.lit(0))
    rows = _blocks(spark, sf).select("block", "r", "g", "b", *(F.shiftright(F.sum(c).over(per) + 8, 4).alias("m" + c) for c in "rgb"))
    return rows.groupBy("block").agg(F.call_function("div", F.sum(square), F.lit(48).cast("long")).alias("err"))


@query("px rgb", BLK + ", o as (select *, [0, 3, 1, 2][sel + 1] as o from blk); select block, sum((3 - o) * (3 - o))::bigint as aa, sum(o * o)::bigint as bb, sum(o * (3 - o))::bigint as ab, sum(r * (3 - o))::bigint as ar, sum(r * o)::bigint as br from o group by block")
def block_refit_sums(spark, sf):
    o = F.element_at(F.array(*map(F.lit, color.SELECTOR_ORDER)), F.col("sel") + 1)
    rows = _blocks(spark, sf).withColumn("o", o).withColumn("a", 3 - F.col("o"))
    return rows.groupBy("block").agg(F.sum(F.expr("a * a")).alias("aa"), F.sum(F.expr("o * o")).alias("bb"), F.sum(F.expr("o * a")).alias("ab"), F.sum(F.expr("r * a")).alias("ar"), F.sum(F.expr("r * o")).alias("br"))


@query("px rgb", "e as (select avg(((r - (r // 8) * 8) * (r - (r // 8) * 8) + (g - (g // 4) * 4) * (g - (g // 4) * 4) + (b - (b // 8) * 8) * (b - (b // 8) * 8))::double) as mse from rgb); select round(mse, 6) as mse, round(10 * log10(3 * 255.0::double * 255.0::double / mse), 6) as psnr from e")
def image_psnr(spark, sf):
    square = sum(((F.col(c) % s) * (F.col(c) % s) for c, s in (("r", 8), ("g", 4), ("b", 8))), F.lit(0))
    mse = C.colours(spark, sf).agg(F.avg(square.cast("double")).alias("mse"))
    return mse.select(F.round("mse", 6).alias("mse"), F.round(codec.psnr(F.col("mse")), 6).alias("psnr"))


@query("px", "e as (select p, w as a, (w * 31 + 7) % 65536 as b from px), x as (select p, a, b, ((a >> 11) << 3) | (a >> 13) as ar, ((b >> 11) << 3) | (b >> 13) as br from e); select p, ar as c0, br as c1, (case when a > b then (2 * ar + br) // 3 else (ar + br) // 2 end)::int as c2, (case when a > b then (ar + 2 * br) // 3 else 0 end)::int as c3 from x")
def block_expand_palette(spark, sf):
    b = (F.col("w") * 31 + 7) % 65536
    rows = C.pixels(spark, sf).select("p", F.col("w").alias("a"), b.alias("b"))
    ar, br = (color.widen(color.unpack565(F.col(c))[0], 5) for c in "ab")
    four = F.col("a") > F.col("b")
    third = F.when(four, color.lerp(ar, br, 1, 3)).otherwise(color.lerp(ar, br, 1, 2))
    return rows.select("p", ar.alias("c0"), br.alias("c1"), third.alias("c2"), F.when(four, color.lerp(ar, br, 2, 3)).otherwise(0).alias("c3"))


@query("px:1", "w16 as (select p // 16 as block, p % 16 as k, w % 4 as s from px), words as (select block, sum(s::bigint << (2 * k)::int)::bigint as word, count(*) as n from w16 group by block); select word, count(*) as cnt from words where n = 16 group by word order by cnt desc, word limit 100")
def count_blocks(spark, sf):
    px = C.pixels(spark, sf, 1).withColumn("block", F.expr("p div 16")).withColumn("s", (F.col("w") % 4).cast("long"))
    words = px.groupBy("block").agg(F.sum(F.expr("shiftleft(s, cast(2 * (p % 16) as int))")).alias("word"), F.count("*").alias("n")).where("n = 16")
    return neighbours.most_used(words, "word", 100)


# -- transforms -------------------------------------------------------------------------------------------------------


def _tiles(spark, sf, size: int):
    """tile, a: square tiles of the raster's red channel, the last ones filled up with zeros."""
    px = C.colours(spark, sf, size)
    tile = (color.quotient(F.col("y"), size) * (C.WIDTH // size) + color.quotient(F.col("x"), size)).alias("tile")
    place = (F.col("y") % size * size + F.col("x") % size).alias("k")
    t = px.select(tile, place, F.col("r").alias("v")).groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("a")).where(F.size("a") == size * size)
    return t.select("tile", F.transform("a", lambda s: s["v"]).alias("a"))


@query("px:8 rgb", "t as (select ((y // 8) * 8 + x // 8)::int as tile, (y % 8)::int as i, (x % 8)::int as j, r as v from rgb), full_ as (select * from t where tile in (select tile from t group by tile having count(*) = 64)), "
       "ch as (select *, case when i % 2 = 1 then v - (lag(v) over c + coalesce(lead(v) over c, lag(v) over c)) // 2 end as h from full_ window c as (partition by tile, j order by i)), "
       "cl as (select tile, j, case when i % 2 = 1 then 4 + i // 2 else i // 2 end as i, case when i % 2 = 1 then h else v + (coalesce(lag(h) over c, lead(h) over c) + coalesce(lead(h) over c, lag(h) over c) + 2) // 4 end as v from ch window c as (partition by tile, j order by i)), "
       "rh as (select *, case when j % 2 = 1 then v - (lag(v) over c + coalesce(lead(v) over c, lag(v) over c)) // 2 end as h from cl window c as (partition by tile, i order by j)), "
       "rl as (select tile, i, case when j % 2 = 1 then 4 + j // 2 else j // 2 end as j, case when j % 2 = 1 then h else v + (coalesce(lag(h) over c, lead(h) over c) + coalesce(lead(h) over c, lag(h) over c) + 2) // 4 end as v from rh window c as (partition by tile, i order by j)); select tile, i::int as i, j::int as j, v::bigint as v from rl")
def wavelet2d_tile(spark, sf):
    """Columns, then rows, each by window functions: no arrays, and a task holds a share of the tiles."""
    x, y = F.col("x"), F.col("y")
    px = C.colours(spark, sf, 8).select(grid.block_number(x, y, C.WIDTH, 8).alias("tile"), (y % 8).alias("i"), (x % 8).alias("j"), F.col("r").alias("v"))
    whole = px.withColumn("n", F.count("*").over(Window.partitionBy("tile"))).where("n = 64").drop("n")
    down = scans.lifted(whole, "v", ["tile", "j"], "i").select("tile", "j", (F.col("band") * 4 + F.col("at")).cast("int").alias("i"), F.col("coef").alias("v"))
    across = scans.lifted(down, "v", ["tile", "i"], "j")
    return across.select("tile", "i", (F.col("band") * 4 + F.col("at")).cast("int").alias("j"), F.col("coef").alias("v"))


def _coefficients(tiles: DataFrame, size: int, f, kind: str) -> DataFrame:
    """tile, i, j, v of (tile, a): f over whole batches of (n, size, size) tiles."""

    def run(batches):
        for b in batches:
            t = f(np.array(b["a"].to_pylist(), dtype=np.int64).reshape(-1, size, size))
            i, j = (np.tile(x.ravel(), len(t)).astype(np.int32) for x in np.indices((size, size)))
            tile = np.repeat(b["tile"].to_numpy(), size * size)
            yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(i), pa.array(j), pa.array(t.reshape(-1))], ["tile", "i", "j", "v"])

    return tiles.mapInArrow(run, f"tile {tiles.schema['tile'].dataType.simpleString()}, i int, j int, v {kind}")


def _wavelet_levels(size: int) -> str:
    """The levels of the transform as expressions: columns, then rows, of a corner that halves; the rest stays."""

    def lifted(name: str, of: str, at: str, other: str, d: int) -> str:
        win = f"window c as (partition by tile, {other} order by {at})"
        return f"{name}h as (select tile, i, j, v, case when {at} % 2 = 1 then v - (lag(v) over c + coalesce(lead(v) over c, lag(v) over c)) // 2 end as h from {of} {win}), {name} as (select tile, {other}, case when {at} % 2 = 1 then {d // 2} + {at} // 2 else {at} // 2 end as {at}, case when {at} % 2 = 1 then h else v + (coalesce(lag(h) over c, lead(h) over c) + coalesce(lead(h) over c, lag(h) over c) + 2) // 4 end as v from {name}h {win})"

    out, before, d = [], "t", size
    while d > 1:
        out += [f"corner{d} as (select * from {before} where i < {d} and j < {d})", lifted(f"down{d}", f"corner{d}", "i", "j", d), lifted(f"across{d}", f"down{d}", "j", "i", d)]
        out.append(f"level{d} as (select tile, i, j, v from across{d} union all select tile, i, j, v from {before} where i >= {d} or j >= {d})")
        before, d = f"level{d}", d // 2
    return ", ".join(out)


@query("px:32 rgb", "t as (select (y // 32) * 2 + x // 32 as tile, y % 32 as i, x % 32 as j, r as v from rgb), " + _wavelet_levels(32) + "; select tile::int as tile, i::int as i, j::int as j, v::bigint as v from level2")
def wavelet_levels(spark, sf):
    """Every coefficient of tiles of 32x32 after five levels."""
    return _coefficients(_tiles(spark, sf, 32), 32, transforms.forward_tiles, "long")


@query("px:32", "select count(*) // 1024 as tiles, 0::bigint as bad from px")
def wavelet_bad_rows(spark, sf):
    """Tiles of 32x32 through five levels and back: how many there are and how many are not restored."""

    def run(batches):
        for b in batches:
            t = np.array(b["a"].to_pylist(), dtype=np.int64).reshape(-1, 32, 32)
            bad = (transforms.inverse_tiles(transforms.forward_tiles(t)) != t).any(axis=(1, 2)).sum()
            yield pa.RecordBatch.from_arrays([pa.array([len(t)], pa.int64()), pa.array([int(bad)], pa.int64())], ["tiles", "bad"])

    return _tiles(spark, sf, 32).select("a").mapInArrow(run, "tiles long, bad long").agg(F.sum("tiles").alias("tiles"), F.sum("bad").alias("bad"))


COSINES = "m as (select k, i, case when k = 0 then sqrt(1.0::double / 8) else sqrt(2.0::double / 8) end * cos((2 * i + 1) * k * pi() / 16) as c from range(8) a(k), range(8) b(i))"


@query("px:1 rgb", COSINES + ", row_ as (select p // 8 as n, p % 8 as i, r as v from rgb), whole as (select n from row_ group by n having count(*) = 8); select row_.n::bigint as n, m.k::int as k, round(sum(m.c * row_.v), 6) as coef from row_ join whole using (n) join m using (i) group by row_.n, m.k")
def dct8_rows(spark, sf):
    rows = C.colours(spark, sf, 1).groupBy(F.expr("p div 8").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.expr("p % 8").alias("i"), "r"))).alias("a")).where(F.size("a") == 8)
    out = rows.select("n", F.posexplode(transforms.dct_row(F.transform("a", lambda s: s["r"]))).alias("k", "coef"))
    return out.select("n", "k", (F.round("coef", 6) + F.lit(0.0)).alias("coef"))


def _quant(table):
    values = ", ".join(f"({k}, {q})" for k, q in enumerate(table))
    return f"q(k, q) as (values {values}), s as (select p, ((y % 8) * 8 + x % 8)::int as k, r - 128 as v from rgb); select p, (v // q)::int as level, (v // q * q)::int as back from s join q using (k)"


def _quantised(spark, sf, table):
    q = F.element_at(F.array(*map(F.lit, table)), F.col("y") % 8 * 8 + F.col("x") % 8 + 1)
    level = color.quotient(F.col("r") - 128, q)
    return C.colours(spark, sf).select("p", level.alias("level"), (level * q).alias("back"))


@query("px rgb", _quant(transforms.LUMA))
def quant_luma(spark, sf):
    return _quantised(spark, sf, transforms.LUMA)


@query("px rgb", _quant(transforms.CHROMA))
def quant_chroma(spark, sf):
    return _quantised(spark, sf, transforms.CHROMA)


@query("px:8 rgb", COSINES + ", t as (select (y // 8) * 8 + x // 8 as tile, y % 8 as i, x % 8 as j, r as v from rgb), a as (select tile, t.i, m.k as j, sum(m.c * v) as v from t join m on m.i = t.j group by all), b as (select tile, m.k as i, a.j, sum(m.c * v) as v from a join m on m.i = a.i group by all); select tile::int as tile, i::int as i, j::int as j, round(v, 6) + 0.0::double as v from b")
def dct2d_tiles(spark, sf):
    """Every coefficient of the cosine transform of 8x8 tiles."""
    return _coefficients(_tiles(spark, sf, 8), 8, lambda t: transforms.dct_tiles(t.astype(np.float64)), "double").withColumn("v", F.round("v", 6) + 0.0)


@query("px:8", "select count(*) // 64 as tiles, 0.0::double as gap from px")
def dct_tile_round_trip(spark, sf):
    """8x8 tiles transformed, and back; the largest difference, rounded."""

    def run(batches):
        for b in batches:
            t = np.array(b["a"].to_pylist(), dtype=np.float64).reshape(-1, 8, 8)
            gap = np.abs(transforms.idct_tiles(transforms.dct_tiles(t)) - t).max(initial=0)
            yield pa.RecordBatch.from_arrays([pa.array([len(t)], pa.int64()), pa.array([float(gap)])], ["tiles", "gap"])

    return _tiles(spark, sf, 8).select("a").mapInArrow(run, "tiles long, gap double").agg(F.sum("tiles").alias("tiles"), F.round(F.max("gap"), 9).alias("gap"))


# -- vectors ----------------------------------------------------------------------------------------------------------

PAIR = "qs as (select id as query_id, vec as q from pts where id % 20 = 0), ds as (select query_id, id, q, vec as v, round(sqrt(list_sum(list_transform(list_zip(q, vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) as dist from qs, pts where query_id <> id)"


def _queries(spark, sf):
    p = C.points(spark, sf)
    return p.where("id % 20 = 0"), p


def _distance_query(name, p, expr):
    def f(spark, sf):
        a, b = _queries(spark, sf)
        return neighbours.distances(a, b, p, 6)

    f.__name__ = name
    query("pts", f"qs as (select id as query_id, vec as q from pts where id % 20 = 0); select query_id, id, round({expr}, 6) as dist from qs, pts where query_id <> id")(f)


_distance_query("l1_dist", 1, "list_sum(list_transform(list_zip(q, vec), lambda z: abs(z[1] - z[2])))")
_distance_query("l2_dist", 2, "sqrt(list_sum(list_transform(list_zip(q, vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))")
_distance_query("linf_dist", float("inf"), "list_max(list_transform(list_zip(q, vec), lambda z: abs(z[1] - z[2])))")
_distance_query("lp_dist", 3, "pow(list_sum(list_transform(list_zip(q, vec), lambda z: pow(abs(z[1] - z[2]), 3))), 1.0::double / 3)")


@query("pts", "select id, round(list_sum(list_transform(vec, lambda x: abs(x))), 6) as n1, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) as n2, round(list_max(list_transform(vec, lambda x: abs(x))), 6) as ninf, round(pow(list_sum(list_transform(vec, lambda x: pow(abs(x), 3))), 1.0::double / 3), 6) as n3 from pts")
def lp_norm(spark, sf):
    norms = (("n1", 1), ("n2", 2), ("ninf", float("inf")), ("n3", 3))
    return C.points(spark, sf).select("id", *(F.round(vectors.norm(F.col("vec"), p), 6).alias(n) for n, p in norms))


@query("pts", "select id, unnest(generate_series(0, len(vec) - 1))::int as dim, round(unnest(vec) / sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) as u from pts")
def unit_vectors(spark, sf):
    return C.points(spark, sf).select("id", F.posexplode(vectors.unit(F.col("vec"))).alias("dim", "u")).withColumn("u", F.round("u", 6))


@query("pts", "qs as (select id as query_id, vec as q from pts where id % 20 = 0); select query_id, id, round(list_sum(list_transform(list_zip(q, vec), lambda z: z[1] * z[2])), 6) as dot from qs, pts where query_id <> id")
def dot_product(spark, sf):
    return neighbours.pairs(*_queries(spark, sf)).select("query_id", "id", F.round(vectors.dot(F.col("q"), F.col("v")), 6).alias("dot"))


@query("pts", "e as (select unnest(generate_series(0, len(vec) - 1))::int as dim, unnest(vec) as x from pts); select dim, min(x) as low, max(x) as high from e group by dim")
def bbox(spark, sf):
    return neighbours.bounding_box(C.points(spark, sf))


KNN = PAIR + ", rk as (select query_id, id, dist, (row_number() over (partition by query_id order by dist, id))::int as rank from ds)"


@query("pts", KNN + "; select * from rk where rank <= 5")
def knn_exact(spark, sf):
    return neighbours.nearest(*_queries(spark, sf), k=5)


@query("pts", PAIR + "; select query_id, id, dist from ds where dist < 1.2")
def knn_radius(spark, sf):
    return neighbours.within(*_queries(spark, sf), radius=1.2)


@query("pts", KNN + "; select * from rk where rank > 20 and rank <= 30")
def knn_page(spark, sf):
    return neighbours.page(*_queries(spark, sf), number=2, size=10)


@query()
def knn_lsh(spark, sf):
    p = C.points(spark, sf)
    return neighbours.approximate(p.where("id % 20 = 0"), p, k=5)


ASSIGN = "seeds as (select id as cluster, vec as centre from pts where id < 8), near as (select id, vec, cluster, round(sqrt(list_sum(list_transform(list_zip(vec, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) as dist from pts, seeds), asg as (select * from near qualify row_number() over (partition by id order by dist, cluster) = 1)"


def _seeds(spark, sf):
    return C.points(spark, sf).where("id < 8").select(F.col("id").alias("cluster"), F.col("vec").alias("centre"))


@query("pts", ASSIGN + "; select id, cluster, dist from asg")
def nearest_centroid(spark, sf):
    return neighbours.assign(C.points(spark, sf), _seeds(spark, sf)).select("id", "cluster", "dist")


@query("pts", ASSIGN + ", e as (select cluster, unnest(generate_series(0, len(vec) - 1))::int as dim, unnest(vec) as x from asg); select cluster, dim, round(avg(x), 6) as m from e group by cluster, dim")
def kmeans_step(spark, sf):
    c = neighbours.recentre(neighbours.assign(C.points(spark, sf), _seeds(spark, sf)))
    return c.select("cluster", F.posexplode("centre").alias("dim", "m")).withColumn("m", F.round("m", 6))


@query()
def kmeans_fixed(spark, sf):
    return neighbours.kmeans(C.points(spark, sf), _seeds(spark, sf)).select("id", "cluster", "dist")


# -- sequential coders: rows-only, with a column that says whether the data came back -----------------------------------


PIECE = 256 * entropy.GROUP  # bytes that are coded at once


def _by_stream(b: pa.RecordBatch):
    """Row numbers of each stream in a batch."""
    codes = pa.array(b["stream"]).dictionary_encode(null_encoding="encode")
    number = codes.indices.to_numpy()
    for k, stream in enumerate(codes.dictionary.to_pylist()):
        yield stream, np.flatnonzero(number == k)


def _grouped(texts: list[bytes | None]) -> np.ndarray:
    """The texts one after another, each padded to whole groups."""
    return np.frombuffer(b"".join(t + b"\0" * (-len(t) % entropy.GROUP) for t in texts if t), np.uint8)


def _streams(spark, sf):
    """stream, data, freq: every document's bytes under its source, with the source's frequencies (256 words of 16 bits)."""
    docs = C.table(spark, sf, "documents").select(F.col("source").alias("stream"), F.encode("text", "UTF-8").alias("data"))

    def count(batches):
        for b in batches:
            for stream, rows in _by_stream(b):
                data, counts = _grouped(b["data"].take(pa.array(rows)).to_pylist()), np.zeros(256, np.int64)
                for i in range(0, len(data), PIECE):
                    counts += np.bincount(data[i : i + PIECE], minlength=256)
                yield pa.RecordBatch.from_arrays([pa.array([stream] * 256, pa.string()), pa.array(range(256), pa.int32()), pa.array(counts, pa.int64())], ["stream", "sym", "cnt"])

    def apportion(key, t):
        counts = np.zeros(256, np.int64)
        counts[t["sym"].to_numpy()] = t["cnt"].to_numpy()
        freq = frequency.apportion_array(counts, entropy.TOTAL) if counts.any() else counts
        return pa.table({"name": pa.array([key[0].as_py()], pa.string()), "freq": pa.array([freq.astype("<u2").tobytes()], pa.binary())})

    counts = docs.mapInArrow(count, "stream string, sym int, cnt long").groupBy("stream", "sym").agg(F.sum("cnt").alias("cnt"))
    freq = counts.groupBy("stream").applyInArrow(apportion, "name string, freq binary")
    docs = spread(docs)
    return docs.join(F.broadcast(freq), docs["stream"].eqNullSafe(freq["name"])).select("stream", "data", "freq")


def _per_stream(f, names: list[str]):
    """Sums of what f gives for every piece of a stream: stream, n (bytes of the texts), the named sizes, ok."""

    def run(batches):
        for b in batches:
            for stream, rows in _by_stream(b):
                texts = b["data"].take(pa.array(rows)).to_pylist()
                data, freq = _grouped(texts), np.frombuffer(b["freq"][int(rows[0])].as_py(), "<u2").astype(np.int64)
                sums, ok = np.zeros(len(names), np.int64), True
                for i in range(0, len(data), PIECE):
                    *sizes, whole = f(data[i : i + PIECE], freq)
                    sums += sizes
                    ok &= whole
                yield pa.RecordBatch.from_pylist([{"stream": stream, "n": sum(len(t or b"") for t in texts), **dict(zip(names, sums.tolist())), "ok": ok}], schema=schema)

    schema = pa.schema([("stream", pa.string()), ("n", pa.int64()), *((x, pa.int64()) for x in names), ("ok", pa.bool_())])
    columns = ", ".join(f"{x} long" for x in ("n", *names))

    def add(streams: DataFrame) -> DataFrame:
        rows = streams.mapInArrow(run, f"stream string, {columns}, ok boolean")
        return rows.groupBy("stream").agg(*(F.sum(x).alias(x) for x in ("n", *names)), F.bool_and("ok").alias("ok"))

    return add


LANE = "q as (select user_id, v % 4 as s, row_number() over (partition by user_id order by ts, event_id) as i from seqs), c as (select user_id, i, [1024, 512, 256, 256][s + 1]::bigint as f, [0, 1024, 1536, 1792][s + 1]::bigint as b from q), z as (select user_id, 0::bigint as i, 32768::bigint as state, 0::bigint as words, 0::bigint as added from c group by user_id union all select c.user_id, c.i, (case when z.state >= c.f * 1048576 then z.state >> 16 else z.state end) // c.f * 2048 + c.b + (case when z.state >= c.f * 1048576 then z.state >> 16 else z.state end) % c.f, z.words + (z.state >= c.f * 1048576)::bigint, z.added + case when z.state >= c.f * 1048576 then z.state & 65535 else 0 end from z join c on c.user_id = z.user_id and c.i = z.i + 1)"


def rans_encode_lane(spark, sf):
    """One coder lane per user over the low two bits of the values, the fold in column expressions."""
    s = C.sequences(spark, sf).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "v"))), lambda x: (x["v"] % 4).cast("int")).alias("a"))
    options = entropy.Options((1024, 512, 256, 256))
    return s.select("user_id", entropy.lane_state(F.col("a"), options).alias("e")).select("user_id", "e.*")


QUERIES["rans_encode_lane"] = rans_encode_lane
ORACLE["rans_encode_lane"] = "with recursive " + C.SQL["seqs"] + ", " + LANE + " select user_id, state, words, added from z qualify row_number() over (partition by user_id order by i desc) = 1"


@query()
def rans_group_encode(spark, sf):
    """Every source's documents through the interleaved coder and back: sizes and whether all is whole.

    A document is coded in groups of 8,192 bytes, the last one padded, by the frequencies of its whole source.
    """

    def f(data, freq):
        raw = entropy.encode_stream(data, freq)[1]
        return len(raw), bool((entropy.decode_stream(freq, raw, len(data)) == data).all())

    return _per_stream(f, ["coded"])(_streams(spark, sf))


@query()
def tans_roundtrip(spark, sf):
    """The same by the tabled coder: the number of its words."""

    def f(data, freq):
        table = entropy.Table(freq, ranges=False)
        symbols = data.reshape(-1, entropy.LANES, entropy.LANE_SYMBOLS).astype(np.int64)
        state, words = entropy.encode_groups(symbols, table)
        back = entropy.decode_groups(state, words, entropy.LANE_SYMBOLS, table)
        return sum(map(len, words)), bool((back == symbols).all())

    return _per_stream(f, ["words"])(_streams(spark, sf))


@query("seqs", "select user_id, count(*) as n, count(*) filter (where abs(delta - 128) > 127) as aside, true as ok from (select *, v - lag(v, 1, 0) over (partition by user_id order by ts, event_id) + 128 as delta from seqs) group by user_id")
def short_coder_roundtrip(spark, sf):
    def f(key, t):
        v = t["delta"].to_numpy() - 128
        sym, aside = entropy.encode_shorts(v)
        ok = bool((entropy.decode_shorts(sym, aside) == v).all())
        return pa.table({"user_id": [key[0].as_py()], "n": pa.array([len(v)], pa.int64()), "aside": pa.array([len(aside)], pa.int64()), "ok": [ok]})

    return _deltas(spark, sf).select("user_id", "delta").groupBy("user_id").applyInArrow(f, "user_id long, n long, aside long, ok boolean")


IMAGE = 512


def _containers(spark, sf):
    """The events' raster cut into 512x512 images, row by row, each to its container and back.

    Pixels that the events leave empty have the mean colour of the image's others. `radius` is the smoothing that
    the container needed, 0 where it holds the image as it is; `psnr` is against the image that was coded.
    """
    area = IMAGE * IMAGE
    p, k = F.col("p"), F.pmod(F.col("p"), F.lit(area))
    place = [F.floor(p / area).cast("string").alias("image_id"), (k % IMAGE).cast("int").alias("x"), color.quotient(k, IMAGE).cast("int").alias("y")]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x, y = t["x"].to_numpy(), t["y"].to_numpy()
        own = np.stack([t[c].to_numpy() for c in "rgb"], axis=1).astype(np.int64)
        rgb = np.tile(own.sum(axis=0) // len(own), (IMAGE, IMAGE, 1))
        rgb[y, x] = own
        radius, px, ep1, ep2, known, number, raw = codec.encode_fitting(rgb)
        back = codec.decode_blocks(raw)
        ok = back[:2] == (IMAGE, IMAGE) and all((a == b).all() for a, b in zip(back[2:], (ep1, ep2, known[number])))
        mse = ((px - blocks.decode(ep1, ep2, known[number])) ** 2).sum() / area
        psnr = float(10 * np.log10(3 * 255**2 / mse)) if mse else None
        row = {"image_id": key[0].as_py(), "pixels": len(own), "radius": radius, "container": raw, "words": len(known), "psnr": psnr, "ok": bool(ok)}
        return pa.Table.from_pylist([row], schema=schema)

    schema = pa.schema([("image_id", pa.string()), ("pixels", pa.int64()), ("radius", pa.int32()), ("container", pa.binary()), ("words", pa.int64()), ("psnr", pa.float64()), ("ok", pa.bool_())])
    images = C.colours(spark, sf).where("p is not null and b is not null").select(*place, "r", "g", "b").groupBy("image_id")
    return images.applyInArrow(run, "image_id string, pixels long, radius int, container binary, words long, psnr double, ok boolean")


@query()
def container_roundtrip(spark, sf):
    """Images to containers and back: the decoded blocks equal those that were encoded."""
    size = F.octet_length("container").cast("long")
    return _containers(spark, sf).select("image_id", "pixels", "radius", size.alias("bytes"), "words", F.round(8 * size / IMAGE**2, 6).alias("bpp"), F.round("psnr", 6).alias("psnr"), "ok")


@query()
def container_header(spark, sf):
    return codec.header(_containers(spark, sf).select("image_id", "container"))


def _block_table(spark, sf):
    """block, px (16 x 3 bytes) of the blocks of the events' raster, the last ones filled up with zeros."""
    rows = _gathered(C.colours(spark, sf, 4)).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "r", "g", "b"))).alias("a")).where(F.size("a") == 16)
    return rows.select("block", F.flatten(F.transform("a", lambda s: F.array(s["r"], s["g"], s["b"]))).alias("px"))


@query()
def compress_dxt(spark, sf):
    """Endpoints, selector word and error of every 4x4 block."""

    def run(batches):
        for b in batches:
            px = np.array(b["px"].to_pylist(), dtype=np.int64).reshape(-1, 16, 3)
            ep1, ep2, word = blocks.compress(px)
            err = blocks.block_error(px, blocks.decode(ep1, ep2, word)) if len(px) else ep1
            yield pa.RecordBatch.from_arrays([b["block"], *(pa.array(x, pa.int64()) for x in (ep1, ep2, word, err))], ["block", "ep1", "ep2", "sel", "err"])

    return _block_table(spark, sf).mapInArrow(run, "block int, ep1 long, ep2 long, sel long, err long")


@query()
def dict_pass(spark, sf):
    """The ordered dictionary pass over images of 16 x 16 blocks, an image a group."""

    def f(key, t):
        order = np.argsort(t["block"].to_numpy())
        px = np.array(t["px"].to_pylist(), dtype=np.int64).reshape(-1, 16, 3)[order]
        ep1, ep2, known, number = blocks.dictionary_pass(px, *blocks.compress(px))
        n = len(px)
        return pa.table({"block": pa.array(t["block"].to_numpy()[order], pa.int32()), "ep1": pa.array(ep1), "ep2": pa.array(ep2), "sel": pa.array(known[number]), "delta": pa.array(np.diff(number, prepend=0) + 128), "words": pa.array(np.full(n, len(known)), pa.int64())})

    rows = _block_table(spark, sf).withColumn("image", color.quotient(F.col("block"), 256))
    return rows.groupBy("image").applyInArrow(f, "block int, ep1 long, ep2 long, sel long, delta long, words long")


WORD_GROUP = 2048


@query()
def reassign_selectors(spark, sf):
    """Blocks moved to the selector word of other blocks that adds the least error, if that is little.

    Every word that occurs is offered to every block, to equal blocks once: blocks and words meet in groups of about
    WORD_GROUP blocks and 16 WORD_GROUP words, so the pairs grow with the square of the raster's different blocks.
    """

    def code(batches):
        for b in batches:
            px = np.array(b["px"].to_pylist(), dtype=np.int64).reshape(-1, 16, 3)
            raw = pa.array([x.tobytes() for x in px.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([b["block"], raw, *(pa.array(x, pa.int64()) for x in blocks.compress(px))], ["block", "px", "ep1", "ep2", "old"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        px = np.frombuffer(b"".join(left["px"].to_pylist()), np.uint8).reshape(-1, 16, 3).astype(np.int64)
        old = [left[c].to_numpy() for c in ("ep1", "ep2", "old")]
        ep1, ep2, word, cost, uses = blocks.best_words(px, *old, right["word"].to_numpy(), right["uses"].to_numpy(), 400.0)
        values = [pa.array(x, pa.int64()) for x in (cost, -uses, word, ep1, ep2, old[2])]
        return pa.table([left["px"], *values], names=["px", "cost", "rank", "sel", "ep1", "ep2", "old"])

    coded = written(_block_table(spark, sf).mapInArrow(code, "block int, px binary, ep1 long, ep2 long, old long"), "coded-blocks")
    different = coded.drop("block").dropDuplicates(["px"])
    words = coded.groupBy(F.col("old").alias("word")).agg(F.count("*").alias("uses"))
    n_blocks, n_words = different.count(), words.count()
    cores = spark.sparkContext.defaultParallelism
    sides = max(1, -(-n_blocks // WORD_GROUP), min(2 * cores, n_blocks // 256)), max(1, -(-n_words // (16 * WORD_GROUP)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = different.withColumn("b", dealt("px", sides[0])).withColumn("w", copies(sides[1]))
    right = words.withColumn("w", dealt("word", sides[1])).withColumn("b", copies(sides[0]))
    met = left.groupBy("b", "w").cogroup(right.groupBy("b", "w")).applyInArrow(meet, "px binary, cost long, rank long, sel long, ep1 long, ep2 long, old long")
    best = met.groupBy("px").agg(F.min(F.struct("cost", "rank", "sel", "ep1", "ep2", "old")).alias("m"))
    return coded.select("block", "px").join(best, "px").select("block", "m.ep1", "m.ep2", "m.sel", "m.old")


@query("px", "select 't' || p as path, greatest(1, (p + 4) >> l)::bigint as width, greatest(1, (p * 2 + 4) >> l)::bigint as height, 'DXT1' as fourcc, l::bigint as level, (((greatest(1, (p + 4) >> l) + 3) // 4) * ((greatest(1, (p * 2 + 4) >> l) + 3) // 4) * 8)::bigint as bytes from px, range(3) r(l)")
def texture_headers(spark, sf):
    """DDS headers built as binary columns and parsed back, with their mip levels."""
    p = C.pixels(spark, sf).select(F.concat(F.lit("t"), F.col("p")).alias("path"), (F.col("p") + 4).alias("w"), (F.col("p") * 2 + 4).alias("h"))
    word = lambda x: bits.to_little_endian(x, 4)
    zero = F.lit(b"\0" * 4)
    fields = [F.lit(b"DDS "), word(F.lit(124)), zero, word(F.col("h")), word(F.col("w")), zero, zero, word(F.lit(3)), *[zero] * 13, F.lit(b"DXT1"), *[zero] * 10]
    return textures.mip_levels(textures.dds_headers(p.select("path", F.concat(*fields).alias("content"))))


HOURLY = "select date_trunc('hour', ts)::timestamp as start, event_type, count(*) as cnt from events group by all"


@query("", HOURLY)
def hourly_counts(spark, sf):
    """The batch form of the streaming count: tumbling windows of one hour."""
    e = C.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("cnt")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "cnt")


@query("", HOURLY)
def stream_hourly_counts(spark, sf):
    """The same by Structured Streaming, drained once in complete mode: no window and no late row is left out."""
    import tempfile
    import uuid

    at = (spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()) + f"/stream-{uuid.uuid4().hex}"
    rows = streams.drain_complete(streams.windowed_counts(streams.event_stream(spark, sf), late=None), at)
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("", "select lang, source, count(*) as n, sum(n_chars)::bigint as chars from documents group by cube (lang, source)")
def cube_of_sizes(spark, sf):
    return C.table(spark, sf, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
