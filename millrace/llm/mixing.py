"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source size copies. The prefix sum of these expectations runs
within the source, in order of size, so that neighbours are alike and the words taken stay near the target;
one random offset is added, and a document is taken once for each integer boundary that its stretch crosses.
Places within a source come from one range partitioning of (source, size, id): a row's place is its index in
its partition plus the counts of the partitions before it, so a source with a third of all rows is spread.

Null text has size 0; a null source is a source of its own, last in order; a source without words has target 0;
repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, n_words, partitions

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2.0, 20


def offset(seed: int = SEED) -> float:
    return random.Random(seed).random()


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: shares by weight, stopped at cap times the source's size, the excess reshared.

    Resharing until none is above its stop is water-filling: a level v with target = min(stop, v * weight). Only
    one row per source passes through the single-partition windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", w.cast("double").alias("w"), (F.col("source_size") * cap).alias("stop"))
    before = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("stop").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(before.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) * share - full) / left)
    level = F.min(F.when(F.col("level") <= F.col("stop") / F.col("w"), F.struct(F.col("stop") / F.col("w"), F.col("level").alias("level")))).over(everything)
    return per.withColumn("v", level["level"]).select("source", "source_size", F.least("stop", F.col("v") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies * size) of every row."""
    spark = docs.sparkSession
    sizes = materialize(docs.select("doc_id", "source", n_words(docs["text"]).alias("size")), "sizes")
    order = (F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"))
    placed = sizes.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("m", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("m", 33).alias("part")
    cells = placed.groupBy(part, F.col("source").alias("src")).agg(F.min("m").alias("first"), F.count("*").alias("n"))
    behind = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("behind", F.coalesce(F.sum("n").over(behind), F.lit(0)))
    goals = targets(placed, weights, share, cap)
    cells = cells.join(goals, cells["src"].eqNullSafe(goals["source"])).drop("source")
    rows = placed.withColumn("p", F.shiftright("m", 33))
    rows = rows.join(cells, (rows["p"] == cells["part"]) & rows["source"].eqNullSafe(cells["src"]))
    place = F.col("m") - F.col("first") + F.col("behind")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor((place + 1) * rate + offset(seed)) - F.floor(place * rate + offset(seed))
    rows = rows.withColumn("copies", copies.cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def resample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes its document.

    Rows that repeat id, source and size share their copies evenly, the remainder by a seeded draw.
    """
    copies = mix(docs, weights, share, cap, seed).groupBy("doc_id", "source", "size").agg((F.sum("copies") / F.count("*")).alias("copies"))
    own = {c: fresh(docs, f"mix_{c}") for c in (*copies.columns, "words")}
    copies = copies.where("copies > 0").select(*(F.col(c).alias(own[c]) for c in copies.columns))
    rows = docs.withColumn(own["words"], n_words(docs["text"]))
    on = rows["doc_id"].eqNullSafe(copies[own["doc_id"]]) & rows["source"].eqNullSafe(copies[own["source"]]) & (rows[own["words"]] == copies[own["size"]])
    whole = F.floor(F.col(own["copies"]))
    times = whole + F.when(F.col(own["copies"]) > whole, (F.rand(seed) < F.col(own["copies"]) - whole).cast("int")).otherwise(0)
    rows = rows.join(copies, on)
    return rows.withColumn(own["words"], F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*docs.columns)


def oracle(seed: int = SEED) -> str:
    """The same rows in DuckDB SQL: places by one window over each source."""
    u = repr(offset(seed))
    return rf"""
with b as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from b group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w from s),
c as (select *, source_size * 2.0::double as stop from w),
l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(stop) over (order by stop / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by stop / w, source nulls last rows between current row and unbounded following) as level from c),
v as (select min_by(level, stop / w) as v from l where level <= stop / w),
t as (select source, source_size, least(stop, v * w) as target from l, v),
r as (select b.doc_id, b.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
      row_number() over (partition by b.source order by b.size, b.doc_id) as k
      from b join t on b.source is not distinct from t.source)
select doc_id, size, source_size, target, ((floor(k * rate + {u}) - floor((k - 1) * rate + {u})) * size)::bigint as taken from r"""
