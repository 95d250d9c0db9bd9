"""The tables as carriers of codec input: symbol streams, rasters, value sequences, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import quotient
from ..session import table

WIDTH = 64


def pixels(spark: SparkSession, sf: str, lines: int = 0) -> DataFrame:
    """p, x, y, w: a raster of 16-bit words from the events, row by row; with zeros to a multiple of `lines` rows."""
    v = F.abs(F.floor(F.col("value") * 100)).cast("long")
    rows = table(spark, sf, "events").select(F.col("event_id").cast("long").alias("p"), (v % 65536).cast("int").alias("w"))
    if lines:
        area = WIDTH * lines
        n = rows.agg((F.max("p") + 1).alias("n")).where(F.col("n") % area != 0)
        rest = F.explode(F.sequence("n", (F.ceil(F.col("n") / area) * area - 1).cast("long")))
        rows = rows.unionByName(n.select(rest.alias("p"), F.lit(0).alias("w")))
    p = F.col("p")
    return rows.select("p", (p % WIDTH).cast("int").alias("x"), quotient(p, WIDTH).alias("y"), "w")


def colours(spark: SparkSession, sf: str, lines: int = 0) -> DataFrame:
    """p, x, y, r, g, b: 8-bit channels of the same raster."""
    w = F.col("w")
    return pixels(spark, sf, lines).select("p", "x", "y", (w * 7 % 256).alias("r"), (quotient(w, 3) % 256).alias("g"), (w % 256).alias("b"))


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, ts, event_id, v: whole hundredths per user in time order."""
    return table(spark, sf, "events").select("user_id", "ts", "event_id", F.floor(F.col("value") * 100).cast("long").alias("v"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """id, vec."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


#: The carriers in DuckDB SQL, as common table expressions.
SQL = {
    "symbols": "symbols as (select lang, ord(c) & 255 as sym from (select lang, unnest(string_split(text, '')) as c from documents) where c <> '')",
    "px": "px as (select event_id::bigint as p, (event_id % 64)::int as x, (event_id // 64)::int as y, (abs(floor(value * 100))::bigint % 65536)::int as w from events)",
    "rgb": "rgb as (select p, x, y, w * 7 % 256 as r, (w // 3) % 256 as g, w % 256 as b from px)",
    "seqs": "seqs as (select user_id, ts, event_id, floor(value * 100)::bigint as v from events)",
    "pts": "pts as (select vec_id::bigint as id, embedding::double[] as vec from embeddings)",
}


def sql(carriers: str, body: str) -> str:
    """`body` over the named carriers; a body may begin with further expressions, ended by a semicolon.

    `px:8` is the raster with zeros to a multiple of 8 rows.
    """
    need = []
    for c in carriers.split():
        name, _, lines = c.partition(":")
        if not lines:
            need.append(SQL[name])
            continue
        area = WIDTH * int(lines)
        rest = f"select unnest(generate_series(n, (n + {area - 1}) // {area} * {area} - 1)) as p from (select max(event_id) + 1 as n from events) where n % {area} <> 0"
        need += [SQL[name].replace("px as", "px_given as"), f"px as (select * from px_given union all select p::bigint, (p % 64)::int, (p // 64)::int, 0 from ({rest}))"]
    extra, _, last = body.rpartition(";")
    return "with " + ", ".join([*need, *([extra.strip()] if extra.strip() else [])]) + " " + last.strip()
