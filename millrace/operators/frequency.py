"""Symbol statistics: counts, apportionment to a fixed total, cumulative and slot tables, entropy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOTAL = 2048


def symbol_counts(df: DataFrame, stream: str, symbol: str) -> DataFrame:
    """stream, sym, cnt: partial counts in every task, then one row per stream and symbol."""
    return df.groupBy(F.col(stream).alias("stream"), F.col(symbol).alias("sym")).agg(F.count("*").alias("cnt"))


def text_counts(df: DataFrame, stream: str, text: str, size: int = 1 << 20) -> DataFrame:
    """The same of the low bytes of a text column's code points, counted batch by batch in place of a row a character.

    `size` characters are counted at once. Null streams are a stream of their own; null and empty texts have no symbols.
    """

    def count(batches):
        for b in batches:
            codes = b["stream"].dictionary_encode(null_encoding="encode")
            number = codes.indices.to_numpy()
            for k, name in enumerate(codes.dictionary.to_pylist()):
                counts = np.zeros(256, np.int64)
                texts = "".join(t for t in b["text"].take(pa.array(np.flatnonzero(number == k))).to_pylist() if t)
                for i in range(0, len(texts), size):
                    points = np.frombuffer(texts[i : i + size].encode("utf-32-le"), "<u4")
                    counts += np.bincount(points & 255, minlength=256)
                seen = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(counts[seen])], ["stream", "sym", "cnt"])

    rows = df.select(F.col(stream).cast("string").alias("stream"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, "stream string, sym int, cnt long").groupBy("stream", "sym").agg(F.sum("cnt").alias("cnt"))


def apportion(counts: DataFrame, total: int = TOTAL) -> DataFrame:
    """stream, sym, freq: counts scaled to sum to `total` exactly, symbols that occur staying at 1 or more.

    Rounded shares are corrected by single steps, each where it costs least; costs rise from step to step of a
    symbol, so the least |error| of all steps are the greedy ones. Equal costs go to the smaller symbol.
    """
    per = Window.partitionBy("stream")
    f = (F.col("cnt") * total).cast("float").cast("double") / F.sum("cnt").over(per).cast("float").cast("double")
    rows = counts.where("cnt > 0").withColumn("f", f.cast("float")).withColumn("d", F.floor("f"))
    square = F.col("f").cast("double") * F.col("f").cast("double")  # of the single-precision share, in double
    share = F.greatest(F.lit(1), F.when(square <= F.col("d") * (F.col("d") + 1), F.col("d")).otherwise(F.col("d") + 1))
    rows = rows.withColumn("share", share).withColumn("error", F.lit(total) - F.sum("share").over(per))
    rows = rows.withColumn("s", F.signum("error").cast("int"))
    steps = rows.where("error <> 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.abs("error") - 1)))
    at = F.col("share") + F.col("s") * F.col("j")
    steps = steps.withColumn("at", at).where("s > 0 or at > 1")
    cost = F.round(F.col("cnt") * F.log2(F.col("at") / (F.col("at") + F.col("s"))), 9)
    best = Window.partitionBy("stream").orderBy("cost", "sym", "j")
    steps = steps.withColumn("cost", cost).withColumn("r", F.row_number().over(best)).where(F.col("r") <= F.abs("error"))
    change = steps.groupBy("stream", "sym").agg(F.sum("s").alias("change"))
    rows = rows.join(change, ["stream", "sym"], "left")
    return rows.select("stream", "sym", (F.col("share") + F.coalesce("change", F.lit(0))).cast("long").alias("freq"))


def apportion_array(counts: np.ndarray, total: int = TOTAL) -> np.ndarray:
    """The same for one stream in an array; for use within tasks."""
    counts = np.asarray(counts, dtype=np.int64)
    used = np.flatnonzero(counts)
    if total <= 0 or not len(used) or total < len(used):
        raise ValueError("a total of at least the number of symbols that occur, and one symbol, are needed")
    c = counts[used]
    f = (c * total).astype(np.float32) / np.float32(c.sum())
    d = np.floor(f).astype(np.int64)
    h = np.maximum(1, np.where(f.astype(np.float64) ** 2 <= d * (d + 1), d, d + 1))
    error = int(total - h.sum())
    if error:
        s, j = int(np.sign(error)), np.arange(abs(error))
        at = h[:, None] + s * j[None, :]
        cost = np.full(at.shape, np.inf)
        ok = (at > 1) | (s > 0)
        cost[ok] = np.round((c[:, None] * np.log2(np.where(ok, at, 2) / np.where(ok, at + s, 1)))[ok], 9)
        sym = np.broadcast_to(np.arange(len(used))[:, None], at.shape).ravel()
        order = np.lexsort((np.broadcast_to(j, at.shape).ravel(), sym, cost.ravel()))[: abs(error)]
        h = h + s * np.bincount(sym[order], minlength=len(used))
    out = np.zeros(len(counts), np.int64)
    out[used] = h
    return out


def cumulative(freqs: DataFrame) -> DataFrame:
    """stream, sym, freq, cum: exclusive prefix sums in order of the symbols."""
    before = Window.partitionBy("stream").orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    return freqs.withColumn("cum", F.coalesce(F.sum("freq").over(before), F.lit(0)).cast("long"))


def slots(cum: DataFrame) -> DataFrame:
    """A row per slot: the ranges become equal keys, so lookups are equi joins."""
    slot = F.explode(F.sequence(F.col("cum"), F.col("cum") + F.col("freq") - 1)).alias("slot")
    return cum.where("freq > 0").select("stream", slot, "sym", "freq", "cum")


def entropy(counts: DataFrame) -> DataFrame:
    """stream, n, bits: Shannon entropy per symbol."""
    p = F.col("cnt") / F.sum("cnt").over(Window.partitionBy("stream"))
    terms = counts.withColumn("t", -p * F.log2(p))
    return terms.groupBy("stream").agg(F.sum("cnt").alias("n"), F.round(F.sum("t"), 6).alias("bits"))


def coded_bits(freqs: DataFrame, total: int = TOTAL) -> DataFrame:
    """stream, bits: what a symbol costs under the apportioned table, log2(total) - sum f*log2(f)/total."""
    return freqs.groupBy("stream").agg(F.round(F.log2(F.lit(float(total))) - F.sum(F.col("freq") * F.log2(F.col("freq"))) / total, 6).alias("bits"))
