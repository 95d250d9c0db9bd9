"""Structured Streaming forms of the symbol statistics and the delta code (extensions)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """The events table as a stream; the zone-less time column becomes a timestamp so that watermarks apply."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/[e]vents.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Counts per time window and event type; late rows beyond the watermark are left out and closed windows forgotten.

    Without a watermark (None) no row is left out and every window stays open, as a bounded run in complete mode needs.
    """
    if late is not None:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "event_type", "cnt")


def delta_encode(events: DataFrame) -> DataFrame:
    """user_id, event_id, delta: the delta code of each user's values, the last value kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        v = rows["v"].to_numpy()
        before = [last, *v[:-1].tolist()]
        state.update((int(v[-1]),))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "delta": v - before + 128})

    values = events.select("user_id", "event_id", "ts", F.floor(F.col("value") * 100).alias("v"))
    return values.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, delta long", "last long", "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now; its rows as a table."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def drain_complete(df: DataFrame, at: str) -> DataFrame:
    """Run an aggregate over what is there now, in complete mode; its rows after the last trigger, from files."""
    rows = f"{at}/rows"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(rows)

    df.sparkSession.createDataFrame([], df.schema).write.parquet(rows)  # where no trigger runs
    df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(rows)
