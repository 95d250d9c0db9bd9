"""Token-ID output: Parquet list columns in ascending id order, read back selectively.

File format: doc_id, part, local_start and n_tokens are delta-encoded integers (dictionary off, format version
2), `ids` is a dictionary-encoded list of 32-bit integers, row groups and pages are small enough that Parquet's
page index lets a reader take few documents, or only the metadata columns, without the rest. Spark's writer makes
the files, so a lost executor's task is committed once, and any store that Spark reaches will do.

Null text is empty and holds the end id alone; rows that repeat a doc_id are kept, next to each other; a null
doc_id comes first; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, ship
from .tokens import encoder

ROW_GROUP_BYTES, PAGE_ROWS = 16 << 20, 500


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encode doc_id, text and write the files in ascending doc_id order: one range partition, one sorted file."""
    spark = docs.sparkSession
    ship(spark)
    end = np.array([end_id], dtype=np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, texts_to_ids = 0, TaskContext.get().partitionId(), encoder(vocabulary)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                c = b.slice(k, 1000)
                ids = texts_to_ids(c.column(1).to_pylist())
                n = np.array([len(x) + 1 for x in ids], dtype=np.int64)
                ends = np.cumsum(n)
                values = np.concatenate([x for own in ids for x in (own, end)]).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(at + ends - n, pa.int64()), pa.array(n, pa.int64()), lists], ["doc_id", "part", "local_start", "n_tokens", "ids"])
                at += int(ends[-1])

    order = (F.col("doc_id"), F.xxhash64("text"))
    ranged = docs.select("doc_id", "text").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    out = ranged.mapInArrow(encode, "doc_id long, part int, local_start long, n_tokens long, ids array<int>")
    options = {
        "compression": "zstd",
        "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "local_start", "n_tokens")},
    }
    out.write.options(**options).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens, without touching the ids."""
    rows = spark.read.parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    # one row of two numbers for each file, and no more files than shuffle partitions when they were written
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(sums), "part").withColumn("start", F.col("local_start") + F.col("before"))


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """doc_id and ids, of a range of documents; the page index skips the others' pages."""
    rows = spark.read.parquet(path).select("doc_id", "ids")
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    return rows if last_id is None else rows.where(F.col("doc_id") <= last_id)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all from the files."""
    ship(spark)

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            values, at = np.asarray(ids.values).astype("<u4", copy=False), np.asarray(ids.offsets)
            sums = [zlib.crc32(memoryview(values[i:j])) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_metadata(spark, path).select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
