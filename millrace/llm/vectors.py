"""What the vector searches share: which rows take part, matrices of Arrow lists, blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def taking_part(df: DataFrame, id_col: str, vec_col: str, allow_zero: bool) -> DataFrame:
    """id (long) and vec (array<double>) of the rows that take part, repeated rows once.

    Left out: null ids or vectors, empty vectors, null or non-finite components, all-zero vectors unless allowed,
    and vectors of another length than the most frequent one (of equally frequent ones, the longest).
    """
    rows = df.select(df[id_col].cast("long").alias("id"), df[vec_col].cast("array<double>").alias("vec")).where("id is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite if allow_zero else finite & F.exists("vec", lambda x: x != 0))
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return rows.where(F.size("vec") == (dims[0]["dim"] if dims else 0)).dropDuplicates(["id", "vec"])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def dealt(name: str, blocks: int, seed: int) -> Column:
    """A row's block of `blocks`, by a hash of its id and vector."""
    return F.pmod(F.xxhash64("id", "vec", F.lit(seed)), F.lit(blocks)).cast("int").alias(name)


def every(name: str, blocks: int) -> Column:
    """One copy of the row for each block."""
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(name)


def blocks_of(n: int, rows: int) -> int:
    return max(1, -(-n // rows))
