"""What the operators of this subpackage share: scratch tables, sizing, word counts."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, where the cluster's PYTHONPATH lacks it."""
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(PACKAGE.parent) in paths or getattr(spark.sparkContext, "_millrace_shipped", False):
        return
    at = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(at))
    spark.sparkContext._millrace_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one where it is unset (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        own = getattr(sc, "_millrace_checkpoints", None)
        if own is None:
            own = sc._millrace_checkpoints = tempfile.mkdtemp(prefix="millrace-")
            sc.setCheckpointDir(own)
        at = own
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder; unlike checkpoint(), later reads prune columns.

    The shuffle files behind it are of no more use and are dropped with the query where Spark can do that.
    """
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.options(**options).option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], count: str, how: str = "inner", most: int = 10_000) -> DataFrame:
    """Join rows with a table of one row per key whose column `count` says how many of the rows have the key.

    Keys with over 1 / most of all rows, of which there can be no more than `most`, are broadcast; so no key, however
    frequent, gathers its rows in one task. Both sides are read twice and should be stored tables.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    frequent = F.broadcast(keys.where(F.col(count) * most > total))
    rest = rows.join(frequent.select(*on), on, "left_anti").join(keys.where(F.col(count) * most <= total), on, how)
    return rows.join(frequent, on).unionByName(rest)


def n_words(text: Column) -> Column:
    """Number of runs of `[^\\x20\\x09-\\x0D]+`; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()
