"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a URI. Where that is unset, a local session, as in tests, gets a folder of this machine; on a cluster it is an error, since executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder: a lost executor loses none of them, and later plans know their size."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what written() wrote for df, once nothing reads it any more."""
    path = _PATHS.pop(df, None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with a column of numbers from 0 in the given order, counted within ranges that are dealt to tasks: the driver sees a count for each range, no task all rows."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(parts.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    before = [(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)]
    base = df.sparkSession.createDataFrame(before or [(0, 0)], "_part int, _before long")
    return held.join(F.broadcast(base), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def counted_side(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most most rows, which are counted first; beyond, joins with it shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
