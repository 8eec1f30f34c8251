"""Helpers shared by the corpus operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquad.sources.store import forget, shared_dir, written

__all__ = ["STRIP", "WORD", "broadcast_to", "documents", "forget", "fresh", "lower_ascii", "row_of", "shared_dir", "small_batches", "text_hash", "written"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A character outside these ranges may have a lower-case form of its own, which lower() would put in its place.
_MAY_FOLD = r"[^\x00-\x{BF}\x{DF}-\x{FF}\x{2010}-\x{2027}\x{3000}-\x{9FFF}\x{AC00}-\x{D7A3}]"
WORD = r"[^\x20\x09-\x0D]+"
STRIP = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() is faster than translate() and does the same on texts in which no other character has a lower-case form."""
    return F.when(text.rlike(_MAY_FOLD), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def broadcast_to(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df, to be broadcast if it has at most most rows; beyond, joins with it shuffle."""
    return F.broadcast(df) if rows <= most else df


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python gets: whole texts differ in length by orders of magnitude.

    The bounds are settings of the session and stay: plans read them when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception as e:  # noqa: BLE001  an older Spark has the row bound only
        if "CANNOT_MODIFY" not in str(e) and "CONFIG" not in str(e):
            raise


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns beside those of docs, which may have any names: underscores are added until they differ, in upper and lower case too."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def row_of(docs: DataFrame) -> Column:
    """All of a row as one struct: columns beside it have names of their own, whatever the user's are called."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def text_hash(text: Column) -> list[Column]:
    """th, th2: 128 bits of a text; a null text has other ones than the empty text."""
    known = text.isNotNull()
    return [F.xxhash64(known, text).alias("th"), F.xxhash64(F.lit("second"), known, text).alias("th2")]
