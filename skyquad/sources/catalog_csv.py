"""CSV catalogs: Hipparcos and plain ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names of Hipparcos files, in the order of files without names.
HIPPARCOS = ("HIP", "Vmag", "RA_ICRS_deg", "DE_ICRS_deg")


def read_hipparcos(spark: SparkSession, path: str, header: str = "names") -> DataFrame:
    """(id, ra_deg, dec_deg, mag). Rows without a whole number, or without a place with a declination in [-90, 90], are left out; a bad magnitude is null.

    header: "names" takes columns by the first line's names, "skip" by position
    after the first line, "none" by position from the first line.
    """
    reader = spark.read.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if header == "names":
        raw = reader.csv(path, header=True)
        raw = raw.select(*[(F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in HIPPARCOS])
    else:
        raw = reader.schema(", ".join(f"{c} string" for c in HIPPARCOS)).csv(path, header=header == "skip")
    n = lambda c, kind: F.expr(f"try_cast({c} as {kind})")
    out = raw.select(n("HIP", "bigint").alias("id"), n("RA_ICRS_deg", "double").alias("ra_deg"), n("DE_ICRS_deg", "double").alias("dec_deg"), n("Vmag", "double").alias("mag"))
    return out.filter(F.col("id").isNotNull() & F.col("ra_deg").isNotNull() & F.col("dec_deg").between(-90, 90) & ~F.isnan("dec_deg"))


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """(id, ra_deg, dec_deg, mag) of files with those names; blank lines and # comments are skipped, an empty magnitude is null, malformed numbers raise."""
    return spark.read.csv(path, schema="id long, ra_deg double, dec_deg double, mag double", header=True, comment="#", mode="FAILFAST", enforceSchema=True)


def as_text(stars: DataFrame) -> DataFrame:
    """Numbers as plain files have them: eight decimals for places, four for magnitudes, nothing for unknown ones."""
    return stars.select("id", F.format_string("%.8f", F.col("ra_deg").cast("double")).alias("ra_deg"), F.format_string("%.8f", F.col("dec_deg").cast("double")).alias("dec_deg"), F.when(F.col("mag").isNotNull() & ~F.isnan("mag"), F.format_string("%.4f", F.col("mag").cast("double"))).otherwise("").alias("mag"))


def write_plain(stars: DataFrame, path: str) -> None:
    as_text(stars).write.option("emptyValue", "").csv(path, header=True, mode="overwrite")


def stem(path_column: str = "_metadata.file_name"):
    """A file's name without folder and ending."""
    return F.regexp_extract(F.col(path_column), r"([^/]*?)(\.[^./]*)?$", 1)
