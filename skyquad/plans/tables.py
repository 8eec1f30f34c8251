"""Astronomical tables derived from the general test tables, in the DataFrame API and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STARS_SQL = """stars as (select c_custkey as id, ((c_custkey * 7919) % 36000) / 100.0::double as ra_deg,
  degrees(asin((((c_custkey * 104729) % 20001) - 10000) / 10000.0::double)) as dec_deg,
  case when c_custkey % 17 <> 0 then ((c_custkey * 31) % 1000) / 100.0::double end as mag from customer)"""
SOURCES_SQL = """sources as (select s_suppkey % 5 as frame_id, s_suppkey as source_idx, ((s_suppkey * 7919) % 1024)::double as x_px, ((s_suppkey * 104729) % 768)::double as y_px,
  case when s_suppkey % 13 <> 0 then ((s_suppkey * 37) % 500)::double end as flux from supplier)"""
VECTOR_SQL = "cos(radians(dec_deg)) * cos(radians(ra_deg)) as x, cos(radians(dec_deg)) * sin(radians(ra_deg)) as y, sin(radians(dec_deg)) as z"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    dec = F.degrees(F.asin(((k * 104729) % 20001 - 10000) / F.lit(10000.0)))
    return load(spark, sf_dir, "customer").select(k.alias("id"), (((k * 7919) % 36000) / F.lit(100.0)).alias("ra_deg"), dec.alias("dec_deg"), F.when(k % 17 != 0, ((k * 31) % 1000) / F.lit(100.0)).alias("mag"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select((k % 5).alias("frame_id"), k.alias("source_idx"), ((k * 7919) % 1024).cast("double").alias("x_px"), ((k * 104729) % 768).cast("double").alias("y_px"), F.when(k % 13 != 0, ((k * 37) % 500).cast("double")).alias("flux"))


def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as a catalog for solving: 60 stars in each of up to 576 tiles of ten by ten degrees, side by side along bands of declination."""
    k = F.col("c_custkey")
    tile = F.floor(k / 60)
    ra0, dec0 = tile % 36 * 10, (F.floor(tile / 36) + 10) % 16 * 10 - 80
    ra, dec = ((k * 7919) % 1000) / F.lit(100.0), ((k * 104729) % 1009) / F.lit(100.0)
    return load(spark, sf_dir, "customer").select(k.alias("id"), (ra + ra0).alias("ra_deg"), (dec + dec0).alias("dec_deg"), F.when(k % 17 != 0, ((k * 31) % 500) / F.lit(100.0) + 1).alias("mag"))


PATCH_SQL = """patch as (select c_custkey as id, ((c_custkey * 7919) % 1000) / 100.0::double + (t % 36) * 10 as ra_deg, ((c_custkey * 104729) % 1009) / 100.0::double + (((t // 36 + 10) % 16) * 10 - 80) as dec_deg,
  case when c_custkey % 17 <> 0 then ((c_custkey * 31) % 500) / 100.0::double + 1 end as mag from (select *, c_custkey // 60 as t from customer))"""


#: Width and height of an image that stands for a supplier.
WIDE, HIGH = 48, 32


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each supplier: three bright spots, whose strength is the supplier's, on a background that no two share."""
    k = F.col("frame_id")
    rows = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("frame_id"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "frame_id")  # before a row becomes 1,536, so that no pixel has to be shuffled by its frame
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(HIGH - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(WIDE - 1))))
    rows = rows.withColumn("id", k * (WIDE * HIGH) + F.col("y") * WIDE + F.col("x"))
    bright = F.when(((F.col("x") % 16).between(7, 9)) & ((F.col("y") + k % 5).between(12, 14)), 150 + k % 90).otherwise(0)
    v = lambda m: (((F.col("id") * m) % 23) + bright).cast("int")
    return rows.select("frame_id", "y", "x", v(7919).alias("r"), v(104729).alias("g"), v(31).alias("b"))


RASTER_SQL = f"""raster as (select frame_id, y, x, (id * 7919) % 23 + bright as r, (id * 104729) % 23 + bright as g, (id * 31) % 23 + bright as b from (select *, case when x % 16 between 7 and 9 and y + frame_id % 5 between 12 and 14 then 150 + frame_id % 90 else 0 end as bright
  from (select s_suppkey as frame_id, y.range::int as y, x.range::int as x, s_suppkey * {WIDE * HIGH} + y.range * {WIDE} + x.range as id from supplier cross join range({HIGH}) y cross join range({WIDE}) x)))"""
