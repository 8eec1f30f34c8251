"""Made-up fields for tests: a catalog seen by a camera, and patterns for a database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquad.functions.camera import Camera
from skyquad.functions.vectors import unit_vector
from skyquad.operators.catalog import visible
from skyquad.operators.sky import nearest
from skyquad.sources.store import numbered


def flux_of(mag: Column) -> Column:
    """10 ** (-mag / 2.5), a magnitude of exactly 0 as 5; an unknown one has flux 1."""
    return F.when(mag.isNull(), F.lit(1.0)).otherwise(F.pow(F.lit(10.0), F.when(mag == 0, F.lit(5.0)).otherwise(mag) / -2.5))


def field(stars: DataFrame, camera: Camera, most: float | None = None, dropout: float = 0.0, noise_px: float = 0.0, false_sources: int = 0, seed: int = 0) -> DataFrame:
    """Sources (frame_id, source_idx, x_px, y_px, flux, id) of what a camera sees, brightest first; id is null for false sources."""
    spark = stars.sparkSession
    seen = visible(stars, camera.ra, camera.dec, camera.fov_x_deg, camera.fov_y_deg, most)
    if dropout:
        seen = seen.filter(F.rand(seed) >= dropout)
    x, y = camera.pixel("ra_deg", "dec_deg")
    jitter = lambda k: F.randn(seed + k) * noise_px if noise_px else F.lit(0.0)
    out = seen.withColumns({"x_px": x, "y_px": y}).filter("x_px is not null and y_px is not null")
    out = out.select("id", (F.col("x_px") + jitter(1)).alias("x_px"), (F.col("y_px") + jitter(2)).alias("y_px"), flux_of(F.col("mag")).alias("flux"))
    if false_sources:
        made = spark.range(false_sources).select(F.lit(None).cast("long").alias("id"), (F.rand(seed + 3) * camera.width).alias("x_px"), (F.rand(seed + 4) * camera.height).alias("y_px"), (F.rand(seed + 5) * 0.4 + 0.1).alias("flux"))
        out = out.unionByName(made)
    order = Window.partitionBy("frame_id").orderBy(F.coalesce("flux", F.lit(0.0)).desc(), "id", "x_px", "y_px")
    return out.withColumn("frame_id", F.lit(0).cast("long")).withColumn("source_idx", (F.row_number().over(order) - 1).cast("int")).select("frame_id", "source_idx", "x_px", "y_px", "flux", "id")


def solver_stars(stars: DataFrame) -> DataFrame:
    """A catalog as the stars of a solver database: single precision, numbered from 0 by magnitude and id."""
    v = unit_vector("ra_deg", "dec_deg")
    f = lambda c: c.cast("float")
    ranked = numbered(stars, "_number", F.coalesce("mag", F.lit(99.0)), "id")
    return ranked.select(F.col("_number").cast("int").alias("star_index"), F.col("id").alias("catalog_id"), f(F.radians("ra_deg")).alias("ra_rad"), f(F.radians("dec_deg")).alias("dec_rad"), f(v.x).alias("x_unit"), f(v.y).alias("y_unit"), f(v.z).alias("z_unit"), f(F.col("mag")).alias("mag"))


def nearest_patterns(stars: DataFrame, near: int = 5) -> DataFrame:
    """(pattern_index, s0..s3): each star with every three of its near nearest ones, each set of four once, numbered in order."""
    i = F.sequence(F.lit(0), F.lit(near - 1))
    lists = nearest(stars.select(F.col("star_index").alias("key"), *[F.col(f"{k}_unit").alias(k) for k in "xyz"]), near)
    threes = lists.withColumn("a", F.explode(i)).withColumn("b", F.explode(i)).withColumn("c", F.explode(i)).filter("a < b and b < c and c < size(n)")
    s = F.array_sort(F.array("key", F.get("n", "a"), F.get("n", "b"), F.get("n", "c")))
    sets = threes.select(s.alias("s")).select(*[F.col("s")[k].alias(f"s{k}") for k in range(4)]).distinct()
    return numbered(sets, "pattern_index", "s0", "s1", "s2", "s3").select("pattern_index", "s0", "s1", "s2", "s3")


def drop_zero_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.filter("s0 <> 0 or s1 <> 0 or s2 <> 0 or s3 <> 0")
