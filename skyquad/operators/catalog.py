"""Star catalogs: filters, cone searches, statistics and generated catalogs.

A catalog has the columns id, ra_deg, dec_deg, mag (null: unknown).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquad.functions.vectors import Vec, unit_vector

#: Degrees of declination in a zone of the sky index.
ZONE_DEG = 5.0


def with_vectors(stars: DataFrame) -> DataFrame:
    """stars with x, y, z."""
    v = unit_vector("ra_deg", "dec_deg")
    return stars.withColumns({"x": v.x, "y": v.y, "z": v.z})


def sky_index(stars: DataFrame) -> DataFrame:
    """stars with unit vectors and a zone of declination; written with partitionBy("zone"), cone searches read only the zones that they touch."""
    return with_vectors(stars).withColumn("zone", F.floor((F.col("dec_deg") + 90) / F.lit(ZONE_DEG)).cast("int"))


def separation(ra0: float, dec0: float, ra: Column | str = "ra_deg", dec: Column | str = "dec_deg") -> Column:
    return unit_vector(ra, dec).separation_deg(unit_vector(ra0, dec0))


def brighter_than(stars: DataFrame, most: float) -> DataFrame:
    """Stars of a known magnitude of at most most."""
    return stars.filter(F.col("mag") <= F.lit(float(most)))


def least_cosine(radius_deg: float) -> float:
    """The least number whose arc cosine in degrees is at most radius_deg; 2 for a negative radius."""
    if radius_deg < 0:
        return 2.0
    c = math.cos(math.radians(min(radius_deg, 180.0)))
    while math.degrees(math.acos(c)) > radius_deg:
        c = math.nextafter(c, 1.0)
    while c > -1.0 and math.degrees(math.acos(math.nextafter(c, -1.0))) <= radius_deg:
        c = math.nextafter(c, -1.0)
    return c


def cone(stars: DataFrame, ra: float, dec: float, radius_deg: float) -> DataFrame:
    """Stars within radius_deg, the edge included. On a sky index, zones out of reach are pruned first.

    Cosines are compared: at the edge, engines differ in the last digit of an
    arc cosine.
    """
    cos = unit_vector("ra_deg", "dec_deg").dot(unit_vector(ra, dec))
    near = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)) >= F.lit(least_cosine(float(radius_deg)))
    if "zone" in stars.columns:
        lo, hi = (math.floor((dec + s * (radius_deg + 1e-9) + 90) / ZONE_DEG) for s in (-1, 1))
        near = F.col("zone").between(lo, hi) & near
    return stars.filter(near)


def count_in_cone(stars: DataFrame, ra: float, dec: float, radius_deg: float) -> DataFrame:
    return cone(stars, ra, dec, radius_deg).agg(F.count(F.lit(1)).alias("n"))


def coverage(stars: DataFrame, ra: float, dec: float, fov_deg: float) -> DataFrame:
    """One row (coverage): stars within the half diagonal of a square field over the area of its inner circle; 0 for no area."""
    area = math.pi * (fov_deg / 2) ** 2
    found = cone(stars, ra, dec, fov_deg * math.sqrt(2) / 2)
    return found.agg((F.count(F.lit(1)) / F.lit(area) if area > 0 else F.lit(0.0)).alias("coverage"))


def visible(stars: DataFrame, ra: float, dec: float, fov_x_deg: float, fov_y_deg: float, most: float | None = None) -> DataFrame:
    """Stars within 1.2 half diagonals of a field; those of unknown magnitude stay."""
    reach = math.hypot(fov_x_deg, fov_y_deg) / 2 * 1.2
    bright = F.lit(True) if most is None else F.col("mag").isNull() | (F.col("mag") <= F.lit(float(most)))
    return cone(stars.filter(bright), ra, dec, reach)


def stats(stars: DataFrame) -> DataFrame:
    """One row: count, with_mag, mag_min, mag_max, mag_mean, ra_min, ra_max, dec_min, dec_max; all but count are null for an empty catalog."""
    some = F.count(F.lit(1)) > 0
    ends = {f"{p}_{k}": f(c) for c, p in (("ra_deg", "ra"), ("dec_deg", "dec"), ("mag", "mag")) for k, f in (("min", F.min), ("max", F.max))}
    return stars.agg(F.count(F.lit(1)).alias("count"), F.when(some, F.count("mag")).alias("with_mag"), F.avg("mag").alias("mag_mean"), *[v.alias(k) for k, v in ends.items()])


def generated(spark: SparkSession, n: int = 200, seed: int = 42, mean: float = 7.0, sigma: float = 2.0, most: float | None = None) -> DataFrame:
    """Stars spread evenly over the sphere, magnitudes normal and not below 0; with most, fainter ones are left out after drawing, so ids have gaps."""
    ra = F.rand(seed) * 360
    dec = F.degrees(F.asin(F.rand(seed + 1) * 2 - 1))
    out = spark.range(1, n + 1).select("id", ra.alias("ra_deg"), dec.alias("dec_deg"), F.greatest(F.lit(0.0), F.randn(seed + 2) * sigma + mean).alias("mag"))
    return out if most is None else brighter_than(out, most)


def pick_database(databases: DataFrame, fov_x_deg: float, fov_y_deg: float) -> DataFrame:
    """The ready database for a field: of those whose range holds the diagonal the one that begins lowest, else the one whose middle is nearest; none if none is ready.

    databases: id, fov_min_deg, fov_max_deg, ready, position (breaks ties).
    """
    diagonal = F.lit(math.hypot(fov_x_deg, fov_y_deg))
    holds = diagonal.between(F.col("fov_min_deg"), F.col("fov_max_deg"))
    middle = F.abs((F.col("fov_min_deg") + F.col("fov_max_deg")) / 2 - diagonal)
    return databases.filter("ready").orderBy(F.when(holds, 0).otherwise(1), F.when(holds, F.col("fov_min_deg")).otherwise(middle), "position").limit(1)


def pointing_error_arcmin(ra0: Column, dec0: Column, ra1: Column, dec1: Column) -> Column:
    return unit_vector(ra0, dec0).separation_deg(unit_vector(ra1, dec1)) * 60


def star_vector(prefix: str = "") -> Vec:
    """The vector in the columns x_unit, y_unit, z_unit, widened to double before any arithmetic."""
    return Vec(*[F.col(f"{prefix}{k}_unit").cast("double") for k in "xyz"])
