"""Cells of the sky as Column expressions: bands of declination in equal steps of right ascension, nested from level to level.

A band of level L is 180 / 2 ** L degrees high. Its number of steps is the
largest power of two that leaves each step at least about as wide on the sky as
the band is high, so that cells of all bands have about one area, every cell of
a level lies in one cell of the level before, and a circle of a band's height
meets a handful of cells.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquad.functions.vectors import num

#: The finest level; its cells are 0.6 arc seconds high and their numbers stay below 2 ** 63.
FINEST = 20
#: Added to a radius in degrees, so that rounding never hides a cell that a circle touches.
MARGIN = 1e-7


def height_deg(level: int) -> float:
    return 180.0 / (1 << level)


def level_for(radius_deg: float, finest: int = FINEST) -> int:
    """The finest level whose bands are at least as high as radius_deg."""
    return max(0, min(finest, math.floor(math.log2(180.0 / max(radius_deg, 180.0 / (1 << finest))))))


def _table(level: int) -> list[int]:
    """Steps of right ascension in each band of a level up to 10."""
    high = height_deg(level)
    edges = [max(abs(b * high - 90.0), abs((b + 1) * high - 90.0)) for b in range(1 << level)]
    return [1 << math.floor(math.log2(max(1.0, math.cos(math.radians(e)) * (2 << level)))) for e in edges]


def _steps(level: int, band: Column) -> Column:
    """Steps of right ascension in a band; up to level 10 from a table, so that no arithmetic is repeated wherever a cell is asked for."""
    high = height_deg(level)
    if level <= 10:
        return F.get(F.array(*[F.lit(n) for n in _table(level)]), band.cast("int")).cast("long")
    edge = F.greatest(F.abs(band * F.lit(high) - 90.0), F.abs((band + 1) * F.lit(high) - 90.0))
    return F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1.0), F.cos(F.radians(edge)) * float(2 << level))))).cast("long")


def _band(level: int, dec_deg: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit((1 << level) - 1), F.floor((dec_deg + 90.0) / height_deg(level)))).cast("long")


def cell(level: int, ra_deg, dec_deg) -> Column:
    """The number of the cell of level that a place is in; null for an unknown place."""
    band = _band(level, num(dec_deg))
    steps = _steps(level, band)
    step = F.least(steps - 1, F.floor(F.pmod(num(ra_deg), F.lit(360.0)) / 360.0 * steps))
    return F.when(num(ra_deg).isNotNull() & num(dec_deg).isNotNull(), (band * (2 << level) + step).cast("long"))


def cells_of(level: int, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """cell() of unit vectors in arrays, for a level up to 10."""
    ra, dec = np.degrees(np.arctan2(y, x)) % 360.0, np.degrees(np.arcsin(np.clip(z, -1.0, 1.0)))
    band = np.clip(np.floor((dec + 90.0) / height_deg(level)), 0, (1 << level) - 1).astype(np.int64)
    steps = np.array(_table(level), dtype=np.int64)[band]
    return band * (2 << level) + np.minimum(steps - 1, np.floor(ra / 360.0 * steps).astype(np.int64))


def with_cell(df: DataFrame, level: int, ra_deg: Column, dec_deg: Column, name: str = "cell") -> DataFrame:
    """df with cell(), in steps and behind an explode() of one element: a join on it would else infer a test of the whole expression and push that down, spelt out, below all steps."""
    df = df.withColumn("_band", _band(level, dec_deg)).withColumn("_steps", _steps(level, F.col("_band")))
    step = F.least(F.col("_steps") - 1, F.floor(F.pmod(ra_deg, F.lit(360.0)) / 360.0 * F.col("_steps")))
    return df.withColumn(name, F.explode(F.array((F.col("_band") * (2 << level) + step).cast("long")))).drop("_band", "_steps")


def cover(level: int, ra_deg, dec_deg, radius_deg) -> Column:
    """An array of the cells of level that a circle on the sky may touch: all that it does touch, each once; null for an unknown circle."""
    ra, dec, radius = F.pmod(num(ra_deg), F.lit(360.0)), num(dec_deg), num(radius_deg) + MARGIN
    over_pole = F.abs(dec) + radius >= 90.0
    reach = F.when(over_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.try_divide(F.sin(F.radians(radius)), F.cos(F.radians(dec)))))) + MARGIN)
    bands = F.sequence(_band(level, dec - radius), _band(level, dec + radius))

    def in_band(band: Column) -> Column:
        steps = _steps(level, band)
        first, last = F.floor((ra - reach) / 360.0 * steps), F.floor((ra + reach) / 360.0 * steps)
        all_ = (last - first + 1 >= steps) | over_pole
        return F.transform(F.sequence(F.when(all_, F.lit(0).cast("long")).otherwise(first), F.when(all_, steps - 1).otherwise(last)), lambda k: band * (2 << level) + F.pmod(k, steps))

    return F.when(ra.isNotNull() & dec.isNotNull() & radius.isNotNull(), F.flatten(F.transform(bands, in_band)))
