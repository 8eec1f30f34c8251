"""Unit vectors and tangent planes as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A direction whose cosine with a plane's centre is not above this is on or behind the plane.
BEHIND = 1e-9
#: Vectors shorter than this are left as they are by unit().
SHORT = 1e-15


def num(x: Column | float | str) -> Column:
    """x as a double column; a string names a column."""
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))).cast("double")


@dataclass(frozen=True)
class Vec:
    """A vector of three double columns."""

    x: Column
    y: Column
    z: Column

    @staticmethod
    def of(x, y, z) -> Vec:
        return Vec(num(x), num(y), num(z))

    def plus(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def minus(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def times(self, k: Column | float) -> Vec:
        return Vec(self.x * k, self.y * k, self.z * k)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm_sq(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm_sq())

    def unit(self) -> Vec:
        """The vector at length 1; itself where it is too short to have a direction."""
        scale = F.when(self.norm() < SHORT, F.lit(1.0)).otherwise(F.try_divide(F.lit(1.0), self.norm()))
        return self.times(scale)

    def chord(self, o: Vec) -> Column:
        return self.minus(o).norm()

    def separation_deg(self, o: Vec) -> Column:
        """Degrees between two unit vectors; the cosine is held to [-1, 1]."""
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), self.dot(o)))))

    def ra_deg(self) -> Column:
        return F.pmod(F.degrees(F.atan2(self.y, self.x)), F.lit(360.0))

    def dec_deg(self) -> Column:
        return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), self.z))))

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))

    @staticmethod
    def field(c: Column | str) -> Vec:
        c = F.col(c) if isinstance(c, str) else c
        return Vec(c["x"], c["y"], c["z"])


def unit_vector(ra_deg, dec_deg) -> Vec:
    ra, dec = F.radians(num(ra_deg)), F.radians(num(dec_deg))
    return Vec(F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec))


def mean_direction(vs: list[Vec]) -> Vec:
    total = vs[0]
    for v in vs[1:]:
        total = total.plus(v)
    return total.unit()


@dataclass(frozen=True)
class Plane:
    """The tangent plane at a centre, with its two axes."""

    centre: Vec
    e1: Vec
    e2: Vec

    @staticmethod
    def at(centre: Vec) -> Plane:
        """The first axis is the z axis, or near the poles the x axis, laid flat on the plane; the second is centre x first."""
        flat = F.abs(centre.z) < 0.9
        ref = Vec(F.when(flat, 0.0).otherwise(1.0), F.lit(0.0), F.when(flat, 1.0).otherwise(0.0))
        e1 = ref.minus(centre.times(ref.dot(centre))).unit()
        return Plane(centre, e1, centre.cross(e1))

    def project(self, v: Vec, mirrored: Column | bool = False) -> tuple[Column, Column]:
        """Plane coordinates, null on or behind the plane; mirrored turns the second one's sign."""
        cos = v.dot(self.centre)
        ahead = lambda d: F.when(cos > BEHIND, F.try_divide(d, cos))
        return ahead(v.dot(self.e1)), ahead(v.dot(self.e2)) * sign(mirrored)

    def lift(self, xi: Column, eta: Column, mirrored: Column | bool = False) -> Vec:
        return self.centre.plus(self.e1.times(xi)).plus(self.e2.times(eta * sign(mirrored))).unit()


def with_plane(df: DataFrame, centre: Vec, name: str = "_plane") -> tuple[DataFrame, Plane]:
    """df with the plane at centre in three columns, and the plane that reads them: expressions on it stay short."""
    df = df.withColumn(f"{name}_c", centre.struct())
    df = df.withColumn(f"{name}_e1", Plane.at(Vec.field(f"{name}_c")).e1.struct())
    c, e1 = Vec.field(f"{name}_c"), Vec.field(f"{name}_e1")
    df = df.withColumn(f"{name}_e2", c.cross(e1).struct())
    return df, Plane(c, e1, Vec.field(f"{name}_e2"))


def sign(mirrored: Column | bool) -> Column:
    return F.when(mirrored, -1.0).otherwise(1.0) if isinstance(mirrored, Column) else F.lit(-1.0 if mirrored else 1.0)
