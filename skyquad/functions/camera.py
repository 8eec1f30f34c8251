"""The gnomonic projection in angles and a pinhole camera, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyquad.functions.vectors import num


def gnomonic(ra0, dec0, ra, dec) -> tuple[Column, Column]:
    """Plane coordinates in radians, x to the east and y to the north; null for a star on or behind the plane."""
    a0, d0, a, d = (F.radians(num(v)) for v in (ra0, dec0, ra, dec))
    cos = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a - a0)
    over = lambda v: F.when(cos > 0, F.try_divide(v, cos))
    return over(F.cos(d) * F.sin(a - a0)), over(F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a - a0))


def from_gnomonic(ra0, dec0, x, y) -> tuple[Column, Column]:
    """Right ascension in [0, 360) and declination of plane coordinates; the centre's own within 1e-15 of it."""
    a0, d0, x, y = F.radians(num(ra0)), F.radians(num(dec0)), num(x), num(y)
    rho = F.sqrt(x * x + y * y)
    c = F.atan(rho)
    near = rho < 1e-15
    dec = F.asin(F.cos(c) * F.sin(d0) + F.try_divide(y * F.sin(c) * F.cos(d0), rho))
    ra = a0 + F.atan2(x * F.sin(c), rho * F.cos(d0) * F.cos(c) - y * F.sin(d0) * F.sin(c))
    return F.when(near, F.pmod(num(ra0), F.lit(360.0))).otherwise(F.pmod(F.degrees(ra), F.lit(360.0))), F.when(near, num(dec0)).otherwise(F.degrees(dec))


@dataclass(frozen=True)
class Camera:
    """A camera at (ra, dec) whose field of view is linear in the tangent plane; roll turns the field."""

    ra: float
    dec: float
    fov_x_deg: float
    fov_y_deg: float
    width: int
    height: int
    roll_deg: float = 0.0

    @property
    def scale_x(self) -> Column:
        """Radians a pixel."""
        return F.radians(F.lit(float(self.fov_x_deg))) / F.lit(float(self.width))

    @property
    def scale_y(self) -> Column:
        return F.radians(F.lit(float(self.fov_y_deg))) / F.lit(float(self.height))

    def pixel(self, ra, dec, inside: bool = True) -> tuple[Column, Column]:
        """Where a star falls, y downwards; null behind the plane, and with inside also outside of the closed frame."""
        x, y = gnomonic(self.ra, self.dec, ra, dec)
        r = F.radians(F.lit(float(self.roll_deg)))
        u, v = x / self.scale_x, y / self.scale_y
        px = F.lit(self.width / 2) + (u * F.cos(r) - v * F.sin(r))
        py = F.lit(self.height / 2) - (u * F.sin(r) + v * F.cos(r))
        seen = px.between(0, self.width) & py.between(0, self.height) if inside else F.lit(True)
        return F.when(seen, px), F.when(seen, py)

    def sky(self, px, py) -> tuple[Column, Column]:
        r = F.radians(F.lit(float(self.roll_deg)))
        u, v = num(px) - self.width / 2, F.lit(self.height / 2) - num(py)
        return from_gnomonic(self.ra, self.dec, (u * F.cos(r) + v * F.sin(r)) * self.scale_x, (v * F.cos(r) - u * F.sin(r)) * self.scale_y)


def fov_from_lens(focal_mm, sensor_mm) -> Column:
    """Degrees that a sensor's side sees behind a lens."""
    return F.degrees(F.lit(2.0) * F.atan(F.try_divide(num(sensor_mm), F.lit(2.0) * num(focal_mm))))


def arcsec_a_pixel(fov_deg, pixels) -> Column:
    return F.try_divide(num(fov_deg) * 3600, num(pixels))


def pixel_distance(x0, y0, x1, y1) -> Column:
    dx, dy = num(x0) - num(x1), num(y0) - num(y1)
    return F.sqrt(dx * dx + dy * dy)
