"""Numbers as people read them, and what results say, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ra_text(deg: Column) -> Column:
    hours = F.pmod(deg, F.lit(360.0)) / 15
    h = F.floor(hours)
    minutes = (hours - h) * 60
    m = F.floor(minutes)
    return F.format_string("%dh %02dm %04.1fs", h, m, (minutes - m) * 60)


def dec_text(deg: Column) -> Column:
    a = F.abs(deg)
    d = F.floor(a)
    minutes = (a - d) * 60
    m = F.floor(minutes)
    return F.concat(F.when(deg >= 0, "+").otherwise("−"), F.format_string("%02d° %02d′ %04.1f″", d, m, (minutes - m) * 60))


def fov_text(x: Column, y: Column) -> Column:
    return F.when(x.isNull() | y.isNull(), "—").otherwise(F.format_string("%.2f° × %.2f°", x, y))


def rotation_text(deg: Column) -> Column:
    return F.when(deg.isNull(), "—").otherwise(F.format_string("%.2f°", deg))


def bytes_text(n: Column) -> Column:
    """Bytes in the largest unit of which there is at least one."""
    n = n.cast("double")
    text = lambda k, unit: F.format_string(f"%.1f {unit}", n / float(1024**k))
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024**2, text(1, "KB")).when(n < 1024**3, text(2, "MB")).otherwise(text(3, "GB"))


def confidence_label(c: Column) -> Column:
    return F.when(c > 0.75, "high").when(c > 0.5, "medium").otherwise("low")


def brightness(flux: Column, full: float = 50_000.0) -> Column:
    return F.least(F.lit(1.0), flux / full)


def error_px(arcsec: Column) -> Column:
    return arcsec / 3.0


def display_place(x: Column, y: Column, image: tuple[float, float], shown: tuple[float, float]) -> tuple[Column, Column]:
    return x * (shown[0] / image[0]), y * (shown[1] / image[1])


def star_place_deg(ra_rad: Column, dec_rad: Column) -> tuple[Column, Column]:
    """Degrees of single-precision radians, right ascension in [0, 360)."""
    return F.pmod(F.degrees(ra_rad.cast("double")), F.lit(360.0)), F.degrees(dec_rad.cast("double"))


def gaussian(d: Column, sigma: Column) -> Column:
    return F.exp((d / sigma) * (d / sigma) * -0.5)


def steps_log(sources: Column, width: Column, height: Column, stars: Column, patterns: Column) -> Column:
    return F.array(F.format_string("Sources: %d", sources), F.format_string("Image: %dx%d", width, height), F.format_string("Database: %d stars, %d patterns", stars, patterns))


def mapped_result(prob: Column, fov: Column, width: Column, height: Column) -> dict[str, Column]:
    """An outside solver's numbers as a result's: confidence, the other side of the field, arc seconds a pixel."""
    return {"confidence": F.greatest(F.lit(0.0), F.lit(1.0) - prob), "fov_x_deg": fov, "fov_y_deg": fov * height / width, "pixel_scale_arcsec": fov * 3600 / width}
