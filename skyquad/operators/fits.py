"""Least-squares transforms from pixels to a plane: affine and with a radial term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquad.functions.vectors import Plane, Vec

SINGULAR = 1e-18


def det3(m: list[list[Column]]) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def det4(m: list[list[Column]]) -> Column:
    minor = lambda c: [[v for k, v in enumerate(row) if k != c] for row in m[1:]]
    return m[0][0] * det3(minor(0)) - m[0][1] * det3(minor(1)) + m[0][2] * det3(minor(2)) - m[0][3] * det3(minor(3))


def fit_affine(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by and a, b, tx, c, d, ty for the least squares of (xi, eta) on (px, py): xi = a px + b py + tx, eta = c px + d py + ty.

    Groups of fewer than three pairs, or with a determinant under 1e-18, have
    nulls. Only sums are shuffled.
    """
    one = F.lit(1.0)
    row = {"px": F.col("px"), "py": F.col("py"), "one": one}
    sums = {f"{p}_{q}": F.sum(u * v) for i, (p, u) in enumerate(row.items()) for j, (q, v) in enumerate(row.items()) if i <= j}
    sums |= {f"{p}_{t}": F.sum(u * F.col(t)) for p, u in row.items() for t in ("xi", "eta")}
    s = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in sums.items()])
    get = lambda p, q: F.col(f"{p}_{q}") if f"{p}_{q}" in sums else F.col(f"{q}_{p}")
    m = [[get(p, q) for q in row] for p in row]
    out = s.withColumn("_det", det3(m))
    good = (F.col("n") >= 3) & (F.abs("_det") >= SINGULAR)

    def solved(t: str, k: int) -> Column:
        with_rhs = [[F.col(f"{p}_{t}") if q == k else m[i][q] for q in range(3)] for i, p in enumerate(row)]
        return F.when(good, F.try_divide(det3(with_rhs), F.col("_det")))

    return out.select(*by, "n", *[solved(t, k).alias(name) for t, names in (("xi", ("a", "b", "tx")), ("eta", ("c", "d", "ty"))) for k, name in enumerate(names)])


def fit_radial(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by and cx, cy, a to h: as fit_affine(), with a fourth term r2 = (px - cx)^2 + (py - cy)^2 (d for xi, h for eta).

    pairs has cx and cy, the same within a group. Fewer than four pairs or a
    singular system: nulls. Coordinates are taken from (cx, cy) while solving,
    which keeps the determinants well scaled.
    """
    u, v = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
    row = {"u": u, "v": v, "one": F.lit(1.0), "r": u * u + v * v}
    sums = {f"{p}_{q}": F.sum(x * y) for i, (p, x) in enumerate(row.items()) for j, (q, y) in enumerate(row.items()) if i <= j}
    sums |= {f"{p}_{t}": F.sum(x * F.col(t)) for p, x in row.items() for t in ("xi", "eta")}
    s = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first("cx").alias("cx"), F.first("cy").alias("cy"), *[x.alias(k) for k, x in sums.items()])
    get = lambda p, q: F.col(f"{p}_{q}") if f"{p}_{q}" in sums else F.col(f"{q}_{p}")
    m = [[get(p, q) for q in row] for p in row]
    out = s.withColumn("_det", det4(m))
    good = (F.col("n") >= 4) & (F.abs("_det") >= SINGULAR)

    def solved(t: str, k: int) -> Column:
        with_rhs = [[F.col(f"{p}_{t}") if q == k else m[i][q] for q in range(4)] for i, p in enumerate(row)]
        return F.when(good, F.try_divide(det4(with_rhs), F.col("_det")))

    out = out.select(*by, "n", "cx", "cy", *[solved(t, k).alias(name) for t, names in (("xi", "abcd"), ("eta", "efgh")) for k, name in enumerate(names)])
    # back from (px - cx, py - cy) to (px, py)
    return out.withColumns({"c": F.col("c") - F.col("a") * F.col("cx") - F.col("b") * F.col("cy"), "g": F.col("g") - F.col("e") * F.col("cx") - F.col("f") * F.col("cy")})


def apply_affine(t: dict[str, Column], px: Column, py: Column) -> tuple[Column, Column]:
    return t["a"] * px + t["b"] * py + t["tx"], t["c"] * px + t["d"] * py + t["ty"]


def affine_scale(t: dict[str, Column]) -> Column:
    return F.sqrt(t["a"] * t["a"] + t["c"] * t["c"])


def rotation_deg(t: dict[str, Column]) -> Column:
    return F.degrees(F.atan2(t["c"], t["a"]))


def determinant(t: dict[str, Column]) -> Column:
    return t["a"] * t["d"] - t["b"] * t["c"]


def apply_radial(t: dict[str, Column], px: Column, py: Column) -> tuple[Column, Column]:
    r2 = (px - t["cx"]) * (px - t["cx"]) + (py - t["cy"]) * (py - t["cy"])
    return t["a"] * px + t["b"] * py + t["c"] + t["d"] * r2, t["e"] * px + t["f"] * py + t["g"] + t["h"] * r2


def affine_part(t: dict[str, Column]) -> dict[str, Column]:
    return {"a": t["a"], "b": t["b"], "tx": t["c"], "c": t["e"], "d": t["f"], "ty": t["g"]}


def local_scales(t: dict[str, Column], px: Column, py: Column) -> tuple[Column, Column]:
    """Radians a pixel along either axis at a pixel."""
    ux, uy = (px - t["cx"]) * 2.0, (py - t["cy"]) * 2.0
    norm = lambda p, q: F.sqrt(p * p + q * q)
    return norm(t["a"] + t["d"] * ux, t["e"] + t["h"] * ux), norm(t["b"] + t["d"] * uy, t["f"] + t["h"] * uy)


def field_of_view(t: dict[str, Column], plane: Plane, width: Column, height: Column, mirrored: Column) -> tuple[Column, Column]:
    """Degrees between the middles of opposite edges; null if one of the four is on or behind the plane."""

    def sky(px: Column, py: Column) -> tuple[Vec, Column]:
        v = plane.lift(*apply_radial(t, px, py), mirrored)
        return v, v.dot(plane.centre) > 1e-9

    zero = F.lit(0.0)
    (left, a), (right, b), (top, c), (low, d) = sky(zero, height / 2), sky(width, height / 2), sky(width / 2, zero), sky(width / 2, height)
    return F.when(a & b & c & d, left.separation_deg(right)), F.when(a & b & c & d, top.separation_deg(low))


def centre_of_image(t: dict[str, Column], plane: Plane, width: Column, height: Column, mirrored: Column) -> tuple[Column, Column]:
    v = plane.lift(*apply_radial(t, width / 2, height / 2), mirrored)
    return v.ra_deg(), v.dec_deg()
