"""Verification of correspondences as joins and grouped sums: a first fit, then matching and fitting in narrowing radii.

A correspondence is a row (frame_id, rank, variant) with a transform from pixels
to a tangent plane. In each pass a row and a frame's sources give predicted
places in the sky; each looks up the stars of its cell, its nearest star
proposes, a star keeps its nearest proposer, and sums of the pairs that are left
give the next transform. Rows with fewer than four pairs drop out: no later,
narrower pass can give them more.

Beyond some stars, rows meet the stars of the zones that their places lie in,
and each place's nearest star is looked for in circles of about one star.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquad.functions import cells
from skyquad.functions.vectors import BEHIND, Vec
from skyquad.operators import sky
from skyquad.operators.fits import SINGULAR, det3, det4
from skyquad.operators.watch import Watch
from skyquad.sources.store import forget, written

#: Fixed values of the solver: least matches, radii of the passes and of the last match (arc seconds), largest residual of the first fit (radians), where passes stop.
MIN_MATCHED, RADII, MATCH_RADIUS, LOOSE, STILL = 6, (900.0, 400.0, 200.0, 100.0, 60.0), 60.0, 0.01, 1e-12
LEAST_PAIRS = 4
#: Determinant, of a system whose columns have length 1, at which a fit counts as singular.
FLAT = 1e-22
#: The level of the cells that stars are looked up by: twice the widest radius high and more.
LEVEL = 8
#: Sources of all frames, and stars with their copies in neighbouring cells, that may be broadcast.
FEW_SOURCES, FEW_STARS = 200_000, 1_000_000
#: Stars of a zone, about; rows and sources of a frame that meet a zone's stars in a group; places and stars, and pairs of them, that arrays hold at once.
A_ZONE, A_DEAL, A_CHUNK, A_BLOCK, A_LOOK = 6_000, 256, 100_000, 1 << 19, 1 << 20
KEY = ("frame_id", "rank", "variant")
TERMS = tuple("abcdefgh")
_RAD = math.pi / 180 / 3600
_PLANE = tuple(f"{w}{k}" for w in "opq" for k in "xyz")
_STATE = ("turn", "cx", "cy", *_PLANE, *TERMS, "frozen", "step")


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """df's rows that fulfil a condition on computed columns. A plain filter would be pushed down through all steps, and spell them out again and again."""
    return df.withColumn("_kept", F.explode(F.when(condition, F.array(F.lit(1))))).drop("_kept")


def _affine(df: DataFrame, xs: list[Column], ys: list[Column], name: str) -> DataFrame:
    """df with the least-squares terms {name}a, b, c and e, f, g of four targets on (u0..u3, v0..v3), null where the system is singular."""
    u, v = ([F.col(f"{k}{i}") for i in range(4)] for k in "uv")
    total = lambda cs: cs[0] + cs[1] + cs[2] + cs[3]
    times = lambda a, b: total([p * q for p, q in zip(a, b, strict=True)])
    df = df.withColumns({f"_t{i}{t}": c for t, cs in (("x", xs), ("y", ys)) for i, c in enumerate(cs)})
    xs, ys = ([F.col(f"_t{i}{t}") for i in range(4)] for t in "xy")
    df = df.withColumns({"_uu": times(u, u), "_uv": times(u, v), "_vv": times(v, v), "_u": total(u), "_v": total(v)} | {f"_{k}{t}": times(w, ts) for k, w in (("u", u), ("v", v)) for t, ts in (("x", xs), ("y", ys))} | {"_x": total(xs), "_y": total(ys)})
    c = F.col
    m = [[c("_uu"), c("_uv"), c("_u")], [c("_uv"), c("_vv"), c("_v")], [c("_u"), c("_v"), F.lit(4.0)]]
    df = df.withColumn("_det", det3(m))

    def solved(t: str, k: int) -> Column:
        right = [c(f"_u{t}"), c(f"_v{t}"), c(f"_{t}")]
        return F.when(F.abs(c("_det")) >= SINGULAR, F.try_divide(det3([[right[i] if q == k else m[i][q] for q in range(3)] for i in range(3)]), c("_det")))

    out = df.withColumns({f"{name}{t}": solved(axis, k) for axis, ts in (("x", "abc"), ("y", "efg")) for k, t in enumerate(ts)})
    worst = F.greatest(*[F.hypot(c(f"{name}a") * c(f"u{i}") + c(f"{name}b") * c(f"v{i}") + c(f"{name}c") - c(f"_t{i}x"), c(f"{name}e") * c(f"u{i}") + c(f"{name}f") * c(f"v{i}") + c(f"{name}g") - c(f"_t{i}y")) for i in range(4)])
    return out.withColumn(f"{name}worst", worst).drop("_det", "_uu", "_uv", "_vv", "_u", "_v", "_ux", "_uy", "_vx", "_vy", "_x", "_y", *[f"_t{i}{t}" for i in range(4) for t in "xy"])


def _dot(a: str, b: str) -> Column:
    return F.col(f"{a}x") * F.col(f"{b}x") + F.col(f"{a}y") * F.col(f"{b}y") + F.col(f"{a}z") * F.col(f"{b}z")


def _to_unit(df: DataFrame, name: str) -> DataFrame:
    """df with the vector {name}x, y, z at length 1. Steps are plain columns, of which each is computed once."""
    df = df.withColumn("_length", F.sqrt(_dot(name, name)))
    return df.withColumns({f"{name}{k}": F.try_divide(F.col(f"{name}{k}"), F.col("_length")) for k in "xyz"}).drop("_length")


def _with_plane(df: DataFrame) -> DataFrame:
    """df with the axes p and q of the tangent plane at the unit vector o."""
    flat = F.abs("oz") < 0.9
    along = F.when(flat, F.col("oz")).otherwise(F.col("ox"))  # of the z axis, or near the poles of the x axis
    df = df.withColumn("_along", along)
    df = _to_unit(df.withColumns({k: c - F.col(f"o{k[1]}") * F.col("_along") for k, c in (("px", F.when(flat, 0.0).otherwise(1.0)), ("py", F.lit(0.0)), ("pz", F.when(flat, 1.0).otherwise(0.0)))}), "p")
    o, p = (Vec(*[F.col(f"{w}{k}") for k in "xyz"]) for w in "op")
    q = o.cross(p)
    return df.withColumns({"qx": q.x, "qy": q.y, "qz": q.z}).drop("_along")


def _lift(df: DataFrame, xi: Column, eta: Column, name: str) -> DataFrame:
    """df with the unit vector {name}x, y, z of a place in the plane."""
    df = df.withColumns({"_xi": xi, "_eta": eta * F.col("turn")})
    return _to_unit(df.withColumns({f"{name}{k}": F.col(f"o{k}") + F.col(f"p{k}") * F.col("_xi") + F.col(f"q{k}") * F.col("_eta") for k in "xyz"}), name).drop("_xi", "_eta")


def _project(df: DataFrame, vectors: list[str], names: list[tuple[str, str]]) -> DataFrame:
    """df with the plane coordinates of unit vectors, null on or behind the plane."""
    df = df.withColumns({f"_cos{i}": _dot(v, "o") for i, v in enumerate(vectors)})
    ahead = lambda i, c: F.when(F.col(f"_cos{i}") > BEHIND, F.try_divide(c, F.col(f"_cos{i}")))
    out = df.withColumns({n: c for i, (v, (xi, eta)) in enumerate(zip(vectors, names, strict=True)) for n, c in ((xi, ahead(i, _dot(v, "p"))), (eta, ahead(i, _dot(v, "q")) * F.col("turn")))})
    return out.drop(*[f"_cos{i}" for i in range(len(vectors))])


def correspondences(candidates: DataFrame) -> DataFrame:
    """KEY and the state of each correspondence of candidates (frame_id, rank, image, vectors, cx, cy) whose first fit holds.

    Each candidate has eight: the ends of the baseline and the inner stars may
    each be swapped, and the sky may be mirrored. The four pairs are fitted on
    the plane at the stars' mean direction; where no residual is above LOOSE,
    the plane moves to where the fit puts the middle (cx, cy) of the frame's
    sources, and the four are fitted again. Terms are those of (px - cx, py - cy);
    turn is -1 for a mirrored sky.
    """
    df = candidates.select("frame_id", "rank", "cx", "cy", "image", "vectors", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("variant"))
    bit = lambda k: F.col("variant").bitwiseAND(k) > 0
    pick = lambda i, j, k: F.when(bit(k), F.get("vectors", F.lit(j))).otherwise(F.get("vectors", F.lit(i)))
    df = df.withColumns({"turn": F.when(bit(1), -1.0).otherwise(1.0)} | {f"_s{i}": pick(*how) for i, how in enumerate(((0, 1, 4), (1, 0, 4), (2, 3, 2), (3, 2, 2)))})
    df = df.withColumns({f"{w}{i}": F.get("image", F.lit(i))[k].cast("double") - F.col(c) for i in range(4) for w, k, c in (("u", "x", "cx"), ("v", "y", "cy"))} | {f"s{i}{k}": F.col(f"_s{i}")[k].cast("double") for i in range(4) for k in "xyz"}).drop("image", "vectors", *[f"_s{i}" for i in range(4)])
    vectors, flat = [f"s{i}" for i in range(4)], [(f"x{i}", f"y{i}") for i in range(4)]
    xs, ys = ([F.col(n[k]) for n in flat] for k in (0, 1))
    df = _to_unit(df.withColumns({f"o{k}": F.col(f"s0{k}") + F.col(f"s1{k}") + F.col(f"s2{k}") + F.col(f"s3{k}") for k in "xyz"}), "o")
    df = _project(_with_plane(df), vectors, flat)
    df = kept(_affine(df, xs, ys, "_1"), F.col("_1worst") <= LOOSE)
    df = _lift(df, F.col("_1c"), F.col("_1g"), "o").drop(*[n for pair in flat for n in pair], *[f"_1{t}" for t in "abcefg"], "_1worst")
    df = _project(_with_plane(df), vectors, flat)
    df = kept(_affine(df, xs, ys, "_2"), F.col("_2worst").isNotNull())
    return df.select(*KEY, "turn", "cx", "cy", *_PLANE, *[(F.lit(0.0) if t in "dh" else F.col(f"_2{t}")).alias(t) for t in TERMS], F.lit(False).alias("frozen"), F.lit(0).alias("step"))


def lookup(stars: DataFrame) -> DataFrame:
    """(cell, near): for each cell the stars that may be within the widest radius of a place in it."""
    v = {k: F.col(f"{k}_unit").cast("double") for k in "xyz"}
    return sky.around(stars.select(F.col("star_index").alias("key"), *[c.alias(k) for k, c in v.items()]), max(RADII) / 3600, LEVEL)


def pairs(state: DataFrame, sources: DataFrame, table: DataFrame) -> DataFrame:
    """(KEY, star, m): the one-to-one matches of each row of state; m: (d2, source_idx, u, v, r, xi, eta) of the nearest source that proposes.

    The radius is looked up by the state's step, so that all passes are one plan and share its generated code.
    """
    radii = F.array(*[F.lit((r * _RAD) ** 2) for r in (*RADII, MATCH_RADIUS)])
    met = state.withColumn("most", F.get(radii, F.col("step"))).join(sources, "frame_id")
    met = met.withColumns({"u": F.col("x_px") - F.col("cx"), "v": F.col("y_px") - F.col("cy")}).drop("x_px", "y_px")
    met = met.withColumn("r", F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    met = met.withColumns({n: F.col(t[0]) * F.col("u") + F.col(t[1]) * F.col("v") + F.col(t[2]) + F.col(t[3]) * F.col("r") for n, t in (("x", "abcd"), ("y", "efgh"))})
    met = _lift(met, F.col("x"), F.col("y"), "t")
    met = met.withColumns({"_ra": F.degrees(F.atan2("ty", "tx")), "_dec": F.degrees(F.asin("tz"))})
    met = cells.with_cell(met, LEVEL, F.col("_ra"), F.col("_dec")).drop("_ra", "_dec", "tx", "ty", "tz")
    met = met.join(table, "cell").withColumn("s", F.explode("near")).drop("near", "cell")
    met = met.withColumns({"star": F.col("s.key")} | {f"s{k}": F.col(f"s.{k}") for k in "xyz"}).drop("s")
    met = _project(met, ["s"], [("xi", "eta")]).drop("sx", "sy", "sz")
    dx, dy = F.col("xi") - F.col("x"), F.col("eta") - F.col("y")
    met = kept(met.withColumn("d2", dx * dx + dy * dy), F.col("d2") < F.col("most"))
    near = F.struct("d2", "star", "u", "v", "r", "xi", "eta").alias("n")
    nearest = met.select(*KEY, "source_idx", near).groupBy(*KEY, "source_idx").agg(F.min("n").alias("n"))
    one = F.struct("n.d2", "source_idx", *[F.col(f"n.{c}") for c in ("u", "v", "r", "xi", "eta")]).alias("m")
    return nearest.select(*KEY, F.col("n.star").alias("star"), one).groupBy(*KEY, "star").agg(F.min("m").alias("m"))


def zoned(stars: DataFrame, level: int) -> DataFrame:
    """(zone, id, x, y, z): for each zone, a cell of level, the stars that may be within the widest radius of a place in it."""
    v = stars.select(F.col("star_index").cast("long").alias("id"), *[F.col(f"{k}_unit").cast("double").alias(k) for k in "xyz"])
    at = Vec.of("x", "y", "z")
    return v.select(F.explode(cells.cover(level, at.ra_deg(), at.dec_deg(), F.lit(max(RADII) / 3600))).alias("zone"), "id", "x", "y", "z")


def zone_level(n: int) -> int:
    """The level of zones for n stars: those of A_ZONE stars where stars are spread evenly, higher than twice the widest radius."""
    return max(3, min(LEVEL, round(math.log(max(n, 1) / A_ZONE, 4))))


def nearest_of(x: np.ndarray, y: np.ndarray, of: np.ndarray, sx: np.ndarray, sy: np.ndarray, star_of: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places (x, y) of the rows of the first of the nearest stars (sx, sy) of the same row, whose radius it must be within, and its squared distance; -1 where there is none.

    star_of is in order. A row's stars fall into squares of about one star, in
    which places look up to one square away; those that find nothing so near go
    on with twice the size.
    """
    at, least = np.full(len(x), -1), np.full(len(x), np.inf)
    if not len(sx):
        return at, least
    counts = np.bincount(star_of, minlength=len(radius))
    starts, some = np.flatnonzero(np.diff(star_of, prepend=-1)), counts > 0
    corner, span = np.zeros((2, len(radius))), np.zeros((2, len(radius)))
    for k, v in enumerate((sx, sy)):
        corner[k, some] = np.minimum.reduceat(v, starts)
        span[k, some] = np.maximum.reduceat(v, starts) - corner[k, some]
    reach = np.minimum(radius, np.maximum(np.sqrt(span[0] * span[1] / np.maximum(counts, 1)), radius / 4096))
    todo = np.flatnonzero(some[of])
    while len(todo):
        size = reach * (1 + 1e-9)
        # the squares of the edge hold all beyond: it only adds pairs to look at
        square = lambda v, k, row: np.clip(np.floor((v - corner[k, row]) / size[row]), -2, 1 << 18).astype(np.int64)  # noqa: E731, B023
        col, line = square(sx, 0, star_of), square(sy, 1, star_of)
        wide, high = int(col.max()) + 3, int(line.max()) + 3
        key = (star_of * high + line + 1) * wide + col + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        pc, pl = square(x[todo], 0, of[todo]), square(y[todo], 1, of[todo])
        inside = (pc >= -1) & (pc <= wide - 2) & (pl >= -1) & (pl <= high - 2)
        look, middle = todo[inside], ((of[todo] * high + pl + 1) * wide + pc + 1)[inside]
        for d in (-wide, 0, wide):
            first, last = np.searchsorted(key, middle + (d - 1)), np.searchsorted(key, middle + (d + 1), "right")
            n = last - first
            hit = np.flatnonzero(n)
            while len(hit):
                until = np.cumsum(n[hit])
                now = max(1, int(np.searchsorted(until, A_LOOK)))
                ends, p, m, begin = until[:now], look[hit[:now]], n[hit[:now]], first[hit[:now]]
                hit, starts = hit[now:], ends - m
                star = order[np.repeat(begin - starts, m) + np.arange(ends[-1])]
                dx, dy = sx[star] - np.repeat(x[p], m), sy[star] - np.repeat(y[p], m)
                d2 = dx * dx + dy * dy
                low = np.minimum.reduceat(d2, starts)
                one = np.minimum.reduceat(np.where(d2 == np.repeat(low, m), star, len(sx)), starts)
                better = (low < least[p]) | ((low == least[p]) & (one < at[p]))
                least[p[better]], at[p[better]] = low[better], one[better]
        row = of[todo]
        todo, reach = todo[~(least[todo] < reach[row] * reach[row]) & (reach[row] < radius[row])], np.minimum(radius, reach * 2)
    at[~(least < radius[of] * radius[of])] = -1
    return at, least


def one_to_one(t: dict[str, np.ndarray], sources: tuple[np.ndarray, np.ndarray], stars: list[np.ndarray], level: int, zone: int) -> tuple[np.ndarray, ...]:
    """The pairs of rows t, sources (px, py) whose places lie in a zone and stars (x, y, z): row, source, star, d2, u, v, r, xi, eta.

    A place proposes to its nearest star, which keeps the row's nearest place,
    the first of equally near ones. Where the zone is a row's only one,
    directions of its places are not looked at.
    """
    c = {k: v[:, None] for k, v in t.items()}
    u, v = sources[0] - c["cx"], sources[1] - c["cy"]
    r = u * u + v * v
    x, y = c["a"] * u + c["b"] * v + c["c"] + c["d"] * r, c["e"] * u + c["f"] * v + c["g"] + c["h"] * r
    here = np.isfinite(x) & np.isfinite(y)
    more = np.flatnonzero(~t["alone"])
    if len(more):
        way = [c[f"o{k}"][more] + c[f"p{k}"][more] * x[more] + c[f"q{k}"][more] * (y[more] * c["turn"][more]) for k in "xyz"]
        length = np.sqrt(way[0] * way[0] + way[1] * way[1] + way[2] * way[2])
        here[more] &= cells.cells_of(level, *[w / length for w in way]) == zone
    on = lambda w: stars[0] * c[f"{w}x"] + stars[1] * c[f"{w}y"] + stars[2] * c[f"{w}z"]
    cos, wide = on("o"), c["most"] * 1.001
    with np.errstate(divide="ignore", invalid="ignore"):
        xi, eta = on("p") / cos, on("q") / cos * c["turn"]
    near = cos > BEHIND
    for place, star in ((x, xi), (y, eta)):
        near &= (star >= place.min(axis=1, initial=np.inf, where=here, keepdims=True) - wide) & (star <= place.max(axis=1, initial=-np.inf, where=here, keepdims=True) + wide)
    (of, source), (star_of, number), xi, eta = np.nonzero(here), np.nonzero(near), xi[near], eta[near]
    star, d2 = nearest_of(x[here], y[here], of, xi, eta, star_of, t["most"])
    at = np.flatnonzero(star >= 0)
    at = at[np.lexsort((at, d2[at], star[at]))]
    at = at[np.diff(star[at], prepend=-1) > 0]
    of, source, star = of[at], source[at], star[at]
    return of, source, number[star], d2[at], u[of, source], v[of, source], r[of, source], xi[star], eta[star]


def zone_pairs(state: DataFrame, sources: DataFrame, zones: DataFrame, level: int, parts: int) -> DataFrame:
    """pairs() of many stars, zones being their zoned() table.

    A row meets the zones that its places may lie in, whose number is bounded
    by its terms and the frame's size, and each place counts in the zone of its
    own direction. Rows of a frame and zone are dealt to groups of A_DEAL, a
    frame's sources of more than A_CHUNK to chunks; only rows, sources and
    stars are shuffled, of places those that a star of the group keeps.
    """
    radius = F.get(F.array(*[F.lit(r * _RAD) for r in (*RADII, MATCH_RADIUS)]), F.col("step"))
    sizes = sources.groupBy("frame_id").agg(F.ceil(F.count(F.lit(1)) / A_CHUNK).alias("chunks"), *[f(c).alias(f"_{k}{c}") for c in ("x_px", "y_px") for k, f in (("low", F.min), ("high", F.max))])
    at = state.withColumn("most", radius).join(sizes, "frame_id")
    at = at.withColumns({w: F.greatest(F.abs(F.col(f"_low{p}") - F.col(c)), F.abs(F.col(f"_high{p}") - F.col(c))) for w, p, c in (("_u", "x_px", "cx"), ("_v", "y_px", "cy"))})
    at = at.withColumn("_r", F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v"))
    most = lambda p, q, s: F.abs(p) * F.col("_u") + F.abs(q) * F.col("_v") + F.abs(s) * F.col("_r")
    # an angle's chord is at most the distance in the plane
    at = at.withColumn("_far", F.hypot(most("a", "b", "d"), most("e", "f", "h")) * (1 + 1e-9))
    at = _lift(at, F.col("c"), F.col("g"), "t").withColumns({"_ra": F.degrees(F.atan2("ty", "tx")), "_dec": F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("tz"))))), "_far": F.degrees(2 * F.asin(F.least(F.lit(1.0), F.col("_far") / 2)))})
    at = at.withColumn("_zones", cells.cover(level, "_ra", "_dec", "_far")).withColumn("alone", F.size("_zones") == 1).withColumn("zone", F.explode("_zones"))
    deal = F.floor((F.row_number().over(Window.partitionBy("frame_id", "zone").orderBy("rank", "variant")) - 1) / A_DEAL).cast("int")
    by = ["frame_id", "zone", "deal", "chunk"]
    held = at.withColumn("deal", deal).withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))))
    held = written(held.select(*by, "rank", "variant", "alone", "most", "turn", "cx", "cy", *_PLANE, *TERMS), "verify_rows")
    heads = held.select(*[F.col(c).alias(c) for c in by]).distinct()
    places = sources.join(sizes.select("frame_id", "chunks"), "frame_id").select("frame_id", F.pmod(F.hash("source_idx"), F.col("chunks").cast("int")).alias("chunk"), F.col("source_idx").cast("long").alias("id"), F.col("x_px").alias("x"), F.col("y_px").alias("y"), F.lit(None).cast("double").alias("z"))
    right = heads.join(zones, "zone").select(*by, "id", "x", "y", "z").unionByName(heads.join(places, ["frame_id", "chunk"]).select(*by, "id", "x", "y", "z"))
    names = ("d2", "u", "v", "r", "xi", "eta")

    def matched(key: tuple[pa.Scalar, ...], rows: pa.Table, near: pa.Table) -> pa.Table:
        ids, x, y, z = (near[c].to_numpy() for c in ("id", "x", "y", "z"))
        of, star = ((k := np.flatnonzero(np.isnan(z) == is_source))[np.argsort(ids[k], kind="stable")] for is_source in (True, False))
        t = {c: rows[c].to_numpy() for c in rows.column_names if c not in KEY}
        step = max(1, A_BLOCK // max(1, len(ids)))
        found = [one_to_one({c: v[i : i + step] for c, v in t.items()}, (x[of], y[of]), [c[star] for c in (x, y, z)], level, key[1].as_py()) for i in range(0, rows.num_rows, step)]
        row, source, number, *rest = (np.concatenate(c) for c in zip(*found, strict=True))
        row += np.repeat(np.arange(len(found)) * step, [len(f[0]) for f in found])
        which = rows.select(list(KEY)).take(pa.array(row))
        return pa.table({c: which[c] for c in KEY} | {"star": ids[star][number], "source_idx": ids[of][source]} | dict(zip(names, rest, strict=True)))

    kinds = dict(state.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in KEY] + ["star long", "source_idx long"] + [f"{c} double" for c in names])
    met = held.repartition(parts, *by).groupBy(*by).cogroup(right.repartition(parts, *by).groupBy(*by)).applyInArrow(matched, schema)
    one = F.struct("d2", F.col("source_idx").cast(dict(sources.dtypes)["source_idx"]).alias("source_idx"), *names[1:]).alias("m")
    return met.select(*KEY, F.col("star").cast("int").alias("star"), one).groupBy(*KEY, "star").agg(F.min("m").alias("m"))


def refitted(state: DataFrame, matched: DataFrame) -> DataFrame:
    """The next state of rows with enough pairs: radial terms by least squares, unless the row is frozen, the system singular, or the terms stay still."""
    row = {"u": F.col("m.u"), "v": F.col("m.v"), "one": F.lit(1.0), "r": F.col("m.r")}
    names = list(row)
    sums = {f"_{p}_{q}": F.sum(row[p] * row[q]) for i, p in enumerate(names) for q in names[i:]} | {f"_{p}_{t}": F.sum(row[p] * F.col(f"m.{t}")) for p in names for t in ("xi", "eta")}
    s = matched.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in sums.items()])
    s = kept(s, F.col("n") >= LEAST_PAIRS).join(state.hint("merge"), list(KEY))
    #: columns of length 1 keep the determinants well scaled
    s = s.withColumns({f"_s{p}": F.when(F.col(f"_{p}_{p}") > 0, F.sqrt(f"_{p}_{p}")).otherwise(1.0) for p in names})
    get = lambda p, q: F.col(f"_{p}_{q}") if f"_{p}_{q}" in sums else F.col(f"_{q}_{p}")
    s = s.withColumns({f"_n{i}{j}": get(p, q) / F.col(f"_s{p}") / F.col(f"_s{q}") for i, p in enumerate(names) for j, q in enumerate(names)} | {f"_r{i}{t}": F.col(f"_{p}_{t}") / F.col(f"_s{p}") for i, p in enumerate(names) for t in ("xi", "eta")})
    m = [[F.col(f"_n{i}{j}") for j in range(4)] for i in range(4)]
    s = s.withColumn("_det", det4(m))
    new = lambda t, k: F.try_divide(det4([[F.col(f"_r{i}{t}") if j == k else m[i][j] for j in range(4)] for i in range(4)]), F.col("_det")) / F.col(f"_s{names[k]}")
    s = s.withColumns({f"_new{name}": new(t, k) for t, ts in (("xi", "abcd"), ("eta", "efgh")) for k, name in enumerate(ts)})
    moved = F.hypot(F.col("_newa") - F.col("a"), F.col("_newf") - F.col("f")) >= STILL
    s = s.withColumn("_go", ~F.col("frozen") & (F.col("_det") > FLAT) & F.coalesce(moved, F.lit(False)))
    terms = {t: F.when(F.col("_go"), F.col(f"_new{t}")).otherwise(F.col(t)) for t in TERMS}
    return s.select(*KEY, *[terms.get(c, F.col(c)).alias(c) for c in _STATE if c not in ("frozen", "step")], (~F.col("_go")).alias("frozen"), (F.col("step") + 1).alias("step"))


def verified(candidates: DataFrame, sources: DataFrame, stars: DataFrame, few_sources: int = FEW_SOURCES, few_stars: int = FEW_STARS, watch: Watch | None = None) -> DataFrame:
    """All correspondences of the candidates that hold: (KEY, mirrored, matched, rms_arcsec, cx, cy, a to h, x, y, z, matches); terms are those of (px, py).

    Up to few_stars stars, with their copies in neighbouring cells, are
    broadcast, and all passes run in the tasks where the candidates are; beyond,
    rows, a frame's sources and stars meet by zones (zone_pairs()). With few
    stars, up to few_sources sources are broadcast and candidates spread over
    tasks one by one; beyond, sources and candidates meet by frame, whose
    candidates are bounded in number. What survives a pass is written and dealt
    anew. watch is looked at between passes, and its deadline in their tasks.
    """
    watch = watch or Watch()
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = written(sources.select("frame_id", "source_idx", F.col("x_px").cast("double").alias("x_px"), F.col("y_px").cast("double").alias("y_px")), "verify_sources")
    at = Vec.of("x_unit", "y_unit", "z_unit")
    n = stars.count()
    copies = n if n > few_stars else stars.select(F.size(cells.cover(LEVEL, at.ra_deg(), at.dec_deg(), F.lit(max(RADII) / 3600))).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one at least for each star
    close = points.limit(few_sources + 1).count() <= few_sources
    rows = candidates.join(points.groupBy("frame_id").agg(F.avg("x_px").alias("cx"), F.avg("y_px").alias("cy")), "frame_id")
    if copies <= few_stars:
        near, table = F.broadcast(points) if close else points.repartition(parts, "frame_id").hint("merge"), F.broadcast(written(lookup(stars), "verify_stars"))
        met = lambda df: pairs(df, near, table)
    else:
        level = zone_level(n)
        zones = written(zoned(stars, level), "verify_zones")
        met = lambda df: zone_pairs(df, points, zones, level, 4 * parts)
    spread = lambda df: df.repartition(parts, "frame_id", "rank") if close else df.repartition(parts, "frame_id")
    state = written(watch.guarded(correspondences(spread(rows))), "verify_first_fits")
    for _ in RADII:
        watch.check()
        here = spread(state)
        after = written(refitted(here, met(watch.guarded(here))), "verify_survivors")
        forget(state)
        state = after
    here = spread(state)
    found = met(here).groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("matched"), F.degrees(F.sqrt(F.avg("m.d2"))).alias("rms"), F.array_sort(F.collect_list(F.struct("m.source_idx", F.col("star").alias("star_index"), "m.d2"))).alias("matches"))
    found = kept(found, F.col("matched") >= MIN_MATCHED).join(here.hint("merge"), list(KEY))
    t = {k: F.col(k) for k in _STATE}
    offset = lambda c, p, q: t[c] - t[p] * t["cx"] - t[q] * t["cy"]
    terms = t | {"c": offset("c", "a", "b"), "g": offset("g", "e", "f")}
    return found.select(*KEY, (t["turn"] < 0).alias("mirrored"), "matched", (F.col("rms") * 3600).alias("rms_arcsec"), t["cx"].alias("cx"), t["cy"].alias("cy"), *[terms[k].alias(k) for k in TERMS], *[t[f"o{k}"].alias(k) for k in "xyz"], "matches")
