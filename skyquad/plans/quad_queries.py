"""Queries on sources, quads, keys and joins by nearness."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyquad.functions import hashes
from skyquad.functions.camera import pixel_distance
from skyquad.operators import fits, matching, points, synthetic
from skyquad.plans.catalog_queries import r
from skyquad.plans.tables import PATCH_SQL, SOURCES_SQL, VECTOR_SQL, load, patch, sources
from skyquad.sources.store import shared_dir


#: Digits to which the terms of a radial fit are held: slopes, offsets, curvature.
RADIAL_DIGITS = {"a": 8, "b": 8, "c": 6, "d": 10, "e": 8, "f": 8, "g": 6, "h": 10}


def brightest_sources(spark, sf_dir):
    return points.select_brightest(sources(spark, sf_dir), 8).select("frame_id", "source_idx", "flux", "place")


def top_sources(spark, sf_dir):
    return points.brightest_for_quads(sources(spark, sf_dir)).select("frame_id", "source_idx", "rank")


def source_boxes(spark, sf_dir):
    return points.bounding_box(sources(spark, sf_dir))


def source_centroids(spark, sf_dir):
    return points.centroid(sources(spark, sf_dir)).select("frame_id", r(F.col("cx"), 6).alias("cx"), r(F.col("cy"), 6).alias("cy"))


def sources_apart(spark, sf_dir):
    return points.apart(sources(spark, sf_dir), 60.0)


def pixel_distances(spark, sf_dir):
    s = sources(spark, sf_dir)
    t = s.select("frame_id", F.col("source_idx").alias("other"), F.col("x_px").alias("ox"), F.col("y_px").alias("oy"), (F.col("source_idx") - 5).alias("k"))
    return s.join(t, (s["source_idx"] == t["k"]) & (s["frame_id"] == t["frame_id"])).select("source_idx", "other", pixel_distance("x_px", "y_px", "ox", "oy").alias("d"))


def quad_keys(spark, sf_dir):
    q = points.quads(sources(spark, sf_dir))
    return q.select("frame_id", "i", "j", "k", "l", "quality", *[F.col(f"f.{c}").alias(f"f_{c}") for c in hashes.KEY], *[F.col(f"key.{c}").alias(c) for c in hashes.KEY], F.array_join(F.transform("order", lambda x: x.cast("string")), "").alias("points_order"))


def early_features(spark, sf_dir):
    q = points.early_quads(sources(spark, sf_dir), 200).filter("f is not null").withColumn("key", hashes.quantised_even(F.col("f")))
    near = F.struct(*[(F.col(f"key.{c}") * 0.01).alias(c) for c in hashes.KEY])
    order = F.array_join(F.transform("f.order", lambda x: x.cast("string")), "").alias("points_order")
    return q.select("frame_id", "i", "j", "k", "l", *[r(F.col(f"f.{c}"), 9).alias(f"f_{c}") for c in (*hashes.KEY, "scale")], *[F.col(f"key.{c}").alias(c) for c in hashes.KEY], r(hashes.feature_distance(F.col("f"), near), 9).alias("off"), order)


def _keys(df, id_, mod):
    k = F.col(id_)
    return df.select(k.alias("id"), F.struct((k % mod).cast("int").alias("ax"), (k * 7 % mod).cast("int").alias("ay"), (k * 11 % mod).cast("int").alias("bx"), (k * 13 % mod).cast("int").alias("by")).alias("key"))


def neighbour_keys(spark, sf_dir):
    s = _keys(load(spark, sf_dir, "supplier"), "s_suppkey", 23)
    edge = F.struct(F.lit(32767).alias("ax"), F.lit(-32768).alias("ay"), *[F.col(f"key.{c}").alias(c) for c in ("bx", "by")])
    return s.select("id", F.size(hashes.neighbours(F.col("key"))).alias("with_itself"), F.size(hashes.neighbours(F.col("key"), 1, False)).alias("others"), F.size(F.array_distinct(hashes.neighbours(edge))).alias("at_edge"))


def _key_lists(spark, sf_dir, name):
    """Suppliers, or parts as name, in lists of those with equal keys: there are 23 keys, so that many share each."""
    left, right = _keys(load(spark, sf_dir, "supplier"), "s_suppkey", 23), _keys(load(spark, sf_dir, "part"), "p_partkey", 23)
    return matching.listed(left, "id"), matching.listed(right.withColumnRenamed("id", name), name)


def key_lookup(spark, sf_dir):
    hit = matching.exact_matches(*_key_lists(spark, sf_dir, "pattern_index")).select("id", "pattern_index")
    return matching.expanded(hit, "id", "pattern_index")


def key_band_join(spark, sf_dir):
    hit = matching.band_join(*_key_lists(spark, sf_dir, "other"), small=matching.SMALL // matching.A_LIST)
    return matching.expanded(hit.select("id", "other", hashes.key_distance_sq(F.col("key"), F.col("matched_key")).alias("d2")), "id", "other")


def stored_index_join(spark, sf_dir):
    """The band join against an index in buckets, which is written, opened again and read without a shuffle."""
    left, right = _key_lists(spark, sf_dir, "pattern_index")
    path, table = shared_dir(spark, "stored_index"), f"stored_index_{uuid.uuid4().hex}"
    index = matching.write_pattern_index(right, table, path, 8)
    hit = matching.band_join(left, index, small=0)
    return matching.expanded(hit.select("id", "pattern_index", hashes.key_distance_sq(F.col("key"), F.col("matched_key")).alias("d2")), "id", "pattern_index")


def _points(spark, sf_dir):
    k, c = F.col("p_partkey"), F.col("c_custkey")
    left = load(spark, sf_dir, "part").select((k % 4).alias("frame_id"), k.alias("id"), ((k * 7919) % 1000).cast("double").alias("x"), ((k * 104729) % 997).cast("double").alias("y"))
    right = load(spark, sf_dir, "customer").select((c % 4).alias("frame_id"), c.alias("other"), ((c * 6133) % 1000).cast("double").alias("ox"), ((c * 3571) % 997).cast("double").alias("oy"))
    return left, right


def nearest_neighbours(spark, sf_dir):
    return matching.nearest_join(*_points(spark, sf_dir), 25.0).select("frame_id", "id", "other", "d2")


def one_to_one_matches(spark, sf_dir):
    return matching.one_to_one(*_points(spark, sf_dir), 25.0).select("frame_id", "id", "other", "d2")


def match_error(spark, sf_dir):
    m = matching.one_to_one(*_points(spark, sf_dir), 25.0)
    return m.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), r(F.degrees(F.sqrt(F.avg(F.col("d2") * F.lit(1e-12)))) * 3600, 6).alias("rms_arcsec"))


def detected_only(spark, sf_dir):
    s = sources(spark, sf_dir)
    return matching.unmatched(s.withColumn("x_px", F.col("x_px") + 0.25), s.filter("source_idx % 3 = 0").withColumn("x_px", F.col("x_px") - 0.25)).select("frame_id", "source_idx")


def pattern_pruning(spark, sf_dir):
    k = F.col("l_orderkey")
    p = load(spark, sf_dir, "lineitem").select(k.alias("pattern_index"), *[((k * m) % d).cast("int").alias(f"s{i}") for i, (m, d) in enumerate(((1, 3), (1, 2), (1, 5), (1, 7)))])
    return synthetic.drop_zero_patterns(p).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s0") + F.col("s1") + F.col("s2") + F.col("s3")).alias("total"))


def _pairs(spark, sf_dir):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    px, py = ((k * 31 + n * 17) % 200).cast("double"), ((k * 57 + n * 29) % 300).cast("double")
    xi, eta = px * 0.002 - py * 0.001 + ((k * 13) % 7) / F.lit(700.0), px * 0.001 + py * 0.002 + ((k * 11) % 5) / F.lit(500.0)
    return load(spark, sf_dir, "lineitem").select((k % 50).alias("g"), px.alias("px"), py.alias("py"), xi.alias("xi"), eta.alias("eta"))


def affine_fits(spark, sf_dir):
    f = fits.fit_affine(_pairs(spark, sf_dir), ["g"])
    t = {c: F.col(c) for c in ("a", "b", "tx", "c", "d", "ty")}
    out = {c: r(F.col(c), 6) for c in t} | {"scale": r(fits.affine_scale(t), 6), "rotation": r(fits.rotation_deg(t), 3), "det": r(fits.determinant(t), 8)}
    return f.select("g", "n", *[v.alias(k) for k, v in out.items()])


def radial_fits(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumns({"cx": F.lit(100.0), "cy": F.lit(150.0)})
    r2 = (F.col("px") - 100) * (F.col("px") - 100) + (F.col("py") - 150) * (F.col("py") - 150)
    p = p.withColumns({"xi": F.col("xi") + r2 * 1e-6, "eta": F.col("eta") - r2 * 2e-6})
    f = fits.fit_radial(p.withColumnRenamed("g", "set_id"), ["set_id"])
    return f.select("set_id", "n", *[r(F.col(c), d).alias(c) for c, d in RADIAL_DIGITS.items()])


def pattern_count(spark, sf_dir):
    """How many patterns of the patch have a key."""
    s = synthetic.solver_stars(patch(spark, sf_dir))
    return matching.pattern_index(s, synthetic.nearest_patterns(s)).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))


_KEYED = "select {id} as id, {id} % 23 as ax, {id} * 7 % 23 as ay, {id} * 11 % 23 as bx, {id} * 13 % 23 as \"by\" from {t}"
_LR = f"l as ({_KEYED.format(id='s_suppkey', t='supplier')}), r as ({_KEYED.format(id='p_partkey', t='part')})"
_NEAR = """a as (select p_partkey % 4 as frame_id, p_partkey as id, ((p_partkey * 7919) % 1000)::double as x, ((p_partkey * 104729) % 997)::double as y from part),
b as (select c_custkey % 4 as frame_id, c_custkey as other, ((c_custkey * 6133) % 1000)::double as ox, ((c_custkey * 3571) % 997)::double as oy from customer),
n as (select frame_id, id, other, (x - ox) * (x - ox) + (y - oy) * (y - oy) as d2 from a join b using (frame_id) where abs(x - ox) < 25 and abs(y - oy) < 25),
m as (select * from (select *, row_number() over (partition by id order by d2, other) as k from n where d2 < 625) where k = 1),
o as (select * from (select *, row_number() over (partition by frame_id, other order by d2, id) as q from m) where q = 1)"""
_AT = "[0.0, d[1], d[2], d[3], d[1], 0.0, d[4], d[5], d[2], d[4], 0.0, d[6], d[3], d[5], d[6], 0.0]"


def _d(i: str, j: str) -> str:
    return f"m[4 * {i} + {j} + 1]"


def _xy(a: str, b: str, p: str) -> str:
    base, ap, bp = _d(a, b), _d(a, p), _d(b, p)
    x = f"({ap} * {ap} + {base} * {base} - {bp} * {bp}) / (2.0::double * {base} * {base})"
    return f"[{x}, sqrt(greatest(0.0::double, {ap} / {base} * ({ap} / {base}) - ({x}) * ({x})))]"


def keyed_sql(d: str, least: str, columns: str) -> str:
    """CTEs e to z: rows of d (with the list d of six distances) that have a key, with columns, f and points_order."""
    return f"""e as (select {columns}, d, {_AT} as m, list_position(d, list_max(d)) as w from {d} where list_max(d) >= {least}),
g as (select *, [0, 0, 0, 1, 1, 2][w] as a, [1, 2, 3, 2, 3, 3][w] as b, [2, 1, 1, 0, 0, 0][w] as c, [3, 3, 2, 3, 2, 1][w] as o from e),
h as (select *, {_xy("a", "b", "c")} as fc, {_xy("a", "b", "o")} as fo, {_xy("b", "a", "c")} as rc, {_xy("b", "a", "o")} as ro from g),
u as (select *, case when fc <= fo then fc || fo else fo || fc end as fwd, case when rc <= ro then rc || ro else ro || rc end as rev from h),
z as (select *, case when rev < fwd then rev else fwd end as f, case when rev < fwd then b || '' || a || case when rc <= ro then c || '' || o else o || '' || c end else a || '' || b || case when fc <= fo then c || '' || o else o || '' || c end end as points_order from u)"""


KEYS_SQL = ", ".join(f'round(f[{n + 1}] / 0.02::double)::int as "{k}"' for n, k in enumerate(hashes.KEY))
HAS_KEY = "(f[2] >= 1e-9 or f[4] >= 1e-9)"
_SIX = ", ".join(f"sqrt((xs[{i + 1}] - xs[{j + 1}]) * (xs[{i + 1}] - xs[{j + 1}]) + (ys[{i + 1}] - ys[{j + 1}]) * (ys[{i + 1}] - ys[{j + 1}]))" for i, j in hashes.PAIRS)
#: CTEs t to z: all quads of a table sources.
QUADS_SQL = f"""t as (select *, row_number() over (partition by frame_id order by coalesce(flux, 0) desc, source_idx) - 1 as rk from sources),
s as (select frame_id, rk, x_px as x, y_px as y, coalesce(flux, 0.0::double) as fl from t where rk < 25),
q as (select a.frame_id, a.rk as i, b.rk as j, c.rk as k, e.rk as l, a.fl + b.fl + c.fl + e.fl as quality, [a.x, b.x, c.x, e.x] as xs, [a.y, b.y, c.y, e.y] as ys
  from s a join s b on a.frame_id = b.frame_id and b.rk > a.rk join s c on c.frame_id = a.frame_id and c.rk > b.rk join s e on e.frame_id = a.frame_id and e.rk > c.rk),
d as (select *, [{_SIX}] as d from q), {keyed_sql("d", "5", "frame_id, i, j, k, l, quality")}"""
_QUADS = f"with {SOURCES_SQL}, {QUADS_SQL} select frame_id, i, j, k, l, quality, f[1] as f_ax, f[2] as f_ay, f[3] as f_bx, f[4] as f_by, {KEYS_SQL}, points_order from z where {HAS_KEY}"
_CHORDS = ", ".join(f"sqrt((x{i} - x{j}) * (x{i} - x{j}) + (y{i} - y{j}) * (y{i} - y{j}) + (z{i} - z{j}) * (z{i} - z{j}))" for i, j in hashes.PAIRS)
#: (pattern_index, f, keys) of the patch: its stars numbered, each with every three of its five nearest.
PATTERNS_SQL = f"""{PATCH_SQL}, ps as (select row_number() over (order by coalesce(mag, 99), id) - 1 as n, x::float::double as x, y::float::double as y, z::float::double as z from (select *, {VECTOR_SQL} from patch)),
pn as (select a.n, list(b.n order by b.nth) as near from ps a join lateral (select b.n, row_number() over (order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.n) as nth from ps b where b.n <> a.n) b on b.nth <= 5 group by a.n),
pt as (select distinct list_sort([n, near[i], near[j], near[k]]) as s from pn, (select a.i, b.i as j, c.i as k from (select unnest([1, 2, 3, 4, 5]) as i) a, (select unnest([1, 2, 3, 4, 5]) as i) b, (select unnest([1, 2, 3, 4, 5]) as i) c where a.i < b.i and b.i < c.i) where k <= len(near)),
pv as (select row_number() over (order by s) - 1 as pattern_index, {", ".join(f"s{i}.{c} as {c}{i}" for i in range(4) for c in "xyz")} from pt {" ".join(f"join ps s{i} on s{i}.n = s[{i + 1}]" for i in range(4))}),
pd as (select pattern_index, [{_CHORDS}] as d from pv), pattern_keys as (with {keyed_sql("pd", "1e-9", "pattern_index")} select pattern_index, f, {KEYS_SQL} from z where {HAS_KEY})"""
_EARLY = f"""with {SOURCES_SQL}, s as (select *, row_number() over (partition by frame_id order by source_idx) - 1 as rk from sources),
q as (select a.frame_id, a.rk as i, b.rk as j, c.rk as k, e.rk as l, [a.x_px, b.x_px, c.x_px, e.x_px] as xs, [a.y_px, b.y_px, c.y_px, e.y_px] as ys
  from s a join s b on a.frame_id = b.frame_id and b.rk > a.rk join s c on c.frame_id = a.frame_id and c.rk > b.rk join s e on e.frame_id = a.frame_id and e.rk > c.rk),
d as (select *, [{_SIX}] as d from q), o as (select *, row_number() over (partition by frame_id order by i, j, k, l) as nth from d where list_max(d) >= 5),
w as (select *, list_max(d) as scale, list_position(d, list_max(d)) as w from o where nth <= 200),
g as (select *, [0, 0, 0, 1, 1, 2][w] as a, [1, 2, 3, 2, 3, 3][w] as b, [2, 1, 1, 0, 0, 0][w] as c, [3, 3, 2, 3, 2, 1][w] as o from w),
v as (select *, xs[a + 1] as ax, ys[a + 1] as ay, xs[b + 1] - xs[a + 1] as ux, ys[b + 1] - ys[a + 1] as uy from g),
p as (select *, {", ".join(f"[((xs[{n} + 1] - ax) * ux + (ys[{n} + 1] - ay) * uy) / (scale * scale), ((ys[{n} + 1] - ay) * ux - (xs[{n} + 1] - ax) * uy) / (scale * scale), {n}] as p{n}" for n in "co")} from v),
f as (select *, case when pc <= po then pc else po end as n1, case when pc <= po then po else pc end as n2 from p),
k as (select *, [n1[1], n1[2], n2[1], n2[2]] as f, {", ".join(f"round_even(n{n}[{m}] / 0.01::double, 0)::bigint as k{2 * n + m - 2}" for n in (1, 2) for m in (1, 2))} from f)
select frame_id, i, j, k, l, {", ".join(f"round(f[{n + 1}], 9) + 0 as f_{c}" for n, c in enumerate(hashes.KEY))}, round(scale, 9) + 0 as f_scale, {", ".join(f'k{n + 1} as "{c}"' for n, c in enumerate(hashes.KEY))},
  round(sqrt({" + ".join(f"(f[{n}] - k{n} * 0.01::double) * (f[{n}] - k{n} * 0.01::double)" for n in (1, 2, 3, 4))}), 9) + 0 as off, a || '' || b || n1[3]::int || n2[3]::int as points_order from k"""
_APART = f"""with recursive {SOURCES_SQL}, o as (select *, row_number() over (partition by frame_id order by source_idx) as n from sources),
k as (select frame_id, n, [x_px] as xs, [y_px] as ys, true as kept from o where n = 1 union all
  select o.frame_id, o.n, case when far then list_append(xs, x_px) else xs end, case when far then list_append(ys, y_px) else ys end, far from
  (select o.frame_id, o.n, o.x_px, o.y_px, k.xs, k.ys, list_min([(p[1] - o.x_px) ** 2 + (p[2] - o.y_px) ** 2 for p in list_zip(k.xs, k.ys)]) >= 3600 as far from k join o on o.frame_id = k.frame_id and o.n = k.n + 1) o)
select frame_id, source_idx, x_px, y_px, flux from o join k using (frame_id, n) where kept"""
_SUMS = "sum(px * px) as xx, sum(px * py) as xy, sum(px) as sx, sum(py * py) as yy, sum(py) as sy, count(*)::double as n, sum(px * xi) as xu, sum(py * xi) as yu, sum(xi) as su, sum(px * eta) as xv, sum(py * eta) as yv, sum(eta) as sv"


def _det(c: int | None = None, t: str = "u") -> str:
    m = [["xx", "xy", "sx"], ["xy", "yy", "sy"], ["sx", "sy", "n"]]
    if c is not None:
        for row, v in zip(m, (f"x{t}", f"y{t}", f"s{t}"), strict=True):
            row[c] = v
    (p, q, s), (a, b, e), (g, h, k) = m
    return f"({p} * ({b} * {k} - {e} * {h}) - {q} * ({a} * {k} - {e} * {g}) + {s} * ({a} * {h} - {b} * {g}))"


def _det_of(m: list[list[str]]) -> str:
    """A determinant, expanded along its first row."""
    if len(m) == 1:
        return m[0][0]
    terms = [f"{'-' if c % 2 else '+'} {m[0][c]} * ({_det_of([row[:c] + row[c + 1 :] for row in m[1:]])})" for c in range(len(m))]
    return " ".join(terms)


def _radial_sql() -> str:
    names = "uv1r"
    m = [["m_" + "".join(sorted((p, q))) for q in names] for p in names]
    sums = ", ".join(f"sum({p} * {q})::double as {m[n][names.index(q)]}" for n, p in enumerate(names) for q in names[n:])
    rights = ", ".join(f"sum({p} * {t}) as m_{p}_{t}" for p in names for t in ("xi", "eta"))
    terms = [f"({_det_of([[f'm_{names[i]}_{t}' if c == k else m[i][c] for c in range(4)] for i in range(4)])}) / det as {name}" for t, four in (("xi", "abcd"), ("eta", "efgh")) for k, name in enumerate(four)]
    out = ", ".join(f"round({dict(c='c - a * 100 - b * 150', g='g - e * 100 - f * 150').get(c, c)}, {d}) + 0 as {c}" for c, d in RADIAL_DIGITS.items())
    return f"""with b as (select l_orderkey % 50 as set_id, ((l_orderkey * 31 + l_linenumber * 17) % 200)::double as px, ((l_orderkey * 57 + l_linenumber * 29) % 300)::double as py, l_orderkey as k from lineitem),
w as (select *, px - 100 as u, py - 150 as v, (px - 100) * (px - 100) + (py - 150) * (py - 150) as r from b),
p as (select *, px * 0.002::double - py * 0.001::double + ((k * 13) % 7) / 700.0::double + r * 1e-6::double as xi, px * 0.001::double + py * 0.002::double + ((k * 11) % 5) / 500.0::double - r * 2e-6::double as eta from w),
s as (select set_id, count(*) as n, {sums}, {rights} from p group by set_id), d as (select *, {_det_of(m)} as det from s), f as (select set_id, n, {", ".join(terms)} from d where n >= 4 and abs(det) > 0)
select set_id, n, {out} from f"""


SQL = {
    "sources_apart": _APART,
    "early_features": _EARLY,
    "radial_fits": _radial_sql(),
    "pattern_count": f'with {PATTERNS_SQL} select count(*) as n, count(distinct (ax, ay, bx, "by")) as keys from pattern_keys',
    "brightest_sources": f"with {SOURCES_SQL}, t as (select *, count(*) over (partition by frame_id) as n, row_number() over (partition by frame_id order by flux desc nulls last, source_idx) as f, row_number() over (partition by frame_id order by source_idx) as p from sources) select frame_id, source_idx, flux, case when n <= 8 then p else f end as place from t where n <= 8 or f <= 8",
    "top_sources": f"with {SOURCES_SQL} select frame_id, source_idx, rank from (select *, row_number() over (partition by frame_id order by coalesce(flux, 0) desc, source_idx) - 1 as rank from sources) where rank < 25",
    "source_boxes": f"with {SOURCES_SQL} select frame_id, min(x_px) as x_min, max(x_px) as x_max, min(y_px) as y_min, max(y_px) as y_max from sources group by frame_id",
    "source_centroids": f"with {SOURCES_SQL} select frame_id, round(avg(x_px), 6) + 0 as cx, round(avg(y_px), 6) + 0 as cy from sources group by frame_id",
    "pixel_distances": f"with {SOURCES_SQL} select a.source_idx, b.source_idx as other, sqrt((a.x_px - b.x_px) * (a.x_px - b.x_px) + (a.y_px - b.y_px) * (a.y_px - b.y_px)) as d from sources a join sources b on b.source_idx = a.source_idx + 5",
    "quad_keys": _QUADS,
    "neighbour_keys": "select s_suppkey as id, 81 as with_itself, 80 as others, 36 as at_edge from supplier",
    "key_lookup": f"with {_LR} select l.id, r.id as pattern_index from l join r using (ax, ay, bx, \"by\")",
    "key_band_join": f"with {_LR} select l.id, r.id as other, ((l.ax - r.ax) ** 2 + (l.ay - r.ay) ** 2 + (l.bx - r.bx) ** 2 + (l.\"by\" - r.\"by\") ** 2)::bigint as d2 from l join r on abs(l.ax - r.ax) <= 1 and abs(l.ay - r.ay) <= 1 and abs(l.bx - r.bx) <= 1 and abs(l.\"by\" - r.\"by\") <= 1",
    "nearest_neighbours": f"with {_NEAR} select frame_id, id, other, d2 from m",
    "one_to_one_matches": f"with {_NEAR} select frame_id, id, other, d2 from o",
    "match_error": f"with {_NEAR} select frame_id, count(*) as n, round(degrees(sqrt(avg(d2 * 1e-12::double))) * 3600, 6) + 0 as rms_arcsec from o group by frame_id",
    "detected_only": f"with {SOURCES_SQL} select frame_id, source_idx from sources s where not exists (select 1 from sources t where t.source_idx % 3 = 0 and t.frame_id = s.frame_id and round(t.x_px - 0.25) = round(s.x_px + 0.25) and t.y_px = s.y_px)",
    "pattern_pruning": "with p as (select l_orderkey % 3 as s0, l_orderkey % 2 as s1, l_orderkey % 5 as s2, l_orderkey % 7 as s3 from lineitem) select count(*) as n, sum(s0 + s1 + s2 + s3)::bigint as total from p where s0 <> 0 or s1 <> 0 or s2 <> 0 or s3 <> 0",
    "affine_fits": f"""with q as (select l_orderkey % 50 as g, ((l_orderkey * 31 + l_linenumber * 17) % 200)::double as px, ((l_orderkey * 57 + l_linenumber * 29) % 300)::double as py, l_orderkey as k from lineitem),
p as (select g, px, py, px * 0.002::double - py * 0.001::double + ((k * 13) % 7) / 700.0::double as xi, px * 0.001::double + py * 0.002::double + ((k * 11) % 5) / 500.0::double as eta from q),
s as (select g, {_SUMS} from p group by g), f as (select g, n, {", ".join(f"{_det(c, t)} / {_det()} as {name}" for t, names in (("u", ("a", "b", "tx")), ("v", ("c", "d", "ty"))) for c, name in enumerate(names))} from s where n >= 3)
select g, n::bigint as n, {", ".join(f"round({c}, 6) + 0 as {c}" for c in ("a", "b", "tx", "c", "d", "ty"))}, round(sqrt(a * a + c * c), 6) + 0 as scale, round(degrees(atan2(c, a)), 3) + 0 as rotation, round(a * d - b * c, 8) + 0 as det from f""",
}
SQL["stored_index_join"] = SQL["key_band_join"].replace("r.id as other", "r.id as pattern_index")
QUERIES = {f.__name__: f for f in (stored_index_join, brightest_sources, top_sources, source_boxes, source_centroids, sources_apart, pixel_distances, quad_keys, early_features, neighbour_keys, key_lookup, key_band_join, nearest_neighbours, one_to_one_matches, match_error, detected_only, pattern_pruning, affine_fits, radial_fits, pattern_count)}
