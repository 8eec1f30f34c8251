"""Queries on catalogs, projections and numbers as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquad.functions import display
from skyquad.functions.camera import Camera, arcsec_a_pixel, fov_from_lens, from_gnomonic, gnomonic
from skyquad.functions.vectors import Vec, mean_direction, unit_vector, with_plane
from skyquad.operators import catalog, sky, solve
from skyquad.plans.tables import STARS_SQL, VECTOR_SQL, load, stars
from skyquad.sources.catalog_csv import as_text
from skyquad.sources.store import shared_dir

CAMERA = Camera(100.0, 20.0, 60.0, 45.0, 1200, 900, 15.0)


def r(c, digits: int = 7):
    """Rounded, and never a negative zero, for results that two engines compute."""
    return F.round(c, digits) + F.lit(0.0)


def unit_vectors(spark, sf_dir):
    s = catalog.with_vectors(stars(spark, sf_dir))
    back = Vec.of("x", "y", "z")
    return s.select("id", *[r(F.col(k)).alias(k) for k in "xyz"], r(back.ra_deg(), 6).alias("ra"), r(back.dec_deg(), 6).alias("dec"))


def cone_search(spark, sf_dir):
    return catalog.cone(catalog.sky_index(stars(spark, sf_dir)), 100.0, 20.0, 30.0).select("id", "mag", r(catalog.separation(100.0, 20.0), 6).alias("sep"))


def cone_join(spark, sf_dir):
    """A cone for each supplier, against a stored index of all customers."""
    k = F.col("s_suppkey")
    path = shared_dir(spark, "sky_index")
    sky.write_index(stars(spark, sf_dir), path)
    cones = load(spark, sf_dir, "supplier").select(k.alias("cone_id"), (k * 137 % 360).cast("double").alias("ra0"), (k * 71 % 181 - 90).cast("double").alias("dec0"), (k % 7 + 0.5).cast("double").alias("radius_deg"))
    return sky.in_cones(cones, sky.read_index(spark, path)).select("cone_id", "id", r(F.col("separation_deg"), 6).alias("sep"))


def nearest_stars(spark, sf_dir):
    """Each customer's nearest other one on the sky."""
    places = catalog.with_vectors(stars(spark, sf_dir)).select(F.col("id").alias("key"), "x", "y", "z")
    return sky.nearest(places, 1).select(F.col("key").alias("id"), F.get("n", F.lit(0)).alias("nearest"))


def cone_count(spark, sf_dir):
    return catalog.count_in_cone(stars(spark, sf_dir), 100.0, 20.0, 30.0)


def field_coverage(spark, sf_dir):
    return catalog.coverage(stars(spark, sf_dir), 100.0, 20.0, 30.0).select(r(F.col("coverage"), 9).alias("coverage"))


def magnitude_filter(spark, sf_dir):
    return catalog.brighter_than(stars(spark, sf_dir), 5.0).select("id", "mag")


def catalog_stats(spark, sf_dir):
    s = catalog.stats(stars(spark, sf_dir))
    return s.select(*[r(F.col(c), 6).alias(c) if c not in ("count", "with_mag") else F.col(c) for c in s.columns])


def visible_stars(spark, sf_dir):
    return catalog.visible(stars(spark, sf_dir), 100.0, 20.0, 30.0, 20.0, 7.0).select("id", "mag")


def gnomonic_forward(spark, sf_dir):
    x, y = gnomonic(100.0, 20.0, "ra_deg", "dec_deg")
    near = catalog.cone(stars(spark, sf_dir), 100.0, 20.0, 60.0)
    return near.select("id", r(x).alias("x"), r(y).alias("y"))


def gnomonic_inverse(spark, sf_dir):
    k = F.col("p_partkey")
    ra, dec = from_gnomonic(100.0, 20.0, ((k * 7919) % 2001 - 1000) / F.lit(1000.0), ((k * 104729) % 2003 - 1000) / F.lit(1000.0))
    return load(spark, sf_dir, "part").select("p_partkey", r(ra, 6).alias("ra"), r(dec, 6).alias("dec"))


def sky_to_pixel(spark, sf_dir):
    x, y = CAMERA.pixel("ra_deg", "dec_deg")
    return stars(spark, sf_dir).select("id", r(x, 4).alias("x"), r(y, 4).alias("y")).filter("x is not null")


def pixel_to_sky(spark, sf_dir):
    k = F.col("p_partkey")
    ra, dec = CAMERA.sky((k * 7919) % 1200, (k * 104729) % 900)
    return load(spark, sf_dir, "part").select("p_partkey", r(ra, 6).alias("ra"), r(dec, 6).alias("dec"))


def tangent_plane(spark, sf_dir):
    near, plane = with_plane(catalog.with_vectors(catalog.cone(stars(spark, sf_dir), 100.0, 20.0, 70.0)), unit_vector(100.0, 20.0))
    v, mirrored = Vec.of("x", "y", "z"), F.col("id") % 2 == 1
    xi, eta = plane.project(v, mirrored)
    near = near.withColumns({"xi": xi, "eta": eta})
    back = plane.lift(F.col("xi"), F.col("eta"), mirrored)
    return near.select("id", r(F.col("xi"), 6).alias("xi"), r(F.col("eta"), 6).alias("eta"), r(back.separation_deg(v), 3).alias("off"), r(v.chord(plane.centre), 6).alias("chord"))


def vector_algebra(spark, sf_dir):
    a, b = unit_vector("ra_deg", "dec_deg"), unit_vector(30.0, 40.0)
    c, m = a.cross(b), mean_direction([a, b, a.plus(b).unit(), a])
    return stars(spark, sf_dir).select("id", *[r(getattr(c, k), 6).alias(f"c{k}") for k in "xyz"], r(c.norm(), 6).alias("n"), r(a.minus(b).times(2.0).norm_sq(), 6).alias("d"), r(m.dot(a), 6).alias("m"))


def lens_fields(spark, sf_dir):
    f, side = F.col("p_size") + 10, F.col("p_partkey") % 40 + 5
    fov = fov_from_lens(f, side)
    return load(spark, sf_dir, "part").select("p_partkey", r(fov, 6).alias("fov"), r(arcsec_a_pixel(fov, 1000 + F.col("p_partkey") % 500), 5).alias("scale"))


def place_text(spark, sf_dir):
    # whole hundredths of a second away from halves, so that engines round alike
    k = F.col("c_custkey")
    ra, dec = (k * 7919 % 864000) / F.lit(2400.0) + F.lit(1e-5), (k * 104729 % 640000) / F.lit(3600.0) - 88 + F.lit(1e-5)
    return load(spark, sf_dir, "customer").select("c_custkey", display.ra_text(ra).alias("ra"), display.dec_text(dec).alias("dec"), display.fov_text(F.when(k % 7 != 0, (k % 90).cast("double")), (k % 50).cast("double")).alias("fov"), display.rotation_text(F.when(k % 5 != 0, (k % 360).cast("double"))).alias("roll"))


def size_text(spark, sf_dir):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 1024 + 512
    return load(spark, sf_dir, "orders").select("o_orderkey", display.bytes_text(n).alias("size"))


def csv_text(spark, sf_dir):
    s = stars(spark, sf_dir)
    return as_text(s.withColumn("dec_deg", F.round("dec_deg", 6)))


def confidence_tiers(spark, sf_dir):
    m, e = F.col("l_linenumber") + F.col("l_quantity").cast("int") % 5, F.col("l_discount") * 300
    c = solve.confidence(m, e)
    return load(spark, sf_dir, "lineitem").groupBy(r(c.cast("double"), 2).alias("confidence"), display.confidence_label(c).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def field_gates(spark, sf_dir):
    x, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 37).cast("double")
    est, err = F.when(F.col("p_partkey") % 3 != 0, (F.col("p_partkey") % 25).cast("double")), F.when(F.col("p_partkey") % 2 != 0, (F.col("p_partkey") % 11).cast("double"))
    ok = solve.within_estimate(x, y, est, err)
    return load(spark, sf_dir, "part").select("p_partkey", ok.alias("near"), F.greatest(x, y).between(10.0, 30.0).alias("inside"))


def database_choice(spark, sf_dir):
    k = F.col("n_nationkey")
    d = load(spark, sf_dir, "nation").select(F.concat(F.lit("db"), k.cast("string")).alias("id"), (k * 7 % 40).cast("double").alias("fov_min_deg"), (k * 7 % 40 + 5 + k % 6).cast("double").alias("fov_max_deg"), (k % 4 != 0).alias("ready"), k.alias("position"))
    return catalog.pick_database(d, 12.0, 9.0).select("id", "fov_min_deg", "fov_max_deg")


def catalog_append(spark, sf_dir):
    s = stars(spark, sf_dir)
    far = s.filter("dec_deg < -60").select((F.col("id") + 1_000_000).alias("id"), "mag")
    both = s.filter("dec_deg > 30").select("id", "mag").unionByName(far)
    return both.join(catalog.brighter_than(s, 2.0).select("id"), "id", "left_anti")


def generated_catalog(spark, sf_dir):
    return catalog.generated(spark, 2000, 42, 6.0, 2.0, 9.0)


_C = "radians(100.0::double)", "radians(20.0::double)"
_COS = f"(sin({_C[1]}) * sin(radians(dec_deg)) + cos({_C[1]}) * cos(radians(dec_deg)) * cos(radians(ra_deg) - {_C[0]}))"
_SEP = f"degrees(acos(greatest(-1.0::double, least(1.0::double, x * cos({_C[1]}) * cos({_C[0]}) + y * cos({_C[1]}) * sin({_C[0]}) + z * sin({_C[1]})))))"
_GX = f"cos(radians(dec_deg)) * sin(radians(ra_deg) - {_C[0]}) / {_COS}"
_GY = f"(cos({_C[1]}) * sin(radians(dec_deg)) - sin({_C[1]}) * cos(radians(dec_deg)) * cos(radians(ra_deg) - {_C[0]})) / {_COS}"
_V = f"with {STARS_SQL}, v as (select *, {VECTOR_SQL} from stars), s as (select *, {_SEP} as sep from v)"
_INV = f"""i as (select *, sqrt(x * x + y * y) as rho, atan(sqrt(x * x + y * y)) as c from p)
select p_partkey, round(case when rho < 1e-15 then 100.0::double else ((degrees({_C[0]} + atan2(x * sin(c), rho * cos({_C[1]}) * cos(c) - y * sin({_C[1]}) * sin(c))) % 360) + 360) % 360 end, 6) + 0 as ra,
  round(case when rho < 1e-15 then 20.0::double else degrees(asin(cos(c) * sin({_C[1]}) + y * sin(c) * cos({_C[1]}) / rho)) end, 6) + 0 as dec from i"""
_PIX = "radians(60.0::double) / 1200.0::double", "radians(45.0::double) / 900.0::double", "radians(15.0::double)"

SQL = {
    "unit_vectors": f"with {STARS_SQL}, v as (select *, {VECTOR_SQL} from stars) select id, round(x, 7) + 0 as x, round(y, 7) + 0 as y, round(z, 7) + 0 as z, round(((degrees(atan2(y, x)) % 360) + 360) % 360, 6) + 0 as ra, round(degrees(asin(greatest(-1, least(1, z)))), 6) + 0 as dec from v",
    "cone_join": f"""with {STARS_SQL}, v as (select id, {VECTOR_SQL} from stars), c as (select s_suppkey as cone_id, radians((s_suppkey * 137 % 360)::double) as a, radians((s_suppkey * 71 % 181 - 90)::double) as d, s_suppkey % 7 + 0.5::double as radius from supplier),
m as (select cone_id, id, radius, degrees(acos(greatest(-1.0::double, least(1.0::double, x * cos(d) * cos(a) + y * cos(d) * sin(a) + z * sin(d))))) as sep from v cross join c) select cone_id, id, round(sep, 6) + 0 as sep from m where sep <= radius""",
    "nearest_stars": f"""with {STARS_SQL}, v as (select id, {VECTOR_SQL} from stars) select a.id, arg_min(b.id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as nearest from v a join v b on a.id <> b.id group by a.id""",
    "cone_search": f"{_V} select id, mag, round(sep, 6) + 0 as sep from s where sep <= 30",
    "cone_count": f"{_V} select count(*) as n from s where sep <= 30",
    "field_coverage": f"{_V} select round(count(*) / (pi() * 15.0::double * 15.0::double), 9) + 0 as coverage from s where sep <= 30.0::double * sqrt(2.0::double) / 2",
    "magnitude_filter": f"with {STARS_SQL} select id, mag from stars where mag <= 5",
    "catalog_stats": f"with {STARS_SQL} select count(*) as count, count(mag) as with_mag, round(avg(mag), 6) + 0 as mag_mean, round(min(ra_deg), 6) + 0 as ra_min, round(max(ra_deg), 6) + 0 as ra_max, round(min(dec_deg), 6) + 0 as dec_min, round(max(dec_deg), 6) + 0 as dec_max, round(min(mag), 6) + 0 as mag_min, round(max(mag), 6) + 0 as mag_max from stars",
    "visible_stars": f"{_V} select id, mag from s where (mag is null or mag <= 7) and sep <= sqrt(1300.0::double) / 2 * 1.2::double",
    "gnomonic_forward": f"{_V} select id, round({_GX}, 7) + 0 as x, round({_GY}, 7) + 0 as y from s where sep <= 60",
    "gnomonic_inverse": f"with p as (select p_partkey, ((p_partkey * 7919) % 2001 - 1000) / 1000.0::double as x, ((p_partkey * 104729) % 2003 - 1000) / 1000.0::double as y from part), {_INV}",
    "sky_to_pixel": f"""with {STARS_SQL}, g as (select id, {_GX} / ({_PIX[0]}) as u, {_GY} / ({_PIX[1]}) as v from stars where {_COS} > 0),
p as (select id, 600.0::double + (u * cos({_PIX[2]}) - v * sin({_PIX[2]})) as x, 450.0::double - (u * sin({_PIX[2]}) + v * cos({_PIX[2]})) as y from g)
select id, round(x, 4) + 0 as x, round(y, 4) + 0 as y from p where x between 0 and 1200 and y between 0 and 900""",
    "pixel_to_sky": f"""with q as (select p_partkey, (p_partkey * 7919) % 1200 - 600.0::double as u, 450.0::double - (p_partkey * 104729) % 900 as v from part),
p as (select p_partkey, (u * cos({_PIX[2]}) + v * sin({_PIX[2]})) * {_PIX[0]} as x, (v * cos({_PIX[2]}) - u * sin({_PIX[2]})) * {_PIX[1]} as y from q), {_INV}""",
    "tangent_plane": f"""{_V} select id, round({_GY}, 6) + 0 as xi, round(case when id % 2 = 1 then 1 else -1 end * {_GX}, 6) + 0 as eta, 0.0::double as off,
  round(sqrt((x - cos({_C[1]}) * cos({_C[0]})) ** 2 + (y - cos({_C[1]}) * sin({_C[0]})) ** 2 + (z - sin({_C[1]})) ** 2), 6) + 0 as chord from s where sep <= 70""",
    "lens_fields": "with f as (select *, degrees(2.0::double * atan((p_partkey % 40 + 5)::double / (2.0::double * (p_size + 10)))) as fov from part) select p_partkey, round(fov, 6) + 0 as fov, round(fov * 3600 / (1000 + p_partkey % 500), 5) + 0 as scale from f",
    "place_text": """with p as (select c_custkey, (c_custkey * 7919 % 864000) / 2400.0::double + 1e-5::double as ra, (c_custkey * 104729 % 640000) / 3600.0::double - 88 + 1e-5::double as dec from customer),
t as (select *, floor(ra / 15) as h, (ra / 15 - floor(ra / 15)) * 60 as hm, floor(abs(dec)) as d, (abs(dec) - floor(abs(dec))) * 60 as dm from p)
select c_custkey, printf('%dh %02dm %04.1fs', h::int, floor(hm)::int, (hm - floor(hm)) * 60) as ra, case when dec >= 0 then '+' else '−' end || printf('%02d° %02d′ %04.1f″', d::int, floor(dm)::int, (dm - floor(dm)) * 60) as dec,
  case when c_custkey % 7 = 0 then '—' else printf('%.2f° × %.2f°', (c_custkey % 90)::double, (c_custkey % 50)::double) end as fov, case when c_custkey % 5 = 0 then '—' else printf('%.2f°', (c_custkey % 360)::double) end as roll from t""",
    "size_text": "with n as (select o_orderkey, (o_orderkey * o_orderkey * 1024 + 512) as n from orders) select o_orderkey, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', n / 1024.0::double) when n < 1073741824 then printf('%.1f MB', n / 1048576.0::double) else printf('%.1f GB', n / 1073741824.0::double) end as size from n",
    "csv_text": f"with {STARS_SQL} select id, printf('%.8f', ra_deg) as ra_deg, printf('%.8f', round(dec_deg, 6) + 0) as dec_deg, coalesce(printf('%.4f', mag), '') as mag from stars",
    "confidence_tiers": """with c as (select case when m >= 8 and e < 15 then 0.95::double when m >= 5 then 0.75::double when m >= 3 then 0.5::double else 0.25::double end as confidence from (select l_linenumber + l_quantity::int % 5 as m, l_discount * 300 as e from lineitem))
select confidence, case when confidence > 0.75 then 'high' when confidence > 0.5 then 'medium' else 'low' end as label, count(*) as n from c group by all""",
    "field_gates": """with p as (select p_partkey, greatest(p_size, p_partkey % 37)::float as f, case when p_partkey % 3 <> 0 then p_partkey % 25 end as est, case when p_partkey % 2 <> 0 then p_partkey % 11 end as err from part)
select p_partkey, est is null or abs(f - est) <= coalesce(err, est) as near, f between 10 and 30 as inside from p""",
    "database_choice": """with d as (select 'db' || n_nationkey as id, (n_nationkey * 7 % 40)::double as fov_min_deg, (n_nationkey * 7 % 40 + 5 + n_nationkey % 6)::double as fov_max_deg, n_nationkey as position from nation where n_nationkey % 4 <> 0)
select id, fov_min_deg, fov_max_deg from d order by case when 15 between fov_min_deg and fov_max_deg then 0 else 1 end, case when 15 between fov_min_deg and fov_max_deg then fov_min_deg else abs((fov_min_deg + fov_max_deg) / 2 - 15) end, position limit 1""",
    "catalog_append": f"with {STARS_SQL}, u as (select id, mag from stars where dec_deg > 30 union all select id + 1000000, mag from stars where dec_deg < -60) select * from u where id not in (select id from stars where mag <= 2)",
    "vector_algebra": f"""with {STARS_SQL}, a as (select *, {VECTOR_SQL}, cos(radians(40.0::double)) * cos(radians(30.0::double)) as p, cos(radians(40.0::double)) * sin(radians(30.0::double)) as q, sin(radians(40.0::double)) as w from stars),
c as (select *, y * w - z * q as cx, z * p - x * w as cy, x * q - y * p as cz, sqrt((x + p) ** 2 + (y + q) ** 2 + (z + w) ** 2) as h from a),
m as (select *, 2 * x + p + (x + p) / h as mx, 2 * y + q + (y + q) / h as my, 2 * z + w + (z + w) / h as mz from c)
select id, round(cx, 6) + 0 as cx, round(cy, 6) + 0 as cy, round(cz, 6) + 0 as cz, round(sqrt(cx * cx + cy * cy + cz * cz), 6) + 0 as n, round(4 * ((x - p) ** 2 + (y - q) ** 2 + (z - w) ** 2), 6) + 0 as d, round((mx * x + my * y + mz * z) / sqrt(mx * mx + my * my + mz * mz), 6) + 0 as m from m""",
}
QUERIES = {f.__name__: f for f in (cone_join, nearest_stars, unit_vectors, cone_search, cone_count, field_coverage, magnitude_filter, catalog_stats, visible_stars, gnomonic_forward, gnomonic_inverse, sky_to_pixel, pixel_to_sky, tangent_plane, vector_algebra, lens_fields, place_text, size_text, csv_text, confidence_tiers, field_gates, database_choice, catalog_append, generated_catalog)}
