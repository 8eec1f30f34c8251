"""Queries that solve fields, and requests and results as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from skyquad.functions.camera import Camera
from skyquad.operators import matching, points, solve, synthetic
from skyquad.plans.catalog_queries import r
from skyquad.plans.quad_queries import HAS_KEY, KEYS_SQL, PATTERNS_SQL, QUADS_SQL
from skyquad.plans.tables import PATCH_SQL, load, patch
from skyquad.sources import requests
from skyquad.sources.store import written

CENTRES = ((5.0, 25.0, 10.0), (15.0, 25.5, 75.0), (6.0, 24.5, 130.0))


def fields(catalog):
    """Sources of three frames of the catalog, eight degrees wide."""
    made = [synthetic.field(catalog, Camera(ra, dec, 8.0, 8.0, 1200, 1200, roll)).withColumn("frame_id", F.lit(i).cast("long")) for i, (ra, dec, roll) in enumerate(CENTRES)]
    return reduce(lambda a, b: a.unionByName(b), made)


def database(spark, sf_dir):
    """The catalog, and the stars and index made from it, written once each: all are read several times."""
    catalog = written(patch(spark, sf_dir), "catalog")
    stars = written(synthetic.solver_stars(catalog), "solver_stars")
    return catalog, stars, written(matching.pattern_index(stars, synthetic.nearest_patterns(stars)), "pattern_index")


def candidate_patterns(spark, sf_dir):
    catalog, _, index = database(spark, sf_dir)
    c = matching.candidates(written(points.quads(fields(catalog)), "quads"), index)
    return c.select("frame_id", "i", "j", "k", "l", "pattern_index", "key_dist_sq", "rank")


def plate_solve(spark, sf_dir):
    catalog, stars, index = database(spark, sf_dir)
    wanted = spark.createDataFrame([(i, 1200, 1200, 8.0, None) for i in range(len(CENTRES))], "frame_id long, width int, height int, fov_estimate_deg double, fov_max_error_deg double")
    header = spark.createDataFrame([(1.0, 60.0)], "min_fov_deg double, max_fov_deg double")
    return solve.solve(written(fields(catalog), "sources"), wanted, stars, index, header).select("frame_id", "success", r(F.col("ra_deg"), 3).alias("ra_deg"), r(F.col("dec_deg"), 3).alias("dec_deg"), "confidence", F.col("reason"))


def synthetic_field(spark, sf_dir):
    return fields(written(patch(spark, sf_dir), "catalog")).select("frame_id", "source_idx", "id", r(F.col("x_px"), 3).alias("x_px"), r(F.col("y_px"), 3).alias("y_px"))


def _bodies(spark, sf_dir):
    k = F.col("s_suppkey")
    one = F.format_string('{"x_px": %d, "y_px": %d, "flux": %d.5}', k, k * 2, k % 7)
    body = F.when(k % 4 == 0, F.concat(F.lit(" ["), one, F.lit("]"))).when(k % 4 == 1, F.concat(F.lit('{"sources": ['), one, F.lit(","), one, F.lit('], "fov_estimate_deg": 20.5}'))).when(k % 4 == 2, F.lit('{"solve_timeout_ms": 10}')).otherwise(F.lit("{broken"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", body.alias("body"))


def parsed_requests(spark, sf_dir):
    q = requests.parse_request(F.col("body"))
    out = _bodies(spark, sf_dir).withColumn("q", q)
    return out.select("s_suppkey", F.when(F.col("q").isNotNull(), F.size("q.sources")).alias("n"), F.get("q.sources", F.lit(0))["x_px"].alias("x"), F.get("q.sources", F.lit(0))["flux"].alias("flux"), F.col("q.fov_estimate_deg").cast("double").alias("estimate"), F.col("q.solve_timeout_ms").alias("timeout"), requests.parse_request(F.col("body"), True).isNotNull().alias("valid"))


def request_round_trip(spark, sf_dir):
    k = F.col("s_suppkey")
    body = requests.build_request(F.array(F.struct(k.cast("double").alias("x_px"), (k * 2).cast("double").alias("y_px"), F.when(k % 3 != 0, k / 4).alias("flux"))), F.lit(20.0).cast("float"), F.lit(25.0).cast("float"), F.when(k % 2 == 0, F.lit(1000.0)))
    q = load(spark, sf_dir, "supplier").select("s_suppkey", requests.parse_request(body).alias("q"))
    return q.select("s_suppkey", F.col("q.sources")[0]["x_px"].alias("x"), F.col("q.sources")[0]["flux"].alias("flux"), F.col("q.solve_timeout_ms").alias("timeout"))


def result_envelopes(spark, sf_dir):
    k = F.col("s_suppkey")
    failed = requests.failure(F.array(F.format_string("No sources in frame %d", k)))
    body = F.when(k % 3 == 0, requests.error(F.lit("busy"))).when(k % 3 == 1, failed).otherwise(requests.annotate(failed))
    out = load(spark, sf_dir, "supplier").select("s_suppkey", body.alias("body"))
    return out.select("s_suppkey", requests.envelope(F.col("body")).alias("kind"), requests.parse_result(F.col("body"))["success"].alias("success"), requests.parse_result(F.col("body"))["log"][0].alias("first_line"))


def centroid_fluxes(spark, sf_dir):
    """Centroids with fluxes by position: one list is shorter, one flux unknown, one above 1."""
    k = F.col("s_suppkey").cast("double")
    centroids = F.array(*[F.struct((k + i).alias("y"), (k * 2 + i).alias("x")) for i in range(4)])
    s = load(spark, sf_dir, "supplier").select("s_suppkey", points.with_fluxes(centroids, F.array(k / 1000, F.lit(None).cast("double"), k)).alias("d"))
    return s.select("s_suppkey", F.posexplode("d").alias("i", "s")).select("s_suppkey", "i", "s.x_px", "s.y_px", "s.brightness")


def app_stars(spark, sf_dir):
    """A native result's star lists under the names of the app."""
    k = F.col("s_suppkey").cast("double")
    seen = F.when(k % 3 != 0, F.array(F.struct(k.alias("x_px"), (k + 1).alias("y_px"), (k / 8).alias("brightness"))))
    met = F.when(k % 4 != 0, F.array(F.struct(k.alias("image_x"), (k + 2).alias("image_y"), F.col("s_suppkey").alias("catalog_id"), (k / 4).alias("ra_deg"), (-k / 8).alias("dec_deg"))))
    s = load(spark, sf_dir, "supplier").select("s_suppkey", requests.app_detected(seen).alias("d"), requests.app_matched(met).alias("m"))
    d, m = F.get("d", F.lit(0)), F.get("m", F.lit(0))
    return s.select("s_suppkey", F.size("d").alias("n_detected"), d["x"].alias("x"), d["flux"].alias("flux"), F.size("m").alias("n_matched"), m["imageY"].alias("image_y"), m["catalogId"].alias("catalog_id"), m["dec"].alias("dec"))


def _frame_sql(i: int, ra: float, dec: float, roll: float) -> str:
    """What frame i's camera sees of the patch, with the flux of each star."""
    a, d, turn, px = f"radians({ra}::double)", f"radians({dec}::double)", f"radians({roll}::double)", "(radians(8.0::double) / 1200.0::double)"
    cos = f"(sin({d}) * sin(radians(dec_deg)) + cos({d}) * cos(radians(dec_deg)) * cos(radians(ra_deg) - {a}))"
    return f"""select {i} as frame_id, id, mag, 600.0::double + (u * cos({turn}) - v * sin({turn})) as x_px, 600.0::double - (u * sin({turn}) + v * cos({turn})) as y_px,
  case when mag is null then 1.0::double else pow(10.0::double, mag / -2.5::double) end as flux
  from (select *, cos(radians(dec_deg)) * sin(radians(ra_deg) - {a}) / {cos} / {px} as u, (cos({d}) * sin(radians(dec_deg)) - sin({d}) * cos(radians(dec_deg)) * cos(radians(ra_deg) - {a})) / {cos} / {px} as v
  from patch where degrees(acos(least(1.0::double, {cos}))) <= sqrt(128.0::double) / 2 * 1.2::double)"""


_FIELDS = f"""seen as ({" union all ".join(_frame_sql(i, ra, dec, roll) for i, (ra, dec, roll) in enumerate(CENTRES))}),
sources as (select *, row_number() over (partition by frame_id order by flux desc, id) - 1 as source_idx from seen where x_px between 0 and 1200 and y_px between 0 and 1200)"""
_STEPS = "(select unnest([-1, 0, 1]) as {0})"
_CANDIDATES = f"""with {PATTERNS_SQL}, {_FIELDS}, qk as (with {QUADS_SQL} select frame_id, i, j, k, l, quality, f as qf, {KEYS_SQL} from z where {HAS_KEY}),
near as (select qk.* exclude (ax, ay, bx, "by"), ax + da as ax, ay + db as ay, bx + dc as bx, "by" + dd as "by", da * da + db * db + dc * dc + dd * dd as d2 from qk, {_STEPS.format("da")}, {_STEPS.format("db")}, {_STEPS.format("dc")}, {_STEPS.format("dd")}),
hit as (select frame_id, i, j, k, l, pattern_index, quality, {" + ".join(f"(qf[{n}] - f[{n}]) * (qf[{n}] - f[{n}])" for n in (1, 2, 3, 4))} as fd, d2 as key_dist_sq from near join pattern_keys using (ax, ay, bx, "by")),
top as (select *, row_number() over (partition by frame_id, i, j, k, l order by fd, key_dist_sq, pattern_index) as nth from hit)
select frame_id, i, j, k, l, pattern_index, key_dist_sq::bigint as key_dist_sq, rank from (select *, row_number() over (partition by frame_id order by fd, key_dist_sq, quality desc, pattern_index, i, j, k, l) as rank from top where nth <= 50) where rank <= 2000"""


SQL = {
    "centroid_fluxes": """select s_suppkey, i::int as i, (s_suppkey * 2 + i)::double as x_px, (s_suppkey + i)::double as y_px, least(1.0::double, case i when 0 then s_suppkey / 1000.0::double when 2 then s_suppkey::double else 1.0::double end) as brightness
  from supplier cross join (select unnest([0, 1, 2, 3]) as i)""",
    "app_stars": """select s_suppkey, (s_suppkey % 3 <> 0)::int as n_detected, case when s_suppkey % 3 <> 0 then s_suppkey::double end as x, case when s_suppkey % 3 <> 0 then s_suppkey / 8.0::double end as flux, (s_suppkey % 4 <> 0)::int as n_matched,
  case when s_suppkey % 4 <> 0 then (s_suppkey + 2)::double end as image_y, case when s_suppkey % 4 <> 0 then s_suppkey end as catalog_id, case when s_suppkey % 4 <> 0 then s_suppkey / -8.0::double end as dec from supplier""",
    "synthetic_field": f"with {PATCH_SQL}, {_FIELDS} select frame_id, source_idx, id, round(x_px, 3) + 0 as x_px, round(y_px, 3) + 0 as y_px from sources",
    "candidate_patterns": _CANDIDATES,
    "parsed_requests": """select s_suppkey, case s_suppkey % 4 when 0 then 1 when 1 then 2 when 2 then 0 end as n, case when s_suppkey % 4 < 2 then s_suppkey::double end as x, case when s_suppkey % 4 < 2 then s_suppkey % 7 + 0.5::double end as flux,
  case when s_suppkey % 4 = 1 then 20.5::double end as estimate, case when s_suppkey % 4 = 2 then 10.0::double end as timeout, s_suppkey % 4 < 2 as valid from supplier""",
    "request_round_trip": "select s_suppkey, s_suppkey::double as x, case when s_suppkey % 3 <> 0 then s_suppkey / 4.0::double end as flux, case when s_suppkey % 2 = 0 then 1000.0::double end as timeout from supplier",
    "result_envelopes": "select s_suppkey, case when s_suppkey % 3 = 0 then 'error' else 'result' end as kind, false as success, case when s_suppkey % 3 <> 0 then 'No sources in frame ' || s_suppkey end as first_line from supplier",
}
QUERIES = {f.__name__: f for f in (centroid_fluxes, app_stars, candidate_patterns, plate_solve, synthetic_field, parsed_requests, request_round_trip, result_envelopes)}
