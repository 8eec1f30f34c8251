"""Queries on images."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquad.functions import display
from skyquad.operators import detect
from skyquad.plans.catalog_queries import r
from skyquad.plans.tables import HIGH, RASTER_SQL, WIDE, load, raster


def gray_pixels(spark, sf_dir):
    return raster(spark, sf_dir).select("frame_id", "y", "x", F.round(detect.gray(F.col("r"), F.col("g"), F.col("b")).cast("double"), 3).alias("gray"))


def blurred_pixels(spark, sf_dir):
    rows = raster(spark, sf_dir).withColumn("gray", F.col("r").cast("float"))
    return detect.box_blur(rows, "gray").select("frame_id", "y", "x", r(F.col("blur").cast("double"), 3).alias("blur"))


def image_noise(spark, sf_dir):
    return detect.noise(raster(spark, sf_dir).select("frame_id", "y", "x", (F.col("r") + F.col("g")).cast("float").alias("sub"))).select("frame_id", r(F.col("noise"), 6).alias("noise"))


def detected_sources(spark, sf_dir):
    found = detect.detect(raster(spark, sf_dir), sigma=4.0)
    return found.select("frame_id", "source_idx", *[r(F.col(c), 4).alias(c) for c in ("x_px", "y_px", "flux")])


def resized_pixels(spark, sf_dir):
    """Each image at a width of 20, from 48."""
    return detect.resized(raster(spark, sf_dir), 20)


def random_fields(spark, sf_dir):
    """Stars at random places of an image for each supplier: none is outside of its margin."""
    frames = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id"), (F.col("s_suppkey") % 7 * 10 + 100).alias("width"), F.lit(90).alias("height"))
    s = detect.random_stars(frames, 5, seed=3).join(frames, "frame_id")
    inside = F.col("x").between(20, F.col("width") - 20) & F.col("y").between(20, F.col("height") - 20) & F.col("flux").between(50, 200) & F.col("sigma").between(1.0, 2.5)
    return s.groupBy("frame_id").agg(F.count_if(inside).alias("inside"), F.count_distinct("x", "y").alias("places"))


def _truth(spark, sf_dir):
    """All suppliers as stars, twenty to a frame, on a grid."""
    k, place = F.col("s_suppkey"), F.col("s_suppkey") % 40
    return load(spark, sf_dir, "supplier").select((F.floor(k / 40) * 2 + k % 2).alias("frame_id"), k.alias("star_idx"), (F.floor(place / 2) % 5 * 40 + 20).cast("double").alias("x"), (F.floor(place / 10) * 35 + 20).cast("double").alias("y"), (k % 50 + 120).cast("double").alias("flux"), F.lit(2.0).alias("sigma"))


def rendered_field(spark, sf_dir, noise=0.0):
    truth = _truth(spark, sf_dir)
    frames = truth.select("frame_id").distinct().select("frame_id", F.lit(240).alias("width"), F.lit(180).alias("height"), F.lit(10).alias("background"))
    return detect.render(frames, truth, noise, seed=1)


def detection_metrics(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    found = detect.detect(rendered_field(spark, sf_dir, 2.0))
    m = detect.metrics(detect.evaluated(found, truth), truth)
    return m.select("frame_id", "n_true", "n_matched", (F.col("max_error") < 1.5).alias("close"), F.col("match_rate"))


def missed_and_false(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    found = truth.filter("star_idx % 4 <> 0").select("frame_id", F.col("star_idx").cast("int").alias("source_idx"), F.col("x").alias("x_px"), (F.col("y") + F.when(F.col("star_idx") % 5 == 0, 9.0).otherwise(1.0)).alias("y_px"), "flux")
    m = detect.evaluated(found, truth)
    miss = detect.missed(truth, m).select("frame_id", F.col("star_idx").cast("long").alias("idx"), F.lit("missed").alias("kind"))
    return miss.unionByName(detect.false_positives(found, m).select("frame_id", F.col("source_idx").cast("long").alias("idx"), F.lit("false").alias("kind")))


def overlay(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y = display.display_place((k * 7 % 1024).cast("double"), (k * 11 % 768).cast("double"), (1024, 768), (512, 384))
    return load(spark, sf_dir, "supplier").select("s_suppkey", x.alias("x"), y.alias("y"), r(display.brightness((k * 997).cast("double")), 6).alias("brightness"), r(display.error_px(k.cast("double")), 6).alias("error"))


_TRUTH = """truth as (select s_suppkey // 40 * 2 + s_suppkey % 2 as frame_id, s_suppkey as star_idx, ((s_suppkey % 40) // 2) % 5 * 40 + 20 as sx, ((s_suppkey % 40) // 10) * 35 + 20 as sy, (s_suppkey % 50 + 120)::double as flux from supplier),
steps as (select range - 6 as step from range(13)), light as (select frame_id, sx + a.step as x, sy + b.step as y, sum(round(flux * exp((a.step * a.step + b.step * b.step) / 4.0::double * -0.5::double))) as light from truth, steps a, steps b group by all),
rendered as (select f.frame_id, y.range::int as y, x.range::int as x, least(255, 10 + coalesce(light, 0))::int as v from (select distinct frame_id from truth) f cross join range(180) y cross join range(240) x left join light l on l.frame_id = f.frame_id and l.x = x.range and l.y = y.range)"""
_DETECTED = f"""with recursive {RASTER_SQL}, g as (select frame_id, y, x, (r * 0.299::double + g * 0.587::double + b * 0.114::double)::float as gray from raster), d as (select range - {detect.BLUR} as d from range({2 * detect.BLUR + 1})),
h as (select p.frame_id, p.y, p.x, (sum(q.gray::double) / {2 * detect.BLUR + 1}.0::double)::float as v from g p cross join d join g q on q.frame_id = p.frame_id and q.y = p.y and q.x = greatest(0, least({WIDE - 1}, p.x + d.d)) group by all),
b as (select p.frame_id, p.y, p.x, (sum(q.v::double) / {2 * detect.BLUR + 1}.0::double)::float as blur from h p cross join d join h q on q.frame_id = p.frame_id and q.x = p.x and q.y = greatest(0, least({HIGH - 1}, p.y + d.d)) group by all),
t as (select frame_id, y, x, greatest(0::float, gray - blur)::double as sub from g join b using (frame_id, y, x)), s as (select frame_id, sub from t where (y * {WIDE} + x) % 10 = 0 and sub > 0),
m as (select frame_id, list_sort(list(sub))[floor(count(*) / 2)::int + 1] as med from s group by frame_id),
o as (select frame_id, list_sort(list(abs(sub - med)))[floor(count(*) / 2)::int + 1] * 1.4826::double as noise from s join m using (frame_id) group by frame_id),
lit as (select frame_id, y, x, sub from t join o using (frame_id) where sub > noise * 4.0::double),
reach as (select frame_id, y, x, y * {WIDE} + x as label from lit union select p.frame_id, p.y, p.x, k.label from reach k join lit p on p.frame_id = k.frame_id and abs(p.y - k.y) <= 1 and abs(p.x - k.x) <= 1),
c as (select frame_id, label, sum(x * sub) / sum(sub) as x, sum(y * sub) / sum(sub) as y, sum(sub) as flux, greatest(max(x) - min(x), max(y) - min(y)) / 2.0::double as radius, count(*) as n from lit join (select frame_id, y, x, min(label) as label from reach group by all) using (frame_id, y, x) group by frame_id, label)
select frame_id, source_idx, round(x, 4) + 0 as x_px, round(y, 4) + 0 as y_px, round(flux, 4) + 0 as flux from (select *, row_number() over (partition by frame_id order by flux desc, label) - 1 as source_idx from c
  where n >= {detect.MIN_PIXELS} and flux >= {detect.MIN_FLUX} and radius between {detect.MIN_RADIUS} and {detect.MAX_RADIUS}) where source_idx < {detect.MAX_STARS}"""
SQL = {
    "detected_sources": _DETECTED,
    "rendered_field": f"with {_TRUTH} select frame_id, y, x, v as r, v as g, v as b from rendered",
    "gray_pixels": f"with {RASTER_SQL} select frame_id, y, x, round((r * 0.299::double + g * 0.587::double + b * 0.114::double)::float::double, 3) + 0 as gray from raster",
    "blurred_pixels": f"""with {RASTER_SQL}, d as (select range - 15 as d from range(31)),
h as (select p.frame_id, p.y, p.x, (sum(q.r) / 31.0::double)::float as v from raster p, d join raster q on true where q.frame_id = p.frame_id and q.y = p.y and q.x = greatest(0, least({WIDE - 1}, p.x + d.d)) group by all)
select p.frame_id, p.y, p.x, round((sum(q.v::double) / 31.0::double)::float::double, 3) + 0 as blur from h p, d join h q on true where q.frame_id = p.frame_id and q.x = p.x and q.y = greatest(0, least({HIGH - 1}, p.y + d.d)) group by all""",
    "image_noise": f"""with {RASTER_SQL}, s as (select frame_id, (r + g)::double as v from raster where (y * {WIDE} + x) % 10 = 0 and r + g > 0),
m as (select frame_id, list_sort(list(v))[floor(count(*) / 2)::int + 1] as med from s group by frame_id),
o as (select frame_id, list_sort(list(abs(v - med)))[floor(count(*) / 2)::int + 1] as mad from s join m using (frame_id) group by frame_id)
select frame_id, round(mad * 1.4826::double, 6) + 0 as noise from o""",
    "resized_pixels": f"""with {RASTER_SQL}, s as (select {WIDE} / 20.0::double as step, 13 as high, {HIGH} / 13.0::double as tall),
h as (select frame_id, y, t.range::int as x, {", ".join(f"sum({k} * (least(p.x + 1, (t.range + 1) * step) - greatest(p.x, t.range * step)) / step) as {k}" for k in "rgb")} from raster p, s, range(20) t where p.x < (t.range + 1) * step and p.x + 1 > t.range * step group by all)
select frame_id, t.range::int as y, x, {", ".join(f"floor(sum({k} * (least(h.y + 1, (t.range + 1) * tall) - greatest(h.y, t.range * tall)) / tall) + 0.500000001::double)::int as {k}" for k in "rgb")} from h, s, range(13) t where h.y < (t.range + 1) * tall and h.y + 1 > t.range * tall group by frame_id, t.range, x""",
    "random_fields": "select s_suppkey as frame_id, 5::bigint as inside, 5::bigint as places from supplier",
    "overlay": "select s_suppkey, (s_suppkey * 7 % 1024)::double * 0.5::double as x, (s_suppkey * 11 % 768)::double * 0.5::double as y, round(least(1.0::double, s_suppkey * 997 / 50000.0::double), 6) + 0 as brightness, round(s_suppkey / 3.0::double, 6) + 0 as error from supplier",
    "missed_and_false": """with t as (select s_suppkey // 40 * 2 + s_suppkey % 2 as frame_id, s_suppkey as idx from supplier)
select frame_id, idx, 'missed' as kind from t where idx % 4 = 0 or idx % 5 = 0 union all select frame_id, idx, 'false' from t where idx % 4 <> 0 and idx % 5 = 0""",
}
QUERIES = {f.__name__: f for f in (resized_pixels, random_fields, gray_pixels, blurred_pixels, image_noise, detected_sources, rendered_field, detection_metrics, missed_and_false, overlay)}
