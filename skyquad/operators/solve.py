"""Plate solving: candidates are verified against all stars, and each frame's best solution becomes its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquad.functions import display
from skyquad.functions.vectors import Vec, with_plane
from skyquad.operators import fits, matching, points
from skyquad.operators.verify import MATCH_RADIUS, verified
from skyquad.operators.watch import Watch
from skyquad.sources.store import counted_side, written

#: Detections that an app asks for before it solves.
LEAST_SOURCES = 4


def best(found: DataFrame) -> DataFrame:
    """Each frame's solution with the most matches, then the least error, then the first candidate."""
    order = F.struct(F.col("matched"), -F.col("rms_arcsec"), -F.col("rank"), -F.col("variant"))
    return found.groupBy("frame_id").agg(F.max_by(F.struct(*found.columns), order).alias("r")).select("r.*")


def confidence(matched: Column, rms: Column) -> Column:
    return F.when((matched >= 8) & (rms < MATCH_RADIUS * 0.25), 0.95).when(matched >= 5, 0.75).when(matched >= 3, 0.5).otherwise(0.25).cast("float")


def within_estimate(fov_x: Column, fov_y: Column, estimate: Column, error: Column) -> Column:
    """Whether the larger side is near the estimate, in single precision; an unknown error is as wide as the estimate; no estimate lets all pass."""
    f = lambda c: c.cast("float")
    return estimate.isNull() | (F.abs(F.greatest(f(fov_x), f(fov_y)) - f(estimate)) <= f(F.coalesce(error, estimate)))


def results(solutions: DataFrame, requests: DataFrame, header: DataFrame) -> DataFrame:
    """One row for each request (frame_id, width, height, fov_estimate_deg, fov_max_error_deg): success, ra_deg, dec_deg, roll_deg, fov_x_deg, fov_y_deg, pixel_scale_arcsec, confidence, matched_stars, rms_error_arcsec, reason.

    header: one row (min_fov_deg, max_fov_deg). A request without a solution,
    or whose field is outside its estimate or the database's range, fails.
    """
    x = requests.join(solutions, "frame_id", "left").crossJoin(F.broadcast(header.select("min_fov_deg", "max_fov_deg").limit(1)))
    t = {k: F.col(k) for k in ("cx", "cy", "a", "b", "c", "d", "e", "f", "g", "h")}
    x, plane = with_plane(x, Vec.of("x", "y", "z"))
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    fx, fy = fits.field_of_view(t, plane, w, h, F.col("mirrored"))
    ra, dec = fits.centre_of_image(t, plane, w, h, F.col("mirrored"))
    x = x.withColumns({"_fx": fx, "_fy": fy, "_ra": ra, "_dec": dec, "_roll": fits.rotation_deg(fits.affine_part(t))})
    near = within_estimate(F.col("_fx"), F.col("_fy"), F.col("fov_estimate_deg"), F.col("fov_max_error_deg"))
    side = F.greatest("_fx", "_fy")
    reason = F.when(F.col("matched").isNull(), "no solution").when(side.isNull(), "edges behind the plane").when(~near, "outside the estimate").when(~side.between(F.col("min_fov_deg"), F.col("max_fov_deg")), "outside the database's range")
    x = x.withColumn("reason", reason)
    ok = lambda c: F.when(F.col("reason").isNull(), c)
    scale = (F.col("_fx") / w + F.col("_fy") / h) / 2 * 3600
    return x.select("frame_id", F.col("reason").isNull().alias("success"), ok(F.col("_ra")).alias("ra_deg"), ok(F.col("_dec")).alias("dec_deg"), ok(F.col("_roll")).cast("float").alias("roll_deg"), ok(F.col("_fx")).cast("float").alias("fov_x_deg"), ok(F.col("_fy")).cast("float").alias("fov_y_deg"), ok(scale).cast("float").alias("pixel_scale_arcsec"), F.coalesce(ok(confidence(F.col("matched"), F.col("rms_arcsec"))), F.lit(0.0).cast("float")).alias("confidence"), F.coalesce(ok(F.col("matched")), F.lit(0)).alias("matched_stars"), ok(F.col("rms_arcsec")).cast("float").alias("rms_error_arcsec"), "reason")


def detected_stars(sources: DataFrame) -> DataFrame:
    """(frame_id, n_sources, detected_stars): each frame's sources in their order, an unknown flux as 0."""
    one = F.struct("source_idx", F.col("x_px").cast("double").alias("x_px"), F.col("y_px").cast("double").alias("y_px"), F.coalesce("flux", F.lit(0.0)).alias("flux"))
    lists = sources.groupBy("frame_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    return lists.select("frame_id", F.size("s").alias("n_sources"), F.transform("s", lambda t: F.struct(t["x_px"].alias("x_px"), t["y_px"].alias("y_px"), t["flux"].alias("flux"))).alias("detected_stars"))


def matched_stars(solutions: DataFrame, sources: DataFrame, stars: DataFrame) -> DataFrame:
    """(frame_id, matched_star_positions): where each solution's stars are in the image and in the sky, with their ids in the catalog."""
    ra, dec = display.star_place_deg(F.col("ra_rad"), F.col("dec_rad"))
    places = stars.select("star_index", F.col("catalog_id").cast("long").alias("catalog_id"), ra.alias("ra_deg"), dec.alias("dec_deg"))
    met = solutions.select("frame_id", F.explode("matches").alias("m")).select("frame_id", "m.source_idx", "m.star_index").join(counted_side(places, matching.FEW_STARS), "star_index").join(sources.select("frame_id", "source_idx", F.col("x_px").cast("double").alias("image_x"), F.col("y_px").cast("double").alias("image_y")), ["frame_id", "source_idx"])
    lists = met.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("source_idx", "image_x", "image_y", "catalog_id", "ra_deg", "dec_deg"))).alias("m"))
    return lists.select("frame_id", F.transform("m", lambda t: F.struct(*[t[c].alias(c) for c in ("image_x", "image_y", "catalog_id", "ra_deg", "dec_deg")])).alias("matched_star_positions"))


def with_payload(found: DataFrame, requests: DataFrame, solutions: DataFrame, sources: DataFrame, stars: DataFrame, header: DataFrame) -> DataFrame:
    """Results with detected_stars (on every path), matched_star_positions (of those that succeed) and log.

    Frames with fewer than LEAST_SOURCES detections fail, whatever was found.
    """
    count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in header.columns else F.lit(None).cast("long")
    known = header.select(count("n_stars").alias("_stars"), count("n_patterns").alias("_patterns")).limit(1)
    x = found.join(detected_stars(sources), "frame_id", "left").join(matched_stars(solutions, sources, stars), "frame_id", "left").join(requests.select("frame_id", "width", "height"), "frame_id").crossJoin(F.broadcast(known))
    n = F.coalesce("n_sources", F.lit(0))
    few = n < LEAST_SOURCES
    reason = F.when(few, F.format_string("fewer than %d stars detected", F.lit(LEAST_SOURCES))).otherwise(F.col("reason"))
    x = x.withColumn("reason", reason).withColumn("success", F.col("reason").isNull())
    lines = F.concat(F.filter(display.steps_log(n, F.col("width"), F.col("height"), F.col("_stars"), F.col("_patterns")), lambda t: ~t.contains("null")), F.array(F.coalesce(F.concat(F.lit("Failed: "), F.col("reason")), F.format_string("Solved: %d stars matched", "matched_stars"))))
    x = x.withColumn("log", lines)
    none = lambda c: F.coalesce(F.when(F.col("success"), F.col(c)), F.array().cast(dict(x.dtypes)[c]))
    numbers = ["ra_deg", "dec_deg", "roll_deg", "fov_x_deg", "fov_y_deg", "pixel_scale_arcsec", "rms_error_arcsec"]
    kept = {c: F.when(F.col("success"), F.col(c)) for c in numbers} | {c: F.when(F.col("success"), F.col(c)).otherwise(F.lit(0).cast(dict(found.dtypes)[c])) for c in ("confidence", "matched_stars")}
    stars_of = F.coalesce("detected_stars", F.array().cast(dict(x.dtypes)["detected_stars"]))
    return x.withColumns(kept).withColumns({"detected_stars": stars_of, "matched_star_positions": none("matched_star_positions")}).select(*found.columns, "log", "detected_stars", "matched_star_positions")


def solve(sources: DataFrame, requests: DataFrame, stars: DataFrame, index: DataFrame, header: DataFrame, bins: int = 50, watch: Watch | None = None) -> DataFrame:
    """Solves many frames in one plan: quads, candidates from the index, verification, results with what they are made of. watch can end it between jobs and, at a deadline, in tasks."""
    watch = watch or Watch()
    watch.check()
    quads = written(watch.guarded(points.quads(sources, bin_size=1.0 / max(bins, 1))), "quads")  # read twice
    watch.check()
    found = written(watch.guarded(matching.candidates(quads, index)), "candidates")
    solutions = written(best(verified(found, sources, stars, watch=watch)), "solutions")  # a row for each frame
    watch.check()
    return with_payload(results(solutions, requests, header), requests, solutions, sources, stars, header)
