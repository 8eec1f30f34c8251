"""Requests and results as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE = "struct<x_px: double, y_px: double, flux: double>"
REQUEST = f"struct<sources: array<{SOURCE}>, fov_estimate_deg: float, fov_max_error_deg: float, solve_timeout_ms: double>"
RESULT = "struct<success: boolean, ra_deg: double, dec_deg: double, roll_deg: float, fov_x_deg: float, fov_y_deg: float, pixel_scale_arcsec: float, confidence: float, matched_stars: int, rms_error_arcsec: float, solve_time_ms: bigint, database_id: string, log: array<string>, detected_stars: array<struct<x_px: double, y_px: double, flux: double>>, matched_star_positions: array<struct<image_x: double, image_y: double, catalog_id: bigint, ra_deg: double, dec_deg: double>>>"


def parse_request(body: Column, need_sources: bool = False) -> Column:
    """A request of a JSON object, or of an array, which holds its sources only. Null if malformed, or if it has no sources and must have."""
    array = F.struct(F.from_json(body, f"array<{SOURCE}>").alias("sources"), F.lit(None).cast("float").alias("fov_estimate_deg"), F.lit(None).cast("float").alias("fov_max_error_deg"), F.lit(None).cast("double").alias("solve_timeout_ms"))
    whole = F.from_json(body, REQUEST)
    sources = whole["sources"] if need_sources else F.coalesce(whole["sources"], F.array().cast(f"array<{SOURCE}>"))
    plain = F.struct(sources.alias("sources"), whole["fov_estimate_deg"].alias("fov_estimate_deg"), whole["fov_max_error_deg"].alias("fov_max_error_deg"), whole["solve_timeout_ms"].alias("solve_timeout_ms"))
    ok = F.expr("true") if not need_sources else whole["sources"].isNotNull()
    valid = F.try_parse_json(body).isNotNull()
    return F.when(~valid, None).when(F.ltrim(body).startswith("["), array).when(ok, plain)


def build_request(sources: Column, estimate: Column, error: Column, timeout: Column) -> Column:
    return F.to_json(F.struct(sources.alias("sources"), estimate.alias("fov_estimate_deg"), error.alias("fov_max_error_deg"), timeout.alias("solve_timeout_ms")))


def failure(log: Column) -> Column:
    """A failed result's JSON: no numbers, nothing matched."""
    return F.to_json(F.struct(F.lit(False).alias("success"), F.lit(0.0).alias("confidence"), F.lit(0).alias("matched_stars"), F.lit(0).alias("solve_time_ms"), log.alias("log"), F.array().cast("array<string>").alias("detected_stars"), F.array().cast("array<string>").alias("matched_star_positions")))


def error(message: Column) -> Column:
    return F.to_json(F.struct(F.lit(False).alias("success"), message.alias("error")))


def parse_result(body: Column) -> Column:
    """A result under the names that apps use."""
    r = F.from_json(body, RESULT)
    names = {"success": "success", "ra_deg": "raDeg", "dec_deg": "decDeg", "roll_deg": "rollDeg", "fov_x_deg": "fovXDeg", "fov_y_deg": "fovYDeg", "pixel_scale_arcsec": "pixelScaleArcsec", "confidence": "confidence", "matched_stars": "matchedStars", "rms_error_arcsec": "rmsErrorArcsec", "solve_time_ms": "solveTimeMs", "database_id": "databaseId", "log": "log"}
    stars = F.transform(r["detected_stars"], lambda s: F.struct(s["x_px"].alias("x"), s["y_px"].alias("y"), F.coalesce(s["flux"], F.lit(0.0)).alias("flux")))
    return F.struct(*[r[a].alias(b) for a, b in names.items()], stars.alias("detectedStars"))


def envelope(body: Column) -> Column:
    """"error" for an error's envelope, else "result": by its tag, or where there is none by an error without any of a result's lists and times."""
    get = lambda k: F.get_json_object(body, f"$.{k}")
    old = get("error").isNotNull() & get("log").isNull() & get("detected_stars").isNull() & get("matched_star_positions").isNull() & get("solve_time_ms").isNull()
    return F.when(get("envelope").isNotNull(), F.when(get("envelope") == "error", "error").otherwise("result")).when(old, "error").otherwise("result")


def annotate(body: Column) -> Column:
    """The JSON object with its envelope's tag as the first field."""
    return F.concat(F.lit('{"envelope":"'), envelope(body), F.lit('",'), F.regexp_replace(F.trim(body), r"^\{\s*", ""))


def app_detected(stars: Column) -> Column:
    """A native result's detected stars under the names of the app; null is none."""
    named = F.transform(stars, lambda s: F.struct(s["x_px"].alias("x"), s["y_px"].alias("y"), s["brightness"].alias("flux")))
    return F.coalesce(named, F.array().cast("array<struct<x: double, y: double, flux: double>>"))


def app_matched(stars: Column) -> Column:
    """A native result's matched stars under the names of the app; null is none."""
    named = F.transform(stars, lambda s: F.struct(s["image_x"].alias("imageX"), s["image_y"].alias("imageY"), s["catalog_id"].alias("catalogId"), s["ra_deg"].alias("ra"), s["dec_deg"].alias("dec")))
    return F.coalesce(named, F.array().cast("array<struct<imageX: double, imageY: double, catalogId: bigint, ra: double, dec: double>>"))
