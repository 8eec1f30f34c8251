"""Star detection on images, and its evaluation.

An image is rows (frame_id, y, x, r, g, b), or binary RGBA columns through
pixels(). Every step works on many frames at once, and only the greedy
evaluation takes a frame's stars as a whole. Pixels are often made from rows of
which there are far fewer, by whose size plans would broadcast them: joins with
pixels ask for a merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquad.operators.components import labelled
from skyquad.sources.store import written

#: Fixed defaults of the detector: blur radius, threshold in noise levels, component limits, most stars.
BLUR, SIGMA, MIN_RADIUS, MAX_RADIUS, MIN_FLUX, MIN_PIXELS, MAX_STARS = 15, 5.0, 1.0, 50.0, 100.0, 3, 50


def pixels(images: DataFrame) -> DataFrame:
    """Rows (frame_id, y, x, r, g, b) of images (frame_id, width, height, rgba binary)."""

    def unrolled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples(index=False):
                px = np.frombuffer(f.rgba, dtype=np.uint8).reshape(f.height, f.width, 4).reshape(-1, 4)
                at = np.arange(len(px))
                yield pd.DataFrame({"frame_id": f.frame_id, "y": at // f.width, "x": at % f.width, "r": px[:, 0], "g": px[:, 1], "b": px[:, 2]})

    return images.select("frame_id", "width", "height", "rgba").mapInPandas(unrolled, "frame_id long, y int, x int, r int, g int, b int")


def decoded(encoded: DataFrame) -> DataFrame:
    """images (frame_id, width, height, rgba) of rows (frame_id, png): PNG bytes, or their base64 text. Needs Pillow on the executors."""
    if dict(encoded.dtypes)["png"] == "string":
        encoded = encoded.withColumn("png", F.unbase64("png"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from PIL import Image

        for batch in batches:
            opened = [Image.open(io.BytesIO(p)).convert("RGBA") for p in batch["png"]]
            yield pd.DataFrame({"frame_id": batch["frame_id"], "width": [i.width for i in opened], "height": [i.height for i in opened], "rgba": [i.tobytes() for i in opened]})

    return encoded.select("frame_id", "png").mapInPandas(decode, "frame_id long, width int, height int, rgba binary")


#: The width that a photo is brought to before stars are looked for.
WIDTH = 1024


def resized(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pixels (frame_id, y, x, r, g, b) of images brought to a width, heights in proportion, as rounded means over the area of each new pixel.

    A pixel adds to the new ones that it overlaps, along lines first and then
    across them, by the shares that it overlaps: two grouped sums. A frame's
    size is that of its largest coordinates.
    """
    size = rows.groupBy("frame_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    size = size.withColumn("_high", F.greatest(F.lit(1), F.round(F.col("_h") * F.lit(float(width)) / F.col("_w")).cast("int")))

    def along(df: DataFrame, c: str, old: str, new: Column) -> DataFrame:
        step = F.col(old) / new
        first, last = F.floor(F.col(c) / step), F.least(new - 1, F.ceil((F.col(c) + 1) / step) - 1)
        df = df.withColumn("_to", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        share = F.greatest(F.lit(0.0), F.least(F.col(c) + 1, (F.col("_to") + 1) * step) - F.greatest(F.col(c), F.col("_to") * step)) / step
        df = df.withColumn("_share", share).drop(c).withColumnRenamed("_to", c)
        return df.groupBy("frame_id", "_w", "_h", "_high", "y", "x").agg(*[F.sum(F.col(k) * F.col("_share")).alias(k) for k in "rgb"])

    out = rows.join(size.hint("merge"), "frame_id").select("frame_id", "_w", "_h", "_high", "y", "x", *[F.col(k).cast("double").alias(k) for k in "rgb"])
    out = along(along(out, "x", "_w", F.lit(width)), "y", "_h", F.col("_high"))
    # a hair above a half, so that the order in which shares are added decides no rounding
    return out.select("frame_id", "y", "x", *[F.floor(F.col(k) + 0.5 + 1e-9).cast("int").alias(k) for k in "rgb"])


def random_stars(frames: DataFrame, count: int, seed: int = 0, margin: float = 20.0, flux: tuple[float, float] = (50.0, 200.0), sigma: tuple[float, float] = (1.0, 2.5)) -> DataFrame:
    """(frame_id, star_idx, x, y, flux, sigma): count true stars at random places of each of frames (frame_id, width, height), none nearer to an edge than margin. A hash of seed, frame and star draws, so reruns agree."""
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "frame_id", "star_idx"), F.lit(1 << 52)) / float(1 << 52)
    between = lambda k, lo, hi: draw(k) * (hi - lo) + lo
    each = frames.withColumn("star_idx", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))) if count > 0 else frames.limit(0).withColumn("star_idx", F.lit(0))
    place = lambda k, side: draw(k) * (F.col(side) - 2 * margin) + margin
    return each.select("frame_id", "star_idx", place(0, "width").alias("x"), place(1, "height").alias("y"), between(2, *flux).alias("flux"), between(3, *sigma).alias("sigma"))


def gray(r: Column, g: Column, b: Column) -> Column:
    return (r * 0.299 + g * 0.587 + b * 0.114).cast("float")


def _blurred(rows: DataFrame, value: str, along: str, across: str, radius: int) -> DataFrame:
    """The mean of 2 radius + 1 values along an axis; the edge's value stands for what is beyond it."""
    line = Window.partitionBy("frame_id", across).orderBy(along)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inner = F.sum(F.col(value).cast("double")).over(line.rowsBetween(-radius, radius))
    last = F.max(along).over(whole)
    before, after = F.greatest(F.lit(radius) - F.col(along), F.lit(0)), F.greatest(F.col(along) + radius - last, F.lit(0))
    total = inner + before * F.first(value).over(whole) + after * F.last(value).over(whole)
    return rows.withColumn(value, (total / F.lit(float(2 * radius + 1))).cast("float"))


def box_blur(rows: DataFrame, value: str = "gray", radius: int = BLUR) -> DataFrame:
    """rows with blur: the mean of value over a square, by rows and then by columns, in single precision."""
    out = rows.withColumn("blur", F.col(value))
    return _blurred(_blurred(out, "blur", "x", "y", radius), "blur", "y", "x", radius)


def above_background(rows: DataFrame, radius: int = BLUR) -> DataFrame:
    """(frame_id, y, x, sub): gray less its blur, not below 0."""
    out = box_blur(rows.withColumn("gray", gray(F.col("r"), F.col("g"), F.col("b"))), "gray", radius)
    return out.select("frame_id", "y", "x", F.greatest(F.lit(0.0).cast("float"), (F.col("gray") - F.col("blur")).cast("float")).alias("sub"))


def noise(rows: DataFrame, step: int = 10) -> DataFrame:
    """(frame_id, noise): 1.4826 times the median deviation from the median of every step-th pixel above 0, upper medians; 1 without such pixels."""
    size = rows.groupBy("frame_id").agg((F.max("x") + 1).alias("width"))
    some = rows.join(size.hint("merge"), "frame_id").filter(((F.col("y") * F.col("width") + F.col("x")) % step == 0) & (F.col("sub") > 0))

    def upper(df: DataFrame, value: str, name: str) -> DataFrame:
        frame = Window.partitionBy("frame_id")
        at = df.withColumns({"_k": F.row_number().over(frame.orderBy(value)), "_n": F.count(F.lit(1)).over(frame)})
        return at.filter(F.col("_k") == F.floor(F.col("_n") / 2) + 1).select("frame_id", F.col(value).cast("double").alias(name))

    middle = upper(some, "sub", "median")
    off = some.join(middle.hint("merge"), "frame_id").withColumn("off", F.abs(F.col("sub").cast("double") - F.col("median")))
    mad = upper(off, "off", "mad")
    return size.select("frame_id").join(mad.hint("merge"), "frame_id", "left").select("frame_id", F.coalesce(F.col("mad") * 1.4826, F.lit(1.0)).alias("noise"))


def lit(rows: DataFrame, sigma: float = SIGMA) -> DataFrame:
    return rows.join(noise(rows).hint("merge"), "frame_id").filter(F.col("sub") > F.col("noise") * sigma).drop("noise")


def stars_of(rows: DataFrame, least_flux: float = MIN_FLUX, least_radius: float = MIN_RADIUS, most_radius: float = MAX_RADIUS) -> DataFrame:
    """(frame_id, label, x, y, flux, radius, n) of labelled pixels: brightness-weighted centres of components of the right size."""
    s = F.col("sub").cast("double")
    out = rows.groupBy("frame_id", "label").agg((F.sum(F.col("x") * s) / F.sum(s)).alias("cx"), (F.sum(F.col("y") * s) / F.sum(s)).alias("cy"), F.sum(s).alias("flux"), (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) / 2).alias("radius"), F.count(F.lit(1)).alias("n"))
    return out.filter((F.col("n") >= MIN_PIXELS) & (F.col("flux") >= least_flux) & F.col("radius").between(least_radius, most_radius)).withColumnsRenamed({"cx": "x", "cy": "y"})


def brightest(stars: DataFrame, most: int = MAX_STARS) -> DataFrame:
    order = Window.partitionBy("frame_id").orderBy(F.col("flux").desc(), "label")
    return stars.withColumn("source_idx", F.row_number().over(order) - 1).filter(F.col("source_idx") < most)


def detect(rows: DataFrame, sigma: float = SIGMA, most: int = MAX_STARS, least_flux: float = MIN_FLUX) -> DataFrame:
    """From pixels to sources: (frame_id, source_idx, x_px, y_px, flux). Pixels above their background are read several times, so they are written once."""
    found = brightest(stars_of(labelled(lit(written(above_background(rows), "above_background"), sigma)), least_flux), most)
    return found.select("frame_id", "source_idx", F.col("x").alias("x_px"), F.col("y").alias("y_px"), "flux")


def render(frames: DataFrame, stars: DataFrame, noise_sigma: float = 0.0, seed: int = 0) -> DataFrame:
    """Pixels of frames (frame_id, width, height, background) with stars (frame_id, x, y, flux, sigma) drawn on them.

    A star adds a rounded Gaussian within three sigma; a pixel holds 255 at
    most. As nothing is ever taken away, the order of the stars is of no account.
    Frames and stars meet by lines, each with the lights of its pixels, so that
    pixels are neither shuffled nor sorted; a line is the largest group.
    """
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = frames.repartition(parts, "frame_id").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    reach = F.ceil(F.col("sigma") * 3)
    near = lambda c: F.explode(F.sequence((F.floor(c) - reach).cast("int"), (F.ceil(c) + reach).cast("int")))
    s = stars.withColumnsRenamed({"x": "sx", "y": "sy"}).withColumn("y", near(F.col("sy"))).withColumn("x", near(F.col("sx")))
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    light = F.round(F.col("flux") * F.exp((dx * dx + dy * dy) / (F.col("sigma") * F.col("sigma")) * -0.5))
    added = s.filter((F.abs(dx) <= reach) & (F.abs(dy) <= reach)).groupBy("frame_id", "y", "x").agg(F.sum(light).alias("light"))
    lights = added.groupBy("frame_id", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "light"))).alias("lights"))
    grid = lines.join(lights.hint("merge"), ["frame_id", "y"], "left").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    base = F.col("background") + (F.round(F.randn(seed) * noise_sigma) if noise_sigma else F.lit(0.0))
    value = F.least(F.lit(255.0), F.greatest(F.lit(0.0), base) + F.coalesce(F.col("lights")[F.col("x")], F.lit(0.0))).cast("int")
    return grid.select("frame_id", "y", "x", value.alias("v")).select("frame_id", "y", "x", *[F.col("v").alias(c) for c in "rgb"])


def evaluated(detected: DataFrame, truth: DataFrame, most_px: float = 3.0) -> DataFrame:
    """(frame_id, source_idx, star_idx, error_px): each detection, brightest first, takes the nearest true star that is still free, if within most_px."""
    d = detected.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("flux")).alias("f"), "source_idx", "x_px", "y_px"))).alias("d"))
    t = truth.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("star_idx", "x", "y"))).alias("t"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for frame, dets, stars in zip(batch["frame_id"], batch["d"], batch["t"], strict=True):
                free = {s["star_idx"]: (s["x"], s["y"]) for s in stars}
                for q in dets:
                    best = min(((np.hypot(q["x_px"] - x, q["y_px"] - y), k) for k, (x, y) in free.items()), default=None)
                    if best and best[0] <= most_px:
                        free.pop(best[1])
                        out.append((frame, q["source_idx"], best[1], float(best[0])))
            yield pd.DataFrame(out, columns=["frame_id", "source_idx", "star_idx", "error_px"])

    return d.join(t.hint("merge"), "frame_id").mapInPandas(match, "frame_id long, source_idx int, star_idx int, error_px double")


def missed(truth: DataFrame, matches: DataFrame) -> DataFrame:
    return truth.join(matches.select("frame_id", "star_idx"), ["frame_id", "star_idx"], "left_anti")


def false_positives(detected: DataFrame, matches: DataFrame) -> DataFrame:
    return detected.join(matches.select("frame_id", "source_idx"), ["frame_id", "source_idx"], "left_anti")


def metrics(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """(frame_id, n_true, n_matched, mean_error, max_error, match_rate); without matches the largest error is infinite and the mean 0."""
    m = matches.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_matched"), F.avg("error_px").alias("mean_error"), F.max("error_px").alias("max_error"))
    t = truth.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_true")).join(m.hint("merge"), "frame_id", "left")
    return t.select("frame_id", "n_true", F.coalesce("n_matched", F.lit(0)).alias("n_matched"), F.coalesce("mean_error", F.lit(0.0)).alias("mean_error"), F.coalesce("max_error", F.lit(float("inf"))).alias("max_error"), F.coalesce(F.col("n_matched") / F.col("n_true"), F.lit(0.0)).alias("match_rate"))
