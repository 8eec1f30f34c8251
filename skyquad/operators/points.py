"""Image sources: the brightest, bounding boxes, centroids, least distances, quads.

Sources have the columns frame_id, source_idx, x_px, y_px, flux (null: unknown).
Every operator works on many frames at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquad.functions import hashes
from skyquad.sources.store import written

#: Fixed values of the solver.
MAX_SOURCES, MIN_BASELINE_PX, MAX_QUADS = 25, 5.0, 5000


def select_brightest(sources: DataFrame, most: int) -> DataFrame:
    """Up to most sources a frame with their place: all in input order if there are no more, else by flux, unknown flux last, ties in input order."""
    frame = Window.partitionBy("frame_id")
    by_flux = F.row_number().over(frame.orderBy(F.col("flux").desc_nulls_last(), "source_idx"))
    by_place = F.row_number().over(frame.orderBy("source_idx"))
    counted = sources.join(sources.groupBy("frame_id").agg(F.count(F.lit(1)).alias("_n")), "frame_id")
    place = F.when(F.col("_n") <= most, F.col("_p")).otherwise(F.col("_f"))
    return counted.withColumns({"_f": by_flux, "_p": by_place}).withColumn("place", place).filter(F.col("_f") <= F.greatest(F.lit(most), F.when(F.col("_n") <= most, F.col("_n")).otherwise(F.lit(0)))).drop("_n", "_f", "_p")


def brightest_for_quads(sources: DataFrame, most: int = MAX_SOURCES) -> DataFrame:
    """The most brightest sources a frame, unknown flux as 0, ties in input order; with their rank from 0."""
    order = Window.partitionBy("frame_id").orderBy(F.coalesce("flux", F.lit(0.0)).desc(), "source_idx")
    return sources.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < most)


def bounding_box(sources: DataFrame) -> DataFrame:
    """(frame_id, x_min, y_min, x_max, y_max) of each frame that has sources."""
    return sources.groupBy("frame_id").agg(*[f(c).alias(f"{c[0]}_{k}") for k, f in (("min", F.min), ("max", F.max)) for c in ("x_px", "y_px")])


def centroid(sources: DataFrame) -> DataFrame:
    """(frame_id, cx, cy): the mean place of each frame's sources."""
    return sources.groupBy("frame_id").agg(F.coalesce(F.avg("x_px"), F.lit(0.0)).alias("cx"), F.coalesce(F.avg("y_px"), F.lit(0.0)).alias("cy"))


def apart(sources: DataFrame, least_px: float) -> DataFrame:
    """Sources that keep least_px from all that were kept before them in their frame, in input order.

    Which ones stay depends on that order, so a frame is worked through by one
    task; frames are independent.
    """

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("source_idx")
        kept: list[int] = []
        xy = frame[["x_px", "y_px"]].to_numpy(float)
        for i in range(len(frame)):
            if not kept or (np.hypot(*(xy[kept] - xy[i]).T) >= least_px).all():
                kept.append(i)
        return frame.iloc[kept]

    return sources.groupBy("frame_id").applyInPandas(keep, sources.schema)


def quads(sources: DataFrame, most: int = MAX_SOURCES, least_px: float = MIN_BASELINE_PX, bin_size: float = 0.02) -> DataFrame:
    """(frame_id, i, j, k, l, points, quality, f, order, key): every four of a frame's brightest sources that have a key.

    The number of sources a frame is bounded first, so a frame has 12,650 quads
    at most; each join is within a frame, on the ranks' order.
    """
    top = brightest_for_quads(sources, most).select("frame_id", "rank", F.struct(F.col("x_px").cast("double").alias("x"), F.col("y_px").cast("double").alias("y"), F.coalesce("flux", F.lit(0.0)).alias("flux"), F.col("source_idx").alias("idx")).alias("s"))
    per = top.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "s"))), lambda t: t["s"]).alias("s"))  # at most `most` of them
    n = F.size("s")
    out = per.select("frame_id", "s", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).filter(n - F.col("i") >= 4)
    out = out.repartition("frame_id", "i")  # 25 small rows a frame, so that its quads are made by many tasks
    for a, b, left in (("i", "j", 3), ("j", "k", 2), ("k", "l", 1)):
        out = out.withColumn(b, F.explode(F.sequence(F.col(a) + 1, n - left)))
    points = F.array(*[F.get("s", F.col(c)) for c in "ijkl"])
    out = out.select("frame_id", "i", "j", "k", "l", points.alias("points"))
    p = [(F.col("points")[q]["x"], F.col("points")[q]["y"]) for q in range(4)]
    out = out.withColumns({f"d{q}": d for q, d in enumerate(hashes.pixel_distances(p))}).filter(F.greatest(*[f"d{q}" for q in range(6)]) >= least_px)
    quality = F.col("points")[0]["flux"] + F.col("points")[1]["flux"] + F.col("points")[2]["flux"] + F.col("points")[3]["flux"]
    out = hashes.with_key(out.withColumn("quality", quality), [F.col(f"d{q}") for q in range(6)], bin_size)
    return out.select("frame_id", "i", "j", "k", "l", "points", "quality", "f", "order", "key")


def first_wide(xs: np.ndarray, ys: np.ndarray, most: int, least_px: float) -> Iterator[tuple[int, int, int, int]]:
    """The first most combinations of four points, in lexical order, of which two are least_px apart or more.

    A combination is looked at through distances from its first three points to
    all later ones, so memory is a few numbers for each point. Points without a
    far one among those after them are found once, a block at a time, and passed
    over where the points before them decide nothing.
    """
    xs, ys = np.asarray(xs, dtype=float), np.asarray(ys, dtype=float)
    n, found = len(xs), 0
    far = lambda i: np.hypot(xs - xs[i], ys - ys[i]) >= least_px
    ahead: list[np.ndarray] = []  # whether a point has a far one after it

    def has_ahead() -> np.ndarray:
        if not ahead:
            step = max(1, (1 << 20) // n)
            parts = []
            for i in range(0, n, step):
                d = np.hypot(xs[i : i + step, None] - xs, ys[i : i + step, None] - ys) >= least_px
                parts.append((d & (np.arange(n) > np.arange(i, min(i + step, n))[:, None])).any(axis=1))
            ahead.append(np.concatenate(parts))
        return ahead[0]

    for i in range(n - 3):
        from_i = far(i)
        if not from_i[i + 1 :].any() and not has_ahead()[i + 1 :].any():
            return  # no two of the points that are left are far from each other
        for j in range(i + 1, n - 2):
            either = from_i | far(j)
            ks = range(j + 1, n - 1) if from_i[j] or either[j + 1 :].any() else j + 1 + np.flatnonzero(has_ahead()[j + 1 : n - 1])
            if not len(ks) and not from_i[i + 1 :].any() and not has_ahead()[j:].any():
                break  # nor with a later j
            for k in ks:
                hit = np.arange(k + 1, n) if from_i[j] or either[k] else k + 1 + np.flatnonzero(either[k + 1 :] | far(k)[k + 1 :])
                for m in hit[: most - found]:
                    yield i, j, int(k), int(m)
                found += min(len(hit), most - found)
                if found >= most:
                    return


def early_quads(sources: DataFrame, most_quads: int = MAX_QUADS, least_px: float = MIN_BASELINE_PX) -> DataFrame:
    """(frame_id, i, j, k, l, f): the first most_quads combinations of a frame's sources, in input order, that are wide enough; f is null for points that coincide.

    Combinations are made from the frame's leading sources, of which those that
    begin with its first three are enough unless too few of them are wide
    enough; only frames of which that is so are then gone through whole.
    """
    leading = most_quads + 3

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for frame, xs, ys, more in zip(f["frame_id"], f["xs"], f["ys"], f["more"], strict=True):
                found = list(first_wide(xs, ys, most_quads, least_px))
                if more and (len(found) < most_quads or found[-1][2] > 2):
                    rows.append((frame, -1, 0, 0, 0, [], []))  # later sources may come before some of these
                else:
                    rows += [(frame, *c, [xs[q] for q in c], [ys[q] for q in c]) for c in found]
            yield pd.DataFrame(rows, columns=["frame_id", "i", "j", "k", "l", "xs", "ys"])

    def made(rows: DataFrame, more: Column) -> DataFrame:
        lists = rows.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("source_idx", F.col("x_px").cast("double").alias("x"), F.col("y_px").cast("double").alias("y")))).alias("s"))
        lists = lists.select("frame_id", F.col("s.x").alias("xs"), F.col("s.y").alias("ys"), more.alias("more"))
        return lists.mapInPandas(first, "frame_id long, i int, j int, k int, l int, xs array<double>, ys array<double>")

    order = Window.partitionBy("frame_id").orderBy(*[F.col(c).asc_nulls_last() for c in ("source_idx", "x_px", "y_px")])
    head = sources.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= leading + 1)
    early = written(made(head, F.size("s") > leading), "early_quads")
    rest = early.filter("i < 0").select("frame_id")
    out = early.filter("i >= 0")
    if rest.limit(1).count():
        out = out.unionByName(made(sources.join(rest, "frame_id", "left_semi"), F.lit(False)))
    points = F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return out.select("frame_id", "i", "j", "k", "l", hashes.signed_feature(points).alias("f"))


def with_fluxes(centroids: Column, fluxes: Column) -> Column:
    """Array of (x_px, y_px, brightness) of centroids (y, x) and fluxes by position: a missing or unknown flux is 1, and 1 is the most."""
    return F.transform(centroids, lambda c, i: F.struct(c["x"].alias("x_px"), c["y"].alias("y_px"), F.least(F.lit(1.0), F.coalesce(F.get(fluxes, i), F.lit(1.0))).alias("brightness")))
