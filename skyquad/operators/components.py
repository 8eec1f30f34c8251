"""Connected components of lit pixels by runs, and of graphs in general, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquad.sources.store import forget, written

#: Pixels of a bucket in which runs of neighbouring lines look for each other.
BUCKET = 64
#: A run's number: its line and first pixel, so that the least number of a component is its first pixel by lines.
_LINE = 1 << 24


def runs(rows: DataFrame) -> DataFrame:
    """rows (frame_id, y, x, ...) with node, the number of the run of neighbouring pixels of a line that a pixel belongs to, and x1, the run's last pixel. A line is the largest group."""
    line = Window.partitionBy("frame_id", "y").orderBy("x")
    rows = rows.withColumn("_gap", F.col("x") - F.row_number().over(line))
    run = Window.partitionBy("frame_id", "y", "_gap")
    return rows.withColumns({"node": F.col("y").cast("long") * _LINE + F.min("x").over(run), "x1": F.max("x").over(run)}).drop("_gap")


def touching(found: DataFrame) -> DataFrame:
    """(frame_id, a, b) with a < b: runs (frame_id, node, x1) that touch runs of the line before, diagonally too.

    Runs are spread over the buckets that they and a pixel on either side lie
    in, so that a line with many runs is not compared with all of the next.
    """
    spread = lambda df, lo, hi: df.withColumn("bucket", F.explode(F.sequence(F.floor(lo / BUCKET), F.floor(hi / BUCKET))))
    first = F.col("node") % _LINE
    upper = spread(found.select("frame_id", F.expr(f"node div {_LINE} + 1").alias("line"), F.col("node").alias("a"), first.alias("a0"), F.col("x1").alias("a1")), F.col("a0") - 1, F.col("a1") + 1)
    lower = spread(found.select("frame_id", F.expr(f"node div {_LINE}").alias("line"), F.col("node").alias("b"), first.alias("b0"), F.col("x1").alias("b1")), F.col("b0"), F.col("b1"))
    met = upper.join(lower.hint("merge"), ["frame_id", "line", "bucket"]).filter("b0 <= a1 + 1 and b1 >= a0 - 1")
    return met.select("frame_id", "a", "b").distinct()


def connected(edges: DataFrame, by: str = "frame_id") -> DataFrame:
    """(by, node, label): for each node of edges (by, a, b) the least node that it is connected with.

    Two steps are repeated until nothing changes: every node hands its larger
    neighbours to the least of its neighbourhood, then its smaller ones to the
    least of them. Paths of any shape shrink in about as many rounds as the
    logarithm of their length. Minima are grouped sums of one number, so a node
    with a million neighbours is no group in memory.
    """
    now = written(edges.filter("a <> b").select(by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    told = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(by, "a", "b").cast("decimal(38,0)"))).first()
    before = told(now)
    while before[0]:
        both = now.unionByName(now.select(by, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(by, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least.hint("merge"), [by, "a"]).filter("b > a").select(by, F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "edges")
        least = large.groupBy(by, "a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), [by, "a"])
        small = small.select(by, F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select(by, "a", F.col("m").alias("b"))).distinct()
        after_rows = written(small, "edges")
        after = told(after_rows)
        forget(now)
        forget(large)
        now = after_rows
        if after == before:
            break
        before = after
    labels = now.groupBy(by, F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return labels.unionByName(labels.select(by, F.col("label").alias("node"), "label").distinct())


def labelled(rows: DataFrame) -> DataFrame:
    """rows with label: pixels that touch, diagonally too, share one, by which components are in the order of their first pixels.

    Runs stand for pixels, and runs for lines' neighbours; no frame meets in one
    task, so an image may be of any size.
    """
    held = written(runs(rows), "pixel_runs")
    each = held.select("frame_id", "node", "x1").distinct()
    labels = connected(touching(each))
    return held.join(labels.hint("merge"), ["frame_id", "node"], "left").withColumn("label", F.coalesce("label", "node")).drop("node", "x1")
