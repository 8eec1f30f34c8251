"""A solver that is loaded once and asked often, with a time limit and cancellation."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyquad.errors import AlreadyLoaded, Cancelled, NoDatabase, NoSources, TimedOut
from skyquad.operators import matching, solve
from skyquad.operators.watch import Watch
from skyquad.sources import binary, requests, store

#: Buckets of a stored index, and the number of its layout: a change of what is stored takes another.
BUCKETS, LAYOUT = 16, 1
#: Fixed values of the app: milliseconds for all of a request, and what solving has at least.
TOTAL_MS, LEAST_MS = 30_000, 1_000


def remaining_ms(elapsed_ms: float) -> float:
    return max(LEAST_MS, TOTAL_MS - elapsed_ms)


def database_summary(stars: DataFrame, patterns: DataFrame, properties: dict) -> dict:
    """Counts, columns, types and properties of a pattern archive."""
    nonzero = F.count_if((F.col("s0") != 0) | (F.col("s1") != 0) | (F.col("s2") != 0) | (F.col("s3") != 0))
    p = patterns.agg(F.count(F.lit(1)).alias("n"), nonzero.alias("nonzero")).first()
    return {"stars": stars.count(), "patterns": p["n"], "nonzero_patterns": p["nonzero"], "star_columns": dict(stars.dtypes), "pattern_columns": dict(patterns.dtypes), "properties": properties}


class Solver:
    """Holds a database's stars and pattern index; solves frames of sources.

    A newer request cancels the one that runs: the latest wins. A result that
    is not there when time is up or a cancel comes is given up.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.loaded, self.tag, self.lock = spark, None, None, threading.Lock()

    def ping(self) -> str:
        return "pong"

    def load(self, path: str, cache: str | None = None) -> None:
        """Takes a database's header, stars and pattern index.

        The index is built and stored once for a content: under cache, or a
        folder of the shared one, it is found again by any session and for any
        path with the same bytes, and read from its buckets.
        """
        if self.loaded:
            raise AlreadyLoaded("unload the database first")
        header, stars, patterns = (binary.read_adb(self.spark, path, s) for s in ("header", "stars", "patterns"))
        name = binary.fingerprint(self.spark, path)
        folder, bins = f"{cache or store.shared_base(self.spark) + '/prepared'}/{LAYOUT}-{name}", header.first()["pattern_bins"]
        if not store.exists(self.spark, f"{folder}/ready"):
            part = f"{folder}/{uuid.uuid4().hex}"  # another session may build it at the same time: the last to end is found
            stars.write.parquet(f"{part}/stars")
            index = matching.pattern_index(self.spark.read.parquet(f"{part}/stars"), patterns, bins)
            matching.write_pattern_index(index, f"index_{uuid.uuid4().hex}", f"{part}/index", BUCKETS)
            self.spark.range(1).select(F.lit(part).alias("part")).write.mode("overwrite").parquet(f"{folder}/ready")
        part = self.spark.read.parquet(f"{folder}/ready").first()["part"]
        self.loaded = header, self.spark.read.parquet(f"{part}/stars"), matching.open_pattern_index(self.spark, f"index_{part.rsplit('/', 1)[1]}", f"{part}/index", BUCKETS), bins

    def use(self, header: DataFrame, stars: DataFrame, index: DataFrame, bins: int = 50) -> None:
        """Takes tables that are there already, such as an index written before."""
        if self.loaded:
            raise AlreadyLoaded("unload the database first")
        self.loaded = header, stars, index, bins

    def unload(self) -> None:
        self.loaded = None

    def cancel(self) -> None:
        with self.lock:
            if self.tag:
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
                self.tag = None

    def plan(self, sources: DataFrame, wanted: DataFrame, watch: Watch | None = None) -> DataFrame:
        """The results of many frames; watch is looked at between jobs and in tasks."""
        if not self.loaded:
            raise NoDatabase("no database is loaded")
        header, stars, index, bins = self.loaded
        return solve.solve(sources, wanted, stars, index, header, bins, watch or Watch())

    def solve(self, sources: DataFrame, wanted: DataFrame, timeout_ms: float | None = None) -> list:
        """The results' rows; no limit if timeout_ms is None or not above 0."""
        return self._solved(sources, wanted, timeout_ms)[0]

    def _solved(self, sources: DataFrame, wanted: DataFrame, timeout_ms: float | None) -> tuple[list, StructType]:
        self.cancel()
        context, tag = self.spark.sparkContext, f"solve-{uuid.uuid4().hex}"
        context.setInterruptOnCancel(True)
        with self.lock:
            self.tag = tag
        began, late, done = time.monotonic(), threading.Event(), threading.Event()

        def expire() -> None:
            late.set()
            context.cancelJobsWithTag(tag)
            while not done.wait(0.2):  # a solve starts one job after the other
                context.cancelJobsWithTag(tag)

        def stopped() -> None:
            if late.is_set() or self.tag != tag:
                raise Cancelled("given up")

        timer, until = None, None
        if timeout_ms and timeout_ms > 0:
            timer, until = threading.Timer(timeout_ms / 1000, expire), int(time.time() * 1000 + timeout_ms)
            timer.start()
        context.addJobTag(tag)
        try:
            watch = Watch(until, stopped)
            plan = self.plan(sources, wanted, watch)
            rows = plan.collect()
            watch.check()  # what was found is given up if time is up or a cancel has come
            return rows, plan.schema
        except NoDatabase:
            raise
        except Exception as e:
            if late.is_set() or until is not None and time.time() * 1000 > until:
                raise TimedOut(f"no result within {timeout_ms} ms ({(time.monotonic() - began) * 1000:.0f} ms)") from e
            if self.tag != tag:
                raise Cancelled("the solve was cancelled or superseded") from e
            raise
        finally:
            done.set()
            context.removeJobTag(tag)
            if timer:
                timer.cancel()

    def solve_json(self, body: str, width: int, height: int) -> str:
        """A request's JSON in, a result's JSON out, with its time in milliseconds.

        What has passed is taken off the app's budget, which limits the solve
        unless the request has a limit of its own. No database, an unreadable
        request, a cancel and a timeout give an error's or a failure's JSON.
        """
        began = time.monotonic()
        passed = lambda: (time.monotonic() - began) * 1000
        text = lambda c: self.spark.range(1).select(c).first()[0]
        if not self.loaded:
            return text(requests.error(F.lit("the database is not ready")))
        one = self.spark.createDataFrame([(body,)], "body string").select(requests.parse_request(F.col("body")).alias("q"))
        q = one.first()["q"]
        if q is None:
            return text(requests.error(F.lit("the request cannot be read")))
        rows = [(0, i, s["x_px"], s["y_px"], s["flux"]) for i, s in enumerate(q["sources"])]
        if not rows:
            return text(requests.failure(F.array(F.lit(str(NoSources("No sources provided."))))))
        sources = self.spark.createDataFrame(rows, "frame_id long, source_idx int, x_px double, y_px double, flux double")
        wanted = self.spark.createDataFrame([(0, width, height, q["fov_estimate_deg"], q["fov_max_error_deg"])], "frame_id long, width int, height int, fov_estimate_deg double, fov_max_error_deg double")
        limit = q["solve_timeout_ms"] if q["solve_timeout_ms"] is not None else remaining_ms(passed())
        try:
            found, schema = self._solved(sources, wanted, limit)
        except (Cancelled, TimedOut) as e:
            return text(requests.failure(F.array(F.lit(str(e)))))
        return self.spark.createDataFrame(found, schema).drop("frame_id").select(F.to_json(F.struct("*", F.lit(int(passed())).cast("long").alias("solve_time_ms")))).first()[0]
