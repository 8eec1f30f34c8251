"""Solve requests as a stream: JSON lines in, results out, a micro-batch at a time; of a frame's requests the latest wins."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyquad.session import Solver
from skyquad.sources import requests

LINE = "frame_id long, generation long, width int, height int, body string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of LINE of files with one JSON object a line, whose body can be read as a request. generation is the sender's number of the request; a missing one is 0."""
    lines = spark.readStream.schema(LINE).json(folder)
    return lines.withColumn("generation", F.coalesce("generation", F.lit(0))).filter(requests.parse_request(F.col("body")).isNotNull())


def latest(stream: DataFrame) -> DataFrame:
    """The rows of a stream that no later request of their frame has overtaken: of a batch the one with the greatest generation, if it is above that of all batches before.

    The state of a frame is that one number, kept with the query's checkpoint,
    so it holds after a restart. Of requests with equal generation in a batch
    the greatest body is taken, so that a repeated batch gives the same.
    """

    def newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, best = state.get[0] if state.exists else None, None
        for frame in frames:
            row = frame.sort_values(["generation", "body"]).iloc[[-1]]
            order: Any = (row["generation"].iloc[0], row["body"].iloc[0])
            if best is None or order > best[0]:
                best = order, row
        if best is not None and (known is None or best[0][0] > known):
            state.update((int(best[0][0]),))
            yield best[1][[c.split()[0] for c in LINE.split(", ")]]

    return stream.groupBy("frame_id").applyInPandasWithState(newest, LINE, "generation long", "append", GroupStateTimeout.NoTimeout)


def frames(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sources and the requests of a batch with one request for each frame."""
    batch = batch.withColumn("request", requests.parse_request(F.col("body")))
    sources = batch.select("frame_id", F.posexplode("request.sources").alias("source_idx", "s")).select("frame_id", "source_idx", "s.x_px", "s.y_px", "s.flux")
    return sources, batch.select("frame_id", "width", "height", F.col("request.fov_estimate_deg").cast("double").alias("fov_estimate_deg"), F.col("request.fov_max_error_deg").cast("double").alias("fov_max_error_deg"))


def solve_stream(stream: DataFrame, solver: Solver, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Solves the latest requests of each micro-batch against the solver's database and writes results as Parquet with their generation, a folder for each batch, so that a repeated batch replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            found = solver.plan(*frames(batch)).join(batch.select("frame_id", "generation"), "frame_id")
            found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            batch.unpersist()

    writer = latest(stream).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def results(spark: SparkSession, out: str) -> DataFrame:
    """The result of each frame's latest request of all batches."""
    rows = spark.read.parquet(out).drop("batch")
    columns = [c for c in rows.columns if c != "frame_id"]
    return rows.groupBy("frame_id").agg(F.max_by(F.struct(*columns), "generation").alias("r")).select("frame_id", "r.*")
