"""A deadline and a stop that long work looks at, in the driver between jobs and in tasks between rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Watch:
    """until_ms: milliseconds since 1970 after which nothing is wanted any more; stopped raises once someone has given up."""

    def __init__(self, until_ms: int | None = None, stopped: Callable[[], None] = lambda: None):
        self.until_ms, self.stopped = until_ms, stopped

    def check(self) -> None:
        self.stopped()
        if self.until_ms is not None and time.time() * 1000 > self.until_ms:
            raise TimeoutError("the deadline has passed")

    def guarded(self, df: DataFrame) -> DataFrame:
        """df, whose tasks fail at the first row that they come to after the deadline: no task works on for a driver that cannot reach it."""
        if self.until_ms is None:
            return df
        clock = F.reflect(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("long")
        return df.filter(F.when(clock <= self.until_ms, True).otherwise(F.raise_error(F.lit("the deadline has passed")).cast("boolean")))
