"""Figures of queries: aggregates that come for free while one runs, and counts and times over many."""

import time
from bisect import bisect_left
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def observed(df: DataFrame, **figures) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation whose get holds the row count and the named aggregates once an action has run."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(column.alias(name) for name, column in figures.items())), seen


class Meter:
    """Counts calls by name and outcome, and their seconds in buckets."""

    def __init__(self, bounds: tuple[float, ...] = (0.01, 0.05, 0.1, 0.5, 1, 5, 10, 60)):
        self.bounds, self.calls, self.lock = tuple(sorted(bounds)), {}, Lock()

    @contextmanager
    def timed(self, name: str):
        """Times its block, which has to hold the action. An error counts as one and goes on."""
        began, failed = time.perf_counter(), True
        try:
            yield
            failed = False
        finally:
            self.add(name, time.perf_counter() - began, failed)

    def add(self, name: str, seconds: float, failed: bool = False) -> None:
        with self.lock:
            c = self.calls.setdefault(name, [0, 0, 0.0, [0] * (len(self.bounds) + 1)])
            c[0] += 1
            c[1] += failed
            c[2] += seconds
            c[3][bisect_left(self.bounds, seconds)] += 1

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, n, n_failed, seconds, at_most, n_at_most): a row for each bucket, counts including the smaller ones; null stands for no bound."""
        with self.lock:
            rows = [(k, n, bad, total, bound, sum(b[: i + 1])) for k, (n, bad, total, b) in sorted(self.calls.items()) for i, bound in enumerate([*map(float, self.bounds), None])]
        return spark.createDataFrame(rows, "name string, n long, n_failed long, seconds double, at_most double, n_at_most long")
