"""A table of the library's own runs: what was moderated, how much was flagged, how long it took."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from textwarden.operators.moderation import observe_run, run_counters

COUNTERS = ("total_texts", "flagged_count", "clean_count", "skipped_count", "undecided_count")
RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("finished", T.TimestampType()),
        T.StructField("batch_size", T.LongType()),
        T.StructField("total_ms", T.DoubleType()),
        *[T.StructField(counter, T.LongType()) for counter in COUNTERS],
    ]
)
"""A run's row; ``batch_size`` and ``total_ms`` are the columns that ``evaluate.throughput`` reads."""


def _record(
    spark: SparkSession, path: str, run_id: str, name: str, batch: int | None, ms: float, counters: dict
) -> None:
    """Append one run. Every run is a file of its own, so runs recorded at the same time do not meet."""
    import datetime

    now = datetime.datetime.now()
    values = [counters.get(counter) or 0 for counter in COUNTERS]
    row = (run_id, name, batch, now, values[0], float(ms), *values)
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(path)


def recorded(moderated: DataFrame, write: Callable[[DataFrame], None], path: str, name: str = "moderation") -> dict:
    """Write moderated rows with ``write`` and append the run's counters and time to the runs table at ``path``.

    The rows are counted as they are written, in the same pass. Returns the counters. A run whose write fails
    is not recorded.
    """
    observed, observation = observe_run(moderated, f"{name}-{uuid.uuid4().hex}")
    start = time.perf_counter()
    write(observed)
    ms = (time.perf_counter() - start) * 1000
    counters = observation.get
    _record(moderated.sparkSession, path, uuid.uuid4().hex, name, None, ms, counters)
    return counters


def observe_stream(moderated: DataFrame, name: str = "moderation") -> DataFrame:
    """Count each micro-batch of a moderated stream for :class:`RunListener`."""
    return moderated.observe(name, *run_counters())


class RunListener(StreamingQueryListener):
    """Records every micro-batch of streams that are observed under ``name`` (:func:`observe_stream`).

    Add it with ``spark.streams.addListener``. A batch that is delivered again is recorded under the same
    query and batch number; :func:`read_runs` counts it once.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "moderation"):
        self.spark, self.path, self.name = spark, path, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(self.name)
        if row is None:
            return
        counters = row.asDict()
        if counters.get("total_texts"):
            ms = progress.durationMs.get("triggerExecution", 0)
            _record(self.spark, self.path, str(progress.id), self.name, progress.batchId, ms, counters)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All recorded runs, a batch of a stream once."""
    return spark.read.schema(RUNS).parquet(path).dropDuplicates(["run_id", "batch"])
