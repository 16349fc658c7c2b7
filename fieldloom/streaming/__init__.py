"""The same reports over streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.linear import grouped_gram, unfold
from ..shared import checkpoint_dir


def daily_counts(stream: DataFrame, ts: str, late: str = "1 day", expected: int | None = None) -> DataFrame:
    """Rows per day, given out once a day can get no more; with ``expected``, of days with another number only."""
    days = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")
    return days if expected is None else days.filter(F.col("n") != expected)


def three_step_windows(stream: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """Starts of 18-hour windows, sliding by 6, in which all three 6-hour steps occur."""
    slot = F.floor(F.unix_seconds(ts) / 21600)
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, "18 hours", "6 hours")).agg(F.size(F.collect_set(slot)).alias("steps"))
    return w.filter("steps = 3").select(F.col("window.start").alias("start"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class RunningGram:
    """For ``foreachBatch``: adds each batch's sums, so components can be had at any time.

    A batch's sums are written to ``<path>/number=<batch>`` before they count, so
    a batch that comes again replaces itself, and a new process that is given the
    path starts from all that were written. Without a path the sums are this
    object's alone and end with it.
    """

    def __init__(self, vector: str, spark: SparkSession | None = None, path: str | None = None):
        self.vector, self.path, self.parts = vector, path, {}
        if path is not None:
            try:
                rows = spark.read.parquet(path).collect()
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                rows = []
            self.parts = {r.number: unfold(r.data) for r in rows}

    def __call__(self, batch: DataFrame, number: int) -> None:
        sums = grouped_gram(batch, [], self.vector)
        if self.path is not None:
            sums.write.mode("overwrite").parquet(f"{self.path}/number={number}")
            sums = batch.sparkSession.read.schema("data binary").parquet(f"{self.path}/number={number}")
        got = sums.collect()
        if got:
            self.parts[number] = unfold(got[0].data)

    @property
    def n(self) -> int:
        return sum(p[0] for p in self.parts.values())

    @property
    def total(self) -> np.ndarray:
        return sum(p[1] for p in self.parts.values())

    @property
    def outer(self) -> np.ndarray:
        return sum(p[2] for p in self.parts.values())

    def variances(self) -> np.ndarray:
        mean = self.total / self.n
        return np.linalg.eigvalsh(self.outer / self.n - np.outer(mean, mean))[::-1]


def each_new(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``work`` over what is there and not yet done, then stop."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_through(stream: DataFrame) -> DataFrame:
    """All that an aggregating stream has by the end of what is there now, open windows too.

    The executors write it, and the state, below the shared checkpoint folder;
    no row passes through the driver. The state is deleted at the end.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")
    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    state = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    state.getFileSystem(spark._jsc.hadoopConfiguration()).delete(state, True)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
