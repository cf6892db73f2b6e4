"""Streaming jobs over events: counters, spending alerts, duplicate removal, sessions,
heartbeats and batches handed on once. Late rows are dropped ten minutes after the
watermark; every job works with availableNow as with a running trigger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeframe.sources.shared import work_path

LATE = "10 minutes"


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files below a path; the checkpoint remembers which were read."""
    made = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return made.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, key: str, width: str = "1 minute") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.where(F.col("n") > limit)


def sliding_spend(events: DataFrame, key: str, cost: str, threshold: float, width: str = "60 minutes", step: str = "5 minutes") -> DataFrame:
    """Windows in which a key spends more than the threshold."""
    made = events.withWatermark("ts", LATE).groupBy(F.window("ts", width, step), key).agg(F.sum(cost).alias("spent"))
    return made.where(F.col("spent") > threshold).select(F.col("window.start").alias("start"), key, "spent")


def first_received(events: DataFrame, key: str) -> DataFrame:
    """Each id once within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    made = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return made.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def heartbeats(events: DataFrame, key: str, silence_ms: int, recoveries: int = 3) -> DataFrame:
    """A row whenever a key has been silent for so long in event time, at most `recoveries`
    times per key: (key, last_ms, stale)."""

    def update(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            if told < recoveries:
                yield pd.DataFrame({key: [k[0]], "last_ms": [last], "stale": [told + 1]})
            state.update((last, told + 1))
            return
        for f in frames:
            last = max(last, int(f["ms"].max()))
        state.update((last, told))
        state.setTimeoutTimestamp(max(last + silence_ms, state.getCurrentWatermarkMs() + 1))

    kind = dict(events.dtypes)[key]
    rows = events.withWatermark("ts", LATE).select(key, "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, last_ms long, stale int", "last long, told int", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs over all that is there, into a new shared folder, and reads that."""
    spark, path = stream.sparkSession, work_path(stream.sparkSession)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def hand_on_once(stream: DataFrame, deliver: Callable[[DataFrame, int], None], state: str) -> None:
    """Batches go to `deliver` with their id, by which it can tell a repeat."""
    stream.writeStream.foreachBatch(deliver).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
