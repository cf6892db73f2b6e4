"""Delivery of an outbox in bounded batches, with leases, retries and dead letters.

What happened is a log that is only appended to: a claim of a row (with the time its lease
ends), and what came of it. A dispatcher that dies leaves claims without an outcome; once
their lease has ended, the rows are claimed again, and what receives them tells repeats by id
(`delivered_once`). Nothing is updated in place, so a lost executor repeats a write of whole
files and no more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "id string, attempt int, status string, until long, error string"


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """All claims and outcomes so far; a folder without any is empty."""
    spark.createDataFrame([], LOG).write.mode("append").parquet(folder)
    return spark.read.schema(LOG).parquet(folder)


def states(outbox: DataFrame, log: DataFrame, now: int, most: int) -> DataFrame:
    """outbox (id, enqueued_at, ...) with attempts so far and state: delivered, in_flight (under
    a lease), dead (as many attempts as allowed, none of them good) or pending."""
    each = log.groupBy("id", "attempt").agg(F.bool_or(F.col("status") == "delivered").alias("good"), F.bool_or(F.col("status") != "claimed").alias("over"), F.max("until").alias("until"))
    last = each.groupBy("id").agg(F.bool_or("good").alias("good"), F.max(F.struct("attempt", "over", "until")).alias("x"))
    met = outbox.join(last, "id", "left")
    held = F.coalesce(~F.col("x.over") & (F.col("x.until") > now), F.lit(False))
    attempts = F.coalesce("x.attempt", F.lit(0))
    state = F.when(F.coalesce("good", F.lit(False)), "delivered").when(held, "in_flight").when(attempts >= most, "dead").otherwise("pending")
    return met.select(*outbox.columns, attempts.alias("attempts"), state.alias("state"))


def claim(outbox: DataFrame, folder: str, now: int, limit: int, lease: int, most: int) -> DataFrame:
    """Claims the `limit` oldest pending rows and returns them with their attempt."""
    spark = outbox.sparkSession
    log = read_log(spark, folder)
    chosen = states(outbox, log, now, most).where("state = 'pending'").orderBy("enqueued_at", "id").limit(limit)
    claims = chosen.select("id", (F.col("attempts") + 1).cast("int").alias("attempt"), F.lit("claimed").alias("status"), F.lit(now + lease).cast("long").alias("until"), F.lit(None).cast("string").alias("error"))
    claims.write.mode("append").parquet(folder)
    mine = spark.read.schema(LOG).parquet(folder).where((F.col("status") == "claimed") & (F.col("until") == now + lease))
    open_claims = mine.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("attempt")))).where("__n = 1").select("id", "attempt")
    done = spark.read.schema(LOG).parquet(folder).where("status <> 'claimed'").select("id", "attempt")
    return outbox.join(open_claims.join(done, ["id", "attempt"], "left_anti"), "id")


def dispatch(outbox: DataFrame, folder: str, deliver: Callable[[DataFrame], DataFrame], now: Callable[[], int], limit: int = 1000, lease: int = 300, most: int = 5) -> int:
    """Claims and delivers batch after batch until nothing is pending; returns their number.
    deliver: takes claimed rows and returns id, ok and error of each. Seconds of `now` have to
    grow from batch to batch."""
    batches = 0
    while True:
        claimed = claim(outbox, folder, now(), limit, lease, most)
        if not claimed.limit(1).count():
            return batches
        outcome = deliver(claimed)
        named = claimed.select("id", "attempt").join(outcome, "id")
        named.select("id", "attempt", F.when(F.col("ok"), "delivered").otherwise("failed").alias("status"), F.lit(0).cast("long").alias("until"), "error").write.mode("append").parquet(folder)
        batches += 1


def delivered_once(rows: DataFrame, path: str, key: str = "id") -> None:
    """Appends the rows whose key the table at `path` doesn't have yet."""
    spark = rows.sparkSession
    rows.limit(0).write.mode("append").parquet(path)
    there = spark.read.schema(rows.schema).parquet(path).select(key)
    rows.dropDuplicates([key]).join(there, key, "left_anti").select(*rows.columns).write.mode("append").parquet(path)
