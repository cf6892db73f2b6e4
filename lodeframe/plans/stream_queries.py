"""Streaming jobs run over the events table until it is read, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.plans.stage import table
from lodeframe.streaming import jobs

Q, SQL = {}, {}


def _events(s, d):
    schema = table(s, d, "events").schema
    return jobs.event_stream(s, f"{d}/events.parque[t]", schema)


Q["stream_minute_counts"] = lambda s, d: jobs.drained(jobs.tumbling_counts(_events(s, d), "event_type", "1 hour"), "complete").withColumn("start", F.col("start").cast("string"))
SQL["stream_minute_counts"] = "select cast(date_trunc('hour', ts) as varchar) as start, event_type, count(*) as n from events group by 1, 2"
Q["stream_spend_alerts"] = lambda s, d: jobs.drained(jobs.sliding_spend(_events(s, d).withColumn("cost", F.floor(F.col("value") * 100)), "event_type", "cost", 5000, "60 minutes", "30 minutes"), "complete").withColumn("start", F.col("start").cast("string"))
SQL["stream_spend_alerts"] = """with e as (select event_type, cast(floor(value * 100) as bigint) as cost, ts, time_bucket(interval 30 minutes, ts, timestamp '2000-01-01') as b from events), w as (select event_type, cost, b as start from e union all select event_type, cost, b - interval 30 minutes from e)
select cast(start as varchar) as start, event_type, cast(sum(cost) as bigint) as spent from w group by 1, 2 having sum(cost) > 5000"""
Q["stream_first_received"] = lambda s, d: jobs.drained(jobs.first_received(_events(s, d), "event_id")).select("event_id", "event_type")
SQL["stream_first_received"] = "select distinct event_id, event_type from events"
Q["stream_sessions"] = lambda s, d: jobs.drained(jobs.sessions(_events(s, d), "user_id", "6 hours"), "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))
SQL["stream_sessions"] = """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as new from events)
select user_id, cast(sum(new) as bigint) as sessions, count(*) as events from g group by 1"""
