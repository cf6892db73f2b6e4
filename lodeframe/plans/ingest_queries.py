"""Queries of ingest compositions and targets, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import ingest, targets
from lodeframe.plans.stage import ctes, stage, table

Q, SQL = {}, {}


def _checked(s, d):
    rows = stage(s, d, "assay").select(F.when(F.col("sample_id") % 41 != 0, F.col("collar_id")).alias("collar_id"), "element", "from_depth", F.when(F.col("sample_id") % 13 == 0, F.col("from_depth")).otherwise(F.col("to_depth")).alias("to_depth"), F.col("value_ppm").alias("value"))
    return ingest.checked_assays(rows, s.createDataFrame([("A", 1.0), ("R", 0.001)], "element string, ppm_factor double"))


CHECKED = ctes("assay") + """, r as (select case when sample_id % 41 <> 0 then collar_id end as c, element, from_depth as f, case when sample_id % 13 = 0 then from_depth else to_depth end as t, value_ppm from assay
), x as (select *, case when c is null then 'no_collar' when t <= f then 'bad_interval' when element not in ('A', 'R') then 'unknown_element' end as reason from r)"""
Q["assays_accepted"] = lambda s, d: _checked(s, d)[0].groupBy("element").agg(F.count("*").alias("n"), F.round(F.sum("value_ppm"), 2).alias("total_ppm"))
SQL["assays_accepted"] = CHECKED + " select element, count(*) as n, round(sum(value_ppm * case element when 'A' then 1 else 0.001::double end), 2) as total_ppm from x where reason is null group by 1"
Q["assays_rejected"] = lambda s, d: _checked(s, d)[1].groupBy("reason").agg(F.count("*").alias("n"))
SQL["assays_rejected"] = CHECKED + " select reason, count(*) as n from x where reason is not null group by 1"


def _resolved(s, d):
    rows = stage(s, d, "assay").select("sample_id", F.concat(F.lit("DDH "), F.col("sample_id") % 700).alias("hole_id"))
    return ingest.resolved(rows, stage(s, d, "collar"), "hole_id", "collar_id")


Q["holes_resolved"] = lambda s, d: _resolved(s, d)[0].groupBy("collar_id").agg(F.count("*").alias("n"))
SQL["holes_resolved"] = ctes("collar", "assay") + ", k as (select upper(replace(hole_id, '-', '')) as h, min(collar_id) as collar_id from collar group by 1) select k.collar_id, count(*) as n from assay a join k on k.h = 'DDH' || (a.sample_id % 700) group by 1"
Q["holes_unresolved"] = lambda s, d: _resolved(s, d)[1].agg(F.count("*").alias("n"))
SQL["holes_unresolved"] = ctes("assay") + " select count(*) as n from assay where sample_id % 700 >= 500"
Q["trace_kinds"] = lambda s, d: ingest.traces(stage(s, d, "collar").withColumn("azimuth", F.when(F.col("collar_id") % 5 != 0, F.col("azimuth"))), stage(s, d, "lithology").where("collar_id % 3 = 0")).groupBy("trace").agg(F.count("*").alias("n"), F.round(F.avg("end_z"), 3).alias("mean_z"))
SQL["trace_kinds"] = ctes("collar", "lithology") + """, h as (select distinct collar_id, true as s from lithology where collar_id % 3 = 0
), t as (select case when s then 'surveyed' when total_depth > 0 and collar_id % 5 <> 0 then 'straight' when total_depth > 0 then 'vertical' else 'none' end as trace, elevation + total_depth * sin(radians(dip)) as z from collar left join h using (collar_id))
select trace, count(*) as n, round(avg(case when trace in ('straight', 'vertical') then z end), 3) as mean_z from t group by 1"""
Q["json_features"] = lambda s, d: ingest.features(table(s, d, "events").select("event_id", "props"), "props", {"k": ("k", "long"), "name": ("name", "string")}).groupBy("k", "checksum").agg(F.count("*").alias("n"))
SQL["json_features"] = "with e as (select cast(json_extract_string(props, '$.k') as bigint) as k from events) select k, sha256('{\"k\":' || k || ',\"name\":null}') as checksum, count(*) as n from e group by 1, 2"
Q["graph_counts"] = lambda s, d: ingest.graph_frames(stage(s, d, "collar"), stage(s, d, "assay"))[1].groupBy("kind").agg(F.count("*").alias("n"))
SQL["graph_counts"] = ctes("collar", "assay") + " select 'HAS_HOLE' as kind, count(*) as n from (select distinct project_id, collar_id from collar) union all select 'ASSAYED_FOR', count(*) from (select distinct collar_id, element from assay)"
_factors = lambda s, d: stage(s, d, "usage").select("user_id", "event_type", (F.col("cost") / 2000 - 0.5).alias("v"), F.when(F.col("event_type") == "view", -0.5).otherwise(1.0).alias("w"))
FACTORS = ctes("usage") + ", f as (select user_id, event_type, cost / 2000 - 0.5 as v, case when event_type = 'view' then -0.5 else 1 end as w from usage)"
Q["target_scores"] = lambda s, d: targets.ranks(targets.signed_score(_factors(s, d), "user_id", "v", "w").withColumn("score", F.round("score", 6)), [3, 5], "user_id")
SQL["target_scores"] = FACTORS + ", s as (select user_id, round(greatest(-1, least(1, coalesce(sum(greatest(-1, least(1, v)) * w) / nullif(sum(abs(w)), 0), 0))), 6) as score from f group by 1) select user_id, score, cast(row_number() over (order by score desc, user_id) as integer) as rank from s where user_id not in (3, 5)"
Q["unit_scores"] = lambda s, d: targets.unit_score(_factors(s, d), "user_id", "v", "w").withColumn("score", F.round("score", 6))
SQL["unit_scores"] = FACTORS + " select user_id, round(greatest(0, least(1, case when sum(w) > 0 then sum(v * w) / sum(w) else 0 end)), 6) as score from f group by 1"
Q["factor_weights"] = lambda s, d: targets.fitted_weights(_factors(s, d), "event_type", "v", F.col("user_id") % 2 == 0).select("event_type", F.round("difference", 6).alias("difference"), F.round("weight", 6).alias("weight"))
SQL["factor_weights"] = FACTORS + ", d as (select event_type, avg(v) filter (where user_id % 2 = 0) - avg(v) filter (where user_id % 2 <> 0) as d from f group by 1) select event_type, round(d, 6) as difference, round(abs(d) / nullif(sum(abs(d)) over (), 0), 6) as weight from d"
