"""Queries of gold aggregates, interval joins and windows, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeframe.operators import gold, intervals
from lodeframe.plans.stage import ctes, stage

Q, SQL = {}, {}


def rounded(df, *cols, digits: int = 4):
    return df.withColumns({c: F.round(c, digits) for c in cols})


Q["composites"] = lambda s, d: rounded(gold.composites(stage(s, d, "assay"), 5.0), "weighted_avg").select("collar_id", "element", "composite_type", "from_depth", "to_depth", "weighted_avg", "min_value", "max_value", "sample_count", "unit")
SQL["composites"] = ctes("assay") + """
select collar_id, element, 'fixed_5.0m' as composite_type, floor(from_depth / 5) * 5 as from_depth, floor(from_depth / 5) * 5 + 5 as to_depth,
  round(sum(value_ppm * interval_length) / nullif(sum(interval_length), 0), 4) as weighted_avg,
  min(value_ppm) as min_value, max(value_ppm) as max_value, count(*) as sample_count, max(unit) as unit
from assay where value_ppm is not null group by collar_id, element, floor(from_depth / 5)
having sum(value_ppm * interval_length) / nullif(sum(interval_length), 0) is not null"""

RUNS = """, tagged as (
  select *, coalesce(lag(value_ppm) over w, 0) as prev from assay where value_ppm is not null
  window w as (partition by collar_id, element order by from_depth, to_depth, value_ppm, sample_id)
), runs as (
  select *, sum(case when value_ppm >= 4000 and prev < 4000 then 1 else 0 end) over (
    partition by collar_id, element order by from_depth, to_depth, value_ppm, sample_id rows unbounded preceding) as run_id from tagged
), hits as (
  select collar_id, element, cast(run_id as bigint) as run_id, min(from_depth) as from_depth, max(to_depth) as to_depth,
    sum(value_ppm * interval_length) / nullif(sum(interval_length), 0) as weighted_avg, max(value_ppm) as peak_value,
    min(struct_pack(v := -value_ppm, d := from_depth)).d as peak_depth, count(*) as sample_count
  from runs where value_ppm >= 4000 group by collar_id, element, run_id
)"""
_hits = lambda s, d: gold.significant_intersections(stage(s, d, "assay"), 4000.0)
Q["significant_intersections"] = lambda s, d: rounded(_hits(s, d), "weighted_avg")
SQL["significant_intersections"] = ctes("assay") + RUNS + "\nselect * replace (round(weighted_avg, 4) as weighted_avg) from hits"

Q["drill_summaries"] = lambda s, d: rounded(
    gold.drill_summaries(stage(s, d, "collar"), stage(s, d, "assay"), stage(s, d, "lithology"), "A").withColumn("elements_assayed", F.array_join("elements_assayed", ",")),
    "assay_coverage_pct", "assay_union_pct", "lithology_coverage_pct",
)
SQL["drill_summaries"] = ctes("collar", "assay", "lithology") + """, n as (
  select *, max(to_depth) over (partition by collar_id order by from_depth, to_depth rows between unbounded preceding and 1 preceding) as reach from assay
), u as (select collar_id, sum(greatest(to_depth - greatest(coalesce(reach, from_depth), from_depth), 0)) as covered from n group by collar_id
), a as (select collar_id, sum(distinct to_depth - from_depth) as lengths, array_to_string(list_sort(list(distinct element)), ',') as els from assay group by collar_id
), l as (select collar_id, sum(to_depth - from_depth) as logged from lithology group by collar_id
), b as (
  select * from (select collar_id, value_ppm, from_depth, to_depth, row_number() over (partition by collar_id order by value_ppm desc, from_depth, to_depth) as rn
  from assay where element = 'A' and value_ppm is not null) where rn = 1)
select c.collar_id, c.hole_id, c.total_depth,
  round(coalesce(lengths, 0) / nullif(total_depth, 0) * 100, 4) as assay_coverage_pct,
  round(coalesce(covered, 0) / nullif(total_depth, 0) * 100, 4) as assay_union_pct,
  round(coalesce(coalesce(logged, 0) / nullif(total_depth, 0) * 100, 0), 4) as lithology_coverage_pct,
  b.value_ppm as best_grade, b.from_depth as best_from, b.to_depth as best_to, coalesce(els, '') as elements_assayed
from collar c left join a using (collar_id) left join u using (collar_id) left join l using (collar_id) left join b using (collar_id)"""

CAMPAIGN = """, j as (select h.*, c.project_id from hits h join collar c using (collar_id)
), best as (select * from (select project_id, weighted_avg, element, row_number() over (partition by project_id order by weighted_avg desc nulls last, element, collar_id, run_id) as rn from j) where rn = 1
), f as (select project_id, count(*) as n from j group by project_id
), h as (select project_id, count(distinct collar_id) as holes_completed, sum(total_depth) as metres, avg(total_depth) as avg_hole_depth from collar group by project_id)
select h.project_id, holes_completed, cast(metres * {times} as double) as total_metres, round(avg_hole_depth, 4) as avg_hole_depth,
  round(weighted_avg, 4) as best_grade, element as best_element from h left join best using (project_id) left join f using (project_id)"""
for name, corrected, times in (("campaign_summaries", False, "greatest(coalesce(n, 1), 1)"), ("campaign_summaries_corrected", True, "1")):
    Q[name] = lambda s, d, corrected=corrected: rounded(gold.campaign_summaries(stage(s, d, "collar"), _hits(s, d), corrected), "avg_hole_depth", "best_grade")
    SQL[name] = ctes("collar", "assay") + RUNS + CAMPAIGN.replace("{times}", times)

Q["zone_statistics"] = lambda s, d: rounded(gold.zone_statistics(_hits(s, d), stage(s, d, "collar").select("collar_id", "project_id", "hole_type"), F.when(F.col("hole_type") != "5-LOW", F.col("hole_type"))), "avg_grade", "max_grade")
SQL["zone_statistics"] = ctes("collar", "assay") + RUNS + """
select project_id, case when hole_type <> '5-LOW' then hole_type else '__unzoned' end as zone_name, element, count(distinct h.collar_id) as holes_in_zone,
  sum(to_depth - from_depth) as total_length_m, round(avg(weighted_avg), 4) as avg_grade, round(max(weighted_avg), 4) as max_grade
from hits h join collar c using (collar_id) group by 1, 2, 3"""


def _qaqc(s, d):
    a = stage(s, d, "assay").withColumn("reported", F.round(F.col("reported") * 100)).withColumn("expected", F.round(F.col("expected") * 100))
    return a.withColumn("pass_fail", gold.qaqc_pass_fail(F.col("qaqc_type"), F.col("reported"), F.col("expected"), 40.0, "O", "F"))


Q["qaqc_statistics"] = lambda s, d: rounded(gold.qaqc_statistics(_qaqc(s, d), F.date_trunc("quarter", "assay_date").cast("date").cast("string")), "avg_error_pct")
SQL["qaqc_statistics"] = ctes("assay") + """, q as (select *, round(reported * 100) as r, round(expected * 100) as e from assay), p as (
  select *, case when qaqc_type = 'O' and r > 3 * e then 'fail' when qaqc_type = 'F' and abs(r - e) / nullif(e, 0) * 100 > 40 then 'fail' else 'pass' end as pass_fail from q)
select lab, element, qaqc_type, cast(cast(date_trunc('quarter', assay_date) as date) as varchar) as period_start, count(*) as submitted,
  count(*) filter (where pass_fail = 'pass') as passed, round(avg(case when e <> 0 then abs(r - e) / e * 100 end), 4) as avg_error_pct
from p group by 1, 2, 3, 4"""

Q["element_correlations"] = lambda s, d: rounded(gold.element_correlations(stage(s, d, "assay"), 3), "r")
SQL["element_correlations"] = ctes("assay") + """, t as (select collar_id, from_depth, element, avg(value_ppm) as v from assay where value_ppm is not null group by 1, 2, 3
), p as (select a.element as element_a, b.element as element_b, a.v as x, b.v as y from t a join t b on a.collar_id = b.collar_id and a.from_depth = b.from_depth and a.element < b.element)
select element_a, element_b, count(*) as pair_count, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 4) as r
from p group by 1, 2 having count(*) >= 3 and covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) is not null"""

Q["collar_summary"] = lambda s, d: gold.collar_summary(stage(s, d, "collar"), stage(s, d, "assay")).withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})
SQL["collar_summary"] = ctes("collar", "assay") + """, h as (select distinct collar_id from assay)
select project_id, count(*) as collar_count, round(avg(total_depth), 1) as avg_depth, cast(min(total_depth) as double) as min_depth, cast(max(total_depth) as double) as max_depth,
  cast(min(drill_date) as varchar) as first_date, cast(max(drill_date) as varchar) as last_date, count(h.collar_id) as assayed_holes, count(distinct hole_type) as hole_types
from collar c left join h using (collar_id) group by project_id"""

_sampled = lambda s, d: stage(s, d, "assay").groupBy("collar_id", "sample_id").agg(F.min("from_depth").alias("from_depth"), F.max("to_depth").alias("to_depth"))
SAMPLED = ", i as (select collar_id, sample_id, min(from_depth) as from_depth, max(to_depth) as to_depth from assay group by 1, 2)"
Q["interval_overlap"] = lambda s, d: intervals.overlaps(_sampled(s, d), "sample_id")
SQL["interval_overlap"] = ctes("assay") + SAMPLED + """
select a.collar_id, a.sample_id as id_a, b.sample_id as id_b, least(a.to_depth, b.to_depth) - greatest(a.from_depth, b.from_depth) as overlap_m
from i a join i b on a.collar_id = b.collar_id and a.sample_id < b.sample_id and a.from_depth < b.to_depth and b.from_depth < a.to_depth
where a.to_depth > a.from_depth and b.to_depth > b.from_depth"""
Q["interval_overlap_flags"] = lambda s, d: intervals.overlap_flags(intervals.overlaps(_sampled(s, d), "sample_id"), keep=3).withColumn("pairs", F.array_join(F.transform("pairs", lambda p: F.concat_ws("-", p["id_a"], p["id_b"])), ","))
SQL["interval_overlap_flags"] = ctes("assay") + SAMPLED + """, p as (
  select a.collar_id, a.sample_id as id_a, b.sample_id as id_b, least(a.to_depth, b.to_depth) - greatest(a.from_depth, b.from_depth) as m,
    row_number() over (partition by a.collar_id order by a.sample_id, b.sample_id) as rn
  from i a join i b on a.collar_id = b.collar_id and a.sample_id < b.sample_id and a.from_depth < b.to_depth and b.from_depth < a.to_depth)
select collar_id, count(*) as pair_count, sum(m) as overlap_m, string_agg(id_a || '-' || id_b, ',' order by id_a, id_b) filter (where rn <= 3) as pairs from p group by collar_id"""

Q["containing_lithology"] = lambda s, d: intervals.first_containing(stage(s, d, "assay").select("collar_id", "sample_id", "from_depth"), stage(s, d, "lithology"), "rock_code").groupBy("collar_id", "rock_code").agg(F.count("*").alias("samples"))
SQL["containing_lithology"] = ctes("assay", "lithology") + """, m as (
  select distinct a.collar_id, a.from_depth, first_value(rock_code) over (partition by a.collar_id, a.from_depth order by l.from_depth, rock_code) as rock_code
  from assay a join lithology l on a.collar_id = l.collar_id and a.from_depth >= l.from_depth and a.from_depth < l.to_depth)
select a.collar_id, m.rock_code, count(*) as samples from assay a left join m using (collar_id, from_depth) group by 1, 2"""

Q["slab_composite"] = lambda s, d: rounded(intervals.slabs(stage(s, d, "assay"), 1.5, ["collar_id"], "from_depth", "value_ppm"), "mean_value")
SQL["slab_composite"] = ctes("assay") + " select collar_id, floor(from_depth / 1.5) * 1.5 as slab_from, round(avg(value_ppm), 4) as mean_value, count(*) as points from assay where value_ppm is not null group by 1, 2"

Q["lithology_bands"] = lambda s, d: intervals.islands(
    stage(s, d, "lithology").groupBy("collar_id", "from_depth").agg(F.min("rock_code").alias("rock_code"), F.max("to_depth").alias("to_depth")), ["collar_id"], ["from_depth"], F.col("rock_code") > "RK5"
).groupBy("collar_id", "island").agg(F.min("from_depth").alias("from_depth"), F.max("to_depth").alias("to_depth"), F.count("*").alias("n"))
SQL["lithology_bands"] = ctes("lithology") + """, t as (select collar_id, from_depth, min(rock_code) as rock_code, max(to_depth) as to_depth from lithology group by 1, 2
), c as (select *, case when lag(rock_code > 'RK5') over w is distinct from (rock_code > 'RK5') or row_number() over w = 1 then 1 else 0 end as new from t window w as (partition by collar_id order by from_depth)
), g as (select *, cast(sum(new) over (partition by collar_id order by from_depth rows unbounded preceding) as bigint) as island from c)
select collar_id, island, min(from_depth) as from_depth, max(to_depth) as to_depth, count(*) as n from g group by 1, 2"""

Q["grade_tonnage"] = lambda s, d: rounded(intervals.grade_tonnage(stage(s, d, "assay").where("value_ppm is not null").select(F.col("value_ppm").cast("double").alias("value_ppm"), "interval_length"), "value_ppm", "interval_length"), "grade", "tonnes")
SQL["grade_tonnage"] = ctes("assay") + """, m as (select max(value_ppm) as top from assay), c as (select round(k * top / 20, 3) as cutoff from m, range(20) t(k))
select cutoff, round(coalesce(sum(interval_length), 0), 4) as tonnes, round(sum(value_ppm * interval_length) / nullif(sum(interval_length), 0), 4) as grade
from c left join assay on value_ppm >= cutoff group by cutoff"""

Q["latest_assay_per_hole"] = lambda s, d: stage(s, d, "assay").withColumn("rn", F.row_number().over(Window.partitionBy("collar_id").orderBy(F.desc("assay_date"), "sample_id", "from_depth"))).where("rn = 1").select("collar_id", "sample_id", F.col("assay_date").cast("string").alias("assay_date"))
SQL["latest_assay_per_hole"] = ctes("assay") + " select collar_id, sample_id, cast(assay_date as varchar) as assay_date from (select *, row_number() over (partition by collar_id order by assay_date desc, sample_id, from_depth) as rn from assay) where rn = 1"
Q["samples_with_hole_total"] = lambda s, d: stage(s, d, "assay").select("collar_id", "sample_id", F.count("*").over(Window.partitionBy("collar_id")).alias("hole_total"))
SQL["samples_with_hole_total"] = ctes("assay") + " select collar_id, sample_id, count(*) over (partition by collar_id) as hole_total from assay"
Q["element_anomalies"] = lambda s, d: stage(s, d, "assay").where("value_ppm is not null").join(F.broadcast(stage(s, d, "assay").groupBy("element").agg(F.avg("value_ppm").alias("m"), F.stddev_pop("value_ppm").alias("sd"))), "element").select("collar_id", "sample_id", "element", F.round((F.col("value_ppm") - F.col("m")) / F.when(F.col("sd") == 0, 1).otherwise(F.col("sd")), 4).alias("z")).where("z > 1.5")
SQL["element_anomalies"] = ctes("assay") + """, z as (select collar_id, sample_id, element, round((value_ppm - avg(value_ppm) over w) / case when stddev_pop(value_ppm) over w = 0 then 1 else stddev_pop(value_ppm) over w end, 4) as z
  from assay where value_ppm is not null window w as (partition by element)) select * from z where z > 1.5"""
