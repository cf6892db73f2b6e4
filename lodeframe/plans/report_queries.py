"""Queries of rollups, checks, charts and gates, with DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeframe.functions import charts, classify
from lodeframe.operators import quality, reports
from lodeframe.plans.stage import ctes, stage, table, varied

Q, SQL = {}, {}
_r = lambda c, n=4: F.round(c, n)
_sql_list = lambda xs: "[" + ", ".join(repr(x) for x in xs) + "]"
_text = lambda xs: F.array_join(F.transform(xs, lambda x: x.cast("string")), ",")

# relational shapes
Q["like_any"] = lambda s, d: stage(s, d, "usage").where("event_type like any ('pur%', 'cl%')").groupBy("event_type").agg(F.count("*").alias("n"))
SQL["like_any"] = ctes("usage") + " select event_type, count(*) as n from usage where event_type like 'pur%' or event_type like 'cl%' group by 1"
Q["hash_format"] = lambda s, d: table(s, d, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, F.upper(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256))).otherwise(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)).alias("h")).groupBy(F.col("h").rlike("^[0-9a-f]{64}$").alias("good")).agg(F.count("*").alias("n"))
SQL["hash_format"] = "select regexp_full_match(case when o_orderkey % 9 = 0 then upper(sha256(o_orderkey::varchar)) else sha256(o_orderkey::varchar) end, '[0-9a-f]{64}') as good, count(*) as n from orders group by 1"
Q["ingest_gap"] = lambda s, d: stage(s, d, "collar").agg(F.countDistinct("collar_id").alias("processed")).crossJoin(stage(s, d, "assay").agg(F.countDistinct("collar_id").alias("indexed"))).withColumn("gap", F.col("processed") - F.col("indexed"))  # one row each
SQL["ingest_gap"] = ctes("collar", "assay") + " select processed, indexed, processed - indexed as gap from (select count(distinct collar_id) as processed from collar), (select count(distinct collar_id) as indexed from assay)"
Q["resolutions_by_row"] = lambda s, d: stage(s, d, "collar").select("project_id", F.explode(F.when(F.col("total_depth") > 300, F.array(F.lit(5), F.lit(7))).otherwise(F.array(F.lit(7)))).alias("resolution")).groupBy("resolution").agg(F.count("*").alias("n"), F.countDistinct("project_id").alias("projects"))
SQL["resolutions_by_row"] = ctes("collar") + " select resolution, count(*) as n, count(distinct project_id) as projects from (select project_id, unnest(case when total_depth > 300 then [5, 7] else [7] end) as resolution from collar) group by 1"
Q["runs_with_a_negative"] = lambda s, d: stage(s, d, "usage").alias("a").join(stage(s, d, "usage").where("cost < 100").select("user_id", "event_type").distinct(), ["user_id", "event_type"], "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))
SQL["runs_with_a_negative"] = ctes("usage") + ", neg as (select user_id, event_type from usage where cost < 100) select user_id, count(*) as n from usage u where exists (select 1 from neg where neg.user_id = u.user_id and neg.event_type = u.event_type) group by 1"
Q["capped_collars"] = lambda s, d: reports.capped(stage(s, d, "collar").where("status = 'F'").select("collar_id"), ["collar_id"], 100)
SQL["capped_collars"] = ctes("collar") + " select collar_id, (select count(*) from collar where status = 'F') as total, (select count(*) from collar where status = 'F') > 100 as truncated from collar where status = 'F' order by collar_id limit 100"
Q["swept_runs"] = lambda s, d: stage(s, d, "usage").where(~((F.col("ts") < F.lit("2024-01-10").cast("timestamp")) & (F.col("event_type") == "view"))).groupBy("event_type").agg(F.count("*").alias("left_over"))
SQL["swept_runs"] = ctes("usage") + " select event_type, count(*) as left_over from usage where not (ts < timestamp '2024-01-10' and event_type = 'view') group by 1"
Q["graph_matches"] = lambda s, d: table(s, d, "part").where("p_type like '%A%'").select("p_partkey", "p_type").union(table(s, d, "part").where("contains(p_name, '7')").select("p_partkey", "p_type")).distinct()
SQL["graph_matches"] = "select p_partkey, p_type from part where p_type like '%A%' union select p_partkey, p_type from part where contains(p_name, '7')"
Q["strata_concat"] = lambda s, d: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [table(s, d, "supplier").select(F.lit("supplier").alias("stratum"), F.col("s_nationkey").alias("nation")), table(s, d, "customer").select(F.lit("customer").alias("stratum"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))]).groupBy("stratum").agg(F.count("*").alias("n"), F.count("balance").alias("with_balance"))
SQL["strata_concat"] = "select stratum, count(*) as n, count(balance) as with_balance from (select 'supplier' as stratum, null::double as balance from supplier union all select 'customer', c_acctbal::double from customer) group by 1"

# rollups
Q["collars_by_year"] = lambda s, d: reports.by_year(stage(s, d, "collar"), F.nullif(F.col("hole_type"), F.lit("5-LOW")), "drill_date", F.col("total_depth"), "collar_id").withColumn("ids", F.sha2(_text("ids").cast("binary"), 256))
SQL["collars_by_year"] = ctes("collar") + " select coalesce(nullif(hole_type, '5-LOW'), 'Unknown') as technique, cast(year(drill_date) as integer) as year, count(*) as n, sum(total_depth) as metres, sha256(string_agg(collar_id::varchar, ',' order by collar_id)) as ids from collar group by 1, 2"
Q["campaigns_by_year"] = lambda s, d: reports.by_year(stage(s, d, "collar"), F.col("project_id").cast("string"), "drill_date", F.col("total_depth"), "collar_id").drop("ids")
SQL["campaigns_by_year"] = ctes("collar") + " select project_id::varchar as technique, cast(year(drill_date) as integer) as year, count(*) as n, sum(total_depth) as metres from collar group by 1, 2"
Q["surveys_by_year"] = lambda s, d: reports.by_year(stage(s, d, "assay"), F.col("lab").cast("string"), "assay_date", F.col("interval_length").cast("double"), "sample_id").drop("ids").withColumn("metres", _r(F.col("metres")))
SQL["surveys_by_year"] = ctes("assay") + " select lab::varchar as technique, cast(year(assay_date) as integer) as year, count(*) as n, round(sum(interval_length::double), 4) as metres from assay group by 1, 2"
Q["reports_by_year"] = lambda s, d: reports.by_year(table(s, d, "lineitem"), F.col("l_linestatus"), "l_shipdate", F.col("l_quantity").cast("double"), "l_orderkey").drop("ids")
SQL["reports_by_year"] = "select l_linestatus as technique, cast(year(l_shipdate::date) as integer) as year, count(*) as n, sum(l_quantity::double) as metres from lineitem group by 1, 2"
Q["lithology_metres"] = lambda s, d: stage(s, d, "lithology").groupBy("rock_code").agg(F.sum(F.col("to_depth") - F.col("from_depth")).alias("metres")).orderBy(F.desc_nulls_last("metres"), "rock_code").limit(5)
SQL["lithology_metres"] = ctes("lithology") + " select rock_code, sum(to_depth - from_depth) as metres from lithology group by 1 order by metres desc nulls last, rock_code limit 5"
Q["attribute_coverage"] = lambda s, d: stage(s, d, "assay").where("value_ppm is not null").groupBy("element").agg(F.countDistinct("collar_id").alias("covered"), F.min("collar_id").alias("first_id"), F.max("collar_id").alias("last_id"))
SQL["attribute_coverage"] = ctes("assay") + " select element, count(distinct collar_id) as covered, min(collar_id) as first_id, max(collar_id) as last_id from assay where value_ppm is not null group by 1"
Q["density_by_resolution"] = lambda s, d: stage(s, d, "collar").select(F.explode(F.array(F.lit(1000), F.lit(5000))).alias("resolution"), "easting", "northing").groupBy("resolution", F.floor(F.col("easting") / F.col("resolution")).alias("x"), F.floor(F.col("northing") / F.col("resolution")).alias("y")).agg(F.count("*").alias("n")).groupBy("resolution").agg(F.count("*").alias("cells"), F.sum("n").alias("total"))
SQL["density_by_resolution"] = ctes("collar") + " select resolution, count(*) as cells, cast(sum(n) as bigint) as total from (select resolution, floor(easting / resolution) as x, floor(northing / resolution) as y, count(*) as n from (select easting, northing, unnest([1000, 5000]) as resolution from collar) group by 1, 2, 3) group by 1"
Q["top_array_values"] = lambda s, d: stage(s, d, "usage").select(F.explode(F.from_json(F.concat(F.lit('["'), "event_type", F.lit('","k'), F.get_json_object("props", "$.k"), F.lit('"]')), "array<string>")).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(10)
SQL["top_array_values"] = ctes("usage") + " select value, count(*) as n from (select unnest([event_type, 'k' || json_extract_string(props, '$.k')]) as value from usage) where value is not null group by 1 order by n desc, value limit 10"
Q["decision_summary"] = lambda s, d: reports.outcomes(stage(s, d, "collar"), "hole_type", "status", ["F", "O"])
SQL["decision_summary"] = ctes("collar") + " select hole_type, count(*) as total, count(*) filter (where status = 'F') as \"F\", count(*) filter (where status = 'O') as \"O\", count(*) filter (where status is null or status not in ('F', 'O')) as other from collar group by 1"
Q["citation_summary"] = lambda s, d: stage(s, d, "usage").groupBy("event_type", F.when(F.col("cost") > 5000, "accepted").otherwise("rejected").alias("state")).agg(F.count("*").alias("n"))
SQL["citation_summary"] = ctes("usage") + " select event_type, case when cost > 5000 then 'accepted' else 'rejected' end as state, count(*) as n from usage group by 1, 2"
Q["retrieval_stages"] = lambda s, d: stage(s, d, "usage").groupBy(F.col("event_type").alias("stage")).agg(_r(F.avg("cost")).alias("mean_score"), F.sum((F.col("cost") > 100).cast("long")).alias("included"), F.sum((F.col("cost") > 5000).cast("long")).alias("used"))
SQL["retrieval_stages"] = ctes("usage") + " select event_type as stage, round(avg(cost), 4) as mean_score, count(*) filter (where cost > 100) as included, count(*) filter (where cost > 5000) as used from usage group by 1"
Q["source_citation_rate"] = lambda s, d: table(s, d, "nation").select("n_nationkey").join(table(s, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_acctbal"), "n_nationkey", "left").groupBy("n_nationkey").agg(F.count("c_acctbal").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("validated"))
SQL["source_citation_rate"] = "select n_nationkey, count(c_acctbal) as total, count(*) filter (where c_acctbal > 0) as validated from nation left join customer on c_nationkey = n_nationkey group by 1"
Q["low_confidence"] = lambda s, d: reports.low_confidence(stage(s, d, "usage").withColumn("c", F.col("cost") / 20000), F.concat_ws("-", "user_id", "event_type"), "c", 2, 0.7, 20).withColumn("mean", _r(F.col("mean"), 6))
SQL["low_confidence"] = ctes("usage") + ", q as (select user_id || '-' || event_type as question, count(*) as n, avg(cost / 20000) as m from usage group by 1) select question, n, round(m, 6) as mean, round(n * (1 - m), 6) as weight from q where n >= 2 and m < 0.7 order by weight desc, question limit 20"
Q["file_types"] = lambda s, d: table(s, d, "pages").select(F.lower(F.regexp_extract(F.col("url"), r"\.([A-Za-z0-9]+)$", 1)).alias("extension")).groupBy("extension").agg(F.count("*").alias("n"))
SQL["file_types"] = r"select lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) as extension, count(*) as n from pages group by 1"
Q["element_frequency"] = lambda s, d: stage(s, d, "assay").groupBy(F.concat("element", "lab").alias("element")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "element").limit(12)
SQL["element_frequency"] = ctes("assay") + " select element || lab as element, count(*) as n from assay group by 1 order by n desc, element limit 12"
Q["outbox_lag"] = lambda s, d: reports.lag_seconds(stage(s, d, "usage").where("event_type <> 'view'"), "workspace_id", "ts", F.lit("2024-03-01").cast("timestamp"))
SQL["outbox_lag"] = ctes("usage") + " select workspace_id, count(*) as pending, cast(epoch(timestamp '2024-03-01') - floor(epoch(min(ts))) as bigint) as lag_s from usage where event_type <> 'view' group by 1"
Q["outbox_duplicates"] = lambda s, d: quality.duplicate_keys(stage(s, d, "usage"), ["workspace_id", "user_id", "event_type"])
SQL["outbox_duplicates"] = ctes("usage") + " select workspace_id, user_id, event_type, count(*) as copies from usage group by 1, 2, 3 having count(*) > 1"
Q["line_channel_stats"] = lambda s, d: stage(s, d, "assay").groupBy(F.col("lab").alias("line"), F.col("element").alias("channel")).agg(F.min("value_ppm").alias("least"), F.max("value_ppm").alias("most"), _r(F.avg("value_ppm")).alias("mean"), F.count("value_ppm").alias("n"))
SQL["line_channel_stats"] = ctes("assay") + " select lab as line, element as channel, min(value_ppm) as least, max(value_ppm) as most, round(avg(value_ppm), 4) as mean, count(value_ppm) as n from assay group by 1, 2"
Q["assay_statistics"] = lambda s, d: stage(s, d, "assay").where("value_ppm is not null").groupBy("element").agg(F.min("value_ppm").alias("least"), F.max("value_ppm").alias("most"), _r(F.avg("value_ppm")).alias("mean"), F.median("value_ppm").alias("median"), F.count("*").alias("n"))
SQL["assay_statistics"] = ctes("assay") + " select element, min(value_ppm) as least, max(value_ppm) as most, round(avg(value_ppm), 4) as mean, median(value_ppm) as median, count(*) as n from assay where value_ppm is not null group by 1"
Q["ontology_counts"] = lambda s, d: table(s, d, "part").groupBy(F.element_at(F.split("p_type", " "), -1).alias("class")).agg(F.count("*").alias("terms"), F.countDistinct("p_name").alias("synonyms"))
SQL["ontology_counts"] = "select string_split(p_type, ' ')[-1] as class, count(*) as terms, count(distinct p_name) as synonyms from part group by 1"
Q["store_footprint"] = lambda s, d: reduce(lambda a, b: a.unionByName(b), [table(s, d, t).agg(F.lit(t).alias("store"), F.count("*").alias("n")) for t in ("orders", "lineitem", "events", "documents")])
SQL["store_footprint"] = " union all ".join(f"select '{t}' as store, count(*) as n from {t}" for t in ("orders", "lineitem", "events", "documents"))

# pivots and charts
Q["harker_pairs"] = lambda s, d: stage(s, d, "assay").groupBy("collar_id").agg(F.max(F.when(F.col("element") == "A", F.col("value_ppm"))).alias("x"), F.max(F.when(F.col("element") == "N", F.col("value_ppm"))).alias("y")).where("x is not null and y is not null").join(stage(s, d, "lithology").groupBy("collar_id").agg(F.min("rock_code").alias("rock_code")), "collar_id", "left")
SQL["harker_pairs"] = ctes("assay", "lithology") + ", p as (select collar_id, max(value_ppm) filter (where element = 'A') as x, max(value_ppm) filter (where element = 'N') as y from assay group by 1 having x is not null and y is not null), l as (select collar_id, min(rock_code) as rock_code from lithology group by 1) select p.*, rock_code from p left join l using (collar_id)"
Q["sample_matrix"] = lambda s, d: stage(s, d, "assay").join(stage(s, d, "assay").select("sample_id").distinct().orderBy("sample_id").limit(200), "sample_id", "left_semi").groupBy("sample_id").pivot("element", ["A", "N", "R"]).agg(F.min("value_ppm"))  # the first samples are the feature
SQL["sample_matrix"] = ctes("assay") + """ select sample_id, min(value_ppm) filter (where element = 'A') as "A", min(value_ppm) filter (where element = 'N') as "N", min(value_ppm) filter (where element = 'R') as "R" from assay where sample_id in (select distinct sample_id from assay order by sample_id limit 200) group by 1"""


def _traces(s, d, reference):
    """Each assay stands for one element of the reference in turn."""
    names = list(reference)
    rows = stage(s, d, "assay").where("value_ppm is not null").withColumn("trace", F.element_at(F.array(*map(F.lit, names)), (F.col("sample_id") % len(names) + 1).cast("int")))
    place, ratio = charts.normalised(F.col("trace"), F.col("value_ppm"), reference)
    return rows.groupBy(F.col("trace").alias("element"), place.alias("place")).agg(F.count("*").alias("n"), _r(F.avg(ratio), 3).alias("mean_ratio"))


def _traces_sql(reference):
    names = list(reference)
    return ctes("assay") + f""", t as (select ({_sql_list(names)})[sample_id % {len(names)} + 1] as element, cast(sample_id % {len(names)} as integer) as place, value_ppm / ({_sql_list([float(v) for v in reference.values()])}::double[])[sample_id % {len(names)} + 1] as ratio from assay where value_ppm is not null)
select element, place, count(*) as n, round(avg(ratio), 3) as mean_ratio from t group by 1, 2"""


Q["ree_pattern"] = lambda s, d: _traces(s, d, charts.CHONDRITE_PPM)
SQL["ree_pattern"] = _traces_sql(charts.CHONDRITE_PPM)
Q["spider_pattern"] = lambda s, d: _traces(s, d, charts.MANTLE_PPM)
SQL["spider_pattern"] = _traces_sql(charts.MANTLE_PPM)
Q["ternary_shares"] = lambda s, d: stage(s, d, "collar").select("collar_id", *[_r(c, 6).alias(n) for c, n in zip(charts.ternary(F.col("easting"), F.col("northing"), F.col("elevation")), "abc", strict=True)])
SQL["ternary_shares"] = ctes("collar") + ", w as (select *, nullif(easting + northing + elevation, 0) as w from collar) select collar_id, round(easting / w * 100, 6) as a, round(northing / w * 100, 6) as b, round(elevation / w * 100, 6) as c from w"
Q["target_heatmap"] = lambda s, d: stage(s, d, "collar").groupBy(F.floor(F.col("easting") / 500).alias("x"), F.floor(F.col("northing") / 500).alias("y")).agg(F.max("total_depth").alias("score"), F.count("*").alias("n")).orderBy(F.desc("score"), "x", "y").limit(500)
SQL["target_heatmap"] = ctes("collar") + " select cast(floor(easting / 500) as bigint) as x, cast(floor(northing / 500) as bigint) as y, max(total_depth) as score, count(*) as n from collar group by 1, 2 order by score desc, x, y limit 500"
Q["depth_outliers"] = lambda s, d: reports.outliers(stage(s, d, "collar").select("project_id", "collar_id", "total_depth"), ["project_id"], "total_depth").withColumn("sigma", _r(F.col("sigma")))
SQL["depth_outliers"] = ctes("collar") + ", w as (select project_id, collar_id, total_depth, count(*) over p as n, avg(total_depth) over p as m, stddev_pop(total_depth) over p as sd from collar window p as (partition by project_id)), g as (select project_id, collar_id, total_depth, (total_depth - m) / sd as g from w where n >= 3 and sd > 0) select project_id, collar_id, total_depth, round(g, 4) as sigma, case when g > 0 then 'above' else 'below' end as side from g where abs(g) > 2"
Q["assay_outliers"] = lambda s, d: reports.outliers(stage(s, d, "assay").where("value_ppm is not null").select("element", "collar_id", "sample_id", F.col("interval_length").cast("double").alias("interval_length"), "value_ppm"), ["element"], "value_ppm", 1.2).where("side = 'above'").select("element", "collar_id", "sample_id", _r(F.col("sigma")).alias("sigma"), (F.col("value_ppm") * F.col("interval_length")).alias("grade_thickness"))
SQL["assay_outliers"] = ctes("assay") + ", w as (select *, avg(value_ppm) over p as m, stddev_pop(value_ppm) over p as sd from assay where value_ppm is not null window p as (partition by element)) select element, collar_id, sample_id, round((value_ppm - m) / sd, 4) as sigma, value_ppm * interval_length::double as grade_thickness from w where (value_ppm - m) / sd > 1.2"
Q["thick_units"] = lambda s, d: stage(s, d, "lithology").groupBy("collar_id").agg(F.max(F.col("to_depth") - F.col("from_depth")).alias("thickest"), (F.max(F.length("rock_code") * 15) - F.min(F.length("rock_code") * 15)).cast("long").alias("quality_range")).where("thickest > 100 or quality_range >= 15")
SQL["thick_units"] = ctes("lithology") + " select collar_id, max(to_depth - from_depth) as thickest, max(length(rock_code) * 15) - min(length(rock_code) * 15) as quality_range from lithology group by 1 having thickest > 100 or quality_range >= 15"

# units, constraints and texts
_units = lambda s, d: stage(s, d, "assay").select("collar_id", "sample_id", F.element_at(F.array(*map(F.lit, ["Au", "Cu", "Ag"])), (F.col("sample_id") % 3 + 1).cast("int")).alias("element"), F.when(F.col("sample_id") % 13 == 0, None).otherwise(F.col("unit")).alias("unit"))
Q["units_off"] = lambda s, d: reports.units_off(_units(s, d)).where("size(reasons) > 0").groupBy("element", F.array_join("reasons", "; ").alias("reasons")).agg(F.count("*").alias("n"))
SQL["units_off"] = ctes("assay") + """, u as (select (['Au', 'Cu', 'Ag'])[sample_id % 3 + 1] as element, lower(trim(coalesce(case when sample_id % 13 <> 0 then unit end, ''))) as unit from assay
), c as (select element, unit, count(*) as n from u where unit <> '' group by 1, 2), m as (select element, first(unit order by n desc, unit) as usual from c group by 1 having count(*) > 1
), f as (select u.element, case when unit = '' and u.element in ('Au', 'Ag') then 'missing unit' when unit <> '' and unit <> usual then 'not ' || usual end as reasons from u left join m using (element))
select element, reasons, count(*) as n from f where reasons is not null group by 1, 2"""
Q["bare_columns"] = lambda s, d: stage(s, d, "assay").where("value_ppm is not null").select(_text(reports.bare_columns(F.create_map(F.lit("Au"), F.col("value_ppm"), F.lit("Cu"), F.col("value_ppm") / 50, F.lit("Zn_pct"), F.col("value_ppm")))).alias("columns")).groupBy("columns").agg(F.count("*").alias("n"))
SQL["bare_columns"] = ctes("assay") + " select case when value_ppm / 50 > 100 then 'Au,Cu' else 'Au' end as columns, count(*) as n from assay where value_ppm is not null group by 1"
_RULES = [("grade", r"grade|g/t", r"historic", 0.0, 500.0), ("dip", r"\bdip", "", -90.0, 90.0)]
_said = lambda: F.concat(F.when(F.col("collar_id") % 5 == 0, "Historic ").otherwise(""), F.lit("grade of "), F.col("total_depth").cast("long"), F.lit(" g/t [99999]"), F.rpad(F.lit(""), 250, "."), F.lit("dip of "), F.col("elevation").cast("long"))
Q["implausible_numbers"] = lambda s, d: reports.implausible(stage(s, d, "collar").select("collar_id", _said().alias("t")), "collar_id", "t", _RULES).groupBy("rule").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
SQL["implausible_numbers"] = ctes("collar") + " select 'grade' as rule, count(*) as n, sum(total_depth) as total from collar where total_depth > 500 and collar_id % 5 <> 0 having count(*) > 0 union all select 'dip', count(*), sum(elevation) from collar where elevation > 90 having count(*) > 0"
Q["expanded_questions"] = lambda s, d: table(s, d, "nation").select("n_nationkey", reports.expanded(F.concat(F.lit("au and Au over 5 G/T in DDH "), "n_nationkey", F.lit(" of Au, Australia")), {"Au": "gold", "g/t": "grams per tonne", "DDH": "diamond drillhole", "QP": "qualified person"}, 3).alias("t"))
SQL["expanded_questions"] = "select n_nationkey, 'au and Au (gold) over 5 g/t (grams per tonne) in DDH (diamond drillhole) ' || n_nationkey || ' of Au, Australia' as t from nation"
_mentions = lambda: F.concat(F.lit("DDH-"), F.col("collar_id") % 50, F.lit(" then 120/45 and "), F.rpad(F.lit(""), (F.col("collar_id") % 20).cast("int"), "x"), F.lit(" DDH-"), F.col("collar_id") % 70, F.lit(" or 30/60"))
Q["nearest_mentions"] = lambda s, d: reports.nearest_mentions(stage(s, d, "collar").select("collar_id", _mentions().alias("t")), "collar_id", "t", r"[0-9]{2,3}/[0-9]{2}", r"DDH-[0-9]+")
SQL["nearest_mentions"] = ctes("collar") + """, p as (select collar_id, 'DDH-' || collar_id % 50 as a, 'DDH-' || collar_id % 70 as b, collar_id % 20 as x from collar), q as (select *, length(a) + 6 as spot from p), r as (select *, spot + 6 + 5 + x + 1 as later from q)
select collar_id, cast(spot as integer) as "at", '120/45' as found, case when later - spot < spot then b else a end as mention from r union all select collar_id, cast(later + length(b) + 4 as integer), '30/60', b from r"""

# evidence
_scored = lambda s, d: stage(s, d, "usage").withColumn("score", F.round(F.col("cost") / 4000 - 1, 6))
Q["reranked"] = lambda s, d: reports.reranked(_scored(s, d), "user_id", "score", "event_id", 0.0, 12).select("user_id", "event_id", "rank", _r(F.col("relevance"), 6).alias("relevance"))
SQL["reranked"] = ctes("usage") + ", s as (select user_id, event_id, round(cost / 4000 - 1, 6) as score from usage), r as (select *, cast(row_number() over (partition by user_id order by score desc, event_id) as integer) as rank from s where score >= 0) select user_id, event_id, rank, round(1 / (1 + exp(-score)), 6) as relevance from r where rank <= 12"
Q["quality_gate"] = lambda s, d: _scored(s, d).where("score >= 0.25").groupBy("user_id").agg(F.count("*").alias("kept"))
SQL["quality_gate"] = ctes("usage") + " select user_id, count(*) as kept from usage where round(cost / 4000 - 1, 6) >= 0.25 group by 1"
Q["authority_order"] = lambda s, d: reports.authority_order(stage(s, d, "usage").withColumns({"kind": F.element_at(F.array(*map(F.lit, ["NI 43-101", "press release", "email"])), (F.col("event_id") % 3 + 1).cast("int")), "old": F.col("event_id") % 2 == 0}), "user_id", classify.authority_rank(F.col("kind")), "old", "cost", "event_id").where("place <= 5").select("user_id", "event_id", "place")
SQL["authority_order"] = ctes("usage") + ", r as (select user_id, event_id, cast(row_number() over (partition by user_id order by ([1, 3, 5])[event_id % 3 + 1], event_id % 2 = 0, cost desc nulls last, event_id) as integer) as place from usage) select * from r where place <= 5"
Q["floor_trim"] = lambda s, d: reports.trimmed(stage(s, d, "usage"), "user_id", "event_type", [F.desc("cost"), F.col("event_id")], "cost", 30000, 1).select("user_id", "event_id")
SQL["floor_trim"] = ctes("usage") + """, a as (select *, row_number() over (partition by user_id, event_type order by cost desc, event_id) = 1 as f from usage
), b as (select *, sum(case when f then cost else 0 end) over (partition by user_id) + sum(case when f then 0 else cost end) over (partition by user_id order by cost desc, event_id rows unbounded preceding) as t from a) select user_id, event_id from b where f or t <= 30000"""
Q["authority_patterns"] = lambda s, d: varied(s, d, "orders", "o_orderkey", [(t,) for t in AUTHORITY_SAMPLES], "t string").select("o_orderkey", classify.authority_rank(F.col("t")).alias("rank"))
AUTHORITY_SAMPLES = {
    "ni43-101": 1, "Technical-Report": 1, "feasibility study": 1, "PFS 2019": 1, "the PEA": 1, "resource estimate": 1, "reserve statement": 1, "JORC table": 1, "crirsco": 1,
    "assessment report": 2, "annual filing": 2, "Fact sheet": 2, "43-101F1": 2, "government disclosure": 2, "SEDAR": 2, "press release": 3, "investor deck": 3, "corporate presentation": 3, "news-release": 3,
    "historical report": 4, "archived report": 4, "legacy data": 4, "internal memo": 5, "email": 5, "field note": 5, "uncited": 5, "map": 3,
}
SQL["authority_patterns"] = "select o_orderkey, rank from orders join (values " + ", ".join(f"({k}, {r})" for k, r in enumerate(AUTHORITY_SAMPLES.values())) + f") v(k, rank) on o_orderkey % {len(AUTHORITY_SAMPLES)} = k"
IDENTIFIER_SAMPLES = {
    "see PLS-22-08": "HOLE_ID_DASHED", "2024-DDH-001": "HOLE_ID_DASHED", "DDH0023": "HOLE_ID_COMPACT,SAMPLE_ID_ALPHA", "MS240301": "SAMPLE_ID_ALPHA", "AU-240301": "SAMPLE_ID_DASHED",
    "sheet 74I12": "NTS_TILE", "104B08": "NTS_TILE", "U3O8 grade": "COMMODITY_CODE", "in 2022-04-15": "", "Cub Au": "COMMODITY_CODE",
}
Q["identifier_patterns"] = lambda s, d: varied(s, d, "orders", "o_orderkey", [(t,) for t in IDENTIFIER_SAMPLES], "t string").select("o_orderkey", F.array_join(classify.identifiers(F.col("t"))["classes"], ",").alias("classes"))
SQL["identifier_patterns"] = "select o_orderkey, classes from orders join (values " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(IDENTIFIER_SAMPLES.values())) + f") v(k, classes) on o_orderkey % {len(IDENTIFIER_SAMPLES)} = k"

# checks and gates
_judged = lambda s, d: stage(s, d, "assay").select("collar_id", "sample_id", F.when(F.col("sample_id") % 2 == 0, "Au").otherwise("Pt").alias("element"), F.col("value_ppm"), F.when(F.col("sample_id") % 7 == 0, "FAIL").when(F.col("sample_id") % 7 > 1, " Ok").alias("qaqc_flag"), (F.col("sample_id") % 17 != 0).alias("crm_pass"), (F.col("sample_id") % 19 != 0).alias("blank_pass"), (F.col("sample_id") % 23 != 0).alias("duplicate_pass"), (F.col("sample_id") % 5 == 0).alias("over_detection"), (F.col("sample_id") % 3 == 0).alias("under_detection"))
Q["assay_flags"] = lambda s, d: reports_flags(quality.assay_flags(_judged(s, d), keep=3))
reports_flags = lambda rows: rows.withColumns({"elements": _text("elements"), "samples": _text("samples")})
SQL["assay_flags"] = ctes("assay") + """, j as (select collar_id, sample_id as i, case when sample_id % 2 = 0 then 'Au' else 'Pt' end as element, value_ppm as v from assay), f as (
  select collar_id, i, element, 'assay.qaqc_flag_failed' as rule_id, 'ERROR' as severity from j where i % 7 = 0
  union all select collar_id, i, element, 'assay.crm_failed', 'ERROR' from j where i % 17 = 0 union all select collar_id, i, element, 'assay.blank_failed', 'ERROR' from j where i % 19 = 0
  union all select collar_id, i, element, 'assay.duplicate_failed', 'ERROR' from j where i % 23 = 0 union all select collar_id, i, element, 'assay.value_implausibly_high', 'WARNING' from j where v > case element when 'Au' then 100000 else 100 end
  union all select collar_id, i, element, 'assay.detection_paradox', 'INFO' from j where i % 15 = 0
), n as (select *, row_number() over (partition by collar_id, rule_id order by i, element) as rn from f)
select collar_id, rule_id, severity, count(*) as fail_count, array_to_string(list_sort(list(distinct element)), ',') as elements, coalesce(string_agg(i::varchar, ',' order by i) filter (where rn <= 3), '') as samples from n group by 1, 2, 3"""
Q["place_flags"] = lambda s, d: quality.flags(stage(s, d, "collar").select("collar_id", F.when(F.col("collar_id") % 5 == 0, "assumed").otherwise("surveyed").alias("georef_method"), (F.col("collar_id") % 10 / 10).alias("crs_confidence"), (F.col("collar_id") % 8 != 0).alias("has_geom"), "easting", "northing", F.col("elevation").alias("uncertainty_m")), ["collar_id"], quality.PLACE_RULES)
SQL["place_flags"] = ctes("collar") + """, f as (select collar_id, 'collar.crs_assumed' as rule_id, 'WARNING' as severity from collar where collar_id % 5 = 0 union all select collar_id, 'collar.crs_low_confidence', 'WARNING' from collar where collar_id % 10 < 5
  union all select collar_id, 'collar.geom_missing_with_coords', 'ERROR' from collar where collar_id % 8 = 0 union all select collar_id, 'collar.spatial_uncertainty_excessive', 'WARNING' from collar where elevation > 100) select *, 'v1.0' as rule_version from f"""
Q["silver_checks"] = lambda s, d: stage(s, d, "assay").agg((F.count("*") > 0).alias("has_rows"), F.count_if(F.col("value_ppm").isNull()).alias("null_values"), F.count_if(F.col("to_depth") <= F.col("from_depth")).alias("bad_intervals"), F.countDistinct("element").alias("elements"))
SQL["silver_checks"] = ctes("assay") + " select count(*) > 0 as has_rows, count(*) filter (where value_ppm is null) as null_values, count(*) filter (where to_depth <= from_depth) as bad_intervals, count(distinct element) as elements from assay"
_surveyed = lambda s, d: stage(s, d, "lithology").select("collar_id").distinct()
Q["trace_counts"] = lambda s, d: stage(s, d, "collar").join(_surveyed(s, d).withColumn("surveyed", F.lit(True)), "collar_id", "left").agg(F.count_if("surveyed").alias("surveyed"), F.count_if(F.col("surveyed").isNull() & F.col("azimuth").isNotNull() & F.col("dip").isNotNull() & (F.col("total_depth") > 0)).alias("straight"), F.count("*").alias("holes")).withColumn("missing", F.col("holes") - F.col("surveyed") - F.col("straight"))
SQL["trace_counts"] = ctes("collar", "lithology") + ", t as (select c.*, exists (select 1 from lithology l where l.collar_id = c.collar_id) as s from collar c), n as (select count(*) filter (where s) as surveyed, count(*) filter (where not s and azimuth is not null and dip is not null and total_depth > 0) as straight, count(*) as holes from t) select *, holes - surveyed - straight as missing from n"
Q["index_checks"] = lambda s, d: table(s, d, "embeddings").agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNull()).alias("without"), F.count_if(F.col("vec_id") % 10 == 3).alias("zero_pass")).withColumn("passed", (F.col("without") == 0) & (F.col("zero_pass") * 2 < F.col("n")))
SQL["index_checks"] = "select n, without, zero_pass, without = 0 and zero_pass * 2 < n as passed from (select count(*) as n, count(*) filter (where embedding is null) as without, count(*) filter (where vec_id % 10 = 3) as zero_pass from embeddings)"


def _completeness(s, d):
    holes, assays = stage(s, d, "collar"), stage(s, d, "assay")
    lost = holes.where(F.col("easting").isNull() | F.col("northing").isNull() | ((F.col("easting") == 0) & (F.col("northing") == 0)) | (F.col("easting") > 19900))
    return reports.findings([
        ("undocumented_work", "work", holes.where("status = 'P'"), F.col("collar_id")),
        ("unmappable_coordinates", "place", lost, F.col("collar_id")),
        ("missing_attachment", "file", holes.join(assays, "collar_id", "left_anti"), F.col("collar_id")),
    ]).groupBy("tier", "check").agg(F.count("*").alias("n"), F.min("record").alias("first_record"))


Q["completeness_audit"] = _completeness
SQL["completeness_audit"] = ctes("collar", "assay") + """, f as (select 'work' as tier, 'undocumented_work' as "check", collar_id from collar where status = 'P' union all select 'place', 'unmappable_coordinates', collar_id from collar where easting is null or northing is null or (easting = 0 and northing = 0) or easting > 19900
  union all select 'file', 'missing_attachment', collar_id from collar c where not exists (select 1 from assay a where a.collar_id = c.collar_id)) select tier, "check", count(*) as n, min(collar_id::varchar) as first_record from f group by 1, 2"""


def _sweep(s, d):
    orders, lines, people = (table(s, d, t) for t in ("orders", "lineitem", "customer"))
    return reports.findings([
        ("object_without_rows", "bronze", orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"), F.col("o_orderkey")),
        ("row_without_parent", "silver", orders.join(people.where("c_custkey % 10 <> 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"), F.col("o_orderkey")),
        ("summary_without_row", "gold", people.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti"), F.col("c_custkey")),
        ("sent_twice", "outbox", quality.duplicate_keys(stage(s, d, "usage"), ["workspace_id", "user_id", "event_type"]), F.concat_ws("-", "workspace_id", "user_id", "event_type")),
    ]).groupBy("tier", "check").agg(F.count("*").alias("n"))


Q["integrity_sweep"] = _sweep
SQL["integrity_sweep"] = ctes("usage") + """, f as (select 'bronze' as tier, 'object_without_rows' as "check" from orders where o_orderkey not in (select l_orderkey from lineitem) union all select 'silver', 'row_without_parent' from orders where o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 0)
  union all select 'gold', 'summary_without_row' from customer where c_custkey not in (select o_custkey from orders) union all select 'outbox', 'sent_twice' from (select 1 from usage group by workspace_id, user_id, event_type having count(*) > 1)) select tier, "check", count(*) as n from f group by 1, 2"""
Q["orphan_manifests"] = lambda s, d: table(s, d, "orders").where("o_orderstatus <> 'P' and o_orderkey % 4 < 3 and cast(o_orderdate as date) < date '1998-01-01'").join(table(s, d, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")
SQL["orphan_manifests"] = "select o_orderkey from orders o where o_orderstatus <> 'P' and o_orderkey % 4 < 3 and o_orderdate::date < date '1998-01-01' and not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l_returnflag = 'R')"
Q["promotion_gate"] = lambda s, d: reports.gate(stage(s, d, "collar").agg(F.count_if(F.col("status") == "P").alias("failed"), F.count_if(F.col("total_depth") > 500).alias("regressed")), stage(s, d, "collar").groupBy(F.col("hole_type").alias("name")).agg(F.count_if(F.col("total_depth") > 500).alias("regressed")), 0, 10**9, {"1-URGENT": 0, "2-HIGH": 10**9}, blocking=True).withColumn("reasons", F.array_join("reasons", ","))
SQL["promotion_gate"] = ctes("collar") + """, x as (select count(*) filter (where status = 'P') > 0 as a, count(*) filter (where hole_type = '1-URGENT' and total_depth > 500) > 0 as b from collar)
select concat_ws(',', case when a then 'failed' end, case when b then 'set:1-URGENT' end) as reasons, a or b as would_block, a or b as blocks from x"""

# skips and versions
_views = lambda s, d: table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.lit("1997-06-01").cast("date")).alias("made"))
Q["stale_views"] = lambda s, d: reports.stale(_views(s, d), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("changed")), "c_custkey", "made", "changed").select("c_custkey")
SQL["stale_views"] = "select c_custkey from customer where c_custkey % 4 = 0 or (select max(o_orderdate::date) from orders where o_custkey = c_custkey) > date '1997-06-01'"
Q["changed_feeds"] = lambda s, d: stage(s, d, "usage").groupBy("user_id").agg(F.max("ts").alias("edited")).join(stage(s, d, "usage").where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("pulled")), "user_id", "left").where("pulled is null or edited > pulled").select("user_id")
SQL["changed_feeds"] = ctes("usage") + " select user_id from usage group by 1 having max(ts) filter (where event_type = 'view') is null or max(ts) > max(ts) filter (where event_type = 'view')"
Q["data_versions"] = lambda s, d: reports.bumped(table(s, d, "nation").select(F.col("n_nationkey").alias("workspace"), F.lit(3).alias("version")), table(s, d, "customer").select(F.col("c_nationkey").alias("workspace"), (F.col("c_custkey") % 3 > 0).alias("succeeded")), ["workspace"])
SQL["data_versions"] = "select n_nationkey as workspace, cast(3 + count(*) filter (where c_custkey % 3 > 0) as bigint) as version from nation left join customer on c_nationkey = n_nationkey group by 1"
Q["row_of_window"] = lambda s, d: stage(s, d, "usage").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))).where("rn between 2 and 3").select("user_id", "event_id", "rn")
SQL["row_of_window"] = ctes("usage") + " select * from (select user_id, event_id, cast(row_number() over (partition by user_id order by ts desc, event_id) as integer) as rn from usage) where rn between 2 and 3"

DOCUMENT_SAMPLES = [
    ("ni43-101_gold.pdf", "Press Release", "NI 43-101", 0.95, "filename"), ("42.pdf", "ANNUAL REPORT 2020", "Annual Report", 0.85, "title"), ("mail.eml", "", "Email", 0.95, "filename"),
    ("a.pdf", "x" * 300 + " The Assessment work performed here", "Assessment Report", 0.70, "body"), ("b.pdf", "x" * 300 + " Forward-looking statements\nand securities", "Press Release", 0.70, "body"),
    ("project_fs2.pdf", "nothing", "Unknown", 0.0, "default"), ("pea-2.pdf", "Memorandum", "PEA", 0.95, "filename"), (None, "A memorandum", "Internal Memo", 0.85, "title"), ("field_notes3.txt", None, "Field Note", 0.95, "filename"),
]
Q["document_classes"] = lambda s, d: varied(s, d, "documents", "doc_id", [x[:2] for x in DOCUMENT_SAMPLES], "f string, t string").select("doc_id", classify.document_class(F.col("f"), F.col("t")).alias("x")).select("doc_id", "x.*")
SQL["document_classes"] = "select doc_id, document_class, confidence, signal from documents join (values " + ", ".join(f"({k}, '{c}', {p}::double, '{w}')" for k, (*_, c, p, w) in enumerate(DOCUMENT_SAMPLES)) + f") v(k, document_class, confidence, signal) on doc_id % {len(DOCUMENT_SAMPLES)} = k"
_TOPICS = [("viz", ["plot", "fence-diagram"], ["show me a"]), ("spatial", ["hole", "within"], ["cross section"]), ("computation", ["grade"], ["cut off grade"])]
_asked = lambda: F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ["Plot the", "Show me a", "Is the", "Draw a fence-diagram of"])), (F.col("o_orderkey") % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ["holes", "hole", "grades", "grade", "Cross section"])), (F.col("o_orderkey") % 5 + 1).cast("int")))
Q["query_topics"] = lambda s, d: table(s, d, "orders").select(_asked().alias("q")).groupBy("q").agg(F.count("*").alias("n")).withColumn("topic", classify.topic(F.col("q"), _TOPICS))
SQL["query_topics"] = r"""with q as (select (['Plot the', 'Show me a', 'Is the', 'Draw a fence-diagram of'])[o_orderkey % 4 + 1] || ' ' || (['holes', 'hole', 'grades', 'grade', 'Cross section'])[o_orderkey % 5 + 1] as q from orders)
select q, count(*) as n, case when list_has_any(regexp_extract_all(lower(q), '[\w-]+'), ['plot', 'fence-diagram']) or lower(q) like '%show me a%' then 'viz' when list_has_any(regexp_extract_all(lower(q), '[\w-]+'), ['hole', 'within']) or lower(q) like '%cross section%' then 'spatial'
  when list_has_any(regexp_extract_all(lower(q), '[\w-]+'), ['grade']) then 'computation' else 'unknown' end as topic from q group by 1"""
