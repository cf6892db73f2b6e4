"""Queries of flat exports, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.sources import sinks
from lodeframe.plans.stage import ctes, stage, table

Q, SQL = {}, {}

_holes = lambda s, d: stage(s, d, "collar").select("collar_id", "hole_id", "status")

Q["export_collars"] = lambda s, d: sinks.export_rows(stage(s, d, "collar").withColumn("total_depth", F.col("total_depth").cast("int")).withColumns({c: F.col(c).cast("int") for c in ("easting", "northing", "elevation", "azimuth", "dip")}), "collars", {"status": "F", "total_depth_min": 100, "total_depth_max": 400, "hole_type": ""})
SQL["export_collars"] = (
    ctes("collar")
    + """ select cast(collar_id as varchar) as collar_id, hole_id, cast(easting::int as varchar) as easting, cast(northing::int as varchar) as northing, cast(elevation::int as varchar) as elevation, cast(total_depth::int as varchar) as total_depth, hole_type,
cast(azimuth::int as varchar) as azimuth, cast(dip::int as varchar) as dip, cast(drill_date as varchar) as drill_date, status from collar where status = 'F' and total_depth between 100 and 400"""
)

_assay = lambda s, d: table(s, d, "lineitem").selectExpr("l_orderkey as collar_id", "l_linenumber as from_depth", "l_linenumber + 1 as to_depth", "l_partkey as sample_id", "concat(l_orderkey, '-', l_linenumber) as assay_id", "l_returnflag as assay_element", "case when l_partkey % 7 > 0 then cast(l_quantity as int) end as assay_value", "'ppm' as assay_unit", "l_partkey % 5 = 0 as below_detection", "'unused' as note").join(_holes(s, d), "collar_id")
_ROWS = ctes("collar") + ", a as (select l.*, hole_id, l_linenumber as f from lineitem l join collar on l_orderkey = collar_id)"
Q["export_assays"] = lambda s, d: sinks.export_rows(_assay(s, d), "assays", {"from_depth_max": 4})
SQL["export_assays"] = (
    _ROWS
    + """ select l_orderkey || '-' || f as assay_id, l_partkey::varchar as sample_id, l_orderkey::varchar as collar_id, hole_id, f::varchar as from_depth, (f + 1)::varchar as to_depth, l_returnflag as assay_element, coalesce(case when l_partkey % 7 > 0 then l_quantity::int end::varchar, '') as assay_value,
'ppm' as assay_unit, '' as method_code, '' as detection_limit, (l_partkey % 5 = 0)::varchar as below_detection, '' as qc_flag from a where f <= 4"""
)

Q["export_samples"] = lambda s, d: sinks.export_rows(_assay(s, d).withColumns({"sample_type": F.col("assay_element"), "lab_id": F.lit(7)}), "samples", {"from_depth_min": 2, "sample_type": "R"})
SQL["export_samples"] = _ROWS + " select l_partkey::varchar as sample_id, l_orderkey::varchar as collar_id, hole_id, f::varchar as from_depth, (f + 1)::varchar as to_depth, 'R' as sample_type, '7' as lab_id, '' as qaqc_type from a where f >= 2 and l_returnflag = 'R'"

Q["export_lithology"] = lambda s, d: sinks.export_rows(stage(s, d, "lithology").withColumns({"from_depth": F.col("from_depth").cast("int"), "to_depth": F.col("to_depth").cast("int")}).join(_holes(s, d), "collar_id"), "lithology", {"rock_code": "RK3"})
SQL["export_lithology"] = ctes("collar", "lithology") + " select '' as id, l.collar_id::varchar as collar_id, hole_id, from_depth::int::varchar as from_depth, to_depth::int::varchar as to_depth, rock_code, '' as rock_code_confidence, '' as rock_name, '' as description, '' as colour, '' as grain_size, '' as logged_by, '' as logged_date from lithology l join collar using (collar_id) where rock_code = 'RK3'"

_OXIDES = ["sio2_wt_pct", "mgo_wt_pct", "cia"]
_measured = lambda s, d: _assay(s, d).withColumn("geochem_id", F.col("assay_id")).withColumn("measured", F.expr("to_json(named_struct('sio2_wt_pct', assay_value + 0.5D, 'mgo_wt_pct', if(from_depth = 2, 'trace', '3.25'), 'ree', named_struct('la', from_depth)))")).withColumn("ree_json", F.get_json_object("measured", "$.ree"))
Q["export_geochemistry"] = lambda s, d: sinks.export_rows(sinks.expanded(_measured(s, d), "measured", _OXIDES), "geochemistry", extra=["ree_json"])
SQL["export_geochemistry"] = (
    _ROWS
    + """ select l_orderkey || '-' || f as geochem_id, l_orderkey::varchar as collar_id, hole_id, f::varchar as from_depth, (f + 1)::varchar as to_depth, l_partkey::varchar as sample_id, '' as sample_type, coalesce(case when l_partkey % 7 > 0 then l_quantity::int || '.5' end, '') as sio2_wt_pct, '' as al2o3_wt_pct, '' as fe2o3_wt_pct,
case when f = 2 then '' else '3.25' end as mgo_wt_pct, '' as cao_wt_pct, '' as na2o_wt_pct, '' as k2o_wt_pct, '' as mg_number, '' as cia, '' as eu_anomaly, '{"la":' || f || '}' as ree_json from a"""
)
