"""Queries of scalar functions, quality rules, geometry and surveys, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.functions import classify, geo, scalars
from lodeframe.operators import quality, spatial, survey
from lodeframe.plans.stage import ctes, stage, table

Q, SQL = {}, {}
_r = lambda c, n=4: F.round(c, n)

Q["hole_ids"] = lambda s, d: stage(s, d, "collar").select("collar_id", scalars.hole_id(F.concat(F.lit(" "), "hole_id", F.lit("_a/1 "))).alias("canonical"))
SQL["hole_ids"] = ctes("collar") + r" select collar_id, nullif(upper(regexp_replace(trim(' ' || hole_id || '_a/1 '), '[\s\-_./]+', '', 'g')), '') as canonical from collar"

Q["colliding_hole_ids"] = lambda s, d: stage(s, d, "collar").select(scalars.hole_id(F.substring("hole_id", 1, 6)).alias("canonical"), "hole_id").distinct().groupBy("canonical").agg(F.count("*").alias("variants"), F.min("hole_id").alias("first_id")).where("variants > 1")
SQL["colliding_hole_ids"] = ctes("collar") + r", c as (select distinct upper(regexp_replace(substring(hole_id, 1, 6), '[\s\-_./]+', '', 'g')) as canonical, hole_id from collar) select canonical, count(*) as variants, min(hole_id) as first_id from c group by canonical having count(*) > 1"

Q["entity_names"] = lambda s, d: table(s, d, "part").select("p_partkey", scalars.entity_text(F.concat_ws(" / ", "p_name", "p_type")).alias("name"))
SQL["entity_names"] = r"select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')) as name from part"

Q["formation_names"] = lambda s, d: table(s, d, "part").select("p_partkey", scalars.formation_name(F.concat("p_name", F.element_at(F.array(*map(F.lit, [" Formation.", " Group fm", " beds", ""])), (F.col("p_partkey") % 4 + 1).cast("int")))).alias("formation"))
SQL["formation_names"] = r"""with p as (select p_partkey, trim(regexp_replace(lower(trim(regexp_replace(p_name || ([' Formation.', ' Group fm', ' beds', ''])[p_partkey % 4 + 1], '\s+', ' ', 'g'))), '[.,;:]+$', '')) as s from part
), a as (select p_partkey, coalesce(nullif(trim(regexp_replace(s, '[\s\-]+(?:formation|fm|group|gp|member|mbr|zone|unit|suite|complex|sequence|horizon|bed|beds|assemblage)\.?$', '')), ''), s) as s from p
), b as (select p_partkey, coalesce(nullif(trim(regexp_replace(s, '[\s\-]+(?:formation|fm|group|gp|member|mbr|zone|unit|suite|complex|sequence|horizon|bed|beds|assemblage)\.?$', '')), ''), s) as s from a
), c as (select p_partkey, coalesce(nullif(trim(regexp_replace(s, '[\s\-]+(?:formation|fm|group|gp|member|mbr|zone|unit|suite|complex|sequence|horizon|bed|beds|assemblage)\.?$', '')), ''), s) as s from b)
select p_partkey, trim(regexp_replace(s, '[.,;:]+$', '')) as formation from c"""

Q["sample_names"] = lambda s, d: table(s, d, "part").select("p_partkey", scalars.sample_name(F.concat(F.lit("S-"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit("-A"))).alias("sample"))
SQL["sample_names"] = "select p_partkey, 's-' || cast(p_partkey as varchar) || '-a' as sample from part"

Q["units"] = lambda s, d: stage(s, d, "assay").groupBy(scalars.sample_unit(F.col("unit")).alias("sample_unit"), scalars.quality_unit(F.col("unit")).alias("quality_unit")).agg(F.count("*").alias("n"))
SQL["units"] = ctes("assay") + " select case lower(trim(unit)) when 'g/t' then 'gpt' else lower(trim(unit)) end as sample_unit, lower(trim(unit)) as quality_unit, count(*) as n from assay group by 1, 2"

_cell = lambda: F.concat(
    F.element_at(F.array(*map(F.lit, ["", "<", "< ", "BDL ", "x"])), (F.col("l_partkey") % 5 + 1).cast("int")), F.when(F.col("l_partkey") % 5 != 3, F.col("l_linenumber").cast("string")).otherwise("")
)
Q["assay_cells"] = lambda s, d: table(s, d, "lineitem").select("l_orderkey", scalars.assay_cell(_cell()).alias("c")).select("l_orderkey", "c.*").groupBy("value", "below", "threshold", "unparseable").agg(F.count("*").alias("n"))
SQL["assay_cells"] = """with c as (select l_partkey % 5 as k, cast(l_linenumber as double) as v from lineitem)
select case k when 0 then v when 1 then v / 2 when 2 then v / 2 end as value, k in (1, 2, 3) as below, case when k in (1, 2) then v end as threshold, k = 4 as unparseable, count(*) as n from c group by 1, 2, 3, 4"""

Q["qaqc_kinds"] = lambda s, d: table(s, d, "supplier").select("s_suppkey", scalars.qaqc_kind(F.concat(F.element_at(F.array(*map(F.lit, ["std", "BLK", "dup", "core"])), (F.col("s_suppkey") % 4 + 1).cast("int")), F.lit("-1")), F.when(F.col("s_suppkey") % 7 == 0, "Primary")).alias("kind"))
SQL["qaqc_kinds"] = "select s_suppkey, case when s_suppkey % 7 = 0 then 'Primary' else ([ 'Standard', 'Blank', 'Duplicate', null ])[s_suppkey % 4 + 1] end as kind from supplier"

Q["dip_convention"] = lambda s, d: stage(s, d, "collar").withColumn("x", F.when(F.col("project_id") % 3 == 0, -F.col("dip")).otherwise(F.col("dip"))).groupBy("project_id").agg(scalars.dip_convention(F.count("x"), F.count_if(F.col("x").between(-90, 0)), F.count_if(F.col("x").between(0, 90))).alias("convention"))
SQL["dip_convention"] = ctes("collar") + ", x as (select project_id, case when project_id % 3 = 0 then -dip else dip end as x from collar) select project_id, case when count(x) < 5 or count(*) filter (where x between -90 and 0) >= 0.8 * count(x) then 'down_negative' when count(*) filter (where x between 0 and 90) >= 0.8 * count(x) then 'down_positive' else 'ambiguous' end as convention from x group by project_id"

Q["any_dates"] = lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("n/a").alias("t")).select("o_orderkey", scalars.any_date(F.col("t")).cast("string").alias("day"))
SQL["any_dates"] = "select o_orderkey, case when o_orderkey % 3 < 2 then cast(cast(o_orderdate as date) as varchar) end as day from orders"

Q["uuids"] = lambda s, d: table(s, d, "nation").select("n_nationkey", scalars.uuid_of(F.col("n_name")).alias("hash_id"), scalars.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.col("n_name")).alias("name_id"))
SQL["uuids"] = """with h as (select n_nationkey, sha256(n_name) as h, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(n_name)) as s from nation)
select n_nationkey, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) as hash_id,
  s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || (['8','9','a','b'])[(strpos('0123456789abcdef', s[17:17]) - 1) % 4 + 1] || s[18:20] || '-' || s[21:32] as name_id from h"""

Q["recency"] = lambda s, d: stage(s, d, "collar").select("collar_id", _r(scalars.recency(F.when(F.col("collar_id") % 9 != 0, F.col("drill_date")), F.lit("2002-01-01").cast("date")), 6).alias("weight"))
SQL["recency"] = ctes("collar") + " select collar_id, round(case when collar_id % 9 <> 0 then exp(-ln(2.0) * date_diff('day', drill_date, date '2002-01-01') / 365.25 / 5) else 0.5 end, 6) as weight from collar"

Q["numbers_grounded"] = lambda s, d: table(s, d, "events").select("event_id", scalars.numbers_in(F.concat(F.lit("value "), F.get_json_object("props", "$.k"), F.lit(" of 1 [7] and 2.5"))).alias("claims")).select("event_id", F.size("claims").alias("claims"), scalars.grounded(F.col("claims"), F.array(F.lit(2.5), F.lit(50.0)), 20.0).alias("grounded"))
SQL["numbers_grounded"] = """with e as (select event_id, cast(json_extract_string(props, '$.k') as double) as k from events)
select event_id, cast(case when k in (0, 1, 2.5) then 1 else 2 end as integer) as claims, k in (0, 1) or abs(k - 2.5) <= 20 or abs(k - 50) <= 20 as grounded from e"""

Q["token_overlap"] = lambda s, d: table(s, d, "benchmark").alias("a").join(table(s, d, "benchmark").alias("b"), F.col("a.item_id") + 1 == F.col("b.item_id")).select(F.col("a.item_id").alias("item_id"), _r(scalars.token_overlap(F.col("a.text"), F.col("b.text"))).alias("overlap"))
SQL["token_overlap"] = r"""with t as (select item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^0-9A-Za-z_]+'), lambda x: x <> '')) as w from benchmark)
select a.item_id, round(len(list_intersect(a.w, b.w)) / nullif(len(a.w), 0), 4) as overlap from t a join t b on a.item_id + 1 = b.item_id"""

Q["trigram_matches"] = lambda s, d: table(s, d, "part").select("p_partkey", _r(scalars.trigram_similarity(F.col("p_name"), F.lit("steel widget"))).alias("similarity")).where("similarity > 0.1").orderBy(F.desc("similarity"), "p_partkey").limit(25)
SQL["trigram_matches"] = r"""with w as (select p_partkey, unnest(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as w from part
), g as (select distinct p_partkey, substr('  ' || w || ' ', i, 3) as g from (select p_partkey, w, unnest(range(1, length(w) + 2)) as i from w)
), q as (select distinct substr('  ' || w || ' ', i, 3) as g from (select w, unnest(range(1, length(w) + 2)) as i from (values ('steel'), ('widget')) t(w))
), s as (select p_partkey, count(q.g) as c, count(*) as n from g left join q using (g) group by p_partkey)
select p_partkey, round(c / (n + (select count(*) from q) - c), 4) as similarity from s where round(c / (n + (select count(*) from q) - c), 4) > 0.1 order by similarity desc, p_partkey limit 25"""

# quality
Q["collar_flags"] = lambda s, d: quality.flags(stage(s, d, "collar").withColumns({"dip": F.when(F.col("collar_id") % 11 == 0, None).otherwise(F.col("dip") + 30), "total_depth": F.col("total_depth") - 100, "elevation": F.nullif(F.col("elevation"), F.lit(0.0))}), ["collar_id"], quality.COLLAR_RULES)
SQL["collar_flags"] = ctes("collar") + """, c as (select collar_id, case when collar_id % 11 <> 0 then dip + 30 end as dip, azimuth, total_depth - 100 as td, nullif(elevation, 0) as el from collar), f as (
  select collar_id, 'collar.invalid_dip_range' as rule_id, 'ERROR' as severity from c where dip > 0 or dip < -90
  union all select collar_id, 'collar.invalid_azimuth_range', 'ERROR' from c where azimuth < 0 or azimuth >= 360
  union all select collar_id, 'collar.invalid_total_depth', 'ERROR' from c where td is null or td <= 0
  union all select collar_id, 'collar.missing_elevation', 'WARNING' from c where el is null
  union all select collar_id, 'collar.missing_azimuth', 'INFO' from c where azimuth is null
  union all select collar_id, 'collar.missing_dip', 'INFO' from c where dip is null)
select *, 'v1.0' as rule_version from f"""
Q["mixed_units"] = lambda s, d: quality.mixed_units(stage(s, d, "assay"), scalars.quality_unit(F.col("unit")), ["collar_id", "element"]).withColumn("units", F.array_join("units", ","))
SQL["mixed_units"] = ctes("assay") + " select collar_id, element, array_to_string(list_sort(list(distinct lower(trim(unit)))), ',') as units from assay group by 1, 2 having count(distinct lower(trim(unit))) > 1"
Q["duplicate_lines"] = lambda s, d: quality.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])
SQL["duplicate_lines"] = "select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1"
Q["exactly_one"] = lambda s, d: table(s, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, 1).alias("a"), F.when(F.col("o_orderkey") % 3 == 0, 1).alias("b")).groupBy(quality.exactly_one(["a", "b"]).alias("ok")).agg(F.count("*").alias("n"))
SQL["exactly_one"] = "select (o_orderkey % 2 = 0) <> (o_orderkey % 3 = 0) as ok, count(*) as n from orders group by 1"
Q["parse_quality"] = lambda s, d: quality.pass_rate(stage(s, d, "assay"), F.col("value_ppm").isNotNull())
SQL["parse_quality"] = ctes("assay") + " select count(*) as total, count(value_ppm) as valid, round(count(value_ppm) * 100 / nullif(count(*), 0), 2) as quality_pct from assay"


def _broken_ledger(s, d):
    rows = stage(s, d, "usage").select("workspace_id", "event_id", "event_type", "cost")
    sealed = quality.chain(rows, "workspace_id", ["event_id"], ["event_id", "event_type", "cost"])
    return sealed.withColumn("cost", F.when(F.col("event_id") % 500 == 7, F.col("cost") + 1).otherwise(F.col("cost")))


Q["ledger_verification"] = lambda s, d: quality.verify_chain(_broken_ledger(s, d), "workspace_id", ["event_id"], ["event_id", "event_type", "cost"])
SQL["ledger_verification"] = ctes("usage") + " select workspace_id, event_id, false as bad_link, true as bad_hash from usage where event_id % 500 = 7"
Q["ledger_links"] = lambda s, d: stage(s, d, "usage").select("event_id", "workspace_id", scalars.ledger_hash(F.lit(None).cast("string"), F.col("event_id"), F.col("event_type"), F.col("user_id")).alias("hash"))
SQL["ledger_links"] = ctes("usage") + " select event_id, workspace_id, sha256('|' || event_id || '|' || event_type || '|' || user_id) as hash from usage"
Q["checksum_diff"] = lambda s, d: quality.compare(table(s, d, "orders").where("o_orderkey % 7 <> 0").selectExpr("o_orderkey", "o_totalprice as c"), table(s, d, "orders").where("o_orderkey % 5 <> 0").selectExpr("o_orderkey", "o_totalprice + int(o_orderkey % 11 = 0) as c"), "o_orderkey", "c").groupBy("state").agg(F.count("*").alias("n"))
SQL["checksum_diff"] = "select case when o_orderkey % 7 = 0 then 'added' when o_orderkey % 5 = 0 then 'removed' when o_orderkey % 11 = 0 then 'changed' else 'same' end as state, count(*) as n from orders where o_orderkey % 35 <> 0 group by 1"

# geometry
_lon = lambda: F.col("easting") / 20000 * 40 - 120
_lat = lambda: F.col("northing") / 20000 * 30 + 40
GEO = ctes("collar") + ", g as (select *, easting / 20000 * 40 - 120 as lon, northing / 20000 * 30 + 40 as lat from collar)"
Q["haversine"] = lambda s, d: stage(s, d, "collar").select("collar_id", _r(geo.haversine(_lat(), _lon(), F.lit(50.0), F.lit(-105.0)), 2).alias("metres"), _r(geo.bearing(_lat(), _lon(), F.lit(50.0), F.lit(-105.0)), 5).alias("bearing"))
SQL["haversine"] = GEO + """ select collar_id, round(2 * 6371000 * asin(sqrt(least(pow(sin((radians(50.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(50.0)) * pow(sin(radians(-105.0 - lon) / 2), 2), 1))), 2) as metres,
  round(fmod(degrees(atan2(sin(radians(-105.0 - lon)) * cos(radians(50.0)), cos(radians(lat)) * sin(radians(50.0)) - sin(radians(lat)) * cos(radians(50.0)) * cos(radians(-105.0 - lon)))) + 360, 360), 5) as bearing from g"""


def _section(s, d):
    along, off = geo.section(F.col("easting"), F.col("northing"), 1000.0, 2000.0, 15000.0, 9000.0)
    return stage(s, d, "collar").where(geo.in_corridor(F.col("easting"), F.col("northing"), 1000.0, 2000.0, 15000.0, 9000.0, 500.0)).select("collar_id", _r(along).alias("along"), _r(off).alias("off"))


Q["section_corridor"] = _section
SQL["section_corridor"] = ctes("collar") + """, u as (select 14000 / sqrt(14000.0 * 14000 + 7000.0 * 7000) as ux, 7000 / sqrt(14000.0 * 14000 + 7000.0 * 7000) as uy, sqrt(14000.0 * 14000 + 7000.0 * 7000) as len
), p as (select collar_id, easting as x, northing as y, (easting - 1000) * ux + (northing - 2000) * uy as a, (easting - 1000) * uy - (northing - 2000) * ux as o, greatest(0, least(len, (easting - 1000) * ux + (northing - 2000) * uy)) as t, ux, uy from collar, u)
select collar_id, round(a, 4) as along, round(o, 4) as off from p where pow(x - (1000 + t * ux), 2) + pow(y - (2000 + t * uy), 2) <= 250000"""
Q["tile_counts"] = lambda s, d: stage(s, d, "collar").select(*[c.alias(n) for c, n in zip(geo.tile(_lon(), _lat(), 7), ("x", "y"), strict=True)]).groupBy("x", "y").agg(F.count("*").alias("n"))
SQL["tile_counts"] = GEO + " select cast(floor((lon + 180) / 360 * 128) as integer) as x, cast(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 128) as integer) as y, count(*) as n from g group by 1, 2"
Q["hex_density"] = lambda s, d: stage(s, d, "collar").groupBy(geo.hex_cell(F.col("easting"), F.col("northing"), 700.0).alias("cell")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "F").alias("finished"))
SQL["hex_density"] = ctes("collar") + """, a as (select status, (sqrt(3) / 3 * easting - northing / 3) / 700 as q, (northing * (2.0::double / 3)) / 700 as r from collar
), b as (select *, -q - r as s, round(q) as rq, round(r) as rr, round(-q - r) as rs from a), c as (select *, abs(rq - q) as dq, abs(rr - r) as dr, abs(rs - s) as ds from b
), e as (select status, case when dq > dr and dq > ds then -rr - rs else rq end as q, case when dq > dr and dq > ds then rr when dr > ds then -rq - rs else rr end as r from c)
select cast(q as bigint) || ':' || cast(r as bigint) as cell, count(*) as n, count(*) filter (where status = 'F') as finished from e group by 1"""
Q["grid_clusters"] = lambda s, d: spatial.clusters(stage(s, d, "collar"), 2500.0).withColumns({c: _r(F.col(c)) for c in ("cx", "cy")})
SQL["grid_clusters"] = ctes("collar") + " select round(easting / 2500) * 2500 as gx, round(northing / 2500) * 2500 as gy, count(*) as n, round(avg(easting), 4) as cx, round(avg(northing), 4) as cy from collar group by 1, 2"
Q["stereonet"] = lambda s, d: stage(s, d, "collar").select("collar_id", *[_r(c, 6).alias(n) for c, n in zip(geo.stereonet(F.col("azimuth"), -F.col("dip")), ("x", "y"), strict=True)])
SQL["stereonet"] = ctes("collar") + " select collar_id, round(sqrt(2) * sin(radians(90 + dip) / 2) * sin(radians(azimuth)), 6) as x, round(sqrt(2) * sin(radians(90 + dip) / 2) * cos(radians(azimuth)), 6) as y from collar"
Q["straight_ends"] = lambda s, d: stage(s, d, "collar").select("collar_id", *[_r(c, 3).alias(n) for c, n in zip(geo.straight_end(*map(F.col, ("easting", "northing", "elevation", "azimuth", "dip", "total_depth"))), "xyz", strict=True)])
SQL["straight_ends"] = ctes("collar") + " select collar_id, round(easting + total_depth * (cos(radians(dip)) * sin(radians(azimuth))), 3) as x, round(northing + total_depth * (cos(radians(dip)) * cos(radians(azimuth))), 3) as y, round(elevation + total_depth * sin(radians(dip)), 3) as z from collar"
Q["true_orientation"] = lambda s, d: stage(s, d, "collar").select("collar_id", *[_r(c).alias(n) for c, n in zip(geo.true_orientation(F.lit(40.0), F.col("azimuth") / 2 + 1, F.col("azimuth"), F.col("dip")), ("true_dip", "direction"), strict=True)])
SQL["true_orientation"] = ctes("collar") + """, n as (select collar_id, sin(radians(40.0)) * cos(radians(azimuth / 2 + 1)) as u, sin(radians(40.0)) * sin(radians(azimuth / 2 + 1)) as v, cos(radians(40.0)) as w, radians(azimuth) as z, radians(dip) as d from collar
), m as (select collar_id, cos(z) * sin(d) * u - sin(z) * v + cos(z) * cos(d) * w as x, sin(z) * sin(d) * u + cos(z) * v + sin(z) * cos(d) * w as y, -cos(d) * u + sin(d) * w as p from n
), f as (select collar_id, case when p > 0 then -x else x end as x, case when p > 0 then -y else y end as y, abs(p) as p from m)
select collar_id, round(degrees(atan2(sqrt(x * x + y * y), p)), 4) as true_dip, round(fmod(degrees(atan2(x, y)) + 360, 360), 4) as direction from f"""

_stations = lambda s, d: stage(s, d, "lithology").groupBy("collar_id", F.col("from_depth").alias("depth")).agg((F.count("*") * 17 + F.col("from_depth") * 3).alias("azimuth"), (-F.count("*") * 4.0 - 50).alias("dip")).withColumns({"x0": F.lit(100.0), "y0": F.lit(200.0)})
STATIONS = """, st as (select collar_id, from_depth as depth, radians(count(*) * 17 + from_depth * 3) as a, radians(-count(*) * 4.0 - 50) as d from lithology group by 1, 2
), dc as (select *, cos(d) * cos(a) as n, cos(d) * sin(a) as e, sin(d) as u from st
), pv as (select *, lag(n) over w as pn, lag(e) over w as pe, lag(u) over w as pu, depth - coalesce(lag(depth) over w, 0) as dl from dc window w as (partition by collar_id order by depth)
), bt as (select *, acos(greatest(-1, least(1, n * pn + e * pe + u * pu))) as beta from pv
), rf as (select *, case when beta < 1e-9 then 1 else 2 / beta * tan(beta / 2) end as r from bt
), path as (select collar_id, depth, 100 + sum(case when pn is null then dl * e else dl / 2 * (e + pe) * r end) over w as x, 200 + sum(case when pn is null then dl * n else dl / 2 * (n + pn) * r end) over w as y,
  sum(case when pn is null then dl * u else dl / 2 * (u + pu) * r end) over w as z, degrees(beta) / nullif(dl, 0) * 30 as dogleg from rf window w as (partition by collar_id order by depth rows unbounded preceding))"""
Q["minimum_curvature"] = lambda s, d: survey.minimum_curvature(_stations(s, d)).withColumns({c: _r(F.col(c)) for c in ("x", "y", "z", "dogleg")})
SQL["minimum_curvature"] = ctes("lithology") + STATIONS + " select collar_id, depth, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z, round(dogleg, 4) as dogleg from path"
Q["max_dogleg"] = lambda s, d: survey.minimum_curvature(_stations(s, d)).groupBy("collar_id").agg(_r(F.max("dogleg")).alias("max_dogleg"))
SQL["max_dogleg"] = ctes("lithology") + STATIONS + " select collar_id, round(max(dogleg), 4) as max_dogleg from path group by 1"
Q["sample_places"] = lambda s, d: survey.interpolate(survey.minimum_curvature(_stations(s, d)), stage(s, d, "assay").select("collar_id", "sample_id", F.col("from_depth").alias("at"))).groupBy("collar_id").agg(F.count("*").alias("samples"), F.count("at_x").alias("placed"), _r(F.max("at_x"), 3).alias("max_x"), _r(F.min("at_z"), 3).alias("min_z"))
SQL["sample_places"] = ctes("lithology", "assay") + STATIONS + """, sg as (select *, lead(depth) over w as d1, lead(x) over w as x1, lead(z) over w as z1 from path window w as (partition by collar_id order by depth)
), pl as (select distinct collar_id, from_depth as spot from assay), hit as (select pl.collar_id, spot, x + coalesce((spot - depth) / nullif(d1 - depth, 0), 0) * (x1 - x) as ax, z + coalesce((spot - depth) / nullif(d1 - depth, 0), 0) * (z1 - z) as az,
  row_number() over (partition by pl.collar_id, spot order by depth) as rn from pl join sg using (collar_id) where d1 is not null and spot >= depth and spot <= d1)
select a.collar_id, count(*) as samples, count(ax) as placed, round(max(ax), 3) as max_x, round(min(az), 3) as min_z from assay a left join (select * from hit where rn = 1) h on a.collar_id = h.collar_id and a.from_depth = h.spot group by 1"""
Q["near_pairs"] = lambda s, d: spatial.near(stage(s, d, "collar").select("collar_id", "easting", "northing"), stage(s, d, "collar").select("collar_id", "easting", "northing"), 60.0).where("a_collar_id < b_collar_id").select("a_collar_id", "b_collar_id", _r(F.col("distance")).alias("distance"))
SQL["near_pairs"] = ctes("collar") + " select a.collar_id as a_collar_id, b.collar_id as b_collar_id, round(sqrt(pow(a.easting - b.easting, 2) + pow(a.northing - b.northing, 2)), 4) as distance from collar a join collar b on a.collar_id < b.collar_id and abs(a.easting - b.easting) <= 60 and abs(a.northing - b.northing) <= 60 where pow(a.easting - b.easting, 2) + pow(a.northing - b.northing, 2) <= 3600"
Q["nearest_collars"] = lambda s, d: spatial.nearest(stage(s, d, "collar"), 5000.0, 5000.0, 10, "collar_id").select("collar_id", _r(F.col("distance")).alias("distance"))
SQL["nearest_collars"] = ctes("collar") + " select collar_id, round(sqrt(pow(easting - 5000, 2) + pow(northing - 5000, 2)), 4) as distance from collar order by sqrt(pow(easting - 5000, 2) + pow(northing - 5000, 2)), collar_id limit 10"
Q["every_nth_collar"] = lambda s, d: spatial.every_nth(stage(s, d, "collar"), ["project_id"], ["collar_id"], 20).select("project_id", "collar_id")
SQL["every_nth_collar"] = ctes("collar") + ", n as (select project_id, collar_id, count(*) over (partition by project_id) as n, row_number() over (partition by project_id order by collar_id) - 1 as k from collar) select project_id, collar_id from n where k % greatest(cast(ceil(n / 20) as bigint), 1) = 0"

_KINDS = ["NI 43-101 Technical Report", "Annual report 2004", "press-release", "Legacy data", "field note", "other"]
Q["authority"] = lambda s, d: table(s, d, "orders").select(F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).withColumn("rank", classify.authority_rank(F.col("kind")))
SQL["authority"] = f"select ({_KINDS!r})[o_orderkey % 6 + 1] as kind, count(*) as n, cast(([1, 2, 3, 4, 5, 3])[o_orderkey % 6 + 1] as integer) as rank from orders group by 1, 3"
Q["identifier_classes"] = lambda s, d: stage(s, d, "collar").select(classify.identifiers(F.concat(F.lit("Au in "), F.when(F.col("collar_id") % 2 == 0, F.concat(F.lit("PLS-22-"), F.col("collar_id") % 90)).otherwise("none"))).alias("x")).groupBy(F.array_join("x.classes", ",").alias("classes"), F.array_join("x.tokens", ",").alias("tokens")).agg(F.count("*").alias("n"))
SQL["identifier_classes"] = ctes("collar") + " select case when collar_id % 2 = 0 then 'HOLE_ID_DASHED,COMMODITY_CODE' else 'COMMODITY_CODE' end as classes, case when collar_id % 2 = 0 then 'PLS-22-' || (collar_id % 90) || ',Au' else 'Au' end as tokens, count(*) as n from collar group by 1, 2"
Q["confidence_levels"] = lambda s, d: table(s, d, "events").groupBy(classify.confidence(F.col("user_id") % 4, F.col("event_id") % 3 == 0, F.col("event_id") % 7 == 0).alias("level")).agg(F.count("*").alias("n"))
SQL["confidence_levels"] = "select case when event_id % 7 = 0 then 'Low' when user_id % 4 >= 2 then case when event_id % 3 = 0 then 'Medium' else 'High' end when user_id % 4 = 1 then 'Medium' else 'Low' end as level, count(*) as n from events group by 1"
