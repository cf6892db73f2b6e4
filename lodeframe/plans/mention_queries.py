"""Queries of mentions in texts and of the ingest steps built on them, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.functions import classify, mentions
from lodeframe.operators import ingest, targets
from lodeframe.plans.stage import ctes, stage, table, varied
from lodeframe.sources import readers

Q, SQL = {}, {}

# measurements: a labelled pair, a pair with its kind, core angles, a pair near a structure's word, and a depth
_SAID = [
    "concat('Strike: ', a, ', dip ', b, ' SW')",
    "concat('seen with bedding: ', a, ' / ', b)",
    "concat('alpha ', b, ' beta ', a, ' on a vein')",
    "concat('a fault zone ', a, '/', b, ' NE')",
    "concat('sampled at ', a, '/', b, ' m')",
]
_notes = lambda s, d: table(s, d, "orders").selectExpr("o_orderkey as id", "cast(o_custkey % 400 as int) as a", "cast(o_orderkey * 7 % 100 as int) as b").selectExpr("id", f"element_at(array({', '.join(_SAID)}), cast(id % 5 + 1 as int)) as t")
MEASURED = """with n as (select o_orderkey as id, o_orderkey % 5 as k, o_custkey % 400 as a, o_orderkey * 7 % 100 as b from orders
), m as (select id, case k when 0 then 'other' when 1 then 'bedding' when 2 then 'vein' else 'fault' end as structure_type, case when k = 2 then b::double end as alpha_angle, case when k = 2 then a::double end as beta_angle,
  case when k <> 2 then b::double end as true_dip, case k when 0 then case when (225 - a + 720) % 360 > 180 then (a + 270) % 360 else (a + 90) % 360 end when 3 then case when (45 - a + 720) % 360 > 180 then (a + 270) % 360 else (a + 90) % 360 end
  when 1 then (a + 90) % 360 end::double as true_dip_dir from n where k < 4 and a <= 360 and b <= 90)"""
Q["attitudes"] = lambda s, d: mentions.attitudes(_notes(s, d), ["id"], "t").drop("notes")
SQL["attitudes"] = MEASURED + " select * from m"
Q["mined_structures"] = lambda s, d: ingest.mined_structures(_notes(s, d), mentions.attitudes(_notes(s, d).where("id % 3 = 0"), ["id"], "t"), ["id"], "t").drop("notes")
SQL["mined_structures"] = MEASURED + " select * from m where id % 3 <> 0"

_PLACES = [
    "concat('NAD 83, Zone 12N ', 400000 + c, ' mE ', 6000000 + c, ' mN')",
    "concat('UTM: 13S ', 400000 + c, ' ', 6000000 + c)",
    "concat('13S ', 400000 + c, ' ', 6000000 + c)",
    "concat('at ', c % 120, '.50°S, ', 10 + c % 90, '.250° E (WGS84)')",
    "concat('at 54°30\\'36\"N ', c % 200, '°15\\'00\"W')",
]
Q["text_coordinates"] = lambda s, d: mentions.coordinates(table(s, d, "customer").selectExpr("c_custkey as id", "c_custkey as c").selectExpr("id", f"element_at(array({', '.join(_PLACES)}), cast(id % 5 + 1 as int)) as t"), ["id"], "t").drop("raw", "first", "last").withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})
SQL["text_coordinates"] = """select c_custkey as id, case k when 3 then 'latlon_decimal' when 4 then 'latlon_dms' else 'utm' end as kind, case k when 3 then -(c % 120 + 0.5) when 4 then 54.51 end::double as latitude, case k when 3 then 10.25 + c % 90 when 4 then -(c % 200 + 0.25) end::double as longitude,
  case k when 0 then 12 when 1 then 13 end as zone, case k when 0 then 'N' when 1 then 'S' end as hemisphere, case when k < 2 then 400000 + c end::double as easting, case when k < 2 then 6000000 + c end::double as northing, case k when 0 then 'NAD83' when 3 then 'WGS84' end as datum
  from (select *, c_custkey as c, c_custkey % 5 as k from customer) where k < 2 or (k = 3 and c % 120 < 90) or (k = 4 and c % 200 < 180)"""

_NAMED = [
    ("Drilling was completed by Foraco and assayed at ALS Chemex Vancouver.", [("contractor", 0, "Foraco"), ("contractor", 1, "Foraco and assayed at ALS Chemex"), ("laboratory", 0, "ALS Chemex"), ("laboratory", 1, "ALS"), ("laboratory", 2, "ALS Chemex Vancouver")]),
    ("Logged by Sam O'Connor. Jane Doe, P.Geo, signed.", [("person", 0, "Jane Doe"), ("person", 1, "Sam O'Connor")]),
    ("The Qualified Persons John Smith, P.Eng. and Dr. Ann Lee, QP", [("person", 0, "John Smith"), ("person", 1, "Ann Lee")]),
    ("nothing here", []),
]
Q["text_names"] = lambda s, d: mentions.names(varied(s, d, "orders", "o_orderkey", [x[:1] for x in _NAMED], "t string"), ["o_orderkey"], "t")
_quoted = lambda n: n.replace("'", "''")
SQL["text_names"] = "select o_orderkey, kind, place, name from orders join (values " + ", ".join(f"({k}, '{kind}', {at}, '{_quoted(n)}')" for k, (_, found) in enumerate(_NAMED) for kind, at, n in found) + f") v(k, kind, place, name) on o_orderkey % {len(_NAMED)} = k"
_mentioned = lambda s, d: table(s, d, "orders").selectExpr("o_custkey as c_custkey", "o_orderkey as place", "case when o_orderkey % 4 = 0 then 'laboratory' else 'contractor' end as kind", "concat('N', cast(o_orderkey as string)) as name")
Q["filled_names"] = lambda s, d: ingest.filled(table(s, d, "customer").selectExpr("c_custkey", "case when c_custkey % 3 = 0 then 'Known' when c_custkey % 3 = 1 then ' ' end as contractor", "cast(null as string) as lab"), _mentioned(s, d), "c_custkey", {"contractor": "contractor", "lab": "laboratory"})
SQL["filled_names"] = """select c_custkey, case when c_custkey % 3 = 0 then 'Known' else (select 'N' || min(o_orderkey) from orders where o_custkey = c_custkey and o_orderkey % 4 <> 0) end as contractor, (select 'N' || min(o_orderkey) from orders where o_custkey = c_custkey and o_orderkey % 4 = 0) as lab from customer"""

_FIRST, _LAST = ["What is the grade", "Summarize", "Flag outliers and blanks", "Hole 36-1085", "Tell me about it"], ["across holes", "with data gaps", "in DDH-12", "", "by year with missing coverage"]
Q["question_intents"] = lambda s, d: table(s, d, "orders").select(F.concat_ws(" ", F.element_at(F.array(*map(F.lit, _FIRST)), (F.col("o_orderkey") % 5 + 1).cast("int")), F.element_at(F.array(*map(F.lit, _LAST)), (F.col("o_custkey") % 5 + 1).cast("int"))).alias("q")).groupBy("q").agg(F.count("*").alias("n")).select("q", "n", mentions.intent(F.col("q")).alias("x")).select("q", "n", "x.*")
SQL["question_intents"] = f"""with q as (select {_FIRST}[o_orderkey % 5 + 1] as a, {_LAST}[o_custkey % 5 + 1] as b, count(*) as n from orders group by 1, 2
), c as (select *, (a = 'What is the grade')::int as f, (a = 'Summarize')::int + (b = 'across holes')::int as s, case when a like 'Flag%' then 3 else 0 end as o, case b when 'with data gaps' then 1 when 'by year with missing coverage' then 2 else 0 end as g, (b like 'by year%')::int as p, a like 'Hole%' or b = 'in DDH-12' as h from q
), x as (select *, list_sort(list_filter([{{'n': f, 'k': -1, 'r': 0, 'i': 'factual_lookup'}}, {{'n': s, 'k': -2, 'r': 6, 'i': 'synthesis'}}, {{'n': o, 'k': -4, 'r': 1, 'i': 'anomaly_detection'}}, {{'n': p, 'k': -6, 'r': 2, 'i': 'project_summary'}}, {{'n': g, 'k': -7, 'r': 3, 'i': 'coverage_gap'}}], lambda y: y.n > 0), 'desc') as l from c
), y as (select *, coalesce(l[1].n = l[2].n and l[2].r > l[1].r, false) as sw from x)
select a || ' ' || b as q, n, case when h and s + o + g + p = 0 then 'factual_lookup' when len(l) = 0 then 'synthesis' when sw then l[2].i else l[1].i end as intent,
  case when h and s + o + g + p = 0 then 1 when len(l) = 0 then 0 else (l[1].n - coalesce(l[2].n, 0)) / l[1].n end::double as confidence, case when h and s + o + g + p = 0 then null when sw then l[1].i else l[2].i end as second from y"""

_DOMAINS = [("filename", r"\bassay\b", "geochemistry", "core", 0.45, "filename:assay"), ("filename", r"\bgeochem(?:istry)?\b", "geochemistry", None, 0.3, "filename:geochem"), ("filename", r"\bgravity[\s_-]*survey\b", "geophysics", "gravity", 0.5, "filename:gravity"), ("extension", ".las", "geophysics", None, 0.35, "ext:las"), ("extension", ".dxf", "geology", None, 0.15, "ext:dxf"), ("content", r"\bQualified Person\b", "reports", None, 0.2, "content:qp"), ("content", r"NI[\s-]*43[\s-]*101", "reports", "ni43", 0.35, "content:ni43")]
_FILES = [("PLS_assay_geochem.csv", "", "geochemistry:core:0.75:filename:assay,filename:geochem"), ("a-gravity-survey.LAS", "by a qualified person, NI 43-101", "geophysics:gravity:0.85:ext:las,filename:gravity;reports:ni43:0.55:content:ni43,content:qp"), ("x.dxf", "a qualified person", ""), ("geochem.las", None, "geophysics::0.35:ext:las;geochemistry::0.3:filename:geochem")]
Q["domain_tags"] = lambda s, d: varied(s, d, "documents", "doc_id", [x[:2] for x in _FILES], "f string, t string").select("doc_id", F.array_join(F.transform(mentions.domains(F.col("f"), F.col("t"), _DOMAINS), lambda x: F.concat_ws(":", x["domain"], F.coalesce(x["sub_type"], F.lit("")), x["confidence"].cast("string"), F.array_join(x["labels"], ","))), ";").alias("tags"))
SQL["domain_tags"] = "select doc_id, tags from documents join (values " + ", ".join(f"({k}, '{w}')" for k, (*_, w) in enumerate(_FILES)) + f") v(k, tags) on doc_id % {len(_FILES)} = k"

# steps from landed rows
Q["survey_lines"] = lambda s, d: ingest.survey_lines(stage(s, d, "collar"), "project_id", "collar_id", "easting", "northing", ["elevation"], 7)
SQL["survey_lines"] = ctes("collar") + """, p as (select *, row_number() over (partition by project_id order by collar_id) - 1 as i, count(*) over (partition by project_id) as n from collar
), k as (select project_id, n, unnest(list_distinct([floor(j * greatest(n / 7, 1.0))::bigint for j in range(7)])) as i from (select distinct project_id, n from p)
), w as (select p.project_id, count(*) as stored, 'LINESTRING(' || string_agg(easting || ' ' || northing, ', ' order by p.i) || ')' as wkt from p join k on p.project_id = k.project_id and p.i = k.i group by 1)
select cast(c.project_id as varchar) as project_id, count(*) as points, min(elevation) as elevation_min, max(elevation) as elevation_max, round(avg(elevation), 6) as elevation_mean, any_value(stored) as stored, any_value(wkt) as wkt from collar c join w using (project_id) where stored > 1 group by 1"""
Q["assay_passages"] = lambda s, d: ingest.assay_passages(stage(s, d, "assay").groupBy("collar_id", "sample_id", "from_depth", "to_depth", "element").agg(F.max("value_ppm").alias("value"), F.lit("ppm").alias("unit")), ["collar_id", "sample_id", "from_depth", "to_depth"], F.col("collar_id"), F.lit(None), F.lit("ALS"), F.lit(" "))
SQL["assay_passages"] = ctes("assay") + """, a as (select collar_id, sample_id, from_depth, to_depth, element, max(value_ppm) as v from assay group by all), b as (select collar_id, sample_id, from_depth, to_depth, string_agg(case when v is null then element || ' ND' else element || ' ' || v || ' ppm' end, ', ' order by element) as e from a group by 1, 2, 3, 4)
select collar_id, sample_id, from_depth, to_depth, 'Assay sample ' || sample_id || ' from drillhole ' || collar_id || ' ((unknown project) project), interval ' || from_depth || ' to ' || to_depth || ' m. Results: ' || e || '. Analytical method unspecified method at ALS.' as text from b"""
Q["pending_passages"] = lambda s, d: ingest.pending(table(s, d, "documents").select("doc_id", "text"), table(s, d, "documents").where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.sha2(F.col("text").cast("binary"), 256)).otherwise("old").alias("text_hash")), "doc_id", "text").select("doc_id", "text_hash")
SQL["pending_passages"] = "select doc_id, sha256(text) as text_hash from documents where doc_id % 3 <> 1"
Q["linked_entities"] = lambda s, d: ingest.linked(table(s, d, "orders").selectExpr("o_orderkey as doc_id", "concat('near SMDI-00', cast(o_custkey as string), ' and smdi ', cast(o_custkey as string), ', GOS_', cast(1000 + o_orderkey % 50 as string)) as text"), table(s, d, "customer").selectExpr("'occurrence' as kind", "cast(c_custkey as string) as number", "concat('m', cast(c_custkey as string)) as entity_id").unionAll(table(s, d, "nation").selectExpr("'collar'", "cast(1000 + n_nationkey as string)", "concat('h', cast(n_nationkey as string))")), {"occurrence": r"(?i)\bSMDI[-\s]?0*([0-9]{1,5})\b", "collar": r"(?i)\bGOS[_\s-]([0-9]{3,6})\b"})
SQL["linked_entities"] = "select o_orderkey as doc_id, 'occurrence' as kind, 'm' || c_custkey as entity_id from orders join customer on o_custkey = c_custkey where c_custkey < 100000 union all select o_orderkey, 'collar', 'h' || n_nationkey from orders join nation on o_orderkey % 50 = n_nationkey"
Q["changed_counts"] = lambda s, d: ingest.changed_counts(table(s, d, "orders"), table(s, d, "orders").where("o_orderstatus <> 'P'"), "o_custkey")
SQL["changed_counts"] = "select o_custkey, count(*) as upstream, count(*) filter (where o_orderstatus <> 'P') as held from orders group by 1 having count(*) filter (where o_orderstatus = 'P') > 0"
Q["blended_scores"] = lambda s, d: targets.blended(table(s, d, "customer").selectExpr("c_custkey", "cast(c_acctbal as double) / 1000 as a", "cast(c_custkey % 10 as double) as b"), "a", "b").select("c_custkey", F.round("divergence", 6).alias("divergence"), "fell_back", F.round("shown", 6).alias("shown"))
SQL["blended_scores"] = "select c_custkey, round(abs(a - b), 6) as divergence, f as fell_back, round(case when f then a else 0.6::double * a + 0.4::double * b end, 6) as shown from (select *, greatest(0, 1 - abs(a - b) / greatest(abs(a), 1)) < 0.4::double as f from (select c_custkey, c_acctbal::double / 1000 as a, (c_custkey % 10)::double as b from customer))"
Q["evidence_classes"] = lambda s, d: table(s, d, "orders").select(classify.evidence_class(F.col("o_custkey") % 3 == 0, F.col("o_orderkey") % 2 == 0).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
SQL["evidence_classes"] = "select case when o_custkey % 3 = 0 then 'drill_log' when o_orderkey % 2 = 0 then 'assay_table' else 'ni43' end as class, count(*) as n from orders group by 1"
_ages = lambda s, d: table(s, d, "orders").selectExpr("cast(o_orderkey as string) as sample_id", "element_at(array('u/pb', '40Ar/39Ar', 'Lu-Hf', '', 'X'), cast(o_orderkey % 5 + 1 as int)) as isotopic_system", "element_at(array('2σ', null, '1SD', '3'), cast(o_custkey % 4 + 1 as int)) as uncertainty_kind", "cast(o_custkey % 100 - 5 as double) as age_ma", "cast(1 as double) as age_uncertainty_ma", "cast(o_orderkey % 100 as double) as latitude", "case when o_orderkey % 7 > 0 then cast(o_custkey % 180 as double) end as longitude")
AGED = """with r as (select *, case when o_orderkey % 5 = 3 then 'missing_required' when o_orderkey % 5 = 4 then 'invalid_isotopic_system' when o_custkey % 4 = 3 then 'invalid_uncertainty_kind' when o_custkey % 100 < 5 then 'numeric_cast_failed' when o_orderkey % 100 > 90 and o_orderkey % 7 > 0 then 'latlon_out_of_range' end as reason from orders)"""
Q["ages_accepted"] = lambda s, d: readers.checked_ages(_ages(s, d))[0].select("sample_id", "isotopic_system", "uncertainty_kind", "geom_wkt")
SQL["ages_accepted"] = AGED + " select o_orderkey::varchar as sample_id, (['U-Pb', 'Ar-Ar', 'Lu-Hf'])[o_orderkey % 5 + 1] as isotopic_system, (['2sigma', null, '1sigma'])[o_custkey % 4 + 1] as uncertainty_kind, case when o_orderkey % 7 > 0 then 'POINT(' || (o_custkey % 180) || '.0 ' || (o_orderkey % 100) || '.0)' end as geom_wkt from r where reason is null"
Q["ages_rejected"] = lambda s, d: readers.checked_ages(_ages(s, d))[1].groupBy("reason").agg(F.count("*").alias("n"))
SQL["ages_rejected"] = AGED + " select reason, count(*) as n from r where reason is not null group by 1"
