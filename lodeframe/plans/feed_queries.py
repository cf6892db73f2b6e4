"""Queries of public feeds, hexagon levels, windows and trailing spans, with DuckDB SQL. The
feeds' properties are written from orders by expressions; the SQL says what has to come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import feeds, reports, spatial
from lodeframe.plans.stage import ctes, stage, table

Q, SQL = {}, {}

STATES = {"f": "past_producer", "o": "active", "p": "pending"}
CODES = {"gold": "Au", "au": "Au", "copper": "Cu", "uranium": "U", "u3o8": "U"}
GROUPS = {"gold": "precious", "au": "precious", "copper": "base", "uranium": "uranium", "u3o8": "uranium"}
_ID = ("OBJECTID", "if(o_orderkey % 5 = 0, '0', cast(o_orderkey as string))"), ("OBJECTID_1", "if(o_orderkey % 10 = 0, null, cast(-o_orderkey as string))")
_KEY = "case when o_orderkey % 5 > 0 then cast(o_orderkey as varchar) when o_orderkey % 10 > 0 then cast(-o_orderkey as varchar) end"
_MS = "cast(unix_millis(cast(o_orderdate as timestamp)) as string)"
_DAY = "cast(cast(o_orderdate as date) as varchar)"
_STATE = "case o_orderstatus when 'F' then 'past_producer' when 'O' then 'active' when 'P' then 'pending' else 'unknown' end"
_GOODS = "element_at(array('Gold; copper', 'Au/gold,gold', 'granite', 'U3O8|Uranium; Copper', ''), cast(o_custkey % 5 + 1 as int))"
_PICK = lambda *x: f"([{', '.join(repr(v) if v is not None else 'null' for v in x)}])[o_custkey % 5 + 1]"

# Kind: properties, and what must come out of them (attribute to SQL).
_FEEDS = {
    "mine": (
        {"NAME": "concat('  Mine ', o_custkey, ' ')", "STATUS": "concat(' ', o_orderstatus, ' ')", "COMMODITY": _GOODS, "OPERATOR": "if(o_custkey % 3 = 0, ' ', o_clerk)"},
        {"name": "'Mine ' || o_custkey", "status": _STATE, "commodities": _PICK("Au|Cu", "Au", "", "U|Cu", ""), "commodity_grouping": _PICK("precious", "precious", None, "uranium", None), "operator": "case when o_custkey % 3 > 0 then o_clerk end"},
    ),
    "mineral_occurrence": (
        {"SMDI": "cast(o_custkey as string)", "NAME": "o_clerk", "HISTORICNAMES": "concat('A ', o_custkey, ', ;B')", "STATUS": "lower(o_orderstatus)", "PRIMARYCOMMODITIES": _GOODS, "PRODUCTION": "element_at(array('Y', 'no', 'Copper production 1962', 'N/A', ''), cast(o_custkey % 5 + 1 as int))"},
        {"external_id": "cast(o_custkey as varchar)", "historic_names": "'A ' || o_custkey || '|B'", "status": _STATE, "primary_commodities": _PICK("Au|Cu", "Au", "", "U|Cu", ""), "associated_commodities": "''", "commodity_grouping": _PICK("precious", "precious", None, "uranium", None), "production_flag": "([true, false, true, false, false])[o_custkey % 5 + 1]"},
    ),
    "drillhole_collar": (
        {"GOS_UNIQUE_DRILLHOLE_ID": "concat('D', o_orderkey)", "COMPANY": "o_clerk", "DATE_DRILLED": _MS, "TOTAL_DH_LENGTH_M": "if(o_custkey % 4 = 0, 'deep', cast(o_custkey * 1.5 as string))", "DH_AZIMUTH": "cast(o_custkey % 360 as string)", "COREAVAILABILITY": "element_at(array('Available', 'No core', 'partially available', 'lost', '?'), cast(o_custkey % 5 + 1 as int))", "COMMODITY_OF_INTEREST": _GOODS},
        {"drillhole_id": "'D' || o_orderkey", "company": "o_clerk", "date_drilled": _DAY, "total_length_m": "case when o_custkey % 4 > 0 then o_custkey * 1.5::double end", "azimuth_deg": "cast(o_custkey % 360 as double)", "core_availability": _PICK("available", "unavailable", "partial", "unavailable", "unknown"), "commodity_of_interest": _PICK("Gold|copper", "Au|gold|gold", "granite", "U3O8|Uranium|Copper", "")},
    ),
    "rock_sample": (
        {"STATION": "concat('S-', o_custkey)", "SAMPLE_NUM": "cast(o_orderkey as string)", "NTS_250K": "if(o_custkey % 2 = 0, '', '74H')", "DATE_": "date_format(o_orderdate, 'yyyy/MM/dd')"},
        {"station": "'S-' || o_custkey", "sample_number": "cast(o_orderkey as varchar)", "nts_250k": "case when o_custkey % 2 > 0 then '74H' end", "date_collected": _DAY},
    ),
    "mineral_disposition": (
        {"DISPOSITION": "if(o_custkey % 2 = 0, null, concat('M', o_custkey))", "DISPID": "' '", "DISPOSIT_1": "concat('X', o_custkey)", "DISPSTATUS": "o_orderstatus", "OWNERS": "o_clerk", "EFFECTIVED": "date_format(o_orderdate, 'yyyy-MM-dd')", "EXPIRYDATE": "'soon'", "PARCELHECT": "cast(o_custkey / 4.0D as string)", "COMMODITY": _GOODS},
        {"disposition_number": "case when o_custkey % 2 = 0 then 'X' else 'M' end || o_custkey", "status": _STATE, "holder_name": "o_clerk", "issue_date": _DAY, "expiry_date": "cast(null as varchar)", "area_ha": "o_custkey / 4.0::double", "commodity_codes": _PICK("Gold|copper", "Au|gold|gold", "granite", "U3O8|Uranium|Copper", "")},
    ),
    "bedrock_polygon": (
        {"ROCK_CODE": "concat('R', o_custkey % 9)", "NAME": "if(o_custkey % 3 = 0, o_clerk, null)", "FORMATION": "if(o_custkey % 4 = 0, null, 'Read')", "MEMBER": "if(o_custkey % 5 = 0, 'Upper', null)", "GROUP_": "' Athabasca '"},
        {"unit_code": "'R' || (o_custkey % 9)", "unit_name": "case when o_custkey % 3 = 0 then o_clerk when o_custkey % 4 > 0 then case when o_custkey % 5 = 0 then 'Read / Upper' else 'Read' end else 'R' || (o_custkey % 9) end", "group_name": "'Athabasca'", "formation": "case when o_custkey % 4 > 0 then 'Read' end", "member": "case when o_custkey % 5 = 0 then 'Upper' end"},
    ),
    "assessment_survey": ({"TITLE": "o_clerk"}, {"survey_type": "(['airborne', 'ground', 'underground', 'unknown'])[o_custkey % 4 + 1]"}),
    "resource_potential": (
        {"POTENTIAL": "if(o_custkey % 2 = 0, 'high', cast(o_custkey % 7 as string))", "RANK": "if(o_custkey % 3 = 0, '3.0', null)", "METHODOLOGY": "o_clerk"},
        {"potential_rank": "case when o_custkey % 2 > 0 then cast(o_custkey % 7 as integer) when o_custkey % 3 = 0 then 3 end", "methodology_ref": "o_clerk"},
    ),
}


def _feed(kind):
    made, wanted = _FEEDS[kind]

    def run(s, d):
        orders = table(s, d, "orders").withColumn("o_clerk", F.concat(F.lit("Clerk "), F.col("o_custkey") % 50))
        props = F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in (*_ID, *made.items())]))
        rows = orders.select(F.element_at(F.array(*map(F.lit, ["SK-AIRBORNE", "SK-GROUND", "SK-UNDERGROUND", "SK-X"])), (F.col("o_custkey") % 4 + 1).cast("int")).alias("source_id"), props.alias("props"))
        found = feeds.extracted(rows, kind, STATES, CODES, GROUPS)
        kinds = dict(found.dtypes)
        said = [F.array_join(c, "|").alias(c) if kinds[c].startswith("array") else F.col(c).cast("string").alias(c) if kinds[c] == "date" else F.col(c) for c in wanted]
        return found.select("source_feature_id", *said, (F.length("checksum") == 64).alias("checked"))

    Q[f"feed_{kind}"] = run
    SQL[f"feed_{kind}"] = f"with o as (select *, 'Clerk ' || (o_custkey % 50) as o_clerk from orders) select {_KEY} as source_feature_id, {', '.join(f'{e} as {n}' for n, e in wanted.items())}, true as checked from o where {_KEY} is not null"


for _kind in _FEEDS:
    _feed(_kind)

# Hexagons at three levels from one pass over the collars; each is the sum of those below.
Q["hex_levels"] = lambda s, d: spatial.hex_levels(stage(s, d, "collar"), 300.0, 3, {"n": F.count("*"), "finished": F.count_if(F.col("status") == "F")})
_HEX = """, a as (select status, (sqrt(3) / 3 * easting - northing / 3) / 300 as q, (northing * (2.0::double / 3)) / 300 as r from collar
), b as (select *, round(q) as rq, round(r) as rr, round(-q - r) as rs, abs(round(q) - q) as dq, abs(round(r) - r) as dr, abs(round(-q - r) + q + r) as ds from a
), c as (select status, cast(case when dq > dr and dq > ds then -rr - rs else rq end as bigint) as q, cast(case when dq > dr and dq > ds then rr when dr > ds then -rq - rs else rr end as bigint) as r from b
), o as (select * from (values (0, 0, 0), (1, 1, 0), (5, 0, 1), (4, -1, 1), (6, -1, 0), (2, 0, -1), (3, 1, -1)) t(k, dq, dr)
), d as (select status, c.q, c.r, (3 * (c.q - dq) + c.r - dr) // 7 as q1, (2 * (c.r - dr) - c.q + dq) // 7 as r1 from c join o on o.k = ((c.q + 5 * c.r) % 7 + 7) % 7
), e as (select d.*, (3 * (q1 - dq) + r1 - dr) // 7 as q2, (2 * (r1 - dr) - q1 + dq) // 7 as r2 from d join o on o.k = ((q1 + 5 * r1) % 7 + 7) % 7
), l as (select 0 as level, q || ':' || r as cell, status from e union all select 1, q1 || ':' || r1, status from e union all select 2, q2 || ':' || r2, status from e)"""
SQL["hex_levels"] = ctes("collar") + _HEX + " select level, cell, count(*) as n, count(*) filter (where status = 'F') as finished from l group by 1, 2"
Q["hex_levels_summary"] = lambda s, d: spatial.hex_levels(stage(s, d, "collar"), 300.0, 3, {"n": F.count("*")}).groupBy("level").agg(F.count("*").alias("cells"), F.sum("n").alias("total"), F.max("n").alias("densest"))
SQL["hex_levels_summary"] = ctes("collar") + _HEX + " select level, count(*) as cells, cast(sum(n) as bigint) as total, max(n) as densest from (select level, cell, count(*) as n from l group by 1, 2) group by 1"

# What changed from window to window, and what was spent in the last minutes.
for _name, _days in (("changes_by_day", 1), ("changes_by_week", 7)):
    Q[_name] = lambda s, d, n=_days: reports.window_deltas(stage(s, d, "usage"), "ts", n, ["workspace_id", "event_type"], {"n": F.count("*"), "cost": F.sum("cost")})
    SQL[_name] = ctes("usage") + f""", w as (select workspace_id, event_type, cast(floor(epoch(ts) / {86400 * _days}) as bigint) as k, count(*) as n, sum(cost) as cost from usage group by 1, 2, 3)
select a.workspace_id, a.event_type, cast(to_timestamp(a.k * {86400 * _days}) at time zone 'UTC' as date)::varchar as starts, a.n, a.cost, a.n - coalesce(b.n, 0) as n_delta, a.cost - coalesce(b.cost, 0) as cost_delta
from w a left join w b on a.workspace_id = b.workspace_id and a.event_type = b.event_type and b.k = a.k - 1"""
Q["recent_spend"] = lambda s, d: reports.recent(stage(s, d, "usage"), "ts", 600, ["workspace_id"], "cost")
SQL["recent_spend"] = ctes("usage") + ", m as (select max(ts) as latest from usage) select workspace_id, count(*) as n, sum(cost) as spent from usage, m where ts > latest - interval 600 minute and ts <= latest group by 1 having sum(cost) > 0"
