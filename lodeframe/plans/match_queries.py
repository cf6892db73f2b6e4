"""Queries of joins by likeness and of joins to the last state, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import fuzzy, survey
from lodeframe.plans.stage import ctes, stage, table

Q, SQL = {}, {}

# Aliases are kinds of parts; mentions are their names as mistyped by key.
_ALIAS = "select p_name || ' ' || lower(p_type) as alias, min(p_partkey) as alias_id, max(p_size) / 50.0 as confidence from part group by 1"
_MENTION = "select distinct case p_partkey % 3 when 0 then substr(p_name || ' ' || lower(p_type), 2) when 1 then replace(p_name || ' ' || lower(p_type), 'e', 'i') else p_name || '-' || lower(p_type) || ' no. ' || cast(p_size % 4 as varchar) end as mention from part"


def _aliases(s, d):
    return table(s, d, "part").groupBy(F.expr("p_name || ' ' || lower(p_type)").alias("alias")).agg(F.min("p_partkey").alias("alias_id"), (F.max("p_size") / 50.0).alias("confidence"))


def _mentions(s, d):
    return table(s, d, "part").select(F.expr(_MENTION.removeprefix("select distinct ").removesuffix(" as mention from part").replace("as varchar", "as string")).alias("mention")).distinct()


def _grams(name, source, text):
    return rf"""{name}_w as (select distinct {text} as t, unnest(list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) as w from ({source})
), {name} as (select distinct t, substr('  ' || w || ' ', i, 3) as g from (select t, w, unnest(range(1, length(w) + 2)) as i from {name}_w)
), {name}_n as (select t, count(*) as n from {name} group by 1)"""


def _resolved(s, d, threshold):
    pairs = fuzzy.trigram_pairs(_mentions(s, d), _aliases(s, d), "mention", "alias", threshold).join(_aliases(s, d), "alias")
    found = pairs.withColumn("similarity", F.round("similarity", 6))
    return fuzzy.best_of(found, "mention", [F.desc("similarity"), F.desc("confidence"), F.asc("alias")]).select("mention", "alias", "alias_id", "similarity")


def _resolved_sql(threshold):
    return f"""with {_grams('a', _ALIAS, 'alias')}, {_grams('m', _MENTION, 'mention')}
, s as (select m.t as mention, a.t as alias, count(*) as c from m join a using (g) group by 1, 2
), p as (select mention, alias, c * 1.0::double / (m_n.n + a_n.n - c) as s from s join m_n on m_n.t = mention join a_n on a_n.t = alias where c >= {threshold} * (m_n.n + a_n.n - c) - 1e-9)
select mention, alias, alias_id, similarity from (select mention, p.alias, alias_id, round(s, 6) as similarity, row_number() over (partition by mention order by round(s, 6) desc, confidence desc, p.alias) as k from p join ({_ALIAS}) x on x.alias = p.alias) where k = 1"""


for _name, _least in (("entities_resolved", 0.6), ("entities_resolved_strictly", 0.8)):
    Q[_name] = lambda s, d, t=_least: _resolved(s, d, t)
    SQL[_name] = _resolved_sql(_least)

# Holes named in texts, with a figure or letter more or less, against the register.
_SAID = "case o_custkey % 4 when 0 then concat('DDH-', o_custkey % 700) when 1 then concat('DDH', o_custkey % 700) when 2 then concat('DD-', o_custkey % 700, 'A') else concat('XDH-', o_custkey % 700) end"


def _said_holes(s, d):
    return table(s, d, "orders").select(F.expr(_SAID).alias("said")).distinct()


def _fuzzy_holes(s, d):
    register = stage(s, d, "collar").groupBy(F.upper("hole_id").alias("hole")).agg(F.min("collar_id").alias("collar_id"))
    pairs = fuzzy.ratio_pairs(_said_holes(s, d), register, "said", "hole", 80.0).join(register, "hole").withColumn("score", F.round("score", 4))
    return fuzzy.best_of(pairs, "said", [F.desc("score"), F.asc("hole")]).select("said", "hole", "collar_id", "score")


Q["fuzzy_holes"] = _fuzzy_holes
# a row of the table of common subsequences for each character of the first text
_LCS = "list_last(list_reduce(list_prepend(list_transform(range(len(y) + 1), lambda k: 0), list_transform(x, lambda c: [ascii(c)])), lambda r, c: list_transform(range(1, len(y) + 2), lambda j: greatest(r[j], coalesce(list_max(list_transform(list_filter(range(1, j), lambda i: ascii(y[i]) = c[1]), lambda i: r[i] + 1)), 0)))))"
SQL["fuzzy_holes"] = (
    ctes("collar")
    + f""", r as (select upper(hole_id) as hole, min(collar_id) as collar_id from collar group by 1
), m as (select distinct {_SAID} as said from orders
), p as (select said, hole, collar_id, string_split(said, '') as x, string_split(hole, '') as y from m, r
), l as (select said, hole, collar_id, round(200.0::double * {_LCS} / (len(x) + len(y)), 4) as score from p)
select said, hole, collar_id, score from (select *, row_number() over (partition by said order by score desc, hole) as k from l where score >= 80) where k = 1"""
)

Q["fuzzy_names"] = lambda s, d: fuzzy.best_of(fuzzy.ratio_pairs(table(s, d, "nation").select(F.lower("n_name").alias("name")), table(s, d, "region").select(F.concat(F.lit("nation_"), F.col("r_regionkey") * 3 + 10).alias("match")), "name", "match", 60.0).withColumn("score", F.round("score", 4)), "name", [F.desc("score"), F.asc("match")])
SQL["fuzzy_names"] = f"""with p as (select name, match, string_split(name, '') as x, string_split(match, '') as y from (select lower(n_name) as name from nation), (select concat('nation_', r_regionkey * 3 + 10) as match from region)
), l as (select name, match, round(200.0::double * {_LCS} / (len(x) + len(y)), 4) as score from p)
select name, match, score from (select *, row_number() over (partition by name order by score desc, match) as k from l where score >= 60) where k = 1"""

# Structures measured on core: most have alpha and beta alone.
_STRUCTURE = ["l_orderkey as collar_id", "l_linenumber as row_id", "l_linenumber * 2.75D + l_suppkey % 3 as depth", "case when l_partkey % 11 > 0 then cast(l_quantity % 90 as double) end as alpha", "cast(l_partkey % 360 as double) as beta", "case when l_suppkey % 4 = 0 then 45.0D end as true_dip", "case when l_suppkey % 8 = 0 then 120.0D end as true_dip_dir"]
_STATION = ["l_orderkey as collar_id", "l_linenumber * 4.0D + l_suppkey % 5 as depth", "cast((l_partkey * 7) % 360 as double) as azimuth", "-40.0D - l_partkey % 50 as dip"]
_rows = lambda s, d: table(s, d, "lineitem").selectExpr(*_STRUCTURE)
_stations = lambda s, d: table(s, d, "lineitem").where("l_orderkey % 6 > 0").selectExpr(*_STATION)
_plain = lambda e: e.replace("45.0D", "45.0::double").replace("120.0D", "120.0::double").replace("4.0D", "4.0::double").replace("40.0D", "40.0::double").replace("2.75D", "2.75::double")
_FROM = f"s as (select {', '.join(map(_plain, _STRUCTURE))} from lineitem), t as (select {', '.join(map(_plain, _STATION))} from lineitem where l_orderkey % 6 > 0)"
_TRUE = """, n as (select *, sin(radians(alpha)) * cos(radians(beta)) as u, sin(radians(alpha)) * sin(radians(beta)) as v, cos(radians(alpha)) as w, radians(azimuth) as z, radians(dip) as d from o
), m as (select *, cos(z) * sin(d) * u - sin(z) * v + cos(z) * cos(d) * w as x, sin(z) * sin(d) * u + cos(z) * v + sin(z) * cos(d) * w as y, -cos(d) * u + sin(d) * w as p from n
), f as (select *, case when p > 0 then -x else x end as x1, case when p > 0 then -y else y end as y1, (true_dip is null or true_dip_dir is null) and alpha is not null and azimuth is not null as ready from m
), g as (select *, case when ready then degrees(atan2(sqrt(x * x + y * y), abs(p))) else true_dip end as td, case when not ready then true_dip_dir when sqrt(x * x + y * y) < 1e-9 then 0 else fmod(degrees(atan2(x1, y1)) + 360, 360) end as tw from f)
"""
_GROUP = " select collar_id, count(*) as n, count(td) as dips, count(tw) as ways, max(round(td, 3)) as most_dip, min(round(tw, 3)) as least_way from g group by 1"
_summed = lambda df: df.groupBy("collar_id").agg(F.count("*").alias("n"), F.count("true_dip").alias("dips"), F.count("true_dip_dir").alias("ways"), F.max("true_dip").alias("most_dip"), F.min("true_dip_dir").alias("least_way"))

Q["structures_derived"] = lambda s, d: survey.derived(_rows(s, d), stage(s, d, "collar"))
SQL["structures_derived"] = ctes("collar") + f", {_FROM}, o as (select s.*, azimuth, dip from s left join collar using (collar_id))" + _TRUE + " select collar_id, row_id, depth, alpha, beta, round(td, 3) as true_dip, round(tw, 3) as true_dip_dir from g"

Q["structures_as_of"] = lambda s, d: survey.as_of(_rows(s, d).select("collar_id", "row_id", "depth"), _stations(s, d), "collar_id", "depth", ["azimuth", "dip"], 10.0)
_OF = """x as (select s.collar_id, s.row_id, s.depth, max(row(t.depth, azimuth, dip)) as m from s left join t on t.collar_id = s.collar_id and t.depth <= s.depth group by 1, 2, 3)"""
SQL["structures_as_of"] = f"with {_FROM}, {_OF} select collar_id, row_id, depth, m[2] as azimuth, m[3] as dip from s join x using (collar_id, row_id, depth)"

Q["structures_oriented"] = lambda s, d: _summed(survey.derived(_rows(s, d), stage(s, d, "collar"), _stations(s, d)))
SQL["structures_oriented"] = ctes("collar") + f", {_FROM}, {_OF}, o as (select s.*, coalesce(m[2], azimuth) as azimuth, coalesce(m[3], dip) as dip from s join x using (collar_id, row_id, depth) left join collar using (collar_id))" + _TRUE + _GROUP
