"""Queries of polygon layers and spatial predicates, with DuckDB SQL that tests every edge."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import polygons, tiles
from lodeframe.plans.stage import ctes, stage, table

Q, SQL = {}, {}
ZOOM = 11
_SIDE = f"({2 * tiles.HALF!r}::double / {1 << ZOOM})"
_M = tiles.BUFFER / tiles.EXTENT

# The corners of a made-up polygon with a hole, as shares of its radius.
_OUTER, _HOLE = [(1, 0), (0.3, 1), (-0.8, 0.6), (-0.7, -0.5), (0.2, -1)], [(0.2, 0), (0, 0.2), (-0.1, -0.1)]


def _rings(radius: str, duck: bool) -> str:
    pair = lambda p: f"(x + {p[0]} * {radius}), (y + {p[1]} * {radius})"
    if duck:
        ring = lambda r, ps: ", ".join(f"row({r}, {i}, {pair(p)})" for i, p in enumerate(ps))
        return f"[{ring(0, _OUTER)}, {ring(1, _HOLE)}]"
    ring = lambda ps: "array(" + ", ".join(f"named_struct('x', cast(x + {p[0]}D * {radius} as double), 'y', cast(y + {p[1]}D * {radius} as double))" for p in ps) + ")"
    return f"array({ring(_OUTER)}, {ring(_HOLE)})"


# A layer's polygons lie around collars, a few hundred metres to 40 km wide.
_RADIUS = "(total_depth * 20 + 300)"
_MEANT = {
    "project_id": "project_id", "status": "status", "survey_year": "year(drill_date)", "line_count": "collar_id % 40", "age_ma_lower": "total_depth / 4", "age_ma_upper": "total_depth / 2",
    "effective_from": "drill_date", "source_feature_id": "collar_id", "potential_rank": "collar_id % 5", "has_potential_rank": "collar_id % 5 > 0", "issue_date": "drill_date", "area_ha": "total_depth * 3",
}
_where = {"seismic": "project_id = 3", "boundaries": "project_id = 4", "formations": "project_id = 5"}
_said = {layer: names[1:3] for layer, names in polygons.POLYGON_LAYERS.items()}


def _layer(layer):
    names = polygons.POLYGON_LAYERS[layer]
    made = [f"{_MEANT.get(c, f'concat({c!r}, hole_id)')} as {c}" for c in names]
    where = _where.get(layer)

    def run(s, d):
        rows = stage(s, d, "collar").selectExpr("*", "easting * 10 as x", "northing * 10 as y").selectExpr("collar_id", f"{_rings(_RADIUS, False)} as rings", *made)
        shown = polygons.polygon_tiles(rows, layer, "collar_id", ZOOM, None if where is None else F.expr(where))
        said = F.concat_ws("|", *[F.col(c).cast("string") for c in _said[layer]])
        return shown.select("z", "tile_x", "tile_y", "layer", "collar_id", F.round("share", 5).alias("share"), "whole", "corners", said.alias("said"))

    Q[f"tile_{layer}"] = run
    # every edge against every tile of the polygon's box; kept(v): v between the tile's ends
    kept = lambda v: f"least(greatest({v}, t - {_M}), t + 1 + {_M})"
    whole = lambda v: f"(({kept(v)} - t + {_M}) ** 2 / 2 + {1 + 2 * _M} * greatest({v} - t - 1 - {_M}, 0))"
    SQL[f"tile_{layer}"] = (
        ctes("collar")
        + f""", r as (select collar_id, easting * 10 as x, northing * 10 as y, total_depth, {', '.join(f'{e.split(" as ")[0]} as s{k}' for k, e in enumerate(made[names.index(_said[layer][0]):][:2]))} from (select * from collar{f' where {where}' if where else ''})
), k as (select collar_id, unnest({_rings(_RADIUS, True)}) as k from r
), c as (select collar_id, k[1] as ring, k[2] as i, (k[3] + {tiles.HALF!r}) / {_SIDE} as u, ({tiles.HALF!r} - k[4]) / {_SIDE} as v from k
), e as (select *, coalesce(lead(u) over w, first_value(u) over w) as u1, coalesce(lead(v) over w, first_value(v) over w) as v1 from c window w as (partition by collar_id, ring order by i rows between unbounded preceding and unbounded following)
), b as (select collar_id, min(u) as ul, max(u) as uh, min(v) as vl, max(v) as vh from e group by 1
), q as (select collar_id, unnest(range(floor(ul - {_M})::bigint, floor(uh + {_M})::bigint + 1)) as s, vl, vh from b
), t as (select collar_id, s, unnest(range(floor(vl - {_M})::bigint, floor(vh + {_M})::bigint + 1)) as t from q
), p as (select t.*, ring, i, u, v, least(greatest(u, s - {_M}), s + 1 + {_M}) as ua, least(greatest(u1, s - {_M}), s + 1 + {_M}) as ub, u1, v1, greatest(u, u1) >= s - {_M} and least(u, u1) <= s + 1 + {_M} as near from t join e using (collar_id)
), g as (select *, v + (ua - u) * (v1 - v) / (u1 - u) as va, v + (ub - u) * (v1 - v) / (u1 - u) as vb from p
), a as (select collar_id, s, t, abs(sum((ub - ua) * case when va = vb then {kept('va')} - t + {_M} else ({whole('vb')} - {whole('va')}) / (vb - va) end * case ring when 0 then 1 else -1 end)) / {(1 + 2 * _M) ** 2!r} as share,
  count(*) filter (near and least(va, vb) <= t + 1 + {_M} and greatest(va, vb) >= t - {_M}) as edges, count(*) filter (u between s - {_M} and s + 1 + {_M} and v between t - {_M} and t + 1 + {_M}) as corners from g group by 1, 2, 3)
select {ZOOM} as z, s::integer as tile_x, t::integer as tile_y, '{layer}' as layer, collar_id, round(share, 5) as share, edges = 0 as whole, corners, concat_ws('|', s0, s1) as said from a join r using (collar_id) where edges > 0 or share > 1e-9"""
    )


for _name in polygons.POLYGON_LAYERS:
    _layer(_name)

# Claims: polygons of customers; areas: larger ones of suppliers.
_CLAIM = "select c_custkey as claim_id, cast((c_custkey * 7919) % 20011 as double) as x, cast((c_custkey * 104729) % 20011 as double) as y, cast(100 + c_custkey % 400 as double) as r from customer"
_AREA = "select s_suppkey as area_id, cast((s_suppkey * 3571) % 20011 as double) as x, cast((s_suppkey * 611953) % 20011 as double) as y, cast(400 + (s_suppkey * 13) % 900 as double) as r from supplier"
_CELL = 250.0


def _polygons(s, d, source, made):
    columns = made.removeprefix("select ").removesuffix(f" from {source}").split(", ")
    return table(s, d, source).selectExpr(*columns).selectExpr(columns[0].split(" as ")[1], f"{_rings('r', False)} as rings")


_claims = lambda s, d: _polygons(s, d, "customer", _CLAIM)
_areas = lambda s, d: _polygons(s, d, "supplier", _AREA)


def _edge_sql(name, made, key):
    return f"""{name}_k as (select {key}, unnest({_rings('r', True)}) as k from ({made})
), {name}_c as (select {key}, k[1] as ring, k[2] as i, k[3]::double as x0, k[4]::double as y0 from {name}_k
), {name} as (select *, coalesce(lead(x0) over w, first_value(x0) over w) as x1, coalesce(lead(y0) over w, first_value(y0) over w) as y1 from {name}_c window w as (partition by {key}, ring order by i rows between unbounded preceding and unbounded following)
), {name}_b as (select {key}, min(x0) as xl, max(x0) as xh, min(y0) as yl, max(y0) as yh from {name} group by 1)"""


_ODD = "count(*) filter ((y0 > py) <> (y1 > py) and sign((x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)) = sign(y1 - y0)) % 2 = 1"
_ON = "bool_or((x1 - x0) * (py - y0) = (y1 - y0) * (px - x0) and px between least(x0, x1) and greatest(x0, x1) and py between least(y0, y1) and greatest(y0, y1))"

Q["collars_in_claims"] = lambda s, d: polygons.points_in(stage(s, d, "collar"), _claims(s, d), "collar_id", "claim_id", _CELL, "easting", "northing")
SQL["collars_in_claims"] = (
    ctes("collar")
    + f""", {_edge_sql('e', _CLAIM, 'claim_id')}, p as (select collar_id, easting as px, northing as py, claim_id from collar join e_b on easting between xl and xh and northing between yl and yh
), t as (select collar_id, claim_id, {_ODD} as inside, {_ON} as on_edge from p join e using (claim_id) group by 1, 2)
select collar_id, claim_id, on_edge from t where inside or on_edge"""
)

Q["claims_by_area"] = lambda s, d: polygons.polygon_pairs(_areas(s, d), _claims(s, d), "area_id", "claim_id", _CELL)
_S = lambda p, q, n: f"sign(({p}.x1 - {p}.x0) * ({q}.y{n} - {p}.y0) - ({p}.y1 - {p}.y0) * ({q}.x{n} - {p}.x0))"
_PROPER = f"{_S('a', 'c', 0)} * {_S('a', 'c', 1)} < 0 and {_S('c', 'a', 0)} * {_S('c', 'a', 1)} < 0"
_TOUCH = f"{_S('a', 'c', 0)} * {_S('a', 'c', 1)} <= 0 and {_S('c', 'a', 0)} * {_S('c', 'a', 1)} <= 0 and greatest(a.x0, a.x1) >= least(c.x0, c.x1) and greatest(c.x0, c.x1) >= least(a.x0, a.x1) and greatest(a.y0, a.y1) >= least(c.y0, c.y1) and greatest(c.y0, c.y1) >= least(a.y0, a.y1)"
SQL["claims_by_area"] = f"""with {_edge_sql('a', _AREA, 'area_id')}, {_edge_sql('c', _CLAIM, 'claim_id')}
, m as (select area_id, claim_id from a_b join c_b on a_b.xl <= c_b.xh and c_b.xl <= a_b.xh and a_b.yl <= c_b.yh and c_b.yl <= a_b.yh
), x as (select area_id, claim_id, bool_or({_PROPER}) as crosses, bool_or({_TOUCH}) as touch from m join a using (area_id) join c using (claim_id) group by 1, 2
), f as (select area_id, claim_id, ring, i, {_ODD} as inside, {_ON} as on_edge from (select area_id, claim_id, c.ring, c.i, c.x0 as px, c.y0 as py from m join c using (claim_id)) join (select area_id, x0, y0, x1, y1 from a) using (area_id) group by 1, 2, 3, 4
), g as (select area_id, claim_id, ring, i, {_ODD} as inside, {_ON} as on_edge from (select area_id, claim_id, a.ring, a.i, a.x0 as px, a.y0 as py from m join a using (area_id)) join (select claim_id, x0, y0, x1, y1 from c) using (claim_id) group by 1, 2, 3, 4
), fs as (select area_id, claim_id, count(*) filter (inside or on_edge) as n, count(*) filter (inside and not on_edge) as strict, count(*) as total from f group by 1, 2
), gs as (select area_id, claim_id, count(*) filter (inside or on_edge) as n, count(*) filter (inside and not on_edge) as strict, count(*) as total from g group by 1, 2)
select area_id, claim_id, not crosses and fs.n = fs.total and gs.strict = 0 as contains, not crosses and gs.n = gs.total and fs.strict = 0 as within
from x join fs using (area_id, claim_id) join gs using (area_id, claim_id) where touch or fs.n > 0 or gs.n > 0"""

