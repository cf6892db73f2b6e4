"""Queries of map tiles by layer, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import tiles
from lodeframe.plans.stage import ctes, stage

Q, SQL = {}, {}
ZOOM = 11
_SIDE = f"({2 * tiles.HALF!r}::double / {1 << ZOOM})"

# What stands for each attribute of a layer, in Spark and DuckDB alike; others are the layer's
# name and the hole's.
_MEANT = {
    "project_id": "project_id", "hole_id": "hole_id", "collar_azimuth": "azimuth", "collar_dip": "dip", "total_depth_m": "total_depth", "total_length_m": "total_depth", "has_total_length": "total_depth > 0",
    "status": "status", "collar_id": "collar_id", "from_depth": "total_depth / 4", "to_depth": "total_depth / 2", "grade": "elevation", "element": "case when collar_id % 2 = 0 then 'Au' else 'Cu' end",
    "operational_from_year": "year(drill_date)", "drill_type": "hole_type", "sample_id": "collar_id * 2", "source_feature_id": "collar_id",
}
_where = {"collars": "project_id = 3", "historic_workings": "project_id = 4", "geochem": "project_id = 5", "significant_intersections": "element = 'Au' and grade >= 100"}
_exprs = lambda layer: [f"{_MEANT.get(c, f'concat({c!r}, hole_id)')} as {c}" for c in tiles.POINT_LAYERS[layer]]


def _rows(s, d, layer):
    names = [e for e in _exprs(layer) if not e.endswith(" as collar_id")]
    return stage(s, d, "collar").selectExpr("collar_id", "easting * 10 as x", "northing * 10 as y", *names)


def _points(layer):
    where = _where.get(layer)
    shown = lambda s, d: tiles.point_tiles(_rows(s, d, layer), layer, "collar_id", "x", "y", ZOOM, None if where is None else F.expr(where))
    columns = [c for c in tiles.POINT_LAYERS[layer] if c != "collar_id"]
    Q[f"tile_{layer}"] = lambda s, d: shown(s, d).withColumn("said", F.concat_ws("|", *[F.col(c).cast("string") for c in columns[:2]])).drop(*columns)
    made = ", ".join(e for e in _exprs(layer) if not e.endswith(" as collar_id")).replace("has_total_length", "has_total_length")
    edge = tiles.BUFFER / tiles.EXTENT
    SQL[f"tile_{layer}"] = ctes("collar") + f""", r as (select collar_id, (easting * 10 + {tiles.HALF!r}) / {_SIDE} as u, ({tiles.HALF!r} - northing * 10) / {_SIDE} as v, {made} from collar
), x as (select *, unnest(range(cast(floor(u - {edge}) as bigint), cast(floor(u + {edge}) as bigint) + 1)) as tile_x from r{f' where {where}' if where else ''}), y as (select *, unnest(range(cast(floor(v - {edge}) as bigint), cast(floor(v + {edge}) as bigint) + 1)) as tile_y from x)
select {ZOOM} as z, tile_x, tile_y, '{layer}' as layer, collar_id, cast(floor((u - tile_x) * 4096) as integer) as px, cast(floor((v - tile_y) * 4096) as integer) as py, concat_ws('|', {', '.join(columns[:2])}) as said from y"""


for _layer in tiles.POINT_LAYERS:
    _points(_layer)


def _traces(s, d, zoom):
    """Each hole's straight trace, in map metres, as two vertices."""
    c = stage(s, d, "collar").select("collar_id", (F.col("easting") * 10).alias("x"), (F.col("northing") * 10).alias("y"), (F.col("total_depth") * 5).alias("run"), F.radians("azimuth").alias("a"))
    ends = c.select("collar_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("x"), F.col("y")), F.struct(F.lit(1).alias("k"), (F.col("x") + F.col("run") * F.sin("a")).alias("x"), (F.col("y") + F.col("run") * F.cos("a")).alias("y")))).alias("p"))
    return tiles.line_tiles(ends.select("collar_id", "p.k", "p.x", "p.y"), "collar_id", "k", "x", "y", zoom)


Q["tile_drill_traces"] = lambda s, d: _traces(s, d, ZOOM).withColumn("metres", F.round("metres", 3))
_LO, _HI = tiles.BUFFER / tiles.EXTENT, 1 + tiles.BUFFER / tiles.EXTENT
SQL["tile_drill_traces"] = ctes("collar") + f""", e as (select collar_id, (easting * 10 + {tiles.HALF!r}) / {_SIDE} as u, ({tiles.HALF!r} - northing * 10) / {_SIDE} as v, total_depth * 5 * sin(radians(azimuth)) / {_SIDE} as du, -total_depth * 5 * cos(radians(azimuth)) / {_SIDE} as dv from collar
), x as (select *, unnest(range(cast(floor(least(u, u + du) - {_LO}) as bigint), cast(floor(greatest(u, u + du) + {_LO}) as bigint) + 1)) as tile_x from e), y as (select *, unnest(range(cast(floor(least(v, v + dv) - {_LO}) as bigint), cast(floor(greatest(v, v + dv) + {_LO}) as bigint) + 1)) as tile_y from x
), c as (select *, (tile_x - {_LO} - u) / nullif(du, 0) as a, (tile_x + {_HI} - u) / nullif(du, 0) as b, (tile_y - {_LO} - v) / nullif(dv, 0) as c, (tile_y + {_HI} - v) / nullif(dv, 0) as d from y
), w as (select *, least(1, coalesce(greatest(a, b), 1), coalesce(greatest(c, d), 1)) - greatest(0, coalesce(least(a, b), 0), coalesce(least(c, d), 0)) as share from c)
select {ZOOM} as z, tile_x, tile_y, collar_id, count(*) as segments, round(sum(sqrt(du * du + dv * dv) * {_SIDE} * share), 3) as metres from w where share > 0 group by 2, 3, 4"""


# Section lines of a project, in three vertices.
_SECTION = ["project_id", "concat('section ', hole_id) as section_name", "azimuth as azimuth_deg", "total_depth * 10 as length_m", "collar_id % 50 as buffer_m"]


def _sections(s, d):
    rows = stage(s, d, "collar").where("project_id = 3").selectExpr("collar_id", "easting * 10 as x", "northing * 10 as y", *_SECTION)
    ends = rows.selectExpr("collar_id", "explode(array(struct(0 as k, x, y), struct(1 as k, x + 2 * length_m as x, y + buffer_m * 40 as y), struct(2 as k, x + 3 * length_m as x, y - length_m as y))) as p")
    shown = tiles.line_tiles(ends.select("collar_id", "p.k", "p.x", "p.y"), "collar_id", "k", "x", "y", ZOOM, tiles.section_tolerance(ZOOM))
    return shown.join(rows.select("collar_id", "section_name", "azimuth_deg", "length_m", "buffer_m"), "collar_id").withColumn("metres", F.round("metres", 3))


Q["tile_section_lines"] = _sections
SQL["tile_section_lines"] = ctes("collar") + f""", r as (select collar_id, easting * 10 as x, northing * 10 as y, {', '.join(_SECTION)} from collar where project_id = 3
), p as (select *, x + 2 * length_m as x1, y + buffer_m * 40 as y1, x + 3 * length_m as x2, y - length_m as y2 from r
), k as (select *, abs((x2 - x) * (y1 - y) - (y2 - y) * (x1 - x)) / sqrt((x2 - x) ** 2 + (y2 - y) ** 2) > {tiles.section_tolerance(ZOOM)!r} as bent from p
), s as (select collar_id, x, y, case when bent then x1 else x2 end as xe, case when bent then y1 else y2 end as ye from k union all select collar_id, x1, y1, x2, y2 from k where bent
), e as (select collar_id, (x + {tiles.HALF!r}) / {_SIDE} as u, ({tiles.HALF!r} - y) / {_SIDE} as v, (xe - x) / {_SIDE} as du, (y - ye) / {_SIDE} as dv from s
), x as (select *, unnest(range(cast(floor(least(u, u + du) - {_LO}) as bigint), cast(floor(greatest(u, u + du) + {_LO}) as bigint) + 1)) as tile_x from e), y as (select *, unnest(range(cast(floor(least(v, v + dv) - {_LO}) as bigint), cast(floor(greatest(v, v + dv) + {_LO}) as bigint) + 1)) as tile_y from x
), c as (select *, (tile_x - {_LO} - u) / nullif(du, 0) as a, (tile_x + {_HI} - u) / nullif(du, 0) as b, (tile_y - {_LO} - v) / nullif(dv, 0) as c, (tile_y + {_HI} - v) / nullif(dv, 0) as d from y
), w as (select *, least(1, coalesce(greatest(a, b), 1), coalesce(greatest(c, d), 1)) - greatest(0, coalesce(least(a, b), 0), coalesce(least(c, d), 0)) as share from c
), t as (select {ZOOM} as z, tile_x, tile_y, collar_id, count(*) as segments, round(sum(sqrt(du * du + dv * dv) * {_SIDE} * share), 3) as metres from w where share > 0 group by 2, 3, 4)
select t.*, section_name, azimuth_deg, length_m, buffer_m from t join r using (collar_id)"""
