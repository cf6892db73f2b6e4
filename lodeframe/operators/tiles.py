"""Map tiles as rows: which features a tile shows, where in the tile, and with what attributes.
Encoding the bytes of a tile is left to the server."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Units along a tile's side, units around it that are kept as well, and half the
# projected world in metres.
EXTENT, BUFFER, HALF = 4096, 64, 20037508.342789244
# Attributes of each layer of points.
POINT_LAYERS: dict[str, list[str]] = {
    "pg_mineral_occurrences": ["jurisdiction_code", "source_id", "source_feature_id", "external_id", "name", "status", "primary_commodities", "associated_commodities", "commodity_grouping", "discovery_type", "production_flag", "source_url"],
    "collars": ["project_id", "hole_id", "collar_azimuth", "collar_dip", "total_depth_m"],
    "historic_workings": ["project_id", "working_name", "working_type", "operational_period", "operational_from_year", "operational_to_year", "commodity_codes", "status"],
    "geochem": ["project_id", "sample_id", "sample_type", "assay_element_codes", "collar_id"],
    "pg_mines": ["jurisdiction_code", "source_id", "source_feature_id", "name", "status", "commodities", "commodity_grouping", "operator", "source_url"],
    "pg_drillhole_collars": ["jurisdiction_code", "source_id", "source_feature_id", "drillhole_id", "drillhole_name", "company", "project_name", "drill_type", "total_length_m", "has_total_length", "core_availability"],
    "pg_rock_samples": ["jurisdiction_code", "source_id", "source_feature_id", "station", "sample_number", "geologist", "geographic_area", "report_number", "nts_250k"],
    "significant_intersections": ["hole_id", "element", "from_depth", "to_depth", "grade"],
}
# Metres by which lines may be simplified, below a zoom.
TOLERANCES: list[tuple[int, float]] = [(8, 100.0), (12, 25.0), (99, 5.0)]


def tolerance(zoom: int) -> float:
    return next(metres for below, metres in TOLERANCES if zoom < below)


def section_tolerance(zoom: int) -> float:
    """Of section lines: half a unit of a tile of 256, but not below half a metre (fixed values)."""
    return max(0.5, 156543.034 / (1 << zoom) * 0.5)


def projected(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web-Mercator metres."""
    return lon / 180 * HALF, F.log(F.tan(F.radians(45 + lat / 2))) / math.pi * HALF


def point_tiles(rows: DataFrame, layer: str, key: str, x: str, y: str, zoom: int, where: Column | None = None) -> DataFrame:
    """z, tile_x, tile_y, layer, key, px, py (units from the tile's upper left) and the layer's
    attributes. A point in the buffer of a neighbour is shown there too. x, y: metres. Rows
    with no place, or that fail `where` (a project, a cutoff), are in no tile."""
    side, n = 2 * HALF / (1 << zoom), 1 << zoom
    edge = BUFFER / EXTENT
    kept = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()) if where is None else rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & where)
    u, v = (F.col(x) + HALF) / side, (HALF - F.col(y)) / side
    near = lambda a: F.sequence(F.floor(a - edge).cast("int"), F.floor(a + edge).cast("int"))
    made = kept.select(key, *[c for c in POINT_LAYERS[layer] if c != key], u.alias("__u"), v.alias("__v")).withColumn("tile_x", F.explode(near(F.col("__u")))).withColumn("tile_y", F.explode(near(F.col("__v"))))
    made = made.where(F.col("tile_x").between(0, n - 1) & F.col("tile_y").between(0, n - 1))
    at = [F.floor((F.col(f"__{a}") - F.col(f"tile_{b}")) * EXTENT).cast("int").alias(f"p{b}") for a, b in (("u", "x"), ("v", "y"))]
    return made.select(F.lit(zoom).alias("z"), "tile_x", "tile_y", F.lit(layer).alias("layer"), key, *at, *[c for c in POINT_LAYERS[layer] if c != key])


def simplified(vertices: DataFrame, key: str, order: str, x: str, y: str, metres: float, rounds: int = 3) -> DataFrame:
    """Vertices of lines without those that lie within `metres` of the line through the two
    next to them; ends stay. In a round no two neighbours go, so that a line keeps its shape."""
    w = Window.partitionBy(key).orderBy(order)
    for _ in range(rounds):
        made = vertices.withColumns({f"__{n}{c}": f(c).over(w) for c in (x, y) for n, f in (("p", F.lag), ("n", F.lead))} | {"__at": F.row_number().over(w)})
        px, py, nx, ny = (F.col(f"__{n}{c}") for n in "pn" for c in (x, y))
        length = F.hypot(nx - px, ny - py)
        off = F.when(length > 0, F.abs((nx - px) * (F.col(y) - py) - (ny - py) * (F.col(x) - px)) / length).otherwise(F.hypot(F.col(x) - px, F.col(y) - py))
        vertices = made.where(px.isNull() | nx.isNull() | (off > metres) | (F.col("__at") % 2 == 1)).select(*vertices.columns)
    return vertices


def line_tiles(vertices: DataFrame, key: str, order: str, x: str, y: str, zoom: int, metres: float | None = None) -> DataFrame:
    """z, tile_x, tile_y, key, segments, metres: what of each line lies in each tile and its
    buffer, once simplified by `metres` or for the zoom. A segment meets the tiles of its bounding box and is
    cut to each by the range of its length that lies between the tile's sides."""
    side, edge = 2 * HALF / (1 << zoom), BUFFER / EXTENT
    w = Window.partitionBy(key).orderBy(order)
    plain = simplified(vertices, key, order, x, y, tolerance(zoom) if metres is None else metres).select(key, order, ((F.col(x) + HALF) / side).alias("u"), ((HALF - F.col(y)) / side).alias("v"))
    seg = plain.withColumns({"u1": F.lead("u").over(w), "v1": F.lead("v").over(w)}).where("u1 is not null")
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) - edge).cast("int"), F.floor(F.greatest(a, b) + edge).cast("int"))
    seg = seg.withColumn("tile_x", F.explode(span("u", "u1"))).withColumn("tile_y", F.explode(span("v", "v1")))
    first, last = [F.lit(0.0)], [F.lit(1.0)]
    for a, b, t in (("u", "u1", "tile_x"), ("v", "v1", "tile_y")):
        move = F.nullif(F.col(b) - F.col(a), F.lit(0.0))
        ends = [(F.col(t) - edge - F.col(a)) / move, (F.col(t) + 1 + edge - F.col(a)) / move]
        first.append(F.coalesce(F.least(*ends), F.lit(0.0)))  # null: parallel to the sides, and the bounding box is between them
        last.append(F.coalesce(F.greatest(*ends), F.lit(1.0)))
    share = F.least(*last) - F.greatest(*first)
    made = seg.withColumn("share", share).where("share > 0")
    shown = F.hypot(F.col("u1") - F.col("u"), F.col("v1") - F.col("v")) * side * F.col("share")
    return made.groupBy(F.lit(zoom).alias("z"), "tile_x", "tile_y", key).agg(F.count("*").alias("segments"), F.sum(shown).alias("metres"))
