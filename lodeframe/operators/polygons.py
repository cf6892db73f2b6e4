"""Polygons over grids of cells: which cells a polygon covers, joins of points and polygons by
them, and map tiles of polygon layers.

A polygon is `rings`, an array of arrays of structs (x, y): the outer ring first, then holes;
rings may turn either way and need not repeat their first point. Null or empty rings, and rings
of fewer than three points, have no cells.

Cells come from the edges alone. An edge is cut at the sides of each column of cells. In the
rows it passes, it adds the area between itself and the far end of the cell; in every row
before, the whole width it spans. Summed along the column with the rings' turns as signs,
that is the covered area of every cell, holes left out, and rows between two events are inside
cells. Nothing is tested cell by cell. Joins of points and polygons are those of `meeting`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.operators import meeting
from lodeframe.operators.tiles import BUFFER, EXTENT, HALF, simplified, tolerance

TINY = 1e-9
# Attributes of each layer of polygons.
POLYGON_LAYERS: dict[str, list[str]] = {
    "seismic": ["project_id", "survey_name", "survey_year", "survey_type", "line_count"],
    "boundaries": ["project_id", "boundary_name", "boundary_type", "effective_from", "effective_to"],
    "formations": ["project_id", "formation_code", "formation_name", "age_period", "age_ma_lower", "age_ma_upper", "lithology_primary"],
    "pg_assessment_surveys": ["jurisdiction_code", "source_id", "source_feature_id", "survey_type"],
    "pg_resource_potential": ["jurisdiction_code", "source_id", "commodity", "commodity_grouping", "potential_rank", "has_potential_rank", "methodology_ref"],
    "pg_mineral_dispositions": ["jurisdiction_code", "source_id", "source_feature_id", "disposition_number", "disposition_type", "status", "holder_name", "issue_date", "expiry_date", "area_ha", "commodity_codes", "geographic_area", "source_url"],
    "pg_bedrock_geology": ["jurisdiction_code", "source_id", "source_feature_id", "unit_code", "unit_name", "eon", "era", "period", "group_name", "formation", "member", "structural_domain", "lithology", "scale"],
}


def edges(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """key, ring, i, x0, y0, x1, y1, turn: 1 if the ring adds area where the edge goes right
    (in the direction of x), else -1."""
    p = polygons.select(F.col(key).alias("key"), F.posexplode(rings).alias("ring", "p")).where("size(p) >= 3")
    # the sign of twice the signed area
    around = "sign(aggregate(sequence(0, size(p) - 1), 0D, (s, i) -> s + p[i].x * p[(i + 1) % size(p)].y - p[(i + 1) % size(p)].x * p[i].y))"
    each = p.selectExpr("key", "ring", "p", f"if(ring = 0, 1, -1) * {around} as turn", "explode(sequence(0, size(p) - 1)) as i")
    return each.selectExpr("key as " + key, "ring", "i", *(f"cast(p[{i}].{c} as double) as {c}{n}" for n, i in ((0, "i"), (1, "(i + 1) % size(p)")) for c in "xy"), "turn")


def pieces(found: DataFrame, margin: float) -> DataFrame:
    """Edges in units of cells (u0, v0 to u1, v1), cut at the sides of columns `cx` widened by
    the margin: (ua, va) to (ub, vb)."""
    low, high = F.least("u0", "u1"), F.greatest("u0", "u1")
    each = found.withColumn("cx", F.explode(F.sequence(F.floor(low - margin), F.floor(high + margin))))
    side = lambda c: F.least(F.greatest(F.col(c), F.col("cx") - margin), F.col("cx") + 1 + margin)
    slope = (F.col("v1") - F.col("v0")) / F.nullif(F.col("u1") - F.col("u0"), F.lit(0.0))
    at = lambda c, v: F.coalesce(F.col("v0") + (F.col(c) - F.col("u0")) * slope, F.col(v))
    return each.withColumns({"ua": side("u0"), "ub": side("u1")}).withColumns({"va": at("ua", "v0"), "vb": at("ub", "v1")})


def coverage(found: DataFrame, key: str, margin: float = 0.0) -> DataFrame:
    """key, cx, cy, area (in cells), edges, corners: of each cell, widened by the margin, that
    a polygon meets. Without an edge the cell is inside. found: edges with u0, v0, u1, v1."""
    cut = pieces(found, margin)
    low, high, width = (F.least("va", "vb"), F.greatest("va", "vb"), F.col("turn") * (F.col("ub") - F.col("ua")))
    own = (F.col("cx") >= F.floor(F.col("u0") - margin)) & (F.col("cx") <= F.floor(F.col("u0") + margin))

    def partial(row: Column) -> Column:
        """The mean of v along the piece, kept between the cell's ends, from its first end."""
        begin, end = row - margin, row + 1 + margin
        kept = lambda v: F.least(F.greatest(v, begin), end)
        # an antiderivative of the kept part
        whole = lambda v: F.pow(kept(v) - begin, F.lit(2.0)) / 2 + (end - begin) * F.greatest(v - end, F.lit(0.0))
        va, vb = F.col("va"), F.col("vb")
        return F.when(F.abs(vb - va) < TINY, kept((va + vb) / 2) - begin).otherwise((whole(vb) - whole(va)) / F.nullif(vb - va, F.lit(0.0)))

    none = F.lit(0.0)
    rows = F.sequence(F.floor(low - margin), F.floor(high + margin))
    corner = lambda r: (own & (r >= F.floor(F.col("v0") - margin)) & (r <= F.floor(F.col("v0") + margin))).cast("long")
    here = F.transform(rows, lambda r: F.struct(r.alias("cy"), (width * partial(r)).alias("part"), none.alias("before"), F.lit(1).cast("long").alias("edges"), corner(r).alias("corners")))
    before = F.array(F.struct((F.floor(low - margin) - 1).alias("cy"), none.alias("part"), (width * (1 + 2 * margin)).alias("before"), F.lit(0).cast("long").alias("edges"), F.lit(0).cast("long").alias("corners")))
    events = cut.select(key, "cx", F.explode(F.concat(here, before)).alias("e")).groupBy(key, "cx", F.col("e.cy").alias("cy")).agg(*(F.sum(f"e.{c}").alias(c) for c in ("part", "before", "edges", "corners")))
    column = Window.partitionBy(key, "cx").orderBy(F.desc("cy"))
    summed = events.withColumns({"full": F.sum("before").over(column), "next": F.lead("cy").over(column)})
    gap = F.when((F.col("next") < F.col("cy") - 1) & (F.abs("full") > TINY), F.sequence(F.col("next") + 1, F.col("cy") - 1)).otherwise(F.array().cast("array<bigint>"))
    zero = F.lit(0).cast("long")
    own_row = F.array(F.struct(F.col("cy").alias("cy"), F.abs(F.col("part") + F.col("full")).alias("area"), F.col("edges").alias("edges"), F.col("corners").alias("corners")))
    filled = F.transform(gap, lambda r: F.struct(r.alias("cy"), F.abs("full").alias("area"), zero.alias("edges"), zero.alias("corners")))
    made = summed.select(key, "cx", F.explode(F.concat(own_row, filled)).alias("c")).select(key, "cx", "c.*")
    return made.where((F.col("edges") > 0) | (F.col("area") > TINY))


def in_cells(found: DataFrame, size: float) -> DataFrame:
    return found.withColumns({"u0": F.col("x0") / size, "v0": F.col("y0") / size, "u1": F.col("x1") / size, "v1": F.col("y1") / size})


def points_in(points: DataFrame, polygons: DataFrame, point_key: str, key: str, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """point_key, key, on_edge of points inside a polygon or on its edge (holes are outside,
    their edges are edges). size: of a cell; about that of a small polygon is best. Points
    without a place match nothing."""
    return meeting.points_in(meeting.places(points, point_key, x, y), meeting.outlines(polygons, key, size), point_key, key, size)


def polygon_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str, size: float) -> DataFrame:
    """a_key, b_key, contains, within of the polygons of a and b that intersect, edges included.
    contains: no part of b is outside a (its corners are in a, no edges cross, and no corner of
    a is inside b). Keys have different names and tell polygons apart."""
    return meeting.polygon_pairs(meeting.outlines(a, a_key, size), meeting.outlines(b, b_key, size), a_key, b_key, size)


def thinned(polygons: DataFrame, key: str, zoom: int) -> DataFrame:
    """key, rings: without corners that lie within the zoom's tolerance of their neighbours'
    line. A ring keeps its first point, and one that would fall below three points stays whole."""
    corners = polygons.select(F.col(key).alias("key"), F.posexplode("rings").alias("ring", "p")).where("size(p) >= 3")
    corners = corners.select(F.struct("key", "ring").alias("line"), F.posexplode(F.concat("p", F.slice("p", 1, 1))).alias("i", "q")).select("line", "i", "q.x", "q.y")
    left = simplified(corners, "line", "i", "x", "y", tolerance(zoom))
    rings = left.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("p"))  # of one ring
    whole = polygons.select(F.col(key).alias("key"), F.posexplode("rings").alias("ring", "whole"))
    rings = rings.select("line.key", "line.ring", F.expr("transform(slice(p, 1, size(p) - 1), q -> struct(q.x as x, q.y as y))").alias("p")).join(whole, ["key", "ring"])
    rings = rings.select("key", "ring", F.when(F.size("p") >= 3, F.col("p")).otherwise(F.col("whole")).alias("p"))
    return rings.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ring", "p"))).alias("r")).select(F.col("key").alias(key), F.expr("transform(r, q -> q.p)").alias("rings"))


def polygon_tiles(polygons: DataFrame, layer: str, key: str, zoom: int, where: Column | None = None, thin: bool = True) -> DataFrame:
    """z, tile_x, tile_y, layer, key, share (of the buffered tile that the polygon covers),
    whole (it covers all of it), corners (in the buffered tile) and the layer's attributes, for
    every tile that a polygon meets with its edges or covers. rings: in Mercator metres."""
    margin, side, n = BUFFER / EXTENT, 2 * HALF / (1 << zoom), 1 << zoom
    kept = polygons if where is None else polygons.where(where)
    shape = thinned(kept, key, zoom) if thin else kept
    found = edges(shape, key)
    found = found.withColumns({f"{u}{i}": (F.col(f"x{i}") + HALF) / side if u == "u" else (HALF - F.col(f"y{i}")) / side for u in "uv" for i in (0, 1)})
    cells = coverage(found, key, margin).where(F.col("cx").between(0, n - 1) & F.col("cy").between(0, n - 1))
    share = F.col("area") / (1 + 2 * margin) ** 2
    attributes = [c for c in POLYGON_LAYERS[layer] if c != key]
    made = cells.join(kept.select(key, *attributes), key)
    return made.select(F.lit(zoom).alias("z"), F.col("cx").cast("int").alias("tile_x"), F.col("cy").cast("int").alias("tile_y"), F.lit(layer).alias("layer"), key, share.alias("share"), (F.col("edges") == 0).alias("whole"), "corners", *attributes)
