"""Joins of points by place, each as an equality of grid keys with a distance test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.geo import hex_cell, hex_parent


#: So many rows of one place are one list.
LISTED = 4096


def _by_place(rows: DataFrame, side: str, metres: float, x: str, y: str, parts: int) -> tuple[DataFrame, list[str]]:
    """cx, cy, side_x, side_y, rows: of each place, in lists of up to LISTED; columns in them."""
    names = [c for c in rows.columns if c not in (x, y)]
    place = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.floor(F.col(x) / metres).alias("cx"), F.floor(F.col(y) / metres).alias("cy"), F.col(x).alias(f"{side}x"), F.col(y).alias(f"{side}y"), F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(names)), *([] if names else [F.lit(0).alias("c0")])).alias("row")
    )
    keys = ["cx", "cy", f"{side}x", f"{side}y"]
    counted = place.repartition(parts, "cx", "cy").withColumn("list", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("cx")) - 1) / LISTED))
    listed = counted.groupBy(*keys, "list").agg(F.collect_list("row").alias(f"{side}rows")).drop("list")
    if len(names) == 1:  # a third as wide
        listed = listed.withColumn(f"{side}rows", F.transform(f"{side}rows", lambda r: r["c0"]))
    return listed, names


def near(a: DataFrame, b: DataFrame, metres: float, x: str = "easting", y: str = "northing") -> DataFrame:
    """Rows of a and b within a distance; columns are prefixed a_ and b_. Rows of one place are
    one list, b's in the cell of its own and the eight around it, a's in its own, so each pair
    of places meets once; its rows are paired as they are handed on."""
    spark = a.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    (left, a_names), (right, b_names) = _by_place(a, "__a", metres, x, y, parts), _by_place(b, "__b", metres, x, y, parts)
    around = F.expr("transform(sequence(0, 8), k -> struct(k div 3 - 1 as dx, k % 3 - 1 as dy))")
    right = right.withColumn("d", F.explode(around)).withColumns({"cx": F.col("cx") + F.col("d.dx"), "cy": F.col("cy") + F.col("d.dy")}).drop("d")
    made = left.hint("merge").join(right.repartition(parts, "cx", "cy").hint("merge"), ["cx", "cy"])
    made = made.withColumn("distance", F.sqrt(F.pow(F.col("__ax") - F.col("__bx"), 2) + F.pow(F.col("__ay") - F.col("__by"), 2))).where(F.col("distance") <= metres)
    made = made.withColumn("__a", F.explode("__arows")).withColumn("__b", F.explode("__brows"))
    value = lambda side, names, c: F.col(f"__{side}{'xy'[c == y]}") if c in (x, y) else F.col(f"__{side}" if len(names) == 1 else f"__{side}.c{names.index(c)}")
    return made.select(*(value(s, names, c).alias(f"{s}_{c}") for s, df, names in (("a", a, a_names), ("b", b, b_names)) for c in df.columns), "distance")


def nearest(points: DataFrame, x0: float, y0: float, k: int, key: str, x: str = "easting", y: str = "northing") -> DataFrame:
    """The k points nearest to a place."""
    d = F.sqrt(F.pow(F.col(x) - x0, 2) + F.pow(F.col(y) - y0, 2))
    return points.withColumn("distance", d).orderBy("distance", key).limit(k)


def clusters(points: DataFrame, cell: float, x: str = "easting", y: str = "northing") -> DataFrame:
    """Counts and centroids by grid cell."""
    gx, gy = (F.round(F.col(c) / cell) * cell for c in (x, y))
    return points.groupBy(gx.alias("gx"), gy.alias("gy")).agg(F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"))


def every_nth(points: DataFrame, by: list[str], order: list[str], cap: int) -> DataFrame:
    """At most about `cap` rows of each group, by even steps."""
    w = Window.partitionBy(*by)
    made = points.withColumns({"__n": F.count("*").over(w), "__k": F.row_number().over(w.orderBy(*order)) - 1})
    step = F.greatest(F.ceil(F.col("__n") / cap), F.lit(1))
    return made.where(F.col("__k") % step == 0).drop("__n", "__k")


def hex_levels(points: DataFrame, size: float, levels: int, counts: dict[str, Column], x: str = "easting", y: str = "northing") -> DataFrame:
    """level (0: hexagons of `size` from centre to corner), cell and the counts (sums of rows:
    counts and sums alone add up), at every level from one pass over the points. A coarser
    hexagon is seven of the level below, so its counts are theirs added up. Points without a
    place are in no cell. size: above 0; levels: 1 to 15."""
    if size <= 0 or not 1 <= levels <= 15:
        raise ValueError(f"size {size}, levels {levels}")
    key = F.split(hex_cell(F.col(x), F.col(y), size), ":")
    fine = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key[0].cast("long").alias("__q"), key[1].cast("long").alias("__r")).agg(*(c.alias(n) for n, c in counts.items()))
    q, r, every = F.col("__q"), F.col("__r"), []
    named = fine
    for level in range(levels):
        if level:
            named = named.withColumns(dict(zip((f"__q{level}", f"__r{level}"), hex_parent(q, r), strict=True)))
            q, r = F.col(f"__q{level}"), F.col(f"__r{level}")
        every.append(F.struct(F.lit(level).alias("level"), F.concat_ws(":", q, r).alias("cell")))
    return named.select(F.explode(F.array(*every)).alias("c"), *counts).groupBy("c.level", "c.cell").agg(*(F.sum(n).alias(n) for n in counts))
