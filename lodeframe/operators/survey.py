"""Drill-hole paths from survey stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.geo import directions, true_orientation


def latest_stations(stations: DataFrame, updated: str) -> DataFrame:
    """One station per depth: the one updated last, then by azimuth and dip."""
    w = Window.partitionBy("collar_id", "depth").orderBy(F.desc_nulls_last(updated), "azimuth", "dip")
    return stations.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def minimum_curvature(stations: DataFrame) -> DataFrame:
    """stations: collar_id, depth, azimuth, dip, x0, y0. The path at each station: x and y
    are absolute, z is relative to the collar. From the collar to the first station the hole
    is straight. Adds dogleg, degrees in 30 m since the last station."""
    w = Window.partitionBy("collar_id").orderBy("depth")
    n, e, u = directions(F.col("azimuth"), F.col("dip"))
    made = stations.withColumns({"n": n, "e": e, "u": u})
    made = made.withColumns({f"p{c}": F.lag(c).over(w) for c in "neu"} | {"dl": F.col("depth") - F.coalesce(F.lag("depth").over(w), F.lit(0.0))})
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("n") * F.col("pn") + F.col("e") * F.col("pe") + F.col("u") * F.col("pu")))
    made = made.withColumn("beta", F.acos(dot))
    ratio = F.when(F.col("beta") < 1e-9, 1.0).otherwise(2 / F.col("beta") * F.tan(F.col("beta") / 2))
    step = {f"d{c}": F.when(F.col(f"p{c}").isNull(), F.col("dl") * F.col(c)).otherwise(F.col("dl") / 2 * (F.col(c) + F.col(f"p{c}")) * ratio) for c in "neu"}
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumns(step)
    return made.select(
        "collar_id", "depth",
        (F.col("x0") + F.sum("de").over(run)).alias("x"), (F.col("y0") + F.sum("dn").over(run)).alias("y"), F.sum("du").over(run).alias("z"),
        (F.degrees("beta") / F.nullif(F.col("dl"), F.lit(0.0)) * 30).alias("dogleg"),
    )


def interpolate(path: DataFrame, samples: DataFrame, width: float = 50.0) -> DataFrame:
    """samples (collar_id, at, ...) with the path's place at their depth; null outside it. A
    sample meets only the segments of its own hole and depth bin."""
    w = Window.partitionBy("collar_id").orderBy("depth")
    seg = path.withColumns({f"{c}1": F.lead(c).over(w) for c in ("depth", "x", "y", "z")}).where("depth1 is not null")
    seg = seg.withColumn("bin", F.explode(F.sequence(F.floor(F.col("depth") / width), F.floor(F.col("depth1") / width))))
    places = samples.select("collar_id", "at").distinct().withColumn("bin", F.floor(F.col("at") / width))
    t = (F.col("at") - F.col("depth")) / F.nullif(F.col("depth1") - F.col("depth"), F.lit(0.0))
    at = [(F.col(c) + F.coalesce(t, F.lit(0.0)) * (F.col(f"{c}1") - F.col(c))).alias(f"at_{c}") for c in "xyz"]
    hit = places.join(seg, ["collar_id", "bin"]).where("at >= depth and at <= depth1").select("collar_id", "at", "depth", *at)
    first = hit.groupBy("collar_id", "at").agg(F.min(F.struct("depth", "at_x", "at_y", "at_z")).alias("p")).select("collar_id", "at", "p.at_x", "p.at_y", "p.at_z")
    return samples.join(first, ["collar_id", "at"], "left")


def as_of(rows: DataFrame, states: DataFrame, by: str, at: str, columns: list[str], width: float = 100.0) -> DataFrame:
    """rows with the columns of the last of `states` at or before their place (null: none, or a
    null place). Both have `by` and `at`; of several states at one place the largest by the
    columns, in order, counts. One sort of rows and states together in bins of `width`, and one
    of the bins' last states, carried from bin to bin; no range is joined."""
    last = F.max(F.struct(at, *columns))
    states = states.where(F.col(at).isNotNull()).groupBy(by, at).agg(last.alias("__s")).select(by, at, "__s", F.floor(F.col(at) / width).alias("__bin"))
    marked = rows.withColumn("__bin", F.floor(F.col(at) / width))
    placed = marked.where(F.col(at).isNotNull() & F.col(by).isNotNull())
    every = placed.select(by, at, "__bin", F.struct(*rows.columns).alias("__r"), F.lit(None).cast(states.schema["__s"].dataType).alias("__s")).unionByName(states.withColumn("__r", F.lit(None).cast(rows.schema)))
    w = Window.partitionBy(by, "__bin").orderBy(F.col(at), F.col("__s").isNull())
    inner = every.withColumn("__own", F.last("__s", ignorenulls=True).over(w)).where("__r is not null")
    bins = states.groupBy(by, "__bin").agg(F.max("__s").alias("__s")).unionByName(placed.select(by, "__bin").distinct().withColumn("__s", F.lit(None).cast(states.schema["__s"].dataType)))
    before = Window.partitionBy(by).orderBy("__bin").rangeBetween(Window.unboundedPreceding, -1)
    carried = bins.withColumn("__before", F.last("__s", ignorenulls=True).over(before)).where("__s is null").select(by, "__bin", "__before")
    met = inner.join(carried, [by, "__bin"], "left").withColumn("__s", F.coalesce("__own", "__before"))
    return met.select("__r.*", *(F.col(f"__s.{c}").alias(c) for c in columns)).unionByName(marked.where(F.col(at).isNull() | F.col(by).isNull()).select(*rows.columns, *(F.lit(None).cast(states.schema["__s"].dataType[c].dataType).alias(c) for c in columns)))


def derived(structures: DataFrame, collars: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """structures with true_dip and true_dip_dir, to three digits, filled in where either is
    null and alpha, beta and the hole's orientation are known. The orientation is the collar's
    or, with stations (depth, azimuth, dip), that of the last one at or above the depth, and the
    collar's above the first. collars: collar_id, azimuth, dip, once each."""
    known = structures.drop("azimuth", "dip") if stations is None else as_of(structures.drop("azimuth", "dip"), stations, "collar_id", "depth", ["azimuth", "dip"])
    hole = collars.select("collar_id", F.col("azimuth").alias("__a"), F.col("dip").alias("__d"))
    met = known.join(hole, "collar_id", "left")
    turn, fall = (F.col("__a"), F.col("__d")) if stations is None else (F.coalesce("azimuth", "__a"), F.coalesce("dip", "__d"))
    dip, way = true_orientation(F.col("alpha"), F.col("beta"), turn, fall)
    ready = (F.col("true_dip").isNull() | F.col("true_dip_dir").isNull()) & F.col("alpha").isNotNull() & F.col("beta").isNotNull() & turn.isNotNull() & fall.isNotNull()
    filled = met.withColumns({"__dip": F.when(ready, F.round(dip, 3)), "__way": F.when(ready, F.round(way, 3))})
    return filled.withColumns({"true_dip": F.coalesce("__dip", "true_dip"), "true_dip_dir": F.coalesce("__way", "true_dip_dir")}).select(*structures.columns)
