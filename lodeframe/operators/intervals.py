"""Joins and checks of half-open depth intervals [from, to)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(intervals: DataFrame, id_col: str, key: str = "collar_id", width: float = 10.0) -> DataFrame:
    """Pairs id_a < id_b of intervals of one key that overlap; touching is no overlap. Each
    interval is listed in the depth bins it meets, and pairs join on key and bin, reported
    in the first bin both meet, so a long hole is many small joins, not one large one."""
    last = F.greatest(F.floor(F.col("from_depth") / width), F.ceil(F.col("to_depth") / width) - 1)
    binned = intervals.where("to_depth > from_depth").select(key, id_col, "from_depth", "to_depth", F.explode(F.sequence(F.floor(F.col("from_depth") / width), last)).alias("bin"))
    a, b = binned.alias("a"), binned.alias("b")
    first = F.floor(F.greatest("a.from_depth", "b.from_depth") / width)
    on = (
        (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.bin") == first)
        & (F.col(f"a.{id_col}") < F.col(f"b.{id_col}")) & (F.col("a.from_depth") < F.col("b.to_depth")) & (F.col("b.from_depth") < F.col("a.to_depth"))
    )
    metres = F.least("a.to_depth", "b.to_depth") - F.greatest("a.from_depth", "b.from_depth")
    return a.join(b, on).select(F.col(f"a.{key}").alias(key), F.col(f"a.{id_col}").alias("id_a"), F.col(f"b.{id_col}").alias("id_b"), metres.alias("overlap_m"))


def overlap_flags(pairs: DataFrame, keep: int = 50, key: str = "collar_id") -> DataFrame:
    """One flag per key: how many pairs, metres, and the first `keep` pairs."""
    w = Window.partitionBy(key).orderBy("id_a", "id_b")
    ranked = pairs.withColumn("rn", F.row_number().over(w))
    listed = F.collect_list(F.when(F.col("rn") <= keep, F.struct("id_a", "id_b")))
    return ranked.groupBy(key).agg(F.count("*").alias("pair_count"), F.sum("overlap_m").alias("overlap_m"), F.sort_array(listed).alias("pairs"))


def first_containing(points: DataFrame, intervals: DataFrame, code: str, key: str = "collar_id", width: float = 10.0) -> DataFrame:
    """points with the code of the interval that holds their from_depth; of several, the one
    that starts first, then the smallest code. Intervals are ranked by distinct depth, not
    by point, so repeated points share the work, and meet only depths of their own bins."""
    depths = points.select(key, "from_depth").distinct().withColumn("bin", F.floor(F.col("from_depth") / width))
    bins = F.sequence(F.floor(F.col("from_depth") / width), F.greatest(F.floor(F.col("from_depth") / width), F.ceil(F.col("to_depth") / width) - 1))
    i = intervals.where("to_depth > from_depth").select(F.col(key).alias("k"), F.col("from_depth").alias("lo"), F.col("to_depth").alias("hi"), code, F.explode(bins).alias("b"))
    hit = depths.join(i, (depths[key] == i["k"]) & (depths["bin"] == i["b"]) & (depths["from_depth"] >= i["lo"]) & (depths["from_depth"] < i["hi"]))
    found = hit.groupBy(key, "from_depth").agg(F.min(F.struct("lo", code))[code].alias(code))
    return points.join(found, [key, "from_depth"], "left")


def slabs(points: DataFrame, length: float, key: list[str], depth: str, value: str) -> DataFrame:
    """Mean of valid points in slabs of fixed length."""
    start = (F.floor(F.col(depth) / length) * length).cast("double")
    return points.where(F.col(value).isNotNull()).groupBy(*key, start.alias("slab_from")).agg(F.avg(value).alias("mean_value"), F.count("*").alias("points"))


def islands(rows: DataFrame, key: list[str], order: list[str], label: Column) -> DataFrame:
    """Contiguous runs of one label: island number by key, in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    changed = (~label.eqNullSafe(F.lag(label).over(w))) | (F.row_number().over(w) == 1)
    made = rows.withColumn("__new", changed.cast("int"))
    return made.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def grade_tonnage(blocks: DataFrame, grade: str, tonnes: str, steps: int = 20) -> DataFrame:
    """Tonnes and mean grade at or above each of `steps` cutoffs, multiples of a step of
    max/steps rounded to three decimals. Blocks fold to one row per cutoff band first, so
    the running totals add up `steps` rows however many blocks there are."""
    top = blocks.agg(F.max(grade)).first()[0] or 0.0
    cutoffs = [round(k * top / steps, 3) for k in range(steps)]
    band = sum((F.when(F.col(grade) >= c, 1).otherwise(0) for c in cutoffs), F.lit(0))
    folded = blocks.where(F.col(grade).isNotNull()).groupBy(band.alias("band")).agg(F.sum(tonnes).alias("t"), F.sum(F.col(tonnes) * F.col(grade)).alias("tg"))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, 0)  # over at most steps + 1 rows
    every = blocks.sparkSession.createDataFrame([(k + 1, float(c)) for k, c in enumerate(cutoffs)], "band int, cutoff double").join(folded, "band", "left")
    made = every.withColumn("tonnes", F.sum(F.coalesce("t", F.lit(0.0))).over(above)).withColumn("metal", F.sum(F.coalesce("tg", F.lit(0.0))).over(above))
    return made.select("cutoff", "tonnes", (F.col("metal") / F.nullif(F.col("tonnes"), F.lit(0.0))).alias("grade"))
