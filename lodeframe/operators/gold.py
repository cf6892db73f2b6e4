"""Gold aggregates over intervals: composites, significant intersections, summaries,
statistics and correlations. Grades are weighted by interval length; every ordering is
total, so equal rows cannot change a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))


def composites(assay: DataFrame, length: float) -> DataFrame:
    """Fixed windows of `length` metres per hole and element. A sample belongs whole to the
    window of its from_depth."""
    start = (F.floor(F.col("from_depth") / length) * length).cast("double")
    kept = assay.where("value_ppm is not null").withColumn("window_from", start)
    made = kept.groupBy("collar_id", "element", "window_from").agg(
        weighted_mean("value_ppm", "interval_length").alias("weighted_avg"),
        F.min("value_ppm").alias("min_value"),
        F.max("value_ppm").alias("max_value"),
        F.count("*").alias("sample_count"),
        F.max("unit").alias("unit"),
    )
    made = made.where("weighted_avg is not null").withColumn("to_depth", F.col("window_from") + length)
    return made.withColumnRenamed("window_from", "from_depth").withColumn("composite_type", F.lit(f"fixed_{float(length)}m"))


def runs_above(assay: DataFrame, cutoff: float) -> DataFrame:
    """Assays at or above a cutoff, with run_id: it grows where the hole passes from below
    the cutoff to at or above it. A null value does not interrupt a run."""
    w = Window.partitionBy("collar_id", "element").orderBy("from_depth", "to_depth", "value_ppm", "sample_id")
    known = assay.where("value_ppm is not null").withColumn("before", F.coalesce(F.lag("value_ppm").over(w), F.lit(0.0)))
    begins = ((F.col("value_ppm") >= cutoff) & (F.col("before") < cutoff)).cast("int")
    return known.withColumn("run_id", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("value_ppm") >= cutoff)


def significant_intersections(assay: DataFrame, cutoff: float) -> DataFrame:
    """One row per run: extent, weighted grade, peak and where it is, samples."""
    return runs_above(assay, cutoff).groupBy("collar_id", "element", "run_id").agg(
        F.min("from_depth").alias("from_depth"),
        F.max("to_depth").alias("to_depth"),
        weighted_mean("value_ppm", "interval_length").alias("weighted_avg"),
        F.max("value_ppm").alias("peak_value"),
        F.min(F.struct((-F.col("value_ppm")).alias("v"), F.col("from_depth").alias("d")))["d"].alias("peak_depth"),
        F.count("*").alias("sample_count"),
    )


def union_length(assay: DataFrame) -> DataFrame:
    """Metres of each hole that at least one interval covers."""
    w = Window.partitionBy("collar_id").orderBy("from_depth", "to_depth").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("to_depth").over(w), F.col("from_depth"))
    fresh = F.greatest(F.col("to_depth") - F.greatest(reach, F.col("from_depth")), F.lit(0.0))
    return assay.select("collar_id", "from_depth", "to_depth").withColumn("fresh", fresh).groupBy("collar_id").agg(F.sum("fresh").alias("covered"))


def best_interval(assay: DataFrame, element: str) -> DataFrame:
    """The interval with the highest value of an element in each hole."""
    w = Window.partitionBy("collar_id").orderBy(F.desc("value_ppm"), "from_depth", "to_depth")
    best = assay.where(F.col("element") == element).where("value_ppm is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return best.select("collar_id", F.col("value_ppm").alias("best_grade"), F.col("from_depth").alias("best_from"), F.col("to_depth").alias("best_to"))


def drill_summaries(collar: DataFrame, assay: DataFrame, lithology: DataFrame, element: str) -> DataFrame:
    """One row per hole. assay_coverage_pct sums each distinct length once, as the original
    does; assay_union_pct is what intervals cover. Each side is aggregated before the joins."""
    per_hole = assay.groupBy("collar_id").agg(F.sum_distinct(F.col("to_depth") - F.col("from_depth")).alias("lengths"), F.sort_array(F.collect_set("element")).alias("elements_assayed"))
    logged = lithology.groupBy("collar_id").agg(F.sum(F.col("to_depth") - F.col("from_depth")).alias("logged"))
    depth = F.nullif(F.col("total_depth"), F.lit(0))
    made = collar.select("collar_id", "hole_id", "total_depth").join(per_hole, "collar_id", "left").join(logged, "collar_id", "left")
    made = made.join(union_length(assay), "collar_id", "left").join(best_interval(assay, element), "collar_id", "left")
    pct = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / depth * 100
    return made.select(
        "collar_id", "hole_id", "total_depth",
        pct("lengths").alias("assay_coverage_pct"), pct("covered").alias("assay_union_pct"),
        F.coalesce(pct("logged"), F.lit(0.0)).alias("lithology_coverage_pct"),
        "best_grade", "best_from", "best_to",
        F.coalesce("elements_assayed", F.array().cast("array<string>")).alias("elements_assayed"),
    )


def campaign_summaries(collar: DataFrame, intersections: DataFrame, corrected: bool = False) -> DataFrame:
    """By project: holes, metres, mean depth, best intersection. The original joins holes to
    intersections before it sums, so total_metres counts a hole once for each of the
    campaign's intersections; with corrected=True each hole counts once."""
    scored = intersections.join(collar.select("collar_id", "project_id"), "collar_id")
    w = Window.partitionBy("project_id").orderBy(F.desc_nulls_last("weighted_avg"), "element", "collar_id", "run_id")
    best = scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("project_id", F.col("weighted_avg").alias("best_grade"), F.col("element").alias("best_element"))
    holes = collar.groupBy("project_id").agg(F.count_distinct("collar_id").alias("holes_completed"), F.sum("total_depth").alias("metres"), F.avg("total_depth").alias("avg_hole_depth"))
    fan_out = scored.groupBy("project_id").agg(F.count("*").alias("n"))
    made = holes.join(best, "project_id", "left").join(fan_out, "project_id", "left")
    times = F.lit(1) if corrected else F.greatest(F.coalesce("n", F.lit(1)), F.lit(1))
    return made.select("project_id", "holes_completed", (F.col("metres") * times).cast("double").alias("total_metres"), "avg_hole_depth", "best_grade", "best_element")


def zone_statistics(intersections: DataFrame, collar: DataFrame, zone: Column) -> DataFrame:
    """Grade and thickness by project, zone and element; rows without a zone are together."""
    joined = intersections.join(collar, "collar_id").withColumn("zone_name", F.coalesce(zone, F.lit("__unzoned")))
    return joined.groupBy("project_id", "zone_name", "element").agg(
        F.count_distinct("collar_id").alias("holes_in_zone"),
        F.sum(F.col("to_depth") - F.col("from_depth")).alias("total_length_m"),
        F.avg("weighted_avg").alias("avg_grade"),
        F.max("weighted_avg").alias("max_grade"),
    )


def qaqc_pass_fail(kind: Column, reported: Column, expected: Column, tolerance_pct: float, blank: str, standard: str) -> Column:
    """Blanks fail above three times the expected value, standards beyond the tolerance;
    everything else passes, nulls included."""
    off = F.abs(reported - expected) / F.nullif(expected, F.lit(0.0)) * 100
    return F.when((kind == blank) & (reported > 3 * expected), "fail").when((kind == standard) & (off > tolerance_pct), "fail").otherwise("pass")


def qaqc_statistics(results: DataFrame, period: Column) -> DataFrame:
    """results: lab, element, qaqc_type, pass_fail, reported, expected."""
    error = F.when(F.col("expected") != 0, F.abs(F.col("reported") - F.col("expected")) / F.col("expected") * 100)
    return results.withColumn("period_start", period).groupBy("lab", "element", "qaqc_type", "period_start").agg(
        F.count("*").alias("submitted"), F.count_if(F.col("pass_fail") == "pass").alias("passed"), F.avg(error).alias("avg_error_pct")
    )


def pearson(a: str, b: str) -> Column:
    """Correlation from moments: null where a series is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def element_correlations(assay: DataFrame, min_pairs: int) -> DataFrame:
    """Pearson r of values of two elements at the same place. Values at one place are first
    averaged by element, so the self-join meets few rows of a key."""
    spot = assay.where("value_ppm is not null").groupBy("collar_id", "from_depth", "element").agg(F.avg("value_ppm").alias("v"))
    a, b = spot.alias("a"), spot.alias("b")
    pairs = a.join(b, (F.col("a.collar_id") == F.col("b.collar_id")) & (F.col("a.from_depth") == F.col("b.from_depth")) & (F.col("a.element") < F.col("b.element")))
    made = pairs.select(F.col("a.element").alias("element_a"), F.col("b.element").alias("element_b"), F.col("a.v").alias("x"), F.col("b.v").alias("y"))
    made = made.groupBy("element_a", "element_b").agg(F.count("*").alias("pair_count"), pearson("x", "y").alias("r"))
    return made.where((F.col("pair_count") >= min_pairs) & F.col("r").isNotNull())


def collar_summary(collar: DataFrame, assay: DataFrame) -> DataFrame:
    """By project: depth figures, dates, and how many holes have assays."""
    has = assay.select("collar_id").distinct().withColumn("has", F.lit(True))
    return collar.join(has, "collar_id", "left").groupBy("project_id").agg(
        F.count("*").alias("collar_count"),
        F.round(F.avg("total_depth"), 1).alias("avg_depth"),
        F.min("total_depth").cast("double").alias("min_depth"),
        F.max("total_depth").cast("double").alias("max_depth"),
        F.min("drill_date").alias("first_date"),
        F.max("drill_date").alias("last_date"),
        F.count("has").alias("assayed_holes"),
        F.count_distinct("hole_type").alias("hole_types"),
    )
