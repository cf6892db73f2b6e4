"""Scores of targets from weighted factors, their weights, and their ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.sources.shared import keep_table


def steady_sum(x: Column) -> Column:
    """A sum of doubles that doesn't depend on the order of rows: multiples of 2**-32 add up
    without error up to 2**21, and what is left of each is too small to show."""
    step = F.lit(2.0**32)
    high = F.rint(x * step) / step
    return F.sum(high) + F.sum(x - high)


def signed_score(factors: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Values cut to [-1, 1], weighted over the sum of absolute weights, cut again. Equal
    factors have equal scores, in whatever order their rows come."""
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(value)))
    raw = steady_sum(v * F.col(weight)) / F.nullif(steady_sum(F.abs(weight)), F.lit(0.0))
    return factors.groupBy(key).agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(raw, F.lit(0.0)))).alias("score"))


def unit_score(factors: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Weighted mean cut to [0, 1]; 0 where the weights don't add up to more than 0."""
    total = F.sum(weight)
    raw = F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(0.0)
    return factors.groupBy(key).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("score"))


def fitted_weights(factors: DataFrame, name: str, value: str, hit: Column) -> DataFrame:
    """Mean of hits less mean of misses by factor; `weight` is its share of all absolute
    differences, and `difference` keeps the sign."""
    made = factors.groupBy(name).agg((F.avg(F.when(hit, F.col(value))) - F.avg(F.when(~hit, F.col(value)))).alias("difference"))
    return made.withColumn("weight", F.abs("difference") / F.nullif(F.sum(F.abs("difference")).over(Window.partitionBy(F.lit(1))), F.lit(0.0)))  # a row per factor


def blended(scores: DataFrame, linear: str, learned: str, weights: tuple[float, float] = (0.6, 0.4), least: float = 0.4) -> DataFrame:
    """Both scores, how far apart they are, and what is shown: their blend, or the linear one
    where they are too far apart for its size."""
    apart = F.abs(F.col(linear) - F.col(learned))
    agree = F.greatest(F.lit(0.0), 1 - apart / F.greatest(F.abs(linear), F.lit(1.0)))
    shown = F.when(agree < least, F.col(linear)).otherwise(weights[0] * F.col(linear) + weights[1] * F.col(learned))
    return scores.withColumns({"divergence": apart, "fell_back": agree < least, "shown": shown})


def ranks(scores: DataFrame, excluded: list, key: str = "target_id") -> DataFrame:
    """Ranks from 1 among those not excluded; ties by key."""
    return numbered(scores.where(~F.col(key).isin(excluded)), [F.desc("score"), F.col(key)], "rank")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place in a total order, from 1. Ranges of the order are sorted apart;
    each range's first place is the count of rows in those before it (a number a range)."""
    sorted_rows = keep_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.withColumn("first", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "first")
    placed = sorted_rows.join(F.broadcast(before), part == F.col("part"))
    return placed.withColumn(name, (F.col("first") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("__at", "part", "first")
