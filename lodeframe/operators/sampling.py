"""Seeded samples, splits and hard negatives; all depend on hashes, not on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 2**32) from CRC-32, which other engines share."""
    return F.crc32(F.concat_ws(":", F.lit(seed), key).cast("binary"))


def sqrt_slots(rows: DataFrame, stratum: str, total: int) -> DataFrame:
    """Slots by stratum in proportion to the root of its size, and never more than that."""
    sized = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    share = F.sqrt("n") / F.sum(F.sqrt("n")).over(Window.partitionBy(F.lit(1)))  # one row per stratum
    return sized.withColumn("slots", F.least(F.col("n"), F.greatest(F.lit(1), F.round(share * total))).cast("long"))


def stratified(rows: DataFrame, stratum: str, key: str, total: int, seed: int) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(draw(F.col(key), seed), key)
    made = rows.withColumn("__rn", F.row_number().over(w)).join(F.broadcast(sqrt_slots(rows, stratum, total).select(stratum, "slots")), stratum)
    return made.where(F.col("__rn") <= F.col("slots")).drop("__rn", "slots")


def split(key: Column, seed: int, train: float = 0.8, val: float = 0.1) -> Column:
    p = draw(key, seed) / 2.0**32
    return F.when(p < train, "train").when(p < train + val, "val").otherwise("test")


def hard_negatives(ranked: DataFrame, query: str, group: str, own_group: str, bands: list[tuple[int, int, int]], key: str, seed: int) -> DataFrame:
    """ranked: query, key, rank, group and the query's own group. From other groups, so many
    rows of each (first, last, how many) band of ranks."""
    band, quota = F.lit(None).cast("int"), F.lit(0)
    for k, (lo, hi, n) in enumerate(bands):
        here = F.col("rank").between(lo, hi)
        band, quota = F.when(here, k).otherwise(band), F.when(here, n).otherwise(quota)
    made = ranked.where(~F.col(group).eqNullSafe(F.col(own_group))).withColumns({"band": band, "__quota": quota}).where("band is not null")
    w = Window.partitionBy(query, "band").orderBy(draw(F.concat_ws("/", query, key), seed), key)
    return made.withColumn("__rn", F.row_number().over(w)).where("__rn <= __quota").drop("__rn", "__quota")


def majority(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent non-empty value; ties go to the smaller."""
    counted = rows.where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "").groupBy(*by, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), value))[value].alias(value))
