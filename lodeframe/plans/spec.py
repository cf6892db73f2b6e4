"""Typed sub-queries: a validated specification becomes a DataFrame. Names are checked
against the table's schema and only Column functions are used, so no text is spliced."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"count": lambda c: F.count(c), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp, "median": F.median, "distinct": F.count_distinct}


@dataclass(frozen=True)
class Aggregate:
    """filters: column to value, list of values, or (low, high)."""

    function: str
    column: str = "*"
    group_by: tuple[str, ...] = ()
    filters: dict = field(default_factory=dict)
    limit: int | None = None


def checked(df: DataFrame, *names: str) -> None:
    unknown = [n for n in names if n != "*" and n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")


def filtered(df: DataFrame, filters: dict) -> DataFrame:
    checked(df, *filters)
    for name, want in filters.items():
        c = F.col(name)
        if want is None:
            continue  # an absent parameter doesn't filter
        df = df.where(c.isin(want) if isinstance(want, list) else c.between(*want) if isinstance(want, tuple) else c == want)
    return df


def run(df: DataFrame, spec: Aggregate) -> DataFrame:
    checked(df, spec.column, *spec.group_by)
    if spec.function not in AGGREGATES:
        raise ValueError(f"unknown function: {spec.function}")
    value = F.count("*") if spec.column == "*" else AGGREGATES[spec.function](spec.column)
    made = filtered(df, spec.filters).groupBy(*spec.group_by).agg(value.alias("value"))
    return made if spec.limit is None else made.orderBy(F.desc_nulls_last("value"), *spec.group_by).limit(spec.limit)


def for_workspace(df: DataFrame, workspace_id) -> DataFrame:
    """The rows of one workspace; every table read for a user goes through this."""
    checked(df, "workspace_id")
    return df.where(F.col("workspace_id") == F.lit(workspace_id))
