"""The domain's tables, made from the driver's tables by expressions that Spark and DuckDB
read alike, so that each query has an oracle over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name: (source table, columns).
TABLES: dict[str, tuple[str, list[str]]] = {
    "collar": (
        "orders",
        [
            "o_orderkey as collar_id",
            "o_custkey % 40 as project_id",
            "cast(o_custkey % 5 as int) as workspace_id",
            "concat('ddh-', cast(o_orderkey % 500 as string)) as hole_id",
            "cast(floor(o_totalprice / 500) as double) as total_depth",
            "cast((o_orderkey * 37) % 360 as double) as azimuth",
            "-45 - cast(o_orderkey % 45 as double) as dip",
            "cast((o_orderkey * 7919) % 20000 as double) as easting",
            "cast((o_orderkey * 104729) % 20000 as double) as northing",
            "cast(o_orderkey % 300 as double) as elevation",
            "o_orderpriority as hole_type",
            "o_orderstatus as status",
            "cast(o_orderdate as date) as drill_date",
        ],
    ),
    "assay": (
        "lineitem",
        [
            "l_orderkey as collar_id",
            "l_partkey as sample_id",
            "l_suppkey % 10 as lab",
            "l_returnflag as element",
            "cast(l_linenumber as double) * 2 + l_suppkey % 4 as from_depth",
            "cast(l_linenumber as double) * 2 + l_suppkey % 4 + 0.5 + l_quantity % 4 as to_depth",
            "0.5 + l_quantity % 4 as interval_length",
            "case when l_partkey % 50 = 0 then null else cast(floor(l_extendedprice / 10) as double) end as value_ppm",
            "case l_partkey % 3 when 0 then 'ppm' when 1 then 'PPM ' else 'g/t' end as unit",
            "l_discount as reported",
            "l_tax as expected",
            "l_linestatus as qaqc_type",
            "cast(l_shipdate as date) as assay_date",
        ],
    ),
    "lithology": (
        "lineitem",
        [
            "l_orderkey as collar_id",
            "concat('RK', cast(l_partkey % 12 as string)) as rock_code",
            "cast(l_linenumber as double) * 3 as from_depth",
            "cast(l_linenumber as double) * 3 + 3 as to_depth",
        ],
    ),
    "usage": (
        "events",
        [
            "event_id",
            "cast(ts as timestamp) as ts",
            "user_id % 7 as workspace_id",
            "user_id",
            "event_type",
            "cast(floor(value * 100) as double) as cost",
            "props",
        ],
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    return table(spark, sf_dir, source).selectExpr(*columns)


def ctes(*names: str) -> str:
    """`with` clause text that defines these tables in DuckDB."""
    made = []
    for n in names:
        source, columns = TABLES[n]
        made.append(f"{n} as (select {', '.join(c.replace(' as string', ' as varchar') for c in columns)} from {source})")
    return "with " + ",\n".join(made)


def varied(spark: SparkSession, sf_dir: str, source: str, key: str, samples: list[tuple], schema: str) -> DataFrame:
    """key and the sample that its remainder picks, for every row of a table."""
    picked = spark.createDataFrame([(k, *x) for k, x in enumerate(samples)], f"k long, {schema}")
    return table(spark, sf_dir, source).select(key, (F.col(key) % len(samples)).alias("k")).join(F.broadcast(picked), "k")  # a few samples
