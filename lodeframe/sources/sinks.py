"""Write semantics over Parquet: keyed upserts, histories, scoped rebuilds, exports."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """old with new's rows in place of equal keys; of several new rows the last by `order`."""
    tagged = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), *[F.desc_nulls_last(c) for c in order or []])
    return tagged.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def inserted_if_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys old lacks, one per key."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def with_history(live: DataFrame, new: DataFrame, keys: list[str], checksum: str, at: str) -> tuple[DataFrame, DataFrame]:
    """The live rows after a load, and rows to append to the history: those whose checksum
    changed, with when they were replaced. Unchanged rows stay as they are."""
    other = new.select(*keys, F.col(checksum).alias("__sum"))
    changed = live.join(other, keys).where(~F.col(checksum).eqNullSafe(F.col("__sum")))
    history = changed.drop("__sum").withColumn("replaced_at", F.lit(at).cast("timestamp"))
    same = live.join(other, keys, "left").where(F.col("__sum").isNull() | F.col(checksum).eqNullSafe(F.col("__sum"))).select(*live.columns)
    fresh = new.join(same.select(*keys), keys, "left_anti").select(*live.columns)
    return same.unionByName(fresh), history


def replace_scope(df: DataFrame, path: str, scope: list[str]) -> None:
    """Rewrites only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def export_jsonl(tables: dict[str, DataFrame], path: str, workspace: str) -> None:
    """Gzipped lines: a manifest, then tagged rows of every table. The files are ranges of one
    order that the manifest begins, so it is the first line of the first file."""
    spark = next(iter(tables.values())).sparkSession
    manifest = json.dumps({"manifest": {"workspace": workspace, "tables": sorted(tables)}})
    lines = spark.createDataFrame([("", manifest)], "name string, value string")
    for name, df in sorted(tables.items()):
        lines = lines.unionByName(df.select(F.lit(name).alias("name"), F.to_json(F.struct(F.lit(name).alias("table"), F.struct("*").alias("row")), {"ignoreNullFields": "false"}).alias("value")))
    order = ["name", F.xxhash64("value")]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path, compression="gzip")


def restore_jsonl(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    parsed = spark.read.text(path).select(F.from_json("value", f"table string, row struct<{schema}>").alias("x"))
    return parsed.where(F.col("x.table") == name).select("x.row.*")


def archive(df: DataFrame, day: str, cutoff: str, cold: str) -> DataFrame:
    """Writes rows before the cutoff as gzipped JSON by day; returns the rows that stay."""
    df.where(F.col(day) < cutoff).write.mode("overwrite").partitionBy(day).json(cold, compression="gzip")
    return df.where(F.col(day) >= cutoff)


# Columns of each flat export, in order.
EXPORTS: dict[str, list[str]] = {
    "collars": ["collar_id", "hole_id", "easting", "northing", "elevation", "total_depth", "hole_type", "azimuth", "dip", "drill_date", "status"],
    "assays": ["assay_id", "sample_id", "collar_id", "hole_id", "from_depth", "to_depth", "assay_element", "assay_value", "assay_unit", "method_code", "detection_limit", "below_detection", "qc_flag"],
    "samples": ["sample_id", "collar_id", "hole_id", "from_depth", "to_depth", "sample_type", "lab_id", "qaqc_type"],
    "lithology": ["id", "collar_id", "hole_id", "from_depth", "to_depth", "rock_code", "rock_code_confidence", "rock_name", "description", "colour", "grain_size", "logged_by", "logged_date"],
    "geochemistry": ["geochem_id", "collar_id", "hole_id", "from_depth", "to_depth", "sample_id", "sample_type", "sio2_wt_pct", "al2o3_wt_pct", "fe2o3_wt_pct", "mgo_wt_pct", "cao_wt_pct", "na2o_wt_pct", "k2o_wt_pct", "mg_number", "cia", "eu_anomaly"],
}


def export_rows(rows: DataFrame, kind: str, filters: dict[str, Any] | None = None, extra: list[str] | None = None) -> DataFrame:
    """The columns of an export, all as text (null: empty), after the filters: column to a value
    that it has to equal, or `column_min` and `column_max` to bounds that it may reach. Columns
    that the rows lack are empty; `extra` come after the others; others are left out."""
    for name, value in (filters or {}).items():
        if value is None or value == "":
            continue
        if name.endswith("_min"):
            rows = rows.where(F.col(name.removesuffix("_min")) >= value)
        elif name.endswith("_max"):
            rows = rows.where(F.col(name.removesuffix("_max")) <= value)
        else:
            rows = rows.where(F.col(name) == value)
    there = set(rows.columns)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in there else F.lit("")
    return rows.select(*[said(c).alias(c) for c in [*EXPORTS[kind], *(extra or [])]])


def expanded(rows: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """rows with numbers read out of a JSON object for each of the fields it may hold."""
    return rows.withColumns({c: F.get_json_object(column, f"$.{c}").try_cast("double") for c in fields})


def export_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """df as CSV files with headers; with an order, the files are its ranges."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode("overwrite").csv(path, header=True)


def export_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of CSV files for each table."""
    for name, df in tables.items():
        export_csv(df, f"{path}/{name}")


def export_splits(df: DataFrame, path: str) -> None:
    """JSON lines in one folder per value of `split`."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def las_text(curves: DataFrame, null_value: float = -999.25) -> DataFrame:
    """collar_id and a LAS 2.0 file from rows of collar_id, depth, value. A hole's log is one
    file, so it is gathered as one row."""
    rows = curves.groupBy("collar_id").agg(F.array_sort(F.collect_list(F.struct("depth", F.coalesce("value", F.lit(null_value)).alias("value")))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: F.format_string("%.4f %.4f", x["depth"], x["value"])), "\n")
    head = F.concat(F.lit("~V\nVERS. 2.0 :\n~W\nWELL. "), F.col("collar_id").cast("string"), F.lit(f" : WELL\nNULL. {null_value} :\n~C\nDEPT.M :\nVALUE. :\n~A\n"))
    return rows.select("collar_id", F.concat(head, body, F.lit("\n")).alias("las"))


def geojson_text(points: DataFrame, lon: str, lat: str) -> DataFrame:
    """One GeoJSON feature per row."""
    props = F.struct(*[c for c in points.columns if c not in (lon, lat)])
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("feature"))
