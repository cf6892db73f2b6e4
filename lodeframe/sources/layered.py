"""Public feeds of several layers, pulled page by page, that go on where they stopped.

A pull is named by its layer and the layer's edit date. Its pages are landed as partitions
(layer, edited, page), batch by batch; every page also lands a row that says it is there, so an
empty page isn't asked for again. A pull that is killed leaves whole pages or none, and the next
one asks for the missing pages alone. A layer is read once all pages of its edit date are there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "layer string, edited long, page int, pages int, feature_id string, props string"


class Layer(NamedTuple):
    """What the feed says of a layer: its edit date (milliseconds) and how many pages it has."""

    name: str
    edited: int
    pages: int


def landed(spark: SparkSession, path: str) -> DataFrame:
    """All landed rows; a folder without any is empty."""
    spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("layer", "edited", "page").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def missing(spark: SparkSession, layers: list[Layer], path: str) -> DataFrame:
    """layer, edited, pages, page of the pages that aren't landed yet; a row for each."""
    told = spark.createDataFrame([tuple(x) for x in layers], "layer string, edited long, pages int").where("pages > 0")
    every = told.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
    return every.join(landed(spark, path).select("layer", "edited", "page").distinct(), ["layer", "edited", "page"], "left_anti")


def pull(spark: SparkSession, layers: list[Layer], fetch: Callable[[str, int], Iterable[dict[str, Any]]], path: str, key: str = "OBJECTID", batch: int = 64) -> int:
    """Lands the missing pages, `batch` of them at a time, each in a task of its own, and returns
    their number. fetch(layer, page): the page's features as properties."""
    todo = missing(spark, layers, path).orderBy("layer", "page").collect()  # names of pages

    def ask(batches):
        for rb in batches:
            for layer, edited, pages, page in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                rows = [(None, None)] + [(None if f.get(key) is None else str(f[key]), json.dumps(f, sort_keys=True)) for f in fetch(layer, page)]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([layer] * n), pa.array([edited] * n, pa.int64()), pa.array([page] * n, pa.int32()), pa.array([pages] * n, pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["layer", "edited", "page", "pages", "feature_id", "props"])

    for k in range(0, len(todo), batch):
        some = todo[k : k + batch]
        asked = spark.createDataFrame([(r["layer"], r["edited"], r["pages"], r["page"]) for r in some], "layer string, edited long, pages int, page int")
        rows = asked.repartitionByRange(len(some), "layer", "page").mapInArrow(ask, SCHEMA)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "edited", "page").parquet(path)
    return len(todo)


def current(spark: SparkSession, path: str) -> DataFrame:
    """layer, edited, feature_id, props: each layer as of its last edit date with all pages, each
    feature once (the one on the last page)."""
    rows = landed(spark, path)
    whole = rows.groupBy("layer", "edited").agg(F.count_distinct("page").alias("n"), F.max("pages").alias("pages")).where("n = pages")
    last = whole.groupBy("layer").agg(F.max("edited").alias("edited"))
    found = rows.where("feature_id is not null").join(F.broadcast(last), ["layer", "edited"])  # a row a layer
    w = Window.partitionBy("layer", "feature_id").orderBy(F.desc("page"), F.desc("props"))
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("layer", "edited", "feature_id", "props")
