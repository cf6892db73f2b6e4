"""Data-quality rules as flags, audit chains, and checks of keys and sets."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodeframe.functions.scalars import ledger_hash

#: Rule, severity, and the condition that breaks it.
COLLAR_RULES: list[tuple[str, str, str]] = [
    ("collar.invalid_dip_range", "ERROR", "dip > 0 or dip < -90"),
    ("collar.invalid_azimuth_range", "ERROR", "azimuth < 0 or azimuth >= 360"),
    ("collar.invalid_total_depth", "ERROR", "total_depth is null or total_depth <= 0"),
    ("collar.missing_elevation", "WARNING", "elevation is null"),
    ("collar.missing_azimuth", "INFO", "azimuth is null"),
    ("collar.missing_dip", "INFO", "dip is null"),
]
#: The same for how a collar was placed.
PLACE_RULES: list[tuple[str, str, str]] = [
    ("collar.crs_assumed", "WARNING", "georef_method = 'assumed'"),
    ("collar.crs_low_confidence", "WARNING", "crs_confidence < 0.5"),
    ("collar.geom_missing_with_coords", "ERROR", "not has_geom and easting is not null and northing is not null"),
    ("collar.spatial_uncertainty_excessive", "WARNING", "uncertainty_m > 100"),
]
# Parts per million that no sample of an element exceeds.
ELEMENT_CEILINGS = {"AU": 100_000, "AG": 100_000, "PT": 100, "PD": 100, "CU": 500_000, "PB": 500_000, "ZN": 500_000, "NI": 200_000, "CO": 100_000, "FE": 1_000_000, "U": 500_000, "U3O8": 500_000, "MO": 100_000, "W": 200_000, "LI": 50_000, "BE": 50_000, "REE": 200_000}
# What an assay's QA/QC flag says when it has passed, and each rule's severity.
QAQC_PASSES = ["pass", "ok", "good", "valid"]
ASSAY_SEVERITIES = {"assay.qaqc_flag_failed": "ERROR", "assay.crm_failed": "ERROR", "assay.blank_failed": "ERROR", "assay.duplicate_failed": "ERROR", "assay.value_implausibly_high": "WARNING", "assay.detection_paradox": "INFO"}


def assay_flags(rows: DataFrame, keep: int = 50) -> DataFrame:
    """One row per hole and rule that some of its assays break: severity, fail_count, their
    elements, and the first `keep` samples. rows: collar_id, sample_id, element, value_ppm,
    qaqc_flag, crm_pass, blank_pass, duplicate_pass, over_detection, under_detection."""
    ceiling = F.element_at(F.create_map(*[x for k, v in ELEMENT_CEILINGS.items() for x in (F.lit(k), F.lit(float(v)))]), F.upper(F.trim("element")))
    broken = [
        F.col("qaqc_flag").isNotNull() & ~F.lower(F.trim("qaqc_flag")).isin(QAQC_PASSES),
        ~F.col("crm_pass"), ~F.col("blank_pass"), ~F.col("duplicate_pass"),
        F.col("value_ppm") > ceiling, F.col("over_detection") & F.col("under_detection"),
    ]
    hit = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule_id"), F.lit(v).alias("severity"))) for c, (r, v) in zip(broken, ASSAY_SEVERITIES.items(), strict=True)]))
    found = rows.select("collar_id", "sample_id", "element", F.explode(hit).alias("x")).select("*", "x.rule_id", "x.severity")
    w = Window.partitionBy("collar_id", "rule_id").orderBy("sample_id", "element")
    listed = F.sort_array(F.collect_list(F.when(F.col("__place") <= keep, F.col("sample_id"))))
    return found.withColumn("__place", F.row_number().over(w)).groupBy("collar_id", "rule_id", "severity").agg(F.count("*").alias("fail_count"), F.sort_array(F.collect_set("element")).alias("elements"), listed.alias("samples"))


def flags(rows: DataFrame, keys: list[str], rules: list[tuple[str, str, str]], version: str = "v1.0") -> DataFrame:
    """One row for each rule that a row breaks; all rules in one pass."""
    hit = [F.when(F.expr(c), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, c in rules]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*hit))).alias("x")).select(*keys, "x.rule_id", "x.severity", F.lit(version).alias("rule_version"))


def mixed_units(rows: DataFrame, unit: Column, keys: list[str]) -> DataFrame:
    """Keys whose rows have more than one unit."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(unit)).alias("units")).where("size(units) > 1")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def exactly_one(cols: list[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)) == 1


def chain(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Rows with the hashes of an append-only ledger, previous_hash and hash: each covers the
    row's fields and, through the hash before it, all earlier rows of its chain. A chain is
    one ordered pass over a sorted partition that holds nothing but the last hash."""
    names = rows.columns

    def seal(batches):
        at, last = None, None
        for rb in batches:
            made = []
            for k, said in zip(rb.column(names.index(key)).to_pylist(), rb.column(len(names)).to_pylist(), strict=True):
                before = last if at == (k,) else None
                at, last = (k,), hashlib.sha256(f"{before or ''}|{said}".encode()).hexdigest()
                made.append((before, last))
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], *(pa.array([m[i] for m in made], pa.string()) for i in (0, 1))], [*names, "previous_hash", "hash"])

    said = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    dealt = rows.withColumn("__said", said).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(seal, StructType([*rows.schema.fields]).add("previous_hash", "string").add("hash", "string"))


def verify_chain(ledger: DataFrame, key: str, order: list[str], fields: list[str], window: Column | None = None) -> DataFrame:
    """Rows whose previous_hash is not the hash before them, or whose hash is not that of
    their content. The predecessor comes from the whole chain; a window only picks rows."""
    w = Window.partitionBy(key).orderBy(*order)
    made = ledger.withColumn("__before", F.lag("hash").over(w))
    bad_link, bad_hash = ~F.col("previous_hash").eqNullSafe(F.col("__before")), ~F.col("hash").eqNullSafe(ledger_hash(F.col("previous_hash"), *map(F.col, fields)))
    made = made.withColumns({"bad_link": bad_link, "bad_hash": bad_hash})
    return (made if window is None else made.where(window)).where("bad_link or bad_hash").select(key, *order, "bad_link", "bad_hash")


def compare(old: DataFrame, new: DataFrame, key: str, checksum: str) -> DataFrame:
    """How each key changed: added, removed, changed or same."""
    a, b = old.select(key, F.col(checksum).alias("__old"), F.lit(1).alias("__a")), new.select(key, F.col(checksum).alias("__new"), F.lit(1).alias("__b"))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def pass_rate(rows: DataFrame, good: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(good).alias("valid"), F.round(F.count_if(good) * 100 / F.nullif(F.count("*"), F.lit(0)), 2).alias("quality_pct"))
