"""Readers of field files. Text comes in as strings and is cast cell by cell, so one bad
cell rejects one row, never the file."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodeframe.functions import scalars

# Canonical field, its type, whether it is required, and headers that mean it.
COLLAR_FIELDS = [
    ("hole_id", "string", True, ["holeid", "hole", "bhid", "dhid", "collarid"]),
    ("easting", "double", True, ["east", "x", "utme"]),
    ("northing", "double", True, ["north", "y", "utmn"]),
    ("elevation", "double", False, ["elev", "z", "rl"]),
    ("total_depth", "double", False, ["totaldepth", "depth", "td", "eoh", "maxdepth"]),
    ("azimuth", "double", False, ["az", "azi"]),
    ("dip", "double", False, ["inclination"]),
    ("drill_date", "date", False, ["drilldate", "date", "startdate"]),
]
SURVEY_FIELDS = [("hole_id", "string", True, ["holeid", "bhid"]), ("depth", "double", True, ["at", "surveydepth"]), ("azimuth", "double", True, ["az"]), ("dip", "double", True, ["inclination"])]
LITHOLOGY_FIELDS = [("hole_id", "string", True, ["holeid", "bhid"]), ("from_depth", "double", True, ["from"]), ("to_depth", "double", True, ["to"]), ("rock_code", "string", True, ["lithology", "lith", "code"])]
ASSAY_FIELDS = [("hole_id", "string", True, ["holeid", "bhid"]), ("sample_id", "string", False, ["sampleid", "sample"]), ("from_depth", "double", True, ["from"]), ("to_depth", "double", True, ["to"])]

GEOCHRONOLOGY_FIELDS = [
    ("sample_id", "string", True, ["sampleid", "sample", "samplename"]),
    ("project_id", "string", False, ["projectid", "project"]),
    ("rock_type", "string", False, ["rocktype", "lithology", "rock", "host"]),
    ("isotopic_system", "string", True, ["isotopicsystem", "system", "methodsystem"]),
    ("mineral_dated", "string", False, ["mineral", "mineraldated", "phase"]),
    ("age_ma", "double", False, ["agema", "age"]),
    ("age_uncertainty_ma", "double", False, ["ageuncertainty", "ageuncma", "uncertaintyma", "errorma", "sigmama", "2sigmama"]),
    ("uncertainty_kind", "string", False, ["uncertaintykind", "sigmakind", "sigma", "errorkind"]),
    ("analytical_method", "string", False, ["analyticalmethod", "method", "technique", "instrument"]),
    ("laboratory", "string", False, ["lab", "labname", "facility"]),
    ("publication_ref", "string", False, ["reference", "doi", "citation", "publication", "reportid"]),
    ("latitude", "double", False, ["lat", "y"]),
    ("longitude", "double", False, ["lon", "long", "x"]),
]
# Isotope systems and kinds of uncertainty, with other spellings.
ISOTOPE_SYSTEMS = {"U-Pb": ["u-pb", "upb", "u/pb"], "Pb-Pb": ["pb-pb", "pbpb"], "Ar-Ar": ["ar-ar", "arar", "ar/ar", "40ar/39ar"], "K-Ar": ["k-ar", "kar"], "Re-Os": ["re-os", "reos"], "Rb-Sr": ["rb-sr", "rbsr"], "Sm-Nd": ["sm-nd", "smnd"], "Lu-Hf": ["lu-hf", "luhf"], "other": ["other"]}
UNCERTAINTIES = {"2sigma": ["2sigma", "2σ", "2s", "2sd"], "1sigma": ["1sigma", "1σ", "1s", "1sd"], "unknown": ["unknown", "?", "n/a"]}


def with_vendor(fields, aliases: dict[str, list[str]]):
    """The fields with a vendor's own headers before the common ones."""
    plain = lambda a: "".join(x for x in a.lower() if x.isalnum())
    return [(name, kind, need, [*map(plain, aliases.get(name, [])), *known]) for name, kind, need, known in fields]


def spelled(text: Column, spellings: dict[str, list[str]]) -> Column:
    """The name that a text spells, whatever the case; null if none."""
    plain = F.lower(F.trim(text))
    return F.coalesce(*[F.when(plain.isin(*ways), F.lit(name)) for name, ways in spellings.items()])


def decimal_commas(raw: DataFrame) -> list[str]:
    """Columns of text whose cells are all whole numbers or numbers with a decimal comma, at
    least one of these, and none with a point. One aggregate over all rows decides."""
    cells = {c: F.trim(F.col(f"`{c}`")) for c, kind in raw.dtypes if kind == "string"}
    if not cells:
        return []
    comma = lambda x: x.rlike(r"^-?\d+,\d+$")
    made = raw.agg(*[(F.coalesce(F.bool_and((x == "") | comma(x) | x.rlike(r"^-?\d+$")) & F.bool_or(comma(x)), F.lit(False))).alias(f"c{k}") for k, x in enumerate(cells.values())]).first()
    return [c for k, c in enumerate(cells) if made[k]]


def with_points(raw: DataFrame) -> DataFrame:
    """raw with points for decimal commas in the columns that write numbers so."""
    return raw.withColumns({c: F.regexp_replace(F.col(f"`{c}`"), ",", ".") for c in decimal_commas(raw)})


def checked_ages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of geochronology with spelled-out names and a point, and rejected ones with the
    first reason."""
    lat, lon = F.col("latitude"), F.col("longitude")
    system, kind = spelled(F.col("isotopic_system"), ISOTOPE_SYSTEMS), spelled(F.col("uncertainty_kind"), UNCERTAINTIES)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (
        F.when(blank(F.col("sample_id")) | blank(F.col("isotopic_system")), "missing_required")
        .when(system.isNull(), "invalid_isotopic_system")
        .when(~blank(F.col("uncertainty_kind")) & kind.isNull(), "invalid_uncertainty_kind")
        .when((F.col("age_ma") < 0) | (F.col("age_uncertainty_ma") < 0), "numeric_cast_failed")
        .when(~lat.between(-90, 90) | ~lon.between(-180, 180), F.when(lat.isNotNull() & lon.isNotNull(), "latlon_out_of_range"))
    )
    made = rows.withColumn("reason", reason)
    point = F.when(lat.isNotNull() & lon.isNotNull(), F.concat(F.lit("POINT("), lon, F.lit(" "), lat, F.lit(")")))
    return made.where("reason is null").drop("reason").withColumns({"isotopic_system": system, "uncertainty_kind": kind, "geom_wkt": point}), made.where("reason is not null")


def canonical_headers(columns: list[str], fields) -> dict[str, str]:
    """Header to canonical field: by name first, then by alias; the first header wins."""
    plain = {c: "".join(x for x in c.lower() if x.isalnum()) for c in columns}
    out: dict[str, str] = {}
    for name, _, _, aliases in fields:
        for want in (name.replace("_", ""), *aliases):
            hit = next((c for c in columns if plain[c] == want and c not in out), None)
            if hit:
                out[hit] = name
                break
    return out


def sniff(sample: str) -> str:
    """The delimiter that splits most lines into the same number of parts."""
    lines = [x for x in sample.splitlines() if x.strip()][:50]
    score = {d: (min((x.count(d) for x in lines), default=0), sum(x.count(d) for x in lines)) for d in (",", ";", "\t", "|")}
    return max(score, key=lambda d: score[d])


def read_table(spark: SparkSession, path: str, fields, ranges: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with canonical, typed columns, and rejected ones with reasons."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(50).collect())
    raw = with_points(spark.read.csv(path, header=True, sep=sniff(head), mode="PERMISSIVE"))
    named = canonical_headers(raw.columns, fields)
    missing = [n for n, _, need, _ in fields if need and n not in named.values()]
    if missing:
        raise ValueError(f"no column for {missing}")
    made, why = raw, []
    for header, name in named.items():
        _, kind, need, _ = next(f for f in fields if f[0] == name)
        text = scalars.blank_to_null(F.col(f"`{header}`"))
        value = scalars.any_date(text) if kind == "date" else text.try_cast(kind)
        made = made.withColumn(f"__{name}", value)
        bad = value.isNull() if need else text.isNotNull() & value.isNull()
        why.append(F.when(bad, F.lit(f"bad_{name}")))
        if ranges and name in ranges:
            why.append(F.when(~value.between(*ranges[name]), F.lit(f"range_{name}")))
    made = made.withColumn("reasons", F.array_compact(F.array(*why)))
    good = made.where("size(reasons) = 0").select(*[F.col(f"__{n}").alias(n) for n in named.values()], *[F.col(f"`{c}`") for c in raw.columns if c not in named])
    return good, made.where("size(reasons) > 0").select(*[F.col(f"`{c}`") for c in raw.columns], "reasons")


def long_assays(wide: DataFrame, keys: list[str]) -> DataFrame:
    """One row per element from columns named element_unit, with parsed cells."""
    cells = [c for c in wide.columns if c not in keys and c.count("_") == 1]
    each = [F.struct(F.lit(c.split("_")[0]).alias("element"), F.lit(c.split("_")[1]).alias("unit"), scalars.assay_cell(F.col(f"`{c}`")).alias("cell")) for c in cells]
    made = wide.select(*keys, F.explode(F.array(*each)).alias("x")).select(*keys, "x.element", scalars.sample_unit(F.col("x.unit")).alias("unit"), "x.cell.*")
    return made.where("value is not null or below or unparseable")


def land(spark: SparkSession, pattern: str) -> DataFrame:
    """Raw files with their hash and size."""
    return spark.read.format("binaryFile").load(pattern).select("path", "modificationTime", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def unzip(files: DataFrame) -> DataFrame:
    """Members of ZIP archives among landed files: archive, name, extension, bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i.filename, z.read(i)) for p, c in zip(f["path"], f["content"], strict=True) for z in [zipfile.ZipFile(io.BytesIO(c))] for i in z.infolist() if not i.is_dir()]
            yield pd.DataFrame(rows, columns=["archive", "name", "content"])

    return files.select("path", "content").mapInPandas(run, "archive string, name string, content binary").withColumn("extension", scalars.extension(F.col("name")))


def read_las(spark: SparkSession, pattern: str) -> DataFrame:
    """LAS 2.0 logs: path, well, null_value, and curves as map of name to array of values;
    null sentinels become null. A file is one row, parsed by expressions alone."""
    text = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("t"))
    part = lambda mark: F.regexp_extract("t", rf"(?s)~{mark}[^\n]*\n(.*?)(?=\n~|$)", 1)
    lines = lambda c: F.filter(F.split(c, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    made = text.select(
        "path",
        F.trim(F.regexp_extract(part("W"), r"(?m)^\s*WELL\s*\.\s*(.*?)\s*:", 1)).alias("well"),
        F.regexp_extract(part("W"), r"(?m)^\s*NULL\s*\.\s*(-?[0-9.]+)", 1).try_cast("double").alias("null_value"),
        F.transform(lines(part("C")), lambda x: F.trim(F.split(x, r"\.")[0])).alias("names"),
        F.transform(lines(F.regexp_extract("t", r"(?s)~A[^\n]*\n(.*)$", 1)), lambda x: F.split(F.trim(x), r"\s+")).alias("rows"),
    )
    column = lambda i: F.transform("rows", lambda r: F.nullif(F.get(r, i).try_cast("double"), F.col("null_value")))
    return made.select("path", "well", "null_value", F.map_from_arrays("names", F.transform(F.sequence(F.lit(0), F.size("names") - 1), column)).alias("curves"))


def read_xyz(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Whitespace-separated points of survey lines; lines that begin with `/` are comments."""
    parts = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '/')").select(F.split(F.trim("value"), r"\s+").alias("p"))
    return parts.select(*[F.get("p", F.lit(k)).try_cast("double").alias(c) for k, c in enumerate(columns)])


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a collection: properties, geometry type, and coordinates as JSON."""
    schema = "features array<struct<properties: map<string,string>, geometry: string>>"
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["features"]).alias("f"))
    return text.select("f.properties", F.get_json_object("f.geometry", "$.type").alias("geometry_type"), F.get_json_object("f.geometry", "$.coordinates").alias("coordinates"))


def paged_source(name: str, schema: str, count: Callable[[], int], fetch: Callable[[int, int], list[tuple]], page: int = 1000) -> type[DataSource]:
    """A data source over a paged service: one partition per page, fetched in its task."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(k) for k in range(0, max(count(), 1), page)]

        def read(self, partition):
            yield from fetch(partition.value, page)

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Paged


def latest_files(files: DataFrame) -> DataFrame:
    """The newest landing of each content."""
    w = Window.partitionBy("sha256").orderBy(F.desc("modificationTime"), "path")
    return files.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
