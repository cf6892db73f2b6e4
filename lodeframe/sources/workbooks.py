"""Sheets of workbooks (XLSX) as rows. A task lists a file's sheets; then each sheet is one
task's stream of XML rows, so that no sheet is held whole. Merged cells repeat their first
cell's value. Header rows are joined; a sheet goes to the table whose fields its headers cover.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import scalars
from lodeframe.sources.headers import Ranges
from lodeframe.sources.readers import ASSAY_FIELDS, COLLAR_FIELDS, LITHOLOGY_FIELDS, SURVEY_FIELDS, canonical_headers

SCHEMAS = {"collar": COLLAR_FIELDS, "survey": SURVEY_FIELDS, "lithology": LITHOLOGY_FIELDS, "sample": ASSAY_FIELDS}
# The share of required fields that a sheet's headers must cover, and fields that
# decide alone once half are covered.
LEAST_COVER, ENOUGH = 0.75, 0.5
DECIDES = {"lithology": {"rock_code"}}
MOST_HEADERS = 5
BATCH = 1000
ROWS = "path string, sheet string, row int, cells array<string>"


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def opened(path: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(Ranges(path).file)


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and member of each sheet, in the workbook's order."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if local(x.tag) == "sheet":
            target = links[next(v for k, v in x.attrib.items() if local(k) == "id")]
            found.append((x.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return found


def elements(book: zipfile.ZipFile, member: str, name: str) -> Iterator[ElementTree.Element]:
    """Elements of one name, one at a time."""
    with book.open(member) as source:
        above = []
        for event, x in ElementTree.iterparse(source, ("start", "end")):
            if event == "start":
                above.append(x)
                continue
            above.pop()
            if local(x.tag) == name:
                yield x
                if above:
                    above[-1].remove(x)


def place(reference: str) -> tuple[int, int]:
    """Row and column (from 0) of a reference such as AB12."""
    letters, digits = re.match(r"([A-Z]+)([0-9]+)", reference).groups()
    column = 0
    for c in letters:
        column = 26 * column + ord(c) - 64
    return int(digits) - 1, column - 1


def said(x: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in x.iter() if local(t.tag) == "t")


def sheet_rows(book: zipfile.ZipFile, member: str) -> Iterator[tuple[int, list[str | None]]]:
    """Row number (from 0) and cells of every row that is there."""
    shared = [said(x) for x in elements(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
    spans = sorted(tuple(p for r in x.get("ref").split(":") for p in place(r)) for x in elements(book, member, "mergeCell") if ":" in x.get("ref"))
    open_spans: list[tuple[tuple[int, ...], str | None]] = []
    last = -1
    for r in elements(book, member, "row"):
        at = int(r.get("r", last + 2)) - 1
        last, cells = at, {}
        for c in (x for x in r if local(x.tag) == "c"):
            column = place(c.get("r"))[1] if c.get("r") else max(cells, default=-1) + 1
            value = next((v.text for v in c if local(v.tag) == "v"), None)
            kind = c.get("t")
            cells[column] = shared[int(value)] if kind == "s" and value is not None else said(c) if kind == "inlineStr" else {"1": "true", "0": "false"}.get(value or "") if kind == "b" else None if kind == "e" else value
        while spans and spans[0][0] <= at:
            span = spans.pop(0)
            open_spans.append((span, cells.get(span[1])))
        open_spans = [(s, v) for s, v in open_spans if s[2] >= at]
        for (_, left, _, right), value in open_spans:
            cells |= {k: value for k in range(left, right + 1)}
        yield at, [cells.get(k) for k in range(max(cells, default=-1) + 1)]


def read_sheets(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Rows (path, sheet, row, cells) of all sheets, and rejected files (path, reason)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path")

    def listed(batches):
        for rb in batches:
            rows = []
            for path in rb.column(0).to_pylist():
                try:
                    rows += [(path, name, member, None) for name, member in sheet_parts(opened(path))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration, ValueError) as e:
                    rows.append((path, None, None, f"no workbook: {e}"[:200]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["path", "sheet", "member", "reason"])

    def parsed(batches):
        for rb in batches:
            for path, sheet, member in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                rows = []
                for at, cells in sheet_rows(opened(path), member):
                    rows.append((path, sheet, at, cells))
                    if len(rows) == BATCH:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    def batch(rows):
        kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "sheet", "row", "cells"])

    found = files.repartition("path").mapInArrow(listed, "path string, sheet string, member string, reason string")
    rows = found.where("reason is null").select("path", "sheet", "member").repartition("path", "sheet").mapInArrow(parsed, ROWS)
    return rows, found.where("reason is not null").select("path", "reason")


def number_like(c: Column) -> Column:
    return c.try_cast("double").isNotNull()


def headed(rows: DataFrame) -> DataFrame:
    """path, sheet, first (the row of the first data), headers. Header rows are those above the
    first row with a number, at most MOST_HEADERS, from the first row with two different cells on;
    the parts of a column's header are joined, repeats left out."""
    head = rows.where(F.size(F.array_distinct(F.filter("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))) >= 2)
    numbered = head.withColumn("data", F.exists("cells", lambda c: F.coalesce(number_like(c), F.lit(False))))
    per = numbered.groupBy("path", "sheet").agg(F.min("row").alias("begin"), F.min(F.when(F.col("data"), F.col("row"))).alias("data"))
    first = per.select("path", "sheet", "begin", F.coalesce(F.least("data", F.col("begin") + MOST_HEADERS), F.col("begin") + 1).alias("first"))
    own = head.join(first, ["path", "sheet"]).where("row < first").groupBy("path", "sheet").agg(F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("h"))  # MOST_HEADERS rows at most
    width = F.array_max(F.transform("h", lambda x: F.size(x["cells"])))
    parts = lambda k: F.array_distinct(F.filter(F.transform("h", lambda x: F.trim(F.get(x["cells"], k))), lambda t: t.isNotNull() & (t != "")))
    return own.select("path", "sheet", "first", F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.array_join(parts(k), " ")).alias("headers"))


def sheet_kind(headers: list[str]) -> tuple[str, float, dict[str, str]]:
    """The table a sheet belongs to (or unknown), the share of its required fields that the
    headers cover, and header to field. The best cover counts, then the number of fields."""
    best: tuple[float, int, str, dict[str, str]] = (0.0, 0, "unknown", {})
    for kind, fields in SCHEMAS.items():
        named = canonical_headers(headers, fields)
        need = [n for n, _, required, _ in fields if required]
        cover = sum(n in named.values() for n in need) / len(need)
        enough = ENOUGH if DECIDES.get(kind, set()) & set(named.values()) else LEAST_COVER
        if cover >= enough and (cover, len(named)) > best[:2]:
            best = (cover, len(named), kind, named)
    return best[2], best[0], best[3]


def routed(rows: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """A table for each kind of sheet, with path, sheet, row and the kind's fields as text
    (null if the sheet lacks one); and the sheets that fit none: path, sheet, headers, reason.
    The driver sees nothing but the tables' names."""

    def classified(batches):
        for rb in batches:
            found = [sheet_kind([x for x in h if x]) for h in rb.column(3).to_pylist()]
            kinds = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*rb.columns, *kinds, pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.string()))], [*rb.schema.names, "kind", "cover", "fields"])

    known = headed(rows).mapInArrow(classified, "path string, sheet string, first int, headers array<string>, kind string, cover double, fields map<string,string>")
    placed = rows.join(known.where("kind <> 'unknown'"), ["path", "sheet"]).where("row >= first")
    by_header = F.map_from_arrays("headers", F.transform(F.sequence(F.lit(0), F.size("headers") - 1), lambda k: F.get("cells", k)))
    unique = F.size("headers") == F.size(F.array_distinct("headers"))
    named = placed.withColumn("headers", F.when(unique, F.col("headers")).otherwise(F.transform("headers", lambda h, k: F.when(F.array_position("headers", h) == k + 1, h).otherwise(F.concat(h, F.lit("#"), k)))))
    named = named.withColumn("by", by_header).withColumn("column_of", F.map_from_entries(F.transform(F.map_entries("fields"), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value")))))
    tables = {}
    for kind, fields in SCHEMAS.items():
        cell = lambda n: scalars.blank_to_null(F.element_at("by", F.element_at("column_of", F.lit(n))))
        own = named.where(F.col("kind") == kind).select("path", "sheet", "row", *(cell(n).alias(n) for n, *_ in fields))
        tables[kind] = own.where(F.coalesce(*[F.col(n) for n, *_ in fields]).isNotNull())
    sheets = rows.select("path", "sheet").distinct().join(known, ["path", "sheet"], "left")
    rejected = sheets.where("kind is null or kind = 'unknown'").select("path", "sheet", "headers", F.when(F.col("headers").isNull(), "no headers").otherwise("headers fit no table").alias("reason"))
    return tables, rejected
