"""Headers of large binary files, read by byte ranges: a task opens a file and reads only what
says how the rest is laid out. A file that can't be read so is a rejected row with its reason.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Ranges:
    """A file read in ranges, which counts the bytes."""

    def __init__(self, path: str):
        # Spark writes file:/a, other schemes as usual
        where, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path if ":/" in path else f"file://{path}"))
        self.file = where.open_input_file(name)
        self.size, self.read = self.file.size(), 0

    def at(self, offset: int, count: int) -> bytes:
        if offset < 0 or offset + count > self.size:
            raise ValueError(f"cut off at {self.size} bytes")
        self.read += count
        return self.file.read_at(count, offset)


def read_headers(spark: SparkSession, pattern: str, fields: str, parse: Callable[[Ranges], dict[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """path, bytes, bytes_read and the fields (a schema as text) of files that `parse` can read;
    and path, bytes, reason of the others. Only names are listed first: no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path", F.col("length").alias("bytes"))
    schema = StructType.fromDDL(f"path string, bytes long, bytes_read long, {fields}, reason string")
    names = schema.names

    def run(batches):
        for rb in batches:
            rows = []
            for path, size in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                row: dict[str, Any] = {"path": path, "bytes": size}
                try:
                    source = Ranges(path)
                    row |= parse(source) | {"bytes_read": source.read}
                except (ValueError, OSError, struct.error, UnicodeDecodeError) as e:
                    row["reason"] = str(e)[:200] or type(e).__name__
                rows.append({n: row.get(n) for n in names})
            yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))

    found = files.repartition("path").mapInArrow(run, schema)
    return found.where("reason is null").drop("reason"), found.where("reason is not null").select("path", "bytes", "reason")


# Fixed values of SEG-Y: bytes of a sample by format code, sizes of its headers.
SAMPLE_BYTES = {1: 4, 2: 4, 3: 2, 4: 4, 5: 4, 6: 8, 7: 3, 8: 1, 9: 8, 10: 4, 11: 2, 12: 8, 15: 3, 16: 1}
TEXT, BINARY, TRACE = 3200, 400, 240
SEGY_FIELDS = "survey_type string, byte_order string, num_traces long, num_samples_per_trace int, sample_interval_us int, record_length_ms double, inline_min int, inline_max int, xline_min int, xline_max int, segy_revision string, header_text string"


def segy(source: Ranges) -> dict[str, Any]:
    """What the text header, the binary header and the first and last trace headers say. The
    number of traces follows from the file's size. A survey is 3D if both of its trace headers
    have an inline and a crossline, and either differs; the ranges are those of the two."""
    head = source.at(0, TEXT + BINARY)
    # a code that is known in one order isn't in the other
    order = next((o for o in "><" if struct.unpack_from(o + "h", head, TEXT + 24)[0] in SAMPLE_BYTES), None)
    if order is None:
        raise ValueError("no known sample format")
    word = lambda k: struct.unpack_from(order + "H", head, TEXT + k)[0]
    interval, samples, code, revision = word(16), word(20), word(24), word(300)
    start = TEXT + BINARY + TEXT * max(0, struct.unpack_from(order + "h", head, TEXT + 304)[0] if revision else 0)
    size = TRACE + samples * SAMPLE_BYTES[code]
    traces, rest = divmod(source.size - start, size)
    if rest or not samples:
        raise ValueError(f"{source.size - start} bytes are no whole traces of {size}")
    lines = [struct.unpack(order + "2i", source.at(start + k * size + 188, 8)) for k in ([0, traces - 1] if traces else [])]
    solid = len(lines) == 2 and all(i and x for i, x in lines) and lines[0] != lines[1]
    ranges = {f"{n}_{w}": f(x[k] for x in lines) if solid else None for k, n in enumerate(("inline", "xline")) for w, f in (("min", min), ("max", max))}
    text = head[:TEXT]
    # EBCDIC, unless it begins with the C of ASCII
    text = text.decode("ascii", "replace") if text[:1] == b"C" else text.decode("cp037")
    return ranges | {
        "survey_type": "3D" if solid else "2D", "byte_order": "big" if order == ">" else "little", "num_traces": traces, "num_samples_per_trace": samples, "sample_interval_us": interval,
        "record_length_ms": samples * interval / 1000, "segy_revision": f"{revision >> 8}.{revision & 255}", "header_text": "\n".join(text[k : k + 80].rstrip() for k in range(0, TEXT, 80)).rstrip(),
    }


# Fixed values of TIFF: bytes and struct letters by field type, and the tags read here.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "2I", 6: "b", 8: "h", 9: "i", 10: "2i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
TAGS = {256: "width", 257: "height", 258: "bits", 277: "bands", 339: "kind", 33550: "scale", 33922: "tie", 34264: "matrix", 34735: "keys", 42113: "nodata"}
KINDS = {1: "uint", 2: "int", 3: "float"}
RASTER_FIELDS = "format string, width int, height int, bands int, dtype string, nodata double, epsg int, pixel_x double, pixel_y double, west double, south double, east double, north double"


def tiff_tags(source: Ranges) -> dict[str, Any]:
    """Values of the first directory's tags, in either byte order, 32- or 64-bit offsets."""
    head = source.at(0, min(16, source.size))
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(order + "H", head, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("no TIFF header")
    wide = version == 43
    offset = struct.unpack_from(order + ("Q" if wide else "I"), head, 8 if wide else 4)[0]
    count = struct.unpack(order + ("Q" if wide else "H"), source.at(offset, 8 if wide else 2))[0]
    entry, inline = (20, 8) if wide else (12, 4)
    if count > 4096:
        raise ValueError(f"a directory of {count} tags")
    table = source.at(offset + (8 if wide else 2), count * entry)
    found: dict[str, Any] = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + ("HHQ" if wide else "HHI"), table, k * entry)
        if tag in TAGS and kind in TYPES:
            form = TYPES[kind]
            size = struct.calcsize(order + form) * n
            if size > 1 << 16:
                raise ValueError(f"tag {tag} has {size} bytes")
            at = k * entry + entry - inline
            raw = table[at : at + size] if size <= inline else source.at(struct.unpack_from(order + ("Q" if wide else "I"), table, at)[0], size)
            found[TAGS[tag]] = raw.rstrip(b"\0").decode("ascii", "replace") if kind == 2 else struct.unpack(order + form * n, raw)
    return found


def geotiff(source: Ranges) -> dict[str, Any]:
    """Size, pixels and place of the first image."""
    t = tiff_tags(source)
    if "width" not in t or "height" not in t:
        raise ValueError("no image size")
    width, height = t["width"][0], t["height"][0]
    out: dict[str, Any] = {"format": "GeoTIFF", "width": width, "height": height, "bands": t.get("bands", (1,))[0], "dtype": KINDS.get(t.get("kind", (1,))[0], "uint") + str(t.get("bits", (1,))[0])}
    if str(t.get("nodata", "")).strip():
        out["nodata"] = float(t["nodata"])
    keys = t.get("keys", ())
    named = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    out["epsg"] = next((named[k] for k in (3072, 2048) if 0 < named.get(k, 0) < 32767), None)  # projected, geographic
    if "scale" in t and "tie" in t:
        dx, dy = t["scale"][:2]
        x, y = t["tie"][3] - t["tie"][0] * dx, t["tie"][4] + t["tie"][1] * dy
    elif "matrix" in t:
        dx, x, dy, y = t["matrix"][0], t["matrix"][3], -t["matrix"][5], t["matrix"][7]
    else:
        return out
    return out | {"pixel_x": dx, "pixel_y": dy, "west": x, "north": y, "east": x + width * dx, "south": y - height * dy}


def ascii_grid(source: Ranges) -> dict[str, Any]:
    """The header lines of a text grid; corners may be those of the lower left cell's centre."""
    text = source.at(0, min(4096, source.size)).decode("ascii")
    named = {k.lower(): float(v) for k, v in re.findall(r"^\s*([A-Za-z]\w+)\s+(\S+)\s*$", text, re.M)}
    width, height, size = int(named.get("ncols", 0)), int(named.get("nrows", 0)), named.get("cellsize", 0.0)
    if not (width > 0 and height > 0 and size > 0):
        raise ValueError("no grid size")
    west, south = (named[f"{c}llcorner"] if f"{c}llcorner" in named else named.get(f"{c}llcenter", 0.0) - size / 2 for c in "xy")
    return {"format": "ASCII Grid", "width": width, "height": height, "bands": 1, "dtype": "float32", "nodata": named.get("nodata_value"), "pixel_x": size, "pixel_y": size, "west": west, "south": south, "east": west + width * size, "north": south + height * size}


def raster(source: Ranges) -> dict[str, Any]:
    return geotiff(source) if source.at(0, min(2, source.size)) in (b"II", b"MM") else ascii_grid(source)


def read_segy(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    return read_headers(spark, pattern, SEGY_FIELDS, segy)


def read_rasters(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    return read_headers(spark, pattern, RASTER_FIELDS, raster)
