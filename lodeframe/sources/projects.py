"""Layers of map projects (QGS, or zipped QGZ): the tree of groups flattened to rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = {"path": "string", "groups": "string", "layer_id": "string", "name": "string", "source": "string", "provider": "string", "geometry": "string", "crs": "string", "visible": "boolean", "place": "int", "reason": "string"}


def layers(xml: bytes) -> Iterator[dict]:
    """A row for each layer, in the order of the tree; layers outside the tree come last."""
    root = ElementTree.fromstring(xml)
    known = {x.findtext("id"): x for x in root.iter("maplayer")}
    stack: list[tuple[ElementTree.Element, str, bool]] = [(x, "", True) for x in reversed(root.findall("layer-tree-group"))]
    place = 0

    def row(key, name, groups, shown, tree=None):
        x = known.pop(key, None)
        said = lambda tag, attribute: (x.findtext(tag) if x is not None else None) or (tree.get(attribute) if tree is not None else None)
        return {"groups": groups, "layer_id": key, "name": (x.findtext("layername") if x is not None else None) or name, "source": said("datasource", "source"), "provider": said("provider", "providerKey"), "geometry": x.get("geometry") if x is not None else None, "crs": x.findtext(".//authid") if x is not None else None, "visible": shown, "place": place}

    while stack:
        node, groups, shown = stack.pop()
        seen = shown and node.get("checked", "Qt::Checked") != "Qt::Unchecked"
        if node.tag == "layer-tree-layer":
            yield row(node.get("id"), node.get("name"), groups, seen, node)
            place += 1
        else:
            inner = "/".join(x for x in (groups, node.get("name") or "") if x)
            stack += [(x, inner, seen) for x in reversed(node) if x.tag in ("layer-tree-group", "layer-tree-layer")]
    for key in list(known):
        yield row(key, None, "", False)
        place += 1


def project_xml(path: str, content: bytes) -> bytes:
    if not path.lower().endswith(".qgz"):
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        inside = sorted(n for n in z.namelist() if n.lower().endswith(".qgs"))
        if not inside:
            raise ValueError("no project in the archive")
        return z.read(inside[0])


def read_projects(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Layers of all projects, and the files that hold none: path, reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).where(F.lower("path").rlike(r"\.qg[sz]$")).select("path", "content")
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}

    def run(batches):
        for rb in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                try:
                    rows += [{"path": path} | x for x in layers(project_xml(path, content))]
                except (ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append({"path": path, "reason": str(e)[:200]})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in ROW.items()], list(ROW))

    found = files.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in ROW.items()))
    return found.where("reason is null").drop("reason"), found.where("reason is not null").select("path", "reason")
