import struct
import zipfile

import pytest

from lodeframe.sources import headers, readers, workbooks


def segy_bytes(order, traces, samples=50, code=5, lines=None, ascii_text=False, extended=0, revision=0x0100):
    text = "C 1 CLIENT TEST".ljust(80) + "C 2 LINE 7".ljust(80)
    head = text.ljust(3200).encode("ascii" if ascii_text else "cp037")
    binary = bytearray(400)
    for k, v in ((16, 2000), (20, samples), (24, code), (300, revision), (304, extended)):
        struct.pack_into(order + "H", binary, k, v)
    out = head + bytes(binary) + bytes(3200 * extended)
    for k in range(traces):
        trace = bytearray(240)
        if lines:
            struct.pack_into(order + "2i", trace, 188, *lines(k))
        out += bytes(trace) + bytes(samples * headers.SAMPLE_BYTES[code])
    return out


def test_segy(spark, tmp_path):
    (tmp_path / "a.sgy").write_bytes(segy_bytes(">", 40))
    (tmp_path / "b.sgy").write_bytes(segy_bytes("<", 12, code=3, lines=lambda k: (100 + k // 4, 7 + k % 4), ascii_text=True, extended=1))
    (tmp_path / "c.sgy").write_bytes(segy_bytes(">", 3)[:-5])
    (tmp_path / "d.sgy").write_bytes(b"short")
    (tmp_path / "e.sgy").write_bytes(segy_bytes(">", 0, revision=0))
    good, bad = headers.read_segy(spark, str(tmp_path / "*.sgy"))
    got = {r.path[-5:]: r for r in good.collect()}
    a, b, e = (got[n] for n in ("a.sgy", "b.sgy", "e.sgy"))
    assert (a.survey_type, a.byte_order, a.num_traces, a.num_samples_per_trace, a.sample_interval_us, a.record_length_ms, a.segy_revision) == ("2D", "big", 40, 50, 2000, 100.0, "1.0")
    assert a.header_text == "C 1 CLIENT TEST\nC 2 LINE 7" == b.header_text and a.inline_min is None
    assert (b.survey_type, b.byte_order, b.num_traces, b.inline_min, b.inline_max, b.xline_min, b.xline_max) == ("3D", "little", 12, 100, 102, 7, 10)
    assert (e.num_traces, e.segy_revision) == (0, "0.0")
    assert a.bytes_read == b.bytes_read == 3600 + 16 and a.bytes == 3600 + 40 * 440
    assert {r.path[-5:]: r.reason for r in bad.collect()} == {"c.sgy": "1315 bytes are no whole traces of 440", "d.sgy": "cut off at 5 bytes"}


def tiff_bytes(order, wide, tags):
    """A TIFF with one directory and no pixels."""
    body, entries = b"", b""
    start = 16 + (8 if wide else 2) + len(tags) * (20 if wide else 12) + (8 if wide else 4)
    for tag, kind, values in sorted(tags):
        raw = values if kind == 2 else struct.pack(order + headers.TYPES[kind] * len(values), *values)
        inline = 8 if wide else 4
        where = struct.pack(order + ("Q" if wide else "I"), start + len(body)) if len(raw) > inline else raw.ljust(inline, b"\0")
        if len(raw) > inline:
            body += raw
        entries += struct.pack(order + ("HHQ" if wide else "HHI"), tag, kind, len(values)) + where
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if wide else struct.pack(order + "HI", 42, 16).ljust(14, b"\0"))
    return head + struct.pack(order + ("Q" if wide else "H"), len(tags)) + entries + bytes(8 if wide else 4) + body


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("wide", [False, True])
def test_tiff(spark, tmp_path, order, wide):
    tags = [(256, 3, [400]), (257, 4, [300]), (258, 3, [32, 32, 32]), (277, 3, [3]), (339, 3, [3, 3, 3]), (33550, 12, [0.5, 0.25, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 600_000.0, 5_000_000.0, 0.0]), (34735, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32613]), (42113, 2, b"-9999\0")]
    (tmp_path / "a.tif").write_bytes(tiff_bytes(order, wide, tags) + bytes(100_000))
    (tmp_path / "b.tif").write_bytes(tiff_bytes(order, wide, tags[:2]))
    (tmp_path / "c.tif").write_bytes(tiff_bytes(order, wide, [(256, 3, [10]), (257, 3, [20]), (34264, 12, [2.0, 0, 0, 50.0, 0, -3.0, 0, 90.0, *[0] * 8])]))
    (tmp_path / "d.tif").write_bytes(tiff_bytes(order, wide, tags)[:60])
    (tmp_path / "e.tif").write_bytes(tiff_bytes(order, wide, tags[2:4]))
    (tmp_path / "f.asc").write_text("ncols 4\nnrows 3\nxllcenter 0.5\nyllcorner 10\ncellsize 1\nNODATA_value -1\n1 2 3 4\n" * 1)
    (tmp_path / "g.asc").write_text("nothing here\n")
    good, bad = headers.read_rasters(spark, str(tmp_path / "*"))
    got = {r.path[-5:]: r for r in good.collect()}
    a = got["a.tif"]
    assert (a.format, a.width, a.height, a.bands, a.dtype, a.nodata, a.epsg) == ("GeoTIFF", 400, 300, 3, "float32", -9999.0, 32613)
    assert (a.pixel_x, a.pixel_y, a.west, a.south, a.east, a.north) == (0.5, 0.25, 600_000, 5_000_000 - 75, 600_200, 5_000_000)
    assert a.bytes_read < 1000 and a.bytes > 100_000
    assert got["b.tif"].west is None and got["b.tif"].dtype == "uint1"
    assert (got["c.tif"].west, got["c.tif"].north, got["c.tif"].east, got["c.tif"].south) == (50.0, 90.0, 70.0, 30.0)
    f = got["f.asc"]
    assert (f.format, f.west, f.south, f.east, f.north, f.nodata) == ("ASCII Grid", 0.0, 10.0, 4.0, 13.0, -1.0)
    assert {r.path[-5:] for r in bad.collect()} == {"d.tif", "e.tif", "g.asc"}


def workbook(path, sheets, shared):
    """sheets: name to (rows of (row number, cells), merged). A cell: reference, type, value."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for k, (rows, merged) in enumerate(sheets.values(), 1):
            cell = lambda r, t, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>' if t == "inlineStr" else f'<c r="{r}"' + (f' t="{t}"' if t else "") + f"><v>{v}</v></c>"
            body = "".join(f'<row r="{n}">' + "".join(cell(*c) for c in cells) + "</row>" for n, cells in rows)
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData><mergeCells>" + "".join(f'<mergeCell ref="{m}"/>' for m in merged) + "</mergeCells></worksheet>")


def test_workbook_of_four_tables(spark, tmp_path):
    shared = ["Hole ID", "East", "North", "H-1", "From", "To"]
    text = lambda r, v: (r, "inlineStr", v)
    sheets = {
        "Collars": ([(1, [text("A1", "Drilling 2020")]), (3, [("A3", "s", 0), ("B3", "s", 1), ("C3", "s", 2), text("E3", "Dip")]), (4, [("A4", "s", 3), ("B4", None, "100.5"), ("C4", None, "7"), ("E4", None, "-60")]), (6, [text("A6", "H-2"), ("B6", None, "1"), ("C6", None, "2")])], ["A1:E1"]),
        "Surveys": ([(1, [("A1", "s", 0), text("B1", "Depth"), text("C1", "Az"), text("D1", "Dip")]), (2, [("A2", "s", 3), ("B2", None, "0"), ("C2", None, "90"), ("D2", None, "-60")]), (3, [("B3", None, "30"), ("C3", None, "91"), ("D3", None, "-61")])], ["A2:A3"]),
        "Logs": ([(1, [text("A1", "hole"), text("B1", "interval"), text("D1", "lith")]), (2, [text("A2", "id"), ("B2", "s", 4), ("C2", "s", 5), text("D2", "code")]), (3, [("A3", "s", 3), ("B3", None, "0"), ("C3", None, "2"), text("D3", "GRN")])], ["B1:C1"]),
        "Assays": ([(1, [("A1", "s", 0), text("B1", "Sample"), ("C1", "s", 4), ("D1", "s", 5), text("E1", "Au_ppm")]), (2, [("A2", "s", 3), text("B2", "S1"), ("C2", None, "0"), ("D2", None, "1"), ("E2", None, "0.5")])], []),
        "Notes": ([(1, [text("A1", "who"), text("B1", "what")]), (2, [text("A2", "x"), text("B2", "y")])], []),
        "Empty": ([], []),
    }
    workbook(tmp_path / "a.xlsx", sheets, shared)
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    rows, broken = workbooks.read_sheets(spark, str(tmp_path / "*.xlsx"))
    assert [r.path[-6:] for r in broken.collect()] == ["b.xlsx"]
    tables, rejected = workbooks.routed(rows)
    assert {(r.hole_id, r.easting, r.northing, r.dip) for r in tables["collar"].collect()} == {("H-1", "100.5", "7", "-60"), ("H-2", "1", "2", None)}
    assert {(r.hole_id, r.depth, r.azimuth) for r in tables["survey"].collect()} == {("H-1", "0", "90"), ("H-1", "30", "91")}
    assert [r.hole_id for r in tables["sample"].collect()] == ["H-1"]
    heads = {r.sheet: r.headers for r in workbooks.headed(rows).collect()}
    assert heads["Logs"] == ["hole id", "interval From", "interval To", "lith code"] and heads["Collars"] == ["Hole ID", "East", "North", "", "Dip"]
    assert {r.sheet: r.reason for r in rejected.collect()} == {"Notes": "headers fit no table", "Logs": "headers fit no table"}


def test_sheet_kinds():
    assert workbooks.sheet_kind(["HoleID", "From", "To", "Lith"])[:2] == ("lithology", 1.0)
    assert workbooks.sheet_kind(["HoleID", "From", "To"])[0] == "sample"
    assert workbooks.sheet_kind(["Lith", "From"])[0] == "lithology"
    assert workbooks.sheet_kind(["a", "b"]) == ("unknown", 0.0, {}) == workbooks.sheet_kind([])
    assert workbooks.place("A1") == (0, 0) and workbooks.place("AB12") == (11, 27)


def test_decimal_commas_look_at_every_row(spark):
    rows = [("1,5", "1,5")] * 300 + [("2,25", "3.5")]
    df = spark.createDataFrame(rows, "a string, b string").repartition(3)
    assert readers.decimal_commas(df) == ["a"]
