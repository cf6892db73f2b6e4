import datetime

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import geo, scalars
from lodeframe.operators import feeds, reports, spatial


def test_lists_lose_spaces_alone(spark):
    row = spark.createDataFrame([("1, 21 ,x 3,, 0",)], "t string").select(scalars.delimited(F.col("t")).alias("d"), feeds.items(F.col("t")).alias("i")).first()
    assert row.d == row.i == ["1", "21", "x 3", "0"]


def test_feature_ids(spark):
    cases = [('{"OBJECTID": 5, "OBJECTID_1": 6}', "5"), ('{"OBJECTID": 0, "OBJECTID_1": 6}', "6"), ('{"OBJECTID": " ", "FID": "f"}', "f"), ('{"OBJECTID_1": 0}', "0"), ('{"OBJECTID": 0, "objectid": 9}', "9"), ("{}", None), (None, None), ("broken", None)]
    got = spark.createDataFrame(list(enumerate(c for c, _ in cases)), "k int, p string").select("k", feeds.feature_id(F.col("p")).alias("id"))
    assert [r.id for r in got.orderBy("k").collect()] == [w for _, w in cases]


def test_bad_cells_cost_no_row(spark):
    rows = [("SK-GROUND", '{"OBJECTID": 1, "TOTAL_DH_LENGTH_M": "deep", "DATE_DRILLED": "someday"}'), ("SK-X", '{"OBJECTID": 2, "TOTAL_DH_LENGTH_M": "12.5", "DATE_DRILLED": "-86400000000"}'), ("SK-X", "{}"), ("SK-X", None)]
    df = spark.createDataFrame(rows, "source_id string, props string")
    got = {r.source_feature_id: r for r in feeds.extracted(df, "drillhole_collar", {}, {}, {}).collect()}
    assert set(got) == {"1", "2"} and got["1"].total_length_m is None and got["1"].date_drilled is None
    assert (got["2"].total_length_m, got["2"].date_drilled, got["2"].core_availability) == (12.5, datetime.date(1967, 4, 7), "unknown")
    assert got["1"].checksum != got["2"].checksum
    kinds = {k: feeds.extracted(df, k, {}, {}, {}).where("source_feature_id = '1'").first() for k in feeds.FEEDS}
    assert kinds["assessment_survey"].survey_type == "ground" and kinds["mine"].status == "unknown" and kinds["mine"].commodities == []
    assert all(feeds.extracted(df.limit(0), k, {}, {}, {}).count() == 0 for k in feeds.FEEDS)


def test_hexagons_have_seven_children(spark):
    cells = spark.range(-40, 41).selectExpr("id as q").crossJoin(spark.range(-40, 41).selectExpr("id as r"))
    up = cells.select("q", "r", *[c.alias(n) for n, c in zip("ab", geo.hex_parent(F.col("q"), F.col("r")), strict=True)]).collect()
    by: dict = {}
    for x in up:
        by.setdefault((x.a, x.b), set()).add((x.q, x.r))
    for (a, b), kids in by.items():
        q, r = 2 * a - b, a + 3 * b
        around = {(q, r), (q + 1, r), (q - 1, r), (q, r + 1), (q, r - 1), (q + 1, r - 1), (q - 1, r + 1)}
        assert kids <= around and (kids == around or not all(abs(x) <= 40 and abs(y) <= 40 for x, y in around))


def test_levels_add_up(spark):
    points = spark.range(3000).selectExpr("(id * 7919) % 20011 - 9000.0D as easting", "(id * 104729) % 20011 - 9000.0D as northing", "id % 3 as w").union(spark.createDataFrame([(None, 1.0, 5)], "a double, b double, w long"))
    got = spatial.hex_levels(points, 100.0, 5, {"n": F.count("*"), "w": F.sum("w")}).groupBy("level").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("cells")).orderBy("level").collect()
    assert [(r.n, r.w) for r in got] == [(3000, 3000 - 3000 % 3)] * 5
    assert all(a.cells > b.cells for a, b in zip(got[:-1], got[1:], strict=True))
    for size, levels in ((0.0, 2), (10.0, 0), (10.0, 16)):
        with pytest.raises(ValueError):
            spatial.hex_levels(points, size, levels, {})


def test_windows(spark):
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    rows = [(1, day(1), 5.0), (1, day(1, 23), 1.0), (1, day(2), 2.0), (1, day(4), 9.0), (2, day(2), 0.0), (2, None, 7.0)]
    df = spark.createDataFrame(rows, "g int, ts timestamp, cost double")
    got = {(r.g, r.starts): (r.n, r.n_delta, r.cost_delta) for r in reports.window_deltas(df, "ts", 1, ["g"], {"n": F.count("*"), "cost": F.sum("cost")}).collect()}
    assert got == {(1, "2024-01-01"): (2, 2, 6.0), (1, "2024-01-02"): (1, -1, -4.0), (1, "2024-01-04"): (1, 1, 9.0), (2, "2024-01-02"): (1, 1, 0.0)}
    assert [tuple(r) for r in reports.recent(df, "ts", 60, ["g"], "cost").collect()] == [(1, 1, 9.0)]
    assert [tuple(r) for r in reports.recent(df, "ts", 60 * 24, ["g"], "cost", F.lit(day(2))).collect()] == [(1, 2, 3.0)]
    assert reports.recent(df.limit(0), "ts", 60, ["g"], "cost").collect() == []


def test_thin_bands_join_those_before(spark):
    from lodeframe.operators import ingest

    depth = [0.0, 0.2, 1.0, 2.0, 2.1, 3.0, 4.0, 5.0, 5.1, 9.0]
    value = [10.0, 90.0, 90.0, 10.0, 90.0, 90.0, 10.0, 10.0, 90.0, 90.0]
    logs = spark.createDataFrame([(1, {"DEPT": depth, "GR": value}), (2, {"DEPT": [1.0], "GR": [5.0]}), (3, {"DEPT": [1.0, 1.1, 1.2, 3.0], "GR": [5.0, 90.0, 5.0, 5.0]})], "collar_id int, curves map<string,array<double>>")

    def fold(points):
        bands, out = [], []
        for d, v in points:
            label = "clean" if v < 50 else "shale"
            if bands and bands[-1][2] == label:
                bands[-1][1] = d
            else:
                bands.append([d, d, label])
        for lo, hi, label in bands:
            if out and (hi - lo < 0.5 or out[-1][2] == label):
                out[-1][1] = hi
            else:
                out.append([lo, hi, label])
        return [tuple(b) for b in out]

    got: dict = {}
    for r in ingest.curve_intervals(logs, "GR", [(50.0, "clean")], "shale").orderBy("collar_id", "lo").collect():
        got.setdefault(r.collar_id, []).append((r.lo, r.hi, r.label))
    assert got == {1: fold(zip(depth, value, strict=True)), 2: [(1.0, 1.0, "clean")], 3: fold([(1.0, 5.0), (1.1, 90.0), (1.2, 5.0), (3.0, 5.0)])}


def test_manifest_comes_first(spark, tmp_path):
    import gzip
    import json

    from lodeframe.sources import sinks

    df = spark.range(500).selectExpr("id", "cast(id as string) as t").repartition(4)
    sinks.export_jsonl({"a": df, "b": df}, str(tmp_path / "x"), "it's \"w\"")
    parts = sorted((tmp_path / "x").glob("part-*"))
    lines = [json.loads(x) for p in parts for x in gzip.open(p, "rt")]
    assert lines[0] == {"manifest": {"workspace": "it's \"w\"", "tables": ["a", "b"]}}
    assert len(lines) == 1001 and not any("manifest" in x for x in lines[1:])
    assert sinks.restore_jsonl(spark, str(tmp_path / "x"), "b", "id long, t string").agg({"id": "sum"}).first()[0] == sum(range(500))
