import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from lodeframe.sources import readers, sinks
from lodeframe.streaming import jobs


def test_csv(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("HoleID;East;North;Az;Dip;Drill Date;Note\nA-1;100;200;10;-60;31/12/2020;x\nA-2;bad;200;10;-60;;y\nA-3;1;2;400;-60;2020-02-01;z\n")
    good, bad = readers.read_table(spark, str(p), readers.COLLAR_FIELDS, {"azimuth": (0, 360)})
    row = good.first()
    assert (row.hole_id, row.easting, str(row.drill_date), row.Note) == ("A-1", 100.0, "2020-12-31", "x") and good.count() == 1
    assert sorted(tuple(r.reasons) for r in bad.collect()) == [("bad_easting",), ("range_azimuth",)]
    with pytest.raises(ValueError):
        readers.read_table(spark, str(p), readers.LITHOLOGY_FIELDS)


def test_wide_assays(spark):
    df = spark.createDataFrame([("h", 0.0, "<0.02", "5")], "hole_id string, from_depth double, au_ppb string, cu_pct string")
    assert sorted((r.element, r.unit, r.value, r.below) for r in readers.long_assays(df, ["hole_id", "from_depth"]).collect()) == [("au", "ppb", 0.01, True), ("cu", "pct", 5.0, False)]


def test_files(spark, tmp_path):
    (tmp_path / "a.las").write_text("~V\nVERS. 2.0 :\n~W\nWELL. W-1 : WELL\nNULL. -999.25 : NULL\n~C\nDEPT.M : depth\nGR.API : gamma\n~A\n1.0 20\n1.5 -999.25\n")
    las = readers.read_las(spark, str(tmp_path / "a.las")).first()
    assert las.well == "W-1" and las.curves == {"DEPT": [1.0, 1.5], "GR": [20.0, None]}
    (tmp_path / "a.xyz").write_text("/ head\n1 2 10\n  3 4 20\n")
    assert [tuple(r) for r in readers.read_xyz(spark, str(tmp_path / "a.xyz"), ["x", "y", "line"]).collect()] == [(1, 2, 10), (3, 4, 20)]
    (tmp_path / "a.geojson").write_text('{"features": [{"properties": {"name": "n"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}')
    one = readers.read_geojson(spark, str(tmp_path / "a.geojson")).first()
    assert (one.properties["name"], one.geometry_type, one.coordinates) == ("n", "Point", "[1,2]")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.CSV", "a")
    members = readers.unzip(readers.land(spark, str(tmp_path / "*.zip"))).collect()
    assert [(m.name, m.extension, bytes(m.content)) for m in members] == [("in/x.CSV", "csv", b"a")]


def test_paged_service(spark):
    data = [(k, f"f{k}") for k in range(25)]
    spark.dataSource.register(readers.paged_source("lode_pages", "id int, name string", lambda: 25, lambda at, n: data[at : at + n], page=10))
    df = spark.read.format("lode_pages").load()
    assert df.rdd.getNumPartitions() == 3 and sorted(tuple(r) for r in df.collect()) == data


def test_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "s1"), (2, "b", "s2")], "k int, v string, s string")
    new = spark.createDataFrame([(2, "B", "s3"), (3, "c", "s4"), (1, "a", "s1")], "k int, v string, s string")
    assert sorted((r.k, r.v) for r in sinks.upserted(old, new, ["k"]).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert [r.k for r in sinks.inserted_if_new(old, new, ["k"]).collect()] == [3]
    live, history = sinks.with_history(old, new, ["k"], "s", "2024-01-01")
    assert sorted((r.k, r.v) for r in live.collect()) == [(1, "a"), (2, "B"), (3, "c")] and [(r.k, r.v) for r in history.collect()] == [(2, "b")]
    sinks.export_jsonl({"t": old}, str(tmp_path / "x"), "w1")
    assert any(b"manifest" in gzip.open(f).read() for f in (tmp_path / "x").glob("*.gz"))
    assert sorted(tuple(r) for r in sinks.restore_jsonl(spark, str(tmp_path / "x"), "t", "k int, v string, s string").collect()) == sorted(tuple(r) for r in old.collect())
    sinks.replace_scope(old, str(tmp_path / "p"), ["k"])
    sinks.replace_scope(new.where("k = 2"), str(tmp_path / "p"), ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "a"), (2, "B")]
    text = sinks.las_text(spark.createDataFrame([(7, 1.0, 2.0), (7, 0.5, None)], "collar_id int, depth double, value double")).first().las
    assert text.endswith("~A\n0.5000 -999.2500\n1.0000 2.0000\n")


def test_heartbeats(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00"), (2, "2024-01-01 03:00:00")]
    for k, part in enumerate((rows[:2], rows[2:], [(2, "2024-01-01 03:00:01")])):
        spark.createDataFrame(part, "k int, t string").select("k", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.event_stream(spark, str(tmp_path / "in"), "k int, ts timestamp")
        q = jobs.heartbeats(stream, "k", 3_600_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1}
