import zipfile

import pytest
from pyspark.sql import functions as F

from lodeframe.sources import projects, sinks
from lodeframe.streaming import outbox as ob


def clock():
    at = [1000]

    def now():
        at[0] += 1
        return at[0]

    return at, now


def test_a_killed_batch_is_delivered_once(spark, tmp_path):
    box = spark.createDataFrame([(f"r{k}", 100 - k, f"p{k}") for k in range(11)], "id string, enqueued_at long, payload string")
    log, sink, (at, now), calls = str(tmp_path / "log"), str(tmp_path / "sink"), clock(), []

    def deliver(rows):
        ob.delivered_once(rows.select("id", "payload"), sink)
        calls.append(rows.count())
        if len(calls) == 2:
            raise RuntimeError("killed after the write, before the outcome")
        return rows.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))

    with pytest.raises(RuntimeError):
        ob.dispatch(box, log, deliver, now, limit=4, lease=50, most=3)
    state = lambda: {r.state: r["count"] for r in ob.states(box, ob.read_log(spark, log), at[0], 3).groupBy("state").count().collect()}
    assert state() == {"delivered": 4, "in_flight": 4, "pending": 3}
    first = [r.id for r in spark.read.parquet(sink).where("id in ('r10', 'r9', 'r8', 'r7')").collect()]
    assert len(first) == 4  # the oldest ones
    assert ob.dispatch(box, log, deliver, now, limit=4, lease=50, most=3) == 1  # the others are under a lease
    at[0] += 100
    assert ob.dispatch(box, log, deliver, now, limit=4, lease=50, most=3) == 1
    assert state() == {"delivered": 11} and max(calls) == 4
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == sorted(f"r{k}" for k in range(11))


def test_retries_and_dead_letters(spark, tmp_path):
    box = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, enqueued_at long")
    log, (at, now) = str(tmp_path / "log"), clock()

    def deliver(rows):
        good = (F.col("id") == "a") | ((F.col("id") == "b") & (F.col("attempt") == 2))
        return rows.select("id", good.alias("ok"), F.when(~good, "refused").alias("error"))

    assert ob.dispatch(box, log, deliver, now, limit=10, lease=5, most=3) == 3
    got = {r.id: (r.attempts, r.state) for r in ob.states(box, ob.read_log(spark, log), at[0], 3).collect()}
    assert got == {"a": (1, "delivered"), "b": (2, "delivered"), "c": (3, "dead")}
    assert ob.dispatch(box.limit(0), log, deliver, now) == 0


def test_layer_tree(spark, tmp_path):
    xml = """<qgis><layer-tree-group><layer-tree-layer id="l1" name="Top" source="a.shp" providerKey="ogr"/>
    <layer-tree-group name="Geo" checked="Qt::Unchecked"><layer-tree-group name="Deep"><layer-tree-layer id="l2" name="Two"/></layer-tree-group></layer-tree-group><layer-tree-layer id="l4" name="Four" checked="Qt::Unchecked"/></layer-tree-group>
    <projectlayers><maplayer geometry="Point"><id>l2</id><layername>Second</layername><datasource>b.gpkg|layername=x</datasource><provider>ogr</provider><srs><spatialrefsys><authid>EPSG:26913</authid></spatialrefsys></srs></maplayer><maplayer><id>l3</id><datasource>c.tif</datasource></maplayer></projectlayers></qgis>"""
    (tmp_path / "a.qgs").write_text(xml)
    with zipfile.ZipFile(tmp_path / "b.qgz", "w") as z:
        z.writestr("in/p.qgs", xml)
        z.writestr("in/data.csv", "x")
    with zipfile.ZipFile(tmp_path / "c.qgz", "w") as z:
        z.writestr("data.csv", "x")
    (tmp_path / "d.qgs").write_text("<qgis>")
    (tmp_path / "e.txt").write_text("no project")
    good, bad = projects.read_projects(spark, str(tmp_path / "*"))
    rows = good.orderBy("path", "place").collect()
    assert [r.path[-5:] for r in rows] == ["a.qgs"] * 4 + ["b.qgz"] * 4
    assert [(r.groups, r.layer_id, r.name, r.source, r.visible) for r in rows[:4]] == [("", "l1", "Top", "a.shp", True), ("Geo/Deep", "l2", "Second", "b.gpkg|layername=x", False), ("", "l4", "Four", None, False), ("", "l3", None, "c.tif", False)]
    assert (rows[1].geometry, rows[1].crs, rows[1].provider) == ("Point", "EPSG:26913", "ogr")
    assert sorted(r.path[-5:] for r in bad.collect()) == ["c.qgz", "d.qgs"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(2, "B", None, 5.0), (1, "A, x", 3.0, 50.0)], "collar_id int, hole_id string, easting double, total_depth double")
    rows = sinks.export_rows(df, "collars", {"total_depth_max": 60, "hole_id": None})
    assert rows.columns == sinks.EXPORTS["collars"]
    sinks.export_bundle({"collars": rows.orderBy("hole_id")}, str(tmp_path / "x"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "x" / "collars").glob("*.csv")))
    assert '1,"A, x",3.0,' in text and text.startswith("collar_id,hole_id,easting")
    assert sinks.export_rows(df, "collars", {"total_depth_min": 10}).count() == 1
    sinks.export_csv(rows, str(tmp_path / "y"), ["hole_id"])
    assert spark.read.csv(str(tmp_path / "y"), header=True).count() == 2
