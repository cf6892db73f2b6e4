"""Mentions in texts, and readers of ages and decimal commas, on hand-made cases."""

from lodeframe.functions import mentions
from lodeframe.operators import ingest
from lodeframe.sources import readers


def test_attitudes_side_and_word():
    said = "joint set 045/72 SE, fault zone 215/30 W there. Foliation: 080° / 35°; from 100/50 m to there, S1 10/95, fold axis 12/20"
    assert [(r[0], r[3], r[4]) for r in mentions.read_attitudes(said)] == [("foliation", 35, 170), ("fold_axis", 20, 102), ("joint", 72, 135), ("fault", 30, 305), ("foliation", 50, 190)]
    assert mentions.read_attitudes("depth 100/50 m") == []
    assert mentions.read_attitudes("α=43° β=128°") == [("other", 43, 128, None, None, "α=43° β=128°")]
    assert [r[4] for r in mentions.read_attitudes("strike 0, dip 10 N; strike 180, dip 10 N")] == [90, 270]


def test_coordinates_bounds_and_datum():
    found = mentions.read_coordinates("NAD 27 Zone 12 N 480500 E 6055000 N" + " " * 300 + "54.6789, -110.4321 and 95.1 10.2")
    assert [(r[0], r[4], r[5], r[8], r[10]) for r in found] == [("utm", None, None, 480500, "NAD27"), ("latlon_decimal", 54.6789, -110.4321, None, None)]
    assert mentions.read_coordinates("12N 480500 6055000") == []
    assert [r[0] for r in mentions.read_coordinates("UTM 12N 480500 6055000; UTM 12N 480500 6055000")] == ["utm"]


def test_keys_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, "strike 10 dip 20"), (None, "strike 30 dip 40"), (3, None), (4, "")], "k long, t string")
    assert sorted((r.k or 0, r.true_dip) for r in mentions.attitudes(rows, ["k"], "t").collect()) == [(0, 40), (1, 20)]
    assert mentions.names(rows.limit(0), ["k"], "t").count() == 0


def test_curves(spark):
    logs = spark.createDataFrame([(1, {"DEPT": [2.0, 1.0, 3.0, None], "GR": [20.0, 10.0, None, 5.0]})], "id int, curves map<string,array<double>>")
    assert [tuple(r) for r in ingest.curve_rows(logs, ["id"]).collect()] == [(1, "GR", [1.0, 2.0], [10.0, 20.0], 2, 1.0, 2.0, 1.0)]


def test_sections(spark):
    made = ingest.sections(spark.createDataFrame([(1, '{"Geology": "a", "Assays": "b"}'), (2, None)], "id int, s string"), ["id"], "s")
    assert sorted(tuple(r) for r in made.collect()) == [(1, "Assays", "b"), (1, "Geology", "a")]


def test_decimal_commas(spark):
    raw = spark.createDataFrame([("1,5", "1.234,5", "a,b", "7"), ("-2", "2", "c", "8"), (None, "3", "d", None)], "a string, b string, c string, d string")
    assert readers.decimal_commas(raw) == ["a"]
    assert [r.a for r in readers.with_points(raw).collect()] == ["1.5", "-2", None]


def test_ages_from_file(spark, tmp_path):
    (tmp_path / "ages.csv").write_text("Sample;System;Age(Ma);Lat;Long\nA1;u/pb;1850,5;54,1;-110,2\nA2;;1;2;3\n")
    fields = readers.with_vendor(readers.GEOCHRONOLOGY_FIELDS, {"age_ma": ["Age(Ma)"]})
    good, bad = readers.read_table(spark, str(tmp_path / "ages.csv"), fields)
    row = readers.checked_ages(good.selectExpr("*", "cast(null as string) as uncertainty_kind", "cast(null as double) as age_uncertainty_ma"))[0].first()
    assert (row.isotopic_system, row.age_ma, row.geom_wkt, bad.count()) == ("U-Pb", 1850.5, "POINT(-110.2 54.1)", 1)
