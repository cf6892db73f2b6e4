"""Hand-made frames with values worked out by hand, and properties."""

import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeframe.functions import classify, geo, scalars
from lodeframe.operators import gold, graph, ingest, intervals, quality, reports, retrieval, sampling, spatial, survey, targets, tiles
from lodeframe.plans import spec


def assay(spark, rows):
    return spark.createDataFrame([(1, k, "Au", float(a), float(b), float(b - a), v) for k, (a, b, v) in enumerate(rows)], "collar_id int, sample_id int, element string, from_depth double, to_depth double, interval_length double, value_ppm double")


def test_runs_above_a_cutoff(spark):
    df = assay(spark, [(0, 1, 5.0), (1, 2, 1.0), (2, 3, 7.0), (3, 4, 7.0), (4, 5, None), (5, 6, 2.0), (6, 7, 9.0)])
    got = sorted((r.from_depth, r.to_depth, r.weighted_avg, r.peak_depth, r.sample_count) for r in gold.significant_intersections(df, 5.0).collect())
    assert got == [(0, 1, 5, 0, 1), (2, 4, 7, 2, 2), (6, 7, 9, 6, 1)]


def test_overlaps(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 1.0, 2.0), (1, 3, 1.5, 30.0), (1, 4, 12.0, 13.0), (2, 5, 0.0, 9.0), (1, 6, 5.0, 5.0)], "collar_id int, id int, from_depth double, to_depth double")
    assert sorted((r.id_a, r.id_b, r.overlap_m) for r in intervals.overlaps(df, "id").collect()) == [(2, 3, 0.5), (3, 4, 1.0)]


def test_constant_series_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(gold.pearson("a", "b").alias("r")).first().r is None


def test_union_length(spark):
    df = assay(spark, [(0, 4, 1.0), (1, 2, 1.0), (3, 6, 1.0), (8, 9, 1.0)])
    assert gold.union_length(df).first().covered == 7


def test_vertical_hole(spark):
    df = spark.createDataFrame([(1, 50.0, 10.0, -90.0), (1, 100.0, 200.0, -90.0)], "collar_id int, depth double, azimuth double, dip double").withColumns({"x0": F.lit(5.0), "y0": F.lit(6.0)})
    last = survey.minimum_curvature(df).orderBy(F.desc("depth")).first()
    assert (last.x, last.y, last.z) == pytest.approx((5, 6, -100)) and last.dogleg == pytest.approx(0, abs=1e-5)
    mid = survey.interpolate(survey.minimum_curvature(df), spark.createDataFrame([(1, 75.0), (1, 120.0)], "collar_id int, at double")).orderBy("at").collect()
    assert mid[0].at_z == pytest.approx(-75) and mid[1].at_z is None


def test_cells(spark):
    rows = spark.createDataFrame([("0.42",), ("<0.01",), ("BDL",), ("NS",), ("",), (None,)], "t string").select(scalars.assay_cell(F.col("t")).alias("c")).select("c.*").collect()
    assert [(r.value, r.below, r.unparseable) for r in rows] == [(0.42, False, False), (0.005, True, False), (None, True, False), (None, False, True), (None, False, False), (None, False, False)]


def test_names(spark):
    one = spark.range(1).select(
        scalars.hole_id(F.lit(" pls-22_08 ")).alias("a"), scalars.hole_id(F.lit("--")).alias("b"), scalars.formation_name(F.lit("Manitou  Falls Fm.")).alias("c"),
        scalars.sample_name(F.lit("DH-007-A")).alias("d"), scalars.quality_unit(F.lit(" G/Tonne ")).alias("e"), scalars.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.lit("python.org")).alias("f"),
    ).first()
    assert tuple(one) == ("PLS2208", None, "manitou falls", "dh-7-a", "g/t", "886313e1-3b8a-5372-9b90-0c9aee199e5d")


def test_geometry(spark):
    one = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("m"), geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b"), geo.hex_cell(F.lit(0.0), F.lit(0.0), 5.0).alias("h")).first()
    assert one.m == pytest.approx(math.pi * geo.EARTH_M / 180) and one.b == pytest.approx(90) and one.h == "0:0"


def test_altered_ledger_row(spark):
    df = spark.createDataFrame([(w, k, f"x{k}") for w in "ab" for k in range(4)], "w string, id int, said string")
    sealed = quality.chain(df, "w", ["id"], ["id", "said"])
    assert quality.verify_chain(sealed, "w", ["id"], ["id", "said"]).count() == 0
    altered = sealed.withColumn("said", F.when((F.col("w") == "a") & (F.col("id") == 2), "y").otherwise(F.col("said")))
    assert [(r.w, r.id, r.bad_hash) for r in quality.verify_chain(altered, "w", ["id"], ["id", "said"]).collect()] == [("a", 2, True)]
    resealed = sealed.withColumn("hash", F.when((F.col("w") == "a") & (F.col("id") == 2), "0").otherwise(F.col("hash")))
    assert [(r.id, r.bad_link, r.bad_hash) for r in quality.verify_chain(resealed, "w", ["id"], ["id", "said"]).orderBy("id").collect()] == [(2, False, True), (3, True, False)]
    assert quality.verify_chain(sealed, "w", ["id"], ["id", "said"], F.col("id") >= 2).count() == 0


def test_mmr(spark):
    df = spark.createDataFrame([(1, 1, 1.0, "alpha beta gamma"), (1, 2, 0.9, "alpha beta gamma"), (1, 3, 0.5, "delta epsilon")], "q int, d int, score double, text string")
    assert [r.d for r in retrieval.mmr(df, "q", "d", 2).orderBy("position").collect()] == [1, 3]


def test_fusion_ignores_branch_order(spark):
    a, b = (spark.createDataFrame([(1, k, r) for r, k in enumerate(x, 1)], "q int, d int, rank int") for x in ((1, 2, 3), (3, 1, 4)))
    one, two = (sorted((r.d, round(r.rrf, 9)) for r in retrieval.fuse(x, ["q", "d"]).collect()) for x in ([a, b], [b, a]))
    assert one == two and one[0][1] == round(1 / 61 + 1 / 62, 9)


def test_specification(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (2, "a", 9.0)], "workspace_id int, k string, v double")
    assert spec.run(spec.for_workspace(df, 1), spec.Aggregate("sum", "v")).first().value == 6
    with pytest.raises(ValueError):
        spec.run(df, spec.Aggregate("sum", "v; drop table x"))
    with pytest.raises(ValueError):
        spec.run(df, spec.Aggregate("eval", "v"))


def test_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert sorted(tuple(r) for r in graph.reach(edges, spark.createDataFrame([(1,)], "node long"), 5).collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_sample_is_stable(spark):
    df = spark.range(1000).withColumn("s", (F.col("id") % 3).cast("string"))
    one, two = (sorted(r.id for r in sampling.stratified(x, "s", "id", 30, 5).collect()) for x in (df, df.repartition(7)))
    assert one == two and len(one) == 30


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 8), st.floats(0, 100)), min_size=1, max_size=12))
def test_composites_keep_mass(spark, rows):
    df = assay(spark, [(float(a), float(a + n), float(v)) for a, n, v in rows]).withColumn("unit", F.lit("ppm"))
    made = gold.composites(df, 5.0).collect()
    assert sum(r.sample_count for r in made) == len(rows)
    assert all(r.min_value - 1e-6 <= r.weighted_avg <= r.max_value + 1e-6 for r in made)


def test_labels(spark):
    one = spark.range(1).select(
        classify.authority_rank(F.lit("Technical Report")).alias("a"), classify.authority_rank(F.lit(None).cast("string")).alias("b"),
        classify.uncited(F.lit("It is so [1]. Bare claim. Next. [2] More.")).alias("c"), classify.identifiers(F.lit("hole PLS-22-08 on 74H06, U3O8")).alias("d"),
        classify.ocr_signals(F.lit("aaaaa word"), F.array(F.lit(0.2), F.lit(0.8)), F.lit(4)).alias("e"),
    ).first()
    assert (one.a, one.b) == (1, 3) and one.c == ["Bare claim."] and set(one.d.tokens) == {"PLS-22-08", "74H06", "U3O8"}
    assert (one.e.mean, one.e.median, one.e.low_share, one.e.coverage, one.e.repeated) == (0.5, 0.5, 0.5, 0.5, 0.5)


def test_fuzzy_matches(spark):
    assert classify.indel_ratio("PLS2208", "PLS2280") == pytest.approx(200 * 6 / 14)
    assert classify.token_set_ratio("weathered granite", "granite") == 100
    df = spark.createDataFrame([("PLS2208",), ("zzz",), (None,)], "h string")
    assert sorted(((r.h, r.match) for r in classify.best_match(df, "h", ["PLS2207", "PLS2209"], 80.0).collect()), key=str) == sorted([("PLS2208", "PLS2207"), ("zzz", None), (None, None)], key=str)


def test_curve_bands(spark):
    depth = [0.0, 1.0, 2.0, 2.2, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([(1, {"DEPT": depth, "GR": [10.0, 12.0, 11.0, 90.0, 12.0, 80.0, 85.0]})], "collar_id int, curves map<string, array<double>>")
    got = sorted((r.lo, r.hi, r.label) for r in ingest.curve_intervals(df, "GR", [(50.0, "clean")], "shale").collect())
    assert got == [(0.0, 3.0, "clean"), (4.0, 5.0, "shale")]


def test_replays_change_nothing(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 7)], "bronze_id int, v int")
    assert ingest.deduplicated(df.union(df), "bronze_id", ["v"]).count() == 2
    one, two = (ingest.fingerprints(x).first().survey_hash for x in (spark.createDataFrame(r, "collar_id int, depth int, azimuth int, dip int") for r in ([(1, 2, 3, 4), (1, 5, 6, 7)], [(1, 5, 6, 7), (1, 2, 3, 4)])))
    assert one == two


def test_assay_flags(spark):
    df = spark.createDataFrame([(1, 7, "Pt ", 101.0, "OK", True, True, True, False, False), (1, 8, "au", 5.0, "bad", False, None, True, True, True), (2, 9, "xx", 9e9, None, None, None, None, None, None)], "collar_id int, sample_id int, element string, value_ppm double, qaqc_flag string, crm_pass boolean, blank_pass boolean, duplicate_pass boolean, over_detection boolean, under_detection boolean")
    assert sorted((r.rule_id, r.fail_count) for r in quality.assay_flags(df).collect()) == [("assay.crm_failed", 1), ("assay.detection_paradox", 1), ("assay.qaqc_flag_failed", 1), ("assay.value_implausibly_high", 1)]


def test_grid_and_back(spark):
    df = spark.createDataFrame([(-105.0, 50.0), (-103.2, 58.3), (-107.9, 0.5)], "lon double, lat double")
    e, n = geo.to_utm(F.col("lon"), F.col("lat"), 13)
    rows = df.withColumns({"e": e, "n": n})
    lon, lat = geo.from_utm(F.col("e"), F.col("n"), 13)
    got = rows.withColumns({"x": lon, "y": lat}).collect()
    assert got[0].e == pytest.approx(500_000, abs=1e-3) and got[0].n == pytest.approx(5_538_630.703, abs=2e-3)
    assert all(r.x == pytest.approx(r.lon, abs=2e-8) and r.y == pytest.approx(r.lat, abs=2e-8) for r in got)


def test_sentences_and_groups(spark):
    one = spark.range(1).select(
        scalars.sentence("Hole {h}[ to {d} m][ by {who}].", h=F.lit("A-1"), d=F.lit(12), who=F.lit(None).cast("string")).alias("s"),
        scalars.dominant(F.array(*map(F.lit, ["Cu", "gold", "Au", "cu ", "x"])), {"cu": "base", "gold": "precious", "au": "precious"}).alias("g"),
    ).first()
    assert (one.s, one.g) == ("Hole A-1 to 12 m.", "base")


def test_simplified_lines_stay_near(spark):
    """Ends stay, vertices on a straight stretch go, corners stay."""
    line = [(1, k, float(k * 10), 0.5 * (k % 2)) for k in range(9)] + [(1, 9 + k, 80.0, float((k + 1) * 50)) for k in range(4)] + [(2, 0, 0.0, 0.0), (2, 1, 3.0, 0.0)]
    got = sorted(tiles.simplified(spark.createDataFrame(line, "id int, k int, x double, y double"), "id", "k", "x", "y", 5.0).collect())
    assert [(r.id, r.k) for r in got if r.id == 2] == [(2, 0), (2, 1)]
    kept = {r.k for r in got if r.id == 1}
    assert {0, 8, 12} <= kept and len(kept) < 8
    assert [tiles.tolerance(z) for z in (7, 8, 11, 12)] == [100.0, 25.0, 25.0, 5.0]


def test_a_line_over_three_tiles(spark):
    side = 2 * tiles.HALF / (1 << 10)
    rows = [(1, 0, 0.5 * side, -0.5 * side), (1, 1, 2.5 * side, -0.5 * side), (2, 0, 0.25 * side, -0.25 * side), (2, 1, 0.25 * side, -0.75 * side)]
    got = {(r.id, r.tile_x, r.tile_y): r.metres / side for r in tiles.line_tiles(spark.createDataFrame(rows, "id int, k int, x double, y double"), "id", "k", "x", "y", 10).collect()}
    edge = tiles.BUFFER / tiles.EXTENT
    assert {k: round(v, 6) for k, v in got.items()} == {(1, 512, 512): round(0.5 + edge, 6), (1, 513, 512): round(1 + 2 * edge, 6), (1, 514, 512): round(0.5 + edge, 6), (2, 512, 512): 0.5}


def test_promotion_gate_only_warns_unless_blocking(spark):
    totals, sets = spark.createDataFrame([(3, 9)], "failed int, regressed int"), spark.createDataFrame([("a", 2), ("b", 1), (None, 9)], "name string, regressed int")
    for blocking in (False, True):
        r = reports.gate(totals, sets, 3, 5, {"a": 1, "b": 1}, blocking).first()
        assert (r.reasons, r.would_block, r.blocks) == (["regressed", "set:a"], True, blocking)


def test_ranks_over_ranges(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("id as target_id", "id % 13 as score").repartition(9)
    got = sorted((r["rank"], r.target_id) for r in targets.ranks(df, [3]).collect())
    want = sorted(((k % 13, k) for k in range(5000) if k != 3), key=lambda x: (-x[0], x[1]))
    assert got == [(n + 1, k) for n, (_, k) in enumerate(want)]


def test_ledger_chain_in_order(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 1, "x"), (2, 1, None), (1, 3, "c")], "w int, k int, v string")
    got = {(r.w, r.k): (r.previous_hash, r.hash) for r in quality.chain(df, "w", ["k"], ["k", "v"]).collect()}
    assert got[1, 1][0] is None and got[1, 2][0] == got[1, 1][1] and got[1, 3][0] == got[1, 2][1]
    assert got[2, 1] == (None, hashlib.sha256(b"|1|").hexdigest()) and got[None, 1][0] is None
    assert quality.verify_chain(quality.chain(df, "w", ["k"], ["k", "v"]), "w", ["k"], ["k", "v"]).count() == 0


def test_signed_score_in_any_order(spark):
    """0.1 + 0.2 + 0.3 isn't 0.3 + 0.2 + 0.1 in doubles."""
    rows = [("a", v, 1.0) for v in (0.1, 0.2, 0.3)] + [("b", v, 1.0) for v in (0.3, 0.2, 0.1)]
    got = {r.k: r.score for r in targets.signed_score(spark.createDataFrame(rows, "k string, v double, w double").coalesce(1), "k", "v", "w").collect()}
    assert got["a"] == got["b"] == pytest.approx(0.2)
    assert targets.signed_score(spark.createDataFrame([("c", 0.5, None), ("d", 5.0, -2.0)], "k string, v double, w double"), "k", "v", "w").orderBy("k").collect() == [("c", 0.0), ("d", -1.0)]


def test_near_by_place(spark):
    """Rows of one place are joined as lists: few rows meet, whatever their pairs."""
    n = spatial.LISTED + 5
    a = spark.createDataFrame([(1, "a", 0.0, 0.0), (None, "b", 0.0, 0.0), (3, "c", -59.0, 0.0), (4, "d", None, 0.0), (5, "e", 500.0, float("nan"))], "k int, s string, easting double, northing double")
    b = spark.range(n).selectExpr("id as j", "cast(if(id < 3, 60.5, 0) as double) as easting", "0D as northing")
    found = spatial.near(a, b, 60.0)
    assert found.columns == ["a_k", "a_s", "a_easting", "a_northing", "b_j", "b_easting", "b_northing", "distance"]
    assert sorted(tuple(r) for r in found.groupBy("a_s", "distance").count().collect()) == [("a", 0.0, n - 3), ("b", 0.0, n - 3), ("c", 59.0, n - 3)]
    assert {(r.a_k, r.b_j) for r in found.where("b_j > 4095").collect()} == {(k, j) for k in (1, None, 3) for j in range(4096, n)}
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line or "collect_list" in line]
    assert len(joins) == 3 and spatial.near(b.select("easting", "northing"), a, 60.0).count() == 3 * (n - 3)

