import random

import pytest

from lodeframe.functions.classify import indel_ratio
from lodeframe.operators import fuzzy, survey


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b, 1):
            new.append(row[k - 1] + 1 if x == y else max(new[-1], row[k]))
        row = new
    return row[-1]


def grams(t):
    words = "".join(c if c.isalnum() else " " for c in t.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def texts(seed, n):
    r = random.Random(seed)
    made = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(2, 6))) for _ in range(r.randint(1, 3))) for _ in range(n)]
    for t in made[: n // 2]:
        at = r.randrange(len(t))
        made.append(t[:at] + r.choice("abcde -") + t[at + 1 :])
    return made


def test_ratio():
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in "ab")
        assert indel_ratio(a, b) == pytest.approx(200 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 100)
    assert indel_ratio("", "x") == indel_ratio("x", "") == 0


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_trigram_pairs_lose_none(spark, threshold):
    left, right = texts(1, 60) + ["", "--", "abc"], texts(3, 60) + ["ABC", "", "-abc-"]
    a, b = (spark.createDataFrame([(t,) for t in [*x, None, x[0]]], f"{n} string") for x, n in ((left, "a"), (right, "b")))
    got = sorted((r.a, r.b) for r in fuzzy.trigram_pairs(a, b, "a", "b", threshold).collect())
    want = {(x, y) for x in left for y in right if grams(x) and len(grams(x) & grams(y)) >= threshold * len(grams(x) | grams(y)) - 1e-9}
    assert got == sorted(want)


@pytest.mark.parametrize("threshold", [60.0, 80.0, 95.0])
def test_ratio_pairs_lose_none(spark, threshold):
    left, right = texts(5, 50) + [""], texts(5, 30) + texts(6, 20)
    a, b = (spark.createDataFrame([(t,) for t in [*x, None]], f"{n} string") for x, n in ((left, "a"), (right, "b")))
    pairs = fuzzy.ratio_pairs(a, b, "a", "b", threshold)
    got = {(r.a, r.b): r.score for r in pairs.collect()}
    want = {(x, y): indel_ratio(x, y) for x in left for y in right if x and indel_ratio(x, y) >= threshold - 1e-9}
    assert got == want
    best = {r.a: r.b for r in fuzzy.best_of(pairs, "a", [pairs.score.desc(), pairs.b.asc()]).collect()}
    assert best == {x: min((y for (z, y) in want if z == x), key=lambda y: (-want[x, y], y)) for x in {x for x, _ in want}}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_as_of(spark):
    """Ties, missing states, bins without any, null places, and a state at the very place."""
    r = random.Random(7)
    rows = [(k, h, r.choice([None, *(x / 2 for x in range(0, 400))])) for k, h in enumerate(r.choice("abcd") for _ in range(300))] + [(900, None, 1.0), (901, "d", -3.5)]
    states = [(r.choice("abc"), r.choice([x / 2 for x in range(20, 390)]), r.randrange(360), r.choice([None, -50, -60])) for _ in range(60)]
    states += [("a", 100.0, 5, -1), ("a", 100.0, 5, -2), ("a", None, 1, 1), ("d", 390.0, 9, 9)]
    df = spark.createDataFrame(rows, "id int, hole string, depth double")
    st = spark.createDataFrame(states, "hole string, depth double, azimuth int, dip int")
    for width in (5.0, 1000.0):
        got = {x.id: (x.azimuth, x.dip) for x in survey.as_of(df, st, "hole", "depth", ["azimuth", "dip"], width).collect()}
        key = lambda s: (s[1], s[2], -(10**9) if s[3] is None else s[3])
        want = {}
        for k, h, d in rows:
            before = [s for s in states if d is not None and s[0] == h and s[1] is not None and s[1] <= d]
            want[k] = max(before, key=key)[2:] if before else (None, None)
        assert got == want
    assert survey.as_of(df, st.limit(0), "hole", "depth", ["azimuth"]).where("azimuth is not null").count() == 0
    assert survey.as_of(df.limit(0), st, "hole", "depth", ["azimuth"]).count() == 0


def test_structures_are_completed(spark):
    rows = [(1, 10.0, 40.0, 90.0, None, None), (1, 60.0, 40.0, 90.0, None, None), (1, 70.0, None, 90.0, None, None), (1, 80.0, 40.0, 90.0, 12.0, 34.0), (1, 90.0, 40.0, 90.0, 12.0, None), (2, 5.0, 40.0, 90.0, None, None), (3, None, 40.0, 90.0, None, None)]
    df = spark.createDataFrame(rows, "collar_id int, depth double, alpha double, beta double, true_dip double, true_dip_dir double")
    collars = spark.createDataFrame([(1, 0.0, -60.0), (3, 0.0, -60.0)], "collar_id int, azimuth double, dip double")
    stations = spark.createDataFrame([(1, 50.0, 90.0, -45.0)], "collar_id int, depth double, azimuth double, dip double")
    plain = {(r.collar_id, r.depth): (r.true_dip, r.true_dip_dir) for r in survey.derived(df, collars).collect()}
    with_stations = {(r.collar_id, r.depth): (r.true_dip, r.true_dip_dir) for r in survey.derived(df, collars, stations).collect()}
    assert plain[1, 10.0] == plain[1, 60.0] == plain[3, None] == with_stations[1, 10.0] == with_stations[3, None] != with_stations[1, 60.0]
    assert plain[1, 70.0] == plain[2, 5.0] == (None, None) and plain[1, 80.0] == (12.0, 34.0) and plain[1, 90.0] == plain[1, 10.0]
