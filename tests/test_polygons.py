import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodeframe.operators import meeting as M
from lodeframe.operators import polygons as P
from lodeframe.operators.tiles import BUFFER, EXTENT, HALF

SCHEMA = "id int, rings array<array<struct<x:double,y:double>>>"
SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def cells_of(spark, rows, size=1.0, margin=0.0):
    found = P.in_cells(P.edges(spark.createDataFrame(rows, SCHEMA), "id"), size)
    return {(r.id, r.cx, r.cy): (r.area, r.edges, r.corners) for r in P.coverage(found, "id", margin).collect()}


def clipped_area(ring, x0, y0, x1, y1):
    """Of a ring cut by a rectangle, side by side."""
    for axis, value, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            dp, dq = sign * (p[axis] - value), sign * (q[axis] - value)
            if dp >= 0:
                out.append(p)
            if dp * dq < 0:
                t = dp / (dp - dq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
        if not ring:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def star(r, cx, cy, radius, n=9, turn=1):
    ps = [(cx + radius * r.uniform(0.3, 1) * math.cos(a), cy + radius * r.uniform(0.3, 1) * math.sin(a)) for a in (turn * 2 * math.pi * k / n for k in range(n))]
    return ps


@pytest.mark.parametrize("margin", [0.0, 0.1])
def test_area_of_each_cell(spark, margin):
    r = random.Random(4)
    rows = []
    for k in range(20):
        x, y = r.uniform(-8, 8), r.uniform(-8, 8)
        outer, hole = star(r, x, y, r.choice([0.4, 3, 7]), turn=r.choice([-1, 1])), star(r, x, y, 0.1, 5, r.choice([-1, 1]))
        rows.append((k, [outer, hole] if k % 2 else [outer]))
    got, want = cells_of(spark, rows, margin=margin), {}
    for k, rings in rows:
        for i in range(-17, 17):
            for j in range(-17, 17):
                box = (i - margin, j - margin, i + 1 + margin, j + 1 + margin)
                area = clipped_area(rings[0], *box) - sum(clipped_area(h, *box) for h in rings[1:])
                if area > 1e-9:
                    want[k, i, j] = area
    assert {c for c, (area, *_) in got.items() if area > 1e-9} == set(want)
    assert all(abs(got[c][0] - a) < 1e-9 for c, a in want.items())
    assert all(abs(area - (1 + 2 * margin) ** 2) < 1e-9 for area, edges, _ in got.values() if not edges)
    if not margin:
        assert sum(c for *_, c in got.values()) == sum(len(p) for _, rings in rows for p in rings)


def test_polygon_over_tile_corners(spark):
    """Edges along the sides of cells: all sixteen cells are covered, whichever have edges."""
    got = cells_of(spark, [(1, [SQUARE]), (2, [SQUARE[::-1], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]])])
    assert {c[1:]: a for c, (a, *_) in got.items() if c[0] == 1 and a > 1e-9} == {(i, j): 1.0 for i in range(4) for j in range(4)}
    assert {c[1:] for c, (a, *_) in got.items() if c[0] == 2 and a > 1e-9} == {(i, j) for i in range(4) for j in range(4) if not (i in (1, 2) and j in (1, 2))}


def test_rings_without_area(spark):
    rows = [(1, None), (2, []), (3, [[(0.0, 0.0), (1.0, 1.0)]]), (4, [[]])]
    assert cells_of(spark, rows) == {}
    assert cells_of(spark, [(5, [[*SQUARE, SQUARE[0]]])]).keys() >= {(5, i, j) for i in range(4) for j in range(4)}


def test_points(spark):
    r = random.Random(9)
    rows = [(1, [SQUARE, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]), (2, [star(r, 2, 2, 5)])]
    points = [(0, 0.0, 0.0), (1, 4.0, 2.0), (2, 1.5, 1.5), (3, 1.0, 1.5), (4, 3.0, 3.0), (5, 5.0, 2.0), (6, None, 1.0), (7, -1.0, 0.0), (8, 0.5, 4.0)] + [(100 + k, r.uniform(-4, 8), r.uniform(-4, 8)) for k in range(200)]
    df = spark.createDataFrame(points, "pid int, x double, y double")
    found = P.points_in(df, spark.createDataFrame(rows, SCHEMA), "pid", "id", 0.7)
    joins = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in joins and "NestedLoop" not in joins
    got = {(x.pid, x.id): x.on_edge for x in found.collect()}
    assert {k: v for (k, i), v in got.items() if i == 1 and k < 100} == {0: True, 1: True, 3: True, 4: False, 8: True}

    def inside(ring, x, y):
        return sum((p[1] > y) != (q[1] > y) and x < p[0] + (y - p[1]) * (q[0] - p[0]) / (q[1] - p[1]) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) % 2

    for k, x, y in points[9:]:
        for i, rings in rows:
            assert ((k, i) in got) == bool(sum(inside(p, x, y) for p in rings) % 2)


def test_pairs(spark):
    shift = lambda ring, dx, dy: [(x + dx, y + dy) for x, y in ring]
    small = [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5)]
    a = [(1, [SQUARE, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]]), (2, [shift(SQUARE, 100, 0)])]
    b = {
        10: shift(small, 0.2, 0.2),  # inside
        11: shift(small, 1.5, 1.5),  # in the hole
        12: shift(small, 3.8, 0.2),  # over the edge
        13: shift(small, 4.0, 0.0),  # touches
        14: shift(small, 4.1, 0.0),  # apart
        15: shift([(x * 20, y * 20) for x, y in small], -3, -3),  # around
        16: [(99.0, -1.0), (102.0, -1.0), (102.0, 5.0), (99.0, 5.0)],  # edges cross, no corner of it inside
        17: shift(small, 0.0, 0.0),  # inside, along the edge
        18: [(0.2, 0.2), (3.8, 0.2), (3.8, 3.8), (0.2, 3.8)],  # around the hole: not whole
    }
    df = spark.createDataFrame([(k, [r]) for k, r in b.items()], "oid int, rings array<array<struct<x:double,y:double>>>")
    got = {(x.id, x.oid): (x.contains, x.within) for x in P.polygon_pairs(spark.createDataFrame(a, SCHEMA), df, "id", "oid", 1.0).collect()}
    no = (False, False)
    assert got == {(1, 10): (True, False), (1, 12): no, (1, 13): no, (1, 15): (False, True), (1, 17): (True, False), (1, 18): no, (2, 16): no}


def test_tiles_and_thinning(spark):
    side = 2 * HALF / (1 << 8)
    ring = [(0.1 * side, 0.1 * side), (1.3 * side, 0.1 * side), (1.3 * side, 0.1 * side + 1), (1.3 * side, 0.9 * side), (0.1 * side, 0.9 * side)]
    rows = spark.createDataFrame([(7, [ring], 1, "s", 2000, "t", 3), (8, [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]], 2, "s", 2000, "t", 3)], SCHEMA + ", project_id int, survey_name string, survey_year int, survey_type string, line_count int")
    assert [len(r[0]) for r in P.thinned(rows, "id", 8).orderBy("id").select("rings").toPandas()["rings"]] == [4, 3]
    got = {(r.tile_x, r.tile_y): r for r in P.polygon_tiles(rows, "seismic", "id", 8, rows.project_id == 1).collect()}
    assert set(got) == {(128, 127), (129, 127)}
    m = BUFFER / EXTENT
    assert abs(got[128, 127].share - (0.9 + m) * 0.8 / (1 + 2 * m) ** 2) < 1e-5  # a corner is a metre off
    assert (got[128, 127].corners, got[129, 127].corners, got[128, 127].survey_year) == (2, 2, 2000)
    counts = defaultdict(int)
    for r in P.polygon_tiles(spark.createDataFrame([(9, [[(-3 * side, -3 * side), (3 * side, -3 * side), (3 * side, 3 * side), (-3 * side, 3 * side)]], 1, "s", 2000, "t", 3)], rows.schema), "seismic", "id", 8).collect():
        counts[r.whole] += 1
    assert counts[True] == 16


def related(a, b):
    """(contains, within) of two lists of rings that intersect, edge by edge."""
    edge = lambda rings: [(*p, *q) for r in rings for p, q in zip(r, r[1:] + r[:1], strict=True)]
    side = lambda e, x, y: (e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0])
    sign = lambda v: (v > 0) - (v < 0)
    ea, eb, cross, touch = edge(a), edge(b), False, False
    for e in ea:
        for f in eb:
            s, t = (sign(side(g, h[0], h[1])) * sign(side(g, h[2], h[3])) for g, h in ((e, f), (f, e)))
            box = all(max(e[k], e[k + 2]) >= min(f[k], f[k + 2]) and max(f[k], f[k + 2]) >= min(e[k], e[k + 2]) for k in (0, 1))
            cross, touch = cross or (s < 0 and t < 0), touch or (s <= 0 and t <= 0 and box)

    def corners(es, fs):
        n = strict = 0
        for x, y, *_ in es:
            odd = sum((f[1] > y) != (f[3] > y) and sign(side(f, x, y)) == sign(f[3] - f[1]) for f in fs) % 2
            on = any(side(f, x, y) == 0 and min(f[0], f[2]) <= x <= max(f[0], f[2]) and min(f[1], f[3]) <= y <= max(f[1], f[3]) for f in fs)
            n, strict = n + (odd or on), strict + (odd and not on)
        return n, strict

    (n_a, strict_a), (n_b, strict_b) = corners(ea, eb), corners(eb, ea)
    return (not cross and n_b == len(eb) and not strict_a, not cross and n_a == len(ea) and not strict_b) if touch or n_a or n_b else None


def mixed(r, n):
    """Polygons of many sizes, some with a hole, some with corners on whole numbers."""
    made = []
    for k in range(n):
        x, y, radius = r.uniform(-30, 30), r.uniform(-30, 30), r.choice([0.2, 1, 6, 40])
        rings = [star(r, x, y, radius, r.choice([3, 5, 9, 17])), star(r, x, y, radius / 5, 5)][: 1 + k % 2]
        made.append([[(round(p), round(q)) if k % 3 == 0 and radius > 5 else (p, q) for p, q in ring] for ring in rings])
    return made


def test_pairs_of_many_sizes(spark):
    r = random.Random(3)
    a, b = mixed(r, 40), mixed(r, 60)
    da = spark.createDataFrame([(k, [[tuple(map(float, p)) for p in ring] for ring in rings]) for k, rings in enumerate(a)], SCHEMA)
    db = spark.createDataFrame([(str(k), [[tuple(map(float, p)) for p in ring] for ring in rings]) for k, rings in enumerate(b)], SCHEMA.replace("id int", "oid string"))
    got = [(x.id, int(x.oid), x.contains, x.within) for x in P.polygon_pairs(da, db, "id", "oid", 0.5).collect()]
    want = [(i, j, *w) for i, p in enumerate(a) for j, q in enumerate(b) if (w := related(p, q))]
    assert sorted(got) == sorted(want) and len(want) > 200


def shapes(polygons):
    c = np.array([sum(map(len, rings)) for rings in polygons], np.int32)
    x, y = np.array([p for rings in polygons for ring in rings for p in ring], float).T
    steps = np.array([s for rings in polygons for ring in rings for s in [1] * (len(ring) - 1) + [1 - len(ring)]], np.int32)
    return M.Shapes([(pa.array(range(len(polygons))), *(v.tobytes() for v in (c, x, y, steps)))])


@pytest.mark.parametrize("wide", [1, 100, 1 << 16])
def test_relations_in_steps(monkeypatch, wide):
    """Polygons of many corners are compared slice by slice."""
    monkeypatch.setattr(M, "WIDE", wide)
    r = random.Random(8)
    a, b = mixed(r, 12), mixed(r, 12)
    i, j = (v.ravel() for v in np.indices((12, 12)))
    got = sorted(zip(*(np.concatenate(c).tolist() for c in zip(*M.relations(shapes(a), shapes(b), i, j), strict=True)), strict=True))
    assert got == [(i, j, *w) for i, p in enumerate(a) for j, q in enumerate(b) if (w := related(p, q))]


def test_pairs_stay_in_place(spark):
    """Both joins move each side once and no pair, and broadcast nothing: what a side becomes
    is larger than its estimate says."""
    rows = spark.createDataFrame([(1, [SQUARE])], SCHEMA)
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 0.5), (None, 9.0, 9.0), (4, float("nan"), 1.0)], "pid int, x double, y double")
    found = P.points_in(points, rows, "pid", "id", 1.0)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, False), (2, 1, False)]
    for df in (found, P.polygon_pairs(rows, rows.withColumnRenamed("id", "oid"), "id", "oid", 1.0)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert "Broadcast" not in plan and plan.count("Exchange ") == 2

