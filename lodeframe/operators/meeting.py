"""Polygons and points that may meet, compared in blocks, so that no pair ever moves.

A polygon has a level: cells of side size * 2**level are as wide as its box or wider, so its
box meets four of them at most. Two boxes meet at the higher of their levels, in the one cell
that holds the lower corner of what they share; so each side is listed at its own level and at
the higher ones of the other side, and every pair is found once, by an equality of cells. What
a task lists in a cell is one row, a block; a pair of blocks is compared in arrays.

Blocks have about HELD bytes of coordinates at most, and steps about WIDE comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD, WIDE, SHOWN = 16 << 20, 1 << 16, 1 << 20
#: Arrow batches of blocks are kept small.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
_CELL = ["level", "cx", "cy"]


def outlines(polygons: DataFrame, key: str, size: float, rings: str = "rings") -> DataFrame:
    """key, level, n (points of each ring), xs, ys of polygons with a ring of three points or
    more. Coordinates that are no finite numbers are null."""
    number = lambda c: f"transform(flatten(r), q -> if(abs(cast(q.{c} as double)) < 1e300, cast(q.{c} as double), null))"
    p = polygons.where(F.col(key).isNotNull()).select(key, F.expr(f"filter({rings}, p -> size(p) >= 3)").alias("r")).where("size(r) > 0")
    p = p.select(key, F.expr("transform(r, p -> size(p))").alias("n"), F.expr(number("x")).alias("xs"), F.expr(number("y")).alias("ys"))
    across = [F.array_max(c) - F.array_min(c) for c in ("xs", "ys")]
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(*across) / F.lit(float(size))))).cast("int")
    return p.where(across[0].isNotNull() & across[1].isNotNull()).select(key, level.alias("level"), "n", "xs", "ys")


def places(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key, level (below all), xs, ys of points with a place."""
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    return points.where((F.abs(px) < 1e300) & (F.abs(py) < 1e300)).select(F.col(key), F.lit(-1).alias("level"), px.alias("xs"), py.alias("ys"))


def levels(shapes: DataFrame) -> list[int]:
    """The levels there are: some tens at most."""
    return sorted(r.level for r in shapes.select("level").distinct().collect())


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, so many as it counts."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _bytes(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """The values between one place and the next, as bytes."""
    offsets = (at * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _listed(table: pa.Table, size: float, higher: list[int], name: int) -> Iterator[list[pa.Array]]:
    """Rows of `blocks`, level by level."""
    columns = [c.combine_chunks() for c in table.columns]
    keys, own = columns[0], _flat(columns[1])
    if len(columns) == 4:
        xs, ys, counts = _flat(columns[2]), _flat(columns[3]), np.ones(len(own), np.int64)
        steps = np.zeros(len(own), np.int32)
    else:
        rings, xs, ys = (_flat(c.flatten()) for c in columns[2:])
        counts = np.diff(_flat(columns[3].offsets)).astype(np.int64)
        steps = np.ones(len(xs), np.int32)
        steps[np.cumsum(rings) - 1] = 1 - rings
    starts = np.cumsum(counts) - counts
    low, high = ([f.reduceat(v, starts) for v in (xs, ys)] for f in (np.fmin, np.fmax))
    for level in sorted({*own[own >= 0].tolist(), *higher}):
        side = size * 2.0**level
        for mine in (True, False):
            who = np.flatnonzero(own == level if mine else (own < level) & (level in higher))
            if not len(who):
                continue
            cells = [(np.floor(lo[who] / side), np.floor(hi[who] / side)) for lo, hi in zip(low, high, strict=True)]
            wide, tall = (np.int64(hi - lo) + 1 for lo, hi in cells)
            each = np.repeat(np.arange(len(who)), wide * tall)
            k = _ragged(np.zeros(len(who), np.int64), wide * tall)
            cx, cy = cells[0][0][each] + k % wide[each], cells[1][0][each] + k // wide[each]
            order = np.lexsort((cy, cx))
            cx, cy, i = cx[order], cy[order], who[each[order]]
            heads = np.flatnonzero(np.concatenate([[True], (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])]))
            at = np.append(heads, len(i))
            c = counts[i]
            where = _ragged(starts[i], c)
            inner = np.concatenate([[0], np.cumsum(c)])[at]
            n = len(heads)
            yield [
                pa.array(np.full(n, level, np.int32)), pa.array((cx[heads] + 0.0).view(np.int64)), pa.array((cy[heads] + 0.0).view(np.int64)), pa.array(np.full(n, mine)), pa.array(np.full(n, name)),
                pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), keys.take(pa.array(i))), _bytes(c.astype(np.int32), at), _bytes(xs[where], inner), _bytes(ys[where], inner), _bytes(steps[where], inner),
            ]


def blocks(shapes: DataFrame, key: str, size: float, higher: list[int], side: str) -> DataFrame:
    """level, cx, cy and, named with the side before them, own (these shapes are of the level,
    not below), id, keys, counts, xs, ys, steps (to the next point of a ring). cx, cy: bits of
    whole doubles, since a join by doubles moves all rows once more."""
    kind = shapes.schema[key].dataType
    fields = [("own", T.BooleanType()), ("id", T.LongType()), ("keys", T.ArrayType(kind)), *((c, T.BinaryType()) for c in ("counts", "xs", "ys", "steps"))]
    made = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType()), *(T.StructField(side + n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held, n = [], 0, TaskContext.get().partitionId() << 32

        def rows():
            for columns in _listed(pa.Table.from_batches(held), size, higher, n):
                yield pa.RecordBatch.from_arrays(columns, names=made.names)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size_held += b.nbytes
            if size_held >= HELD:
                yield from rows()
                held, size_held, n = [], 0, n + 1
        if held:
            yield from rows()

    return shapes.mapInArrow(run, made)


def met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of blocks of one cell. Neither side is broadcast, whatever the estimates say."""
    spark = a.sparkSession
    for name, value in BATCH.items():
        spark.conf.set(name, value)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return a.repartition(parts, *_CELL).hint("merge").join(b.repartition(parts, *_CELL).hint("merge"), _CELL).where("a_own or b_own")


class Shapes:
    """Shapes of one or more blocks: x0, y0, x1, y1 of edges (points: x0, y0), the edges of
    shape k from starts[k] on, and boxes."""

    def __init__(self, parts: list[tuple]):
        self.keys = pa.concat_arrays([p[0] for p in parts])
        self.counts, self.x0, self.y0, steps = (np.concatenate([np.frombuffer(p[k], t) for p in parts]) for k, t in ((1, np.int32), (2, np.float64), (3, np.float64), (4, np.int32)))
        self.counts = self.counts.astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        after = np.arange(len(steps)) + steps
        self.x1, self.y1 = self.x0[after], self.y0[after]
        (self.xl, self.yl), (self.xh, self.yh) = ([f.reduceat(v, self.starts) for v in (self.x0, self.y0)] for f in (np.fmin, np.fmax))
        #: Shapes are compared with those of a width: edges, up to the next power of two.
        self.width = 1 << np.ceil(np.log2(self.counts)).astype(np.int64)

    def edges(self, who: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """x0, y0, x1, y1 by edge and shape; what lacks are edges of no length at a corner."""
        k, n = np.arange(width)[:, None], self.counts[who]
        if n.min() == width:
            at = self.starts[who] + k
            return self.x0[at], self.y0[at], self.x1[at], self.y1[at]
        at = self.starts[who] + np.where(k < n, k, 0)
        x0, y0, x1, y1 = self.x0[at], self.y0[at], self.x1[at], self.y1[at]
        return x0, y0, np.where(k < n, x1, x0), np.where(k < n, y1, y0)


    def level_with(self, k: int, low: float, high: float) -> tuple[np.ndarray, ...]:
        """Edges of one shape that are not all below or above: one column."""
        e = tuple(v[self.starts[k] : self.starts[k] + self.counts[k]] for v in (self.x0, self.y0, self.x1, self.y1))
        near = ~((np.maximum(e[1], e[3]) < low) | (np.minimum(e[1], e[3]) > high))
        return tuple(v[near, None] for v in e)


def _parts(b: pa.RecordBatch, k: int, side: str) -> tuple:
    """Keys and bytes of one block."""
    keys = b.column(side + "keys")
    at = keys.offsets
    return (keys.values.slice(at[k].as_py(), at[k + 1].as_py() - at[k].as_py()), *(b.column(side + c)[k].as_buffer() for c in ("counts", "xs", "ys", "steps")))


def _cell(name: tuple) -> tuple[int, float, float]:
    return name[0], *np.array(name[1:3], np.int64).view(np.float64).tolist()


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, float, float, Shapes, Shapes]]:
    """level, cx, cy, a block of a, and the blocks of b that come with it, up to HELD bytes."""
    now, first, parts, n = None, None, [], 0
    for batch in batches:
        head = [batch.column(c).to_pylist() for c in (*_CELL, "a_id", "a_own", "b_own")]
        for k, name in enumerate(zip(*head, strict=True)):
            if parts and (name != now or n > HELD):
                yield *_cell(now), first, Shapes(parts)
                parts, n = [], 0
            if name != now:
                now, first = name, Shapes([_parts(batch, k, "a_")])
            parts.append(_parts(batch, k, "b_"))
            n += sum(len(p) for p in parts[-1][1:])
    if parts:
        yield *_cell(now), first, Shapes(parts)


def candidates(a: Shapes, b: Shapes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of shapes of a and b whose boxes meet."""
    rows = max(1, SHOWN // len(b.counts))
    for k in range(0, len(a.counts), rows):
        part = np.s_[k : k + rows, None]
        meet = (a.xl[part] <= b.xh) & (b.xl <= a.xh[part])
        meet &= (a.yl[part] <= b.yh) & (b.yl <= a.yh[part])
        i, j = np.nonzero(meet)
        for m in range(0, len(i), SHOWN):
            yield i[m : m + SHOWN] + k, j[m : m + SHOWN]


def _cross(e: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Above 0 where a point lies to the left of an edge, 0 where it is in line with it."""
    return (e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0])


def _within(e: tuple, x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether edges along the axis are crossed an odd number of times to the right of a point,
    and whether it is on one of them. left, right: where it lies to the side of an edge."""
    up = e[3] > e[1]
    odd = np.logical_xor.reduce(((e[1] > y) != (e[3] > y)) & ((left & up) | (right & ~up)), axis)
    line = ~(left | right)
    if not line.any():
        return odd, np.zeros(odd.shape, bool)
    at = np.nonzero(line)
    x0, y0, x1, y1, px, py = (np.broadcast_to(v, line.shape)[at] for v in (*e, x, y))
    line[at] = (np.minimum(x0, x1) <= px) & (px <= np.maximum(x0, x1)) & (np.minimum(y0, y1) <= py) & (py <= np.maximum(y0, y1))
    return odd, line.any(axis)


def _compared(a: tuple, b: tuple) -> tuple[np.ndarray, ...]:
    """Edges of shapes in columns, each of a with its of b: whether edges cross, whether they
    touch; which corners of a are in b, which not on its edges; and of b in a."""
    wide, n = b[0].shape
    crossing, touching = np.zeros(n, bool), np.zeros(n, bool)
    b_odd, b_on = np.zeros((wide, n), bool), np.zeros((wide, n), bool)
    a_in, a_strict = np.zeros(a[0].shape, bool), np.zeros(a[0].shape, bool)
    q = tuple(v[None] for v in b)
    step = max(1, WIDE // max(1, n * wide))
    for k in range(0, len(a[0]), step):
        p = tuple(v[k : k + step, None] for v in a)
        sides = [(_cross(p, q[0], q[1]), _cross(p, q[2], q[3])), (_cross(q, p[0], p[1]), _cross(q, p[2], p[3]))]
        (al, ar, al1, ar1), (bl, br, bl1, br1) = ((s > 0, s < 0, t > 0, t < 0) for s, t in sides)
        odd, on = _within(p, q[0], q[1], al, ar, 0)
        b_odd ^= odd
        b_on |= on
        odd, on = _within(q, p[0], p[1], bl, br, 1)
        a_in[k : k + step], a_strict[k : k + step] = odd | on, odd & ~on
        through = ((al & ar1) | (ar & al1)) & ((bl & br1) | (br & bl1))
        crossing |= through.any((0, 1))
        loose = ~((al & al1) | (ar & ar1) | (bl & bl1) | (br & br1) | through)
        if loose.any():  # a corner in line with an edge
            at = np.nonzero(loose)
            near = np.ones(len(at[0]), bool)
            for m in (0, 1):
                c = [np.broadcast_to(v, loose.shape)[at] for v in (p[m], p[m + 2], q[m], q[m + 2])]
                near &= (np.maximum(c[0], c[1]) >= np.minimum(c[2], c[3])) & (np.maximum(c[2], c[3]) >= np.minimum(c[0], c[1]))
            touching[at[2][near]] = True
    return crossing, touching | crossing, a_in, a_strict, b_odd | b_on, b_odd & ~b_on


def relations(a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """i, j, contains, within of those pairs that intersect."""
    wide = a.width[i] * (1 << 31) + b.width[j]
    for w in np.unique(wide).tolist():
        wa, wb = w >> 31, w & ((1 << 31) - 1)
        at = np.flatnonzero(wide == w)
        step = max(1, WIDE // (wa * wb))
        for k in range(0, len(at), step):
            p, q = i[at[k : k + step]], j[at[k : k + step]]
            if step == 1:
                ea, eb = a.level_with(int(p[0]), b.yl[q[0]], b.yh[q[0]]), b.level_with(int(q[0]), a.yl[p[0]], a.yh[p[0]])
                real_a = real_b = True
            else:
                ea, eb = a.edges(p, wa), b.edges(q, wb)
                real_a, real_b = (np.arange(w)[:, None] < s.counts[m] for s, m, w in ((a, p, wa), (b, q, wb)))
            crossing, touching, a_in, a_strict, b_in, b_strict = _compared(ea, eb)
            n_a, n_b, strict_a, strict_b = ((f & r).sum(0) for f, r in ((a_in, real_a), (b_in, real_b), (a_strict, real_a), (b_strict, real_b)))
            hit = touching | (n_a > 0) | (n_b > 0)
            contains = ~crossing & (n_b == b.counts[q]) & (strict_a == 0)
            inside = ~crossing & (n_a == a.counts[p]) & (strict_b == 0)
            yield p[hit], q[hit], contains[hit], inside[hit]


def polygon_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str, size: float) -> DataFrame:
    """a_key, b_key, contains, within of `outlines` of a and b that intersect."""
    listed = [levels(s) for s in (a, b)]
    made = T.StructType([T.StructField(a_key, a.schema[a_key].dataType), T.StructField(b_key, b.schema[b_key].dataType), T.StructField("contains", T.BooleanType()), T.StructField("within", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for level, cx, cy, p, q in runs(batches):
            side = size * 2.0**level
            for i, j in candidates(p, q):
                here = (np.floor(np.maximum(p.xl[i], q.xl[j]) / side) == cx) & (np.floor(np.maximum(p.yl[i], q.yl[j]) / side) == cy)
                found = list(relations(p, q, i[here], j[here]))
                if found:
                    i, j, contains, within = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([p.keys.take(pa.array(i)), q.keys.take(pa.array(j)), pa.array(contains), pa.array(within)], names=made.names)

    return met(blocks(a, a_key, size, listed[1], "a_"), blocks(b, b_key, size, listed[0], "b_")).mapInArrow(run, made)


def points_in(points: DataFrame, polygons: DataFrame, point_key: str, key: str, size: float) -> DataFrame:
    """point_key, key, on_edge of `places` in `outlines` or on their edges. Points of one place
    in a block are tested once, and a polygon's points come as one list for each block."""
    pk, k = points.schema[point_key].dataType, polygons.schema[key].dataType
    made = T.StructType([T.StructField("pks", T.ArrayType(pk)), T.StructField("k", k), T.StructField("on_edge", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = None, None
        for _, cx, cy, p, q in runs(batches):
            if last is not p:
                last, place = p, Places(p)
            for i, j in candidates(place, q):
                for rows, js, on in place.inside(q, i, j):
                    for part in _portions(place.counts[rows]):
                        n = place.counts[rows[part]]
                        where = place.order[_ragged(place.firsts[rows[part]], n)]
                        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                        new = np.flatnonzero(np.concatenate([[True], (js[part][1:] != js[part][:-1]) | (on[part][1:] != on[part][:-1])]))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(ends[new], ends[-1])), p.keys.take(pa.array(where)))
                        yield pa.RecordBatch.from_arrays([lists, q.keys.take(pa.array(js[part][new])), pa.array(on[part][new])], names=made.names)

    a, b = blocks(points, point_key, size, levels(polygons), "a_"), blocks(polygons, key, size, [], "b_")
    return met(a, b).mapInArrow(run, made).select(F.explode("pks").alias(point_key), F.col("k").alias(key), "on_edge")


def _portions(counts: np.ndarray) -> Iterator[slice]:
    """Slices that add up to about SHOWN, or of one."""
    portion = (np.cumsum(counts) - 1) // SHOWN
    cuts = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), len(counts)]
    return (slice(x, y) for x, y in zip(cuts, cuts[1:], strict=False) if x < y)


class Places:
    """The places of a block's points: xl, yl, xh, yh; the points of place k are counts[k] of
    `order` from firsts[k] on."""

    def __init__(self, points: Shapes):
        self.order = np.lexsort((points.y0, points.x0))
        x, y = points.x0[self.order], points.y0[self.order]
        self.firsts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        self.counts = np.diff(np.append(self.firsts, len(x)))
        self.xl = self.xh = x[self.firsts]
        self.yl = self.yh = y[self.firsts]

    def inside(self, b: Shapes, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places and polygons of pairs with the place inside or on an edge, and which it is,
        those of a polygon next to each other."""
        wide = b.width[j]
        for w in np.unique(wide).tolist():
            at = np.flatnonzero(wide == w)
            rows, found = max(1, WIDE // w), []
            for k in range(0, len(at), rows):
                p, q = i[at[k : k + rows]], j[at[k : k + rows]]
                e = b.edges(q, w)
                x, y = self.xl[p], self.yl[p]
                side = _cross(e, x, y)
                odd, on = _within(e, x, y, side > 0, side < 0, 0)
                hit = odd | on
                found.append((p[hit], q[hit], on[hit]))
            p, q, on = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((on, q))
            yield p[order], q[order], on[order]
