"""Polygon areas, overlaps and raster shares against plain clipping of triangles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vigia.operators import geometry

SHAPE = "k long, rings array<array<struct<x:double,y:double>>>"


def area(points):
    return sum((x1 - x2) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True))


def clipped(points, clip):
    """A polygon cut by a convex one, given against the clock's direction."""
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1], strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: E731, B023
        out = []
        for p, q in zip(points, points[1:] + points[:1], strict=True):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                out.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
        points = out
        if not points:
            return []
    return points


def triangles(ring):
    """Signed triangles from the first vertex that add up to the ring, each against the clock's direction."""
    for p, q in zip(ring[1:], ring[2:], strict=False):
        t = [ring[0], p, q]
        a = area(t)
        if abs(a) > 1e-15:
            yield math.copysign(1, a), t if a > 0 else t[::-1]


def common(left, right):
    """Area of two polygons' overlap: rings with signs, triangle by triangle."""
    return sum(s1 * r1 * s2 * r2 * abs(area(c)) for r1, ring1 in left for s1, t1 in triangles(ring1) for r2, ring2 in right for s2, t2 in triangles(ring2) if (c := clipped(t1, t2)))


def star(rng, x, y, size):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randrange(5, 14)))
    ring = [(x + math.cos(a) * r, y + math.sin(a) * r) for a in angles for r in [size * rng.uniform(0.3, 1)]]
    return ring[::-1] if rng.random() < 0.5 else ring


@pytest.fixture(scope="module")
def shapes():
    """Concave stars, some with a square hole; with signs that make them counter-clockwise sums."""
    rng = random.Random(6)
    out = []
    for k in range(40):
        x, y = rng.uniform(-5, 5), rng.uniform(-5, 5)
        if k % 4 == 0:
            outer = [(x - 2, y - 2), (x + 2, y - 2), (x + 2, y + 2), (x - 2, y + 2)]
            hole = [(x - 1, y - 1), (x + 0.5, y - 1), (x + 0.5, y + 1), (x - 1, y + 1)]
            out.append([outer, hole])
        else:
            out.append([star(rng, x, y, rng.uniform(0.5, 3))])
    return out


def signed(rings):
    return [((1 if k == 0 else -1) * math.copysign(1, area(r)), r) for k, r in enumerate(rings)]


def test_areas(spark, shapes):
    got = {r["k"]: r["area"] for r in geometry.polygon_areas(spark.createDataFrame(list(enumerate(shapes)), SHAPE), "k").collect()}
    want = {k: sum(s * area(r) for s, r in signed(x)) for k, x in enumerate(shapes)}
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("cell", [0.4, 2.0, 50.0])
def test_overlaps(spark, shapes, cell):
    left = spark.createDataFrame(list(enumerate(shapes[:20])), SHAPE)
    right = spark.createDataFrame(list(enumerate(shapes[20:])), SHAPE).withColumnRenamed("k", "j")
    got = {(r["k"], r["j"]): r["area"] for r in geometry.overlaps(left, right, "k", "j", cell).collect()}
    want = {(k, j): a for k, x in enumerate(shapes[:20]) for j, y in enumerate(shapes[20:]) if (a := common(signed(x), signed(y))) > 1e-7}
    assert {p: a for p, a in got.items() if a > 1e-7} == pytest.approx(want, rel=1e-6)
    assert len(want) > 50


def test_cell_shares(spark, shapes):
    got = {(r["k"], r["col"], r["row"]): r["share"] for r in geometry.cell_shares(spark.createDataFrame(list(enumerate(shapes)), SHAPE), "k", -9.3, -8.9, 0.7, 0.45).collect()}
    want = {}
    for k, x in enumerate(shapes):
        for c in range(27):
            for r in range(40):
                x0, y0 = -9.3 + 0.7 * c, -8.9 + 0.45 * r
                cell = [(x0, y0), (x0 + 0.7, y0), (x0 + 0.7, y0 + 0.45), (x0, y0 + 0.45)]
                share = common(signed(x), [(1, cell)]) / (0.7 * 0.45)
                if share > 1e-8:
                    want[k, c, r] = share
    assert {p: v for p, v in got.items() if v > 1e-8} == pytest.approx(want, rel=1e-6, abs=1e-8)


def test_odd_polygons(spark):
    box = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    rows = [(1, [box]), (2, None), (3, []), (4, [[(0.0, 0.0), (1.0, 1.0)]]), (5, [box + box[:1]]), (6, [[(0.0, 0.0), (0.0, 5.0), (0.0, 2.0)]]), (7, [box, [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)]]), (None, [box])]
    df = spark.createDataFrame(rows, SHAPE).withColumn("slab", F.lit(1))
    got = {r["k"]: r["area"] for r in geometry.polygon_areas(df, "k").collect()}
    assert got == {1: 1.0, 5: 1.0, 7: 2.0, None: 1.0}
    cells = {(r["col"], r["row"]): r["share"] for r in geometry.cell_shares(df.where("k = 7"), "k").collect()}
    assert cells == {(0, 0): 1.0, (1, 0): 1.0}
    far = spark.createDataFrame([(9, [[(1.0, 0.0), (2.0, 0.0), (2.0, 1.0)]])], SHAPE).withColumnRenamed("k", "j")
    assert {(r["k"], r["area"]) for r in geometry.overlaps(df, far, "k", "j").collect()} == {(7, 0.5)}
    assert geometry.overlaps(df.limit(0), far, "k", "j").count() == 0 and geometry.cell_shares(df.limit(0), "k").count() == 0


def test_km_of_degrees(spark):
    """A box of a degree at latitude 10: the sphere's own area of the zone."""
    ring = [(40.0, 10.0), (41.0, 10.0), (41.0, 11.0), (40.0, 11.0)]
    got = geometry.polygon_areas(geometry.equal_area(spark.createDataFrame([(1, [ring])], SHAPE), "k"), "k").first()["area"]
    want = geometry.RADIUS_KM**2 * math.radians(1) * (math.sin(math.radians(11)) - math.sin(math.radians(10)))
    assert got == pytest.approx(want, rel=1e-9)


def test_point_on_surface(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        steps = sorted(rng.uniform(0, 2 * math.pi) for _ in range(12))
        star = [(math.cos(a) * (r := rng.uniform(0.3, 2)), math.sin(a) * r) for a in steps]
        rows.append((k, [star]))
    rows.append((90, [[(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)], [(1.0, 1.0), (5.5, 1.0), (5.5, 5.0), (1.0, 5.0)]]))
    rows += [(91, []), (92, None), (93, [[(0.0, 0.0), (1.0, 0.0)]]), (94, [[(0.0, 1.0), (2.0, 1.0), (4.0, 1.0)]])]
    df = spark.createDataFrame(rows, SHAPE)
    found = {r["k"]: (r["x"], r["y"]) for r in geometry.point_on_surface(df, "k").collect()}
    assert set(found) == {*range(40), 90}  # no area, no point

    def inside(ring, x, y):
        return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1

    assert all(inside(r[1][0], *found[r[0]]) for r in rows[:40])
    assert found[90] == (0.5, 3.0)  # left of the hole, where the part is wider than on its right
    assert geometry.point_on_surface(df.where("false"), "k").count() == 0
