"""Points of polygons against cases by hand and a walk over each polygon."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from loadweave.operators import polygons

SCHEMA = "code int, ring int, n int, x double, y double"


def table(spark, shapes):
    rows = [(code, r, n, x, y) for code, rings in shapes.items() for r, ring in enumerate(rings) for n, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, SCHEMA)


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and ax + (y - ay) * (bx - ax) / (by - ay) > x:
                odd = not odd
    return odd


def test_points_of_known_shapes(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (3.0, 3.0)]
    bent = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (9.0, 10.0), (9.0, 1.0), (0.0, 1.0)]
    shapes = {1: [square], 2: [square, hole], 3: [bent], 4: [[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]], 5: [[(1.0, 2.0), (3.0, 4.0)]], 6: [square, [(9.0, 9.0)]], 7: [square[::-1]]}
    got = {r["code"]: r[1:] for r in polygons.polygon_points(table(spark, shapes)).collect()}
    assert got[1] == (2.0, 2.0, polygons.CENTROID) == got[6] == got[7]
    assert got[2] == (0.5, 2.0, polygons.INSIDE)  # in the hole: the first of the two stretches beside it
    assert got[3][2] == polygons.INSIDE and inside(*got[3][:2], [bent]) and got[3][0] == 9.5
    assert got[4] == (1.0, 1.0, polygons.MEAN) and got[5] == (2.0, 3.0, polygons.MEAN)
    odd = spark.createDataFrame([(1, 0, 0, None, 1.0), (2, 0, 0, 0.0, 0.0), (2, 0, 1, 3.0, 0.0), (2, 0, 2, None, None), (2, 0, 3, 0.0, 3.0)], SCHEMA)
    assert {r["code"]: r[1:] for r in polygons.polygon_points(odd).collect()} == {1: (None, None, polygons.MEAN), 2: (1.0, 1.0, polygons.CENTROID)}
    assert polygons.polygon_points(odd.limit(0)).count() == 0


def test_points_of_random_polygons_lie_inside(spark):
    rng = random.Random(3)
    shapes = {c: [[(float(rng.randint(0, 50)), float(rng.randint(0, 50))) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 2))] for c in range(300)}
    got = polygons.polygon_points(table(spark, shapes)).collect()
    assert len(got) == 300 and {r["how"] for r in got} >= {polygons.CENTROID, polygons.INSIDE}
    for r in got:
        rings = shapes[r["code"]]
        area, mx, my = 0.0, 0.0, 0.0
        for ring in rings:
            parts = [(ax * by - bx * ay, ax + bx, ay + by) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)]
            own = sum(p[0] for p in parts) / 2
            if own:
                area, mx, my = area + own, mx + sum(p[0] * p[1] for p in parts) / 6, my + sum(p[0] * p[2] for p in parts) / 6
        assert (r["how"] == polygons.MEAN) == (area == 0)
        if area:
            held = inside(mx / area, my / area, rings)
            assert (r["how"] == polygons.CENTROID) == held
            if held:
                assert (r["x"], r["y"]) == pytest.approx((mx / area, my / area))
            elif r["how"] == polygons.INSIDE:
                assert inside(r["x"], r["y"], rings)


def clipped(one, two):
    """Area that two convex polygons (counterclockwise) share."""
    for (ax, ay), (bx, by) in zip(two, two[1:] + two[:1], strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in one]
        out = []
        for i, (p, s) in enumerate(zip(one, side, strict=True)):
            before, t = one[i - 1], side[i - 1]
            if (s >= 0) != (t >= 0):
                out.append(tuple(b + (a - b) * t / (t - s) for a, b in zip(p, before, strict=True)))
            if s >= 0:
                out.append(p)
        one = out
        if not one:
            return 0.0
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(one, one[1:] + one[:1], strict=True))) / 2


def test_overlaps_of_slanted_shapes(spark):
    rng = random.Random(8)

    def triangle():
        a, b, c = ((rng.uniform(0, 60), rng.uniform(-20, 20)) for _ in range(3))
        return [a, b, c] if (b[0] - a[0]) * (c[1] - a[1]) > (b[1] - a[1]) * (c[0] - a[0]) else [a, c, b]

    one, two = ({c: [triangle()] for c in range(25)} for _ in range(2))
    turned = {c: [ring[::-1] if c % 2 else ring for ring in rings] for c, rings in two.items()}
    got = {(r["code"], r["other"]): r["area"] for r in polygons.overlaps(table(spark, one), table(spark, turned), 7.0).collect()}
    for a, (p,) in one.items():
        for b, (q,) in two.items():
            assert got.get((a, b), 0.0) == pytest.approx(clipped(p, q), abs=1e-8)
    square, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (3.0, 3.0)]
    held = table(spark, {1: [square, hole], 2: [square]})
    right = table(spark, {7: [[(0.0, 0.0), (2.0, 0.0), (2.0, 4.0), (0.0, 4.0)]], 8: [[(2.0, 0.0), (9.0, 0.0), (9.0, 4.0), (2.0, 4.0)]], 9: [[(4.0, 0.0), (5.0, 0.0), (5.0, 4.0)]]})
    assert {tuple(r) for r in polygons.overlaps(held, right, 3.0).collect()} == {(1, 7, 6.0), (1, 8, 6.0), (2, 7, 8.0), (2, 8, 8.0)}
    assert {tuple(r) for r in polygons.overlay_weights(held, right, 3.0).collect()} == {(1, 7, 0.5), (1, 8, 0.5), (2, 7, 0.5), (2, 8, 0.5)}
    assert polygons.overlay_weights(held.limit(0), right, 3.0).count() == 0


def test_weights_below_a_crowd(spark):
    rng = random.Random(11)

    def shape(k, wide):
        x, y = rng.uniform(-30, 30), rng.uniform(-30, 30)
        ring = [(x, y), (x + rng.uniform(1, wide), y + rng.uniform(0, 3)), (x + rng.uniform(0, wide), y + rng.uniform(4, wide))]
        return [ring[::-1] if k % 2 else ring]

    one, two = table(spark, {k: shape(k, 25) for k in range(40)}), table(spark, {k: shape(k, 40) for k in range(400)})
    areas = {}
    for r in polygons.overlaps(one, two, 10.0).collect():
        areas.setdefault(r["code"], {})[r["other"]] = r["area"]
    want, told = {}, 0
    for least in (0.01, 0.3):
        want = {}
        for code, held in areas.items():
            kept = {o: a for o, a in held.items() if a >= least * sum(held.values())}
            want |= {(code, o): a / sum(kept.values()) for o, a in kept.items()}
        got = {(r["code"], r["other"]): r["weight"] for r in polygons.overlay_weights(one, two, 10.0, least, 9).collect()}
        assert got == pytest.approx(want, abs=1e-6)
        told += polygons._crowded(one, two, 2.5, least).count()
    own = {r["p"]: r["own"] for r in polygons.cell_areas(polygons.edges(one), 2.5).groupBy("p").agg({"area": "sum"}).withColumnRenamed("sum(area)", "own").collect()}
    moments = {r["code"]: abs(r["area"]) for r in polygons.ring_moments(polygons.edges(one)).collect()}
    assert own == pytest.approx(moments) and told > 0


def test_crowds_form_no_pairs(spark):
    timer = threading.Timer(90, spark.sparkContext.cancelAllJobs)  # 9e8 pairs otherwise
    timer.start()
    try:
        corner = F.expr("posexplode(array(struct(0D as x, 0D as y), struct(10D as x, 0D as y), struct(10D as x, 10D as y), struct(0D as x, 10D as y)))")
        stack = spark.range(30_000).select(F.col("id").alias("code"), F.lit(0).alias("ring"), corner).select("code", "ring", F.col("pos").alias("n"), "col.x", "col.y")
        beside = stack.where("code < 2").withColumns({"code": -1 - F.col("code"), "x": F.col("x") + 20})
        got = polygons.overlay_weights(stack.unionByName(beside), stack.unionByName(beside), 10.0)
        assert {tuple(r) for r in got.collect()} == {(a, b, 0.5) for a in (-1, -2) for b in (-1, -2)}
    finally:
        timer.cancel()
