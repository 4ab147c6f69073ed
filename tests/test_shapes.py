"""Rings: projection into the insets, the 180th meridian, clipping and holes, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgate.operators import shapes

SCHEMA = "shape long, state string, ring int, seq int, lon double, lat double"


def ring(n, lon, lat, r, way=1, seed=0):
    rng = np.random.default_rng(seed)
    return [((lon + r * k * math.cos(way * 2 * math.pi * j / n) + 540) % 360 - 180, lat + r * k * math.sin(way * 2 * math.pi * j / n)) for j, k in enumerate(rng.uniform(0.6, 1, n))]


def rows(shape, number, points, state="06"):
    return [(shape, state, number, j, float(x), float(y)) for j, (x, y) in enumerate(points)]


def area(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2


def covered(p, x0, y0, x1, y1, n=400):
    """The share of a box that a ring covers, by sampling."""
    xs, ys = np.meshgrid(np.linspace(x0, x1, n, endpoint=False) + (x1 - x0) / n / 2, np.linspace(y0, y1, n, endpoint=False) + (y1 - y0) / n / 2)
    odd = np.zeros(xs.shape, bool)
    for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
        if ay != by:
            odd ^= ((ay > ys) != (by > ys)) & (xs < (bx - ax) * (ys - ay) / (by - ay) + ax)
    return odd.mean() * (x1 - x0) * (y1 - y0)


def test_clipped_areas_equal_sampled_ones(spark):
    box = (-1.0, -0.5, 1.5, 1.0)
    rings = {k: [(x * 1.0, y) for x, y in ring(5 + k % 9, (k % 7) * 0.5 - 1.5, (k % 5) * 0.4 - 0.8, 0.5 + k % 3, way=1 - 2 * (k % 2), seed=k)] for k in range(40)}
    data = spark.createDataFrame([r for k, p in rings.items() for r in rows(k, 0, p)], SCHEMA)
    held = shapes.boxed(shapes.rings(data, "lon", "lat"), *[F.lit(x) for x in box])
    got = {r["shape"]: (r["a"], r["p"]) for r in held.select("shape", shapes.signed_area(F.col("p")).alias("a"), "p").collect()}
    for k, p in rings.items():
        assert abs(abs(got[k][0]) - covered(p, *box)) < 0.02
        assert all(box[0] - 1e-9 <= v["x"] <= box[2] + 1e-9 and box[1] - 1e-9 <= v["y"] <= box[3] + 1e-9 for v in got[k][1])
    whole = shapes.boxed(shapes.rings(data, "lon", "lat"), *[F.lit(x) for x in (-99.0, -99.0, 99.0, 99.0)])
    assert all(abs(r["a"] - area(rings[r["shape"]])) < 1e-9 for r in whole.select("shape", shapes.signed_area(F.col("p")).alias("a")).collect())
    none = shapes.boxed(shapes.rings(data, "lon", "lat"), *[F.lit(x) for x in (50.0, 50.0, 60.0, 60.0)])
    assert none.where("size(p) > 0").count() == 0


@pytest.mark.parametrize("lon", [179.0, -179.0, 180.0, 170.0, 0.0])
def test_rings_over_the_180th_meridian_are_cut_there(spark, lon):
    p = ring(14, lon, 52.0, 3.0, seed=3)
    sides = shapes.split_at_180(spark.createDataFrame(rows(1, 0, p, "02"), SCHEMA)).select("side", "p", shapes.signed_area(F.col("p")).alias("a")).collect()
    running = [((x - lon + 540) % 360 - 180, y) for x, y in p]
    assert abs(sum(r["a"] for r in sides) - area(running)) < 1e-9
    assert len(sides) == (2 if abs(lon) > 175 else 1)
    for r in sides:
        assert all(-180 <= v["x"] <= 180 for v in r["p"]) and max(v["x"] for v in r["p"]) - min(v["x"] for v in r["p"]) < 10


def test_states_lie_in_their_boxes(spark):
    towns = [("02", -149.9, 61.2), ("02", -134.4, 58.3), ("02", 179.0, 51.9), ("02", -179.0, 51.9), ("15", -157.8, 21.3), ("72", -66.1, 18.4), ("06", -122.4, 37.8), ("23", -68.8, 44.8), ("12", -80.2, 25.8)]
    data = spark.createDataFrame([(i, s, 0, 0, x, y) for i, (s, x, y) in enumerate(towns)], SCHEMA)
    got = {r["shape"]: r for r in shapes.projected(data).withColumns({c: shapes.of_state(c) for c in ("x0", "y0", "x1", "y1")}).collect()}
    assert all(g["x0"] <= g["x"] <= g["x1"] and g["y0"] <= g["y"] <= g["y1"] for i, g in got.items() if i not in (2, 3))
    # Both sides of the meridian lie side by side in Alaska's frame, and every frame's centre where it is told to.
    assert abs(got[2]["x"] - got[3]["x"]) < 15 and got[2]["x"] < got[3]["x"] < got[0]["x"]
    assert got[6]["x"] < got[7]["x"] and got[8]["y"] > got[7]["y"]
    middle = spark.createDataFrame([(0, "06", 0, 0, -96.6, 38.7)], SCHEMA)
    assert [round(shapes.projected(middle).first()[c], 6) for c in ("x", "y")] == [487.5, 305.0]


def test_rings_are_drawn_by_their_middle_and_area(spark):
    far, small = ring(9, -177.0, 28.2, 0.5), ring(9, -96.0, 38.0, 0.01)
    data = spark.createDataFrame(rows(1, 0, far, "15") + rows(2, 0, small) + rows(3, 0, ring(9, -96.0, 38.0, 1.0)), SCHEMA)
    held = shapes.rings(shapes.projected(data))
    got = {r["shape"]: r["d"] for r in held.select("shape", shapes.drawn(held, 1.0).alias("d")).collect()}
    assert got == {1: False, 2: False, 3: True}


def test_holes_belong_to_the_smallest_ring_that_holds_them(spark):
    square = lambda x, y, r, way=1: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)][::way]
    data = spark.createDataFrame(
        rows(1, 0, square(0, 0, 5)) + rows(1, 1, square(0, 0, 3, -1)) + rows(1, 2, square(0, 0, 2)) + rows(1, 3, square(0, 0, 1, -1)) + rows(1, 4, square(20, 0, 1, -1))
        + rows(2, 7, square(0, 0, 2, -1)) + rows(2, 8, square(0, 0, 1)) + rows(3, 0, square(1, 1, 1)) + rows(4, 0, [(0, 0), (1, 1)]), SCHEMA,
    )
    held = shapes.rings(data, "lon", "lat")
    got = {r["shape"]: tuple(r)[1:] for r in shapes.shape_areas(held).collect()}
    assert got == {1: (5, 3, 1, 160.0, 76.0), 2: (2, 1, 0, 20.0, 12.0), 3: (1, 0, 0, 4.0, 4.0), 4: (1, 0, 0, 0.0, 0.0)}
    owners = {(r["shape"], r["ring"]): r["outer"] for r in shapes.hole_owners(shapes.turned(held)).collect()}
    assert owners == {(1, 1): 0, (1, 3): 2, (2, 8): 7}
    assert shapes.shape_areas(held.limit(0)).count() == 0
