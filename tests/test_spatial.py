from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.operators.current import current_rows, is_number, stack_key
from voxelloom.operators.kdtree import KdTree, descend, split_box
from voxelloom.operators.spatial import EARTH_RADIUS_KM, crossings, places_within, points_in_polygons, points_within


def brute(points, r):
    return {(a[0], b[0]) for i, a in enumerate(points) for b in points[i + 1 :] if a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= r * r}


@pytest.mark.parametrize("n", [0, 1, 2, 17, 500])
def test_trees(n):
    p = np.random.default_rng(n).random((n, 3)) * 10
    found = sorted((min(a, b), max(a, b)) for i, j in KdTree(p, leaf=4).pairs(None, 1.5) for a, b in zip(i.tolist(), j.tolist())) if n else []
    want = sorted((i, j) for i in range(n) for j in range(i + 1, n) if ((p[i] - p[j]) ** 2).sum() <= 2.25)
    assert found == want


def test_trees_of_equal_points():
    assert sum(len(i) for i, _ in KdTree(np.zeros((40, 2)), leaf=4).pairs(None, 0.0)) == 40 * 39 // 2
    assert split_box(np.zeros((40, 2)), 8) == []


def test_every_point_has_one_home_and_neighbours_meet():
    p = np.random.default_rng(1).random((400, 2))
    who, leaf, home = descend(p, split_box(p[:100], 9), 0.05)
    assert sorted(who[home].tolist()) == list(range(400))
    cells = [set() for _ in range(400)]
    for w, c in zip(who.tolist(), leaf.tolist()):
        cells[w].add(c)
    at = dict(zip(who[home].tolist(), leaf[home].tolist()))
    for i in range(400):
        for j in np.flatnonzero(((p - p[i]) ** 2).sum(axis=1) <= 0.05**2).tolist():
            assert at[i] in cells[j]


@pytest.mark.parametrize("cell", [25, 10**6])
def test_points_against_brute_force(spark, cell):
    rng = random.Random(4)
    points = [(k, g, rng.uniform(0, 30), rng.uniform(0, 30)) for k in range(400) for g in [rng.choice(["hot"] * 5 + ["a", "b"])]]
    points += [(1000, "a", 50.0, 50.0), (1001, "a", 53.0, 54.0), (1002, "a", 50.0, 50.0), (1003, "b", 50.0, 50.0)]
    odd = [(2000, "a", None, 1.0), (2001, "a", float("nan"), 1.0), (2002, None, 1.0, 1.0), (None, "a", 1.0, 1.0), (2003, "a", float("inf"), 1.0)]
    df = spark.createDataFrame(points + odd, "id long, cell string, x0 double, home double")
    got = points_within(df, ["cell"], "id", [F.col("x0"), F.col("home")], 5.0, cell_points=cell).collect()
    assert len(got) == len({(r["id_a"], r["id_b"]) for r in got}) and {(r["id_a"], r["id_b"]) for r in got} == brute(points, 5.0)
    assert {(r["id_a"], r["id_b"]): r["distance"] for r in got}[1000, 1001] == 5.0
    assert points_within(df.where("false"), ["cell"], "id", [F.col("x0"), F.col("home")], 5.0).count() == 0


def test_points_of_two_tables(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "id long, y double, x double")
    b = spark.createDataFrame([(1, 0.0, 1.0), (7, 0.5, 0.5), (8, 30.0, 30.0)], "id long, y double, x double")
    got = points_within(a, [], "id", [F.col("y"), F.col("x")], 1.0, others=b)
    assert {(r["id_a"], r["id_b"]) for r in got.collect()} == {(1, 1), (1, 7)}


def test_places_on_a_sphere(spark):
    rng = random.Random(5)
    places = [(k, rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for k in range(300)] + [(900, 179.9, 10.0), (901, -179.9, 10.0), (902, 0.0, 90.0), (903, 120.0, 89.9), (904, 0.0, 91.0)]
    df = spark.createDataFrame(places, "id long, lon double, lat double")

    def apart(a, b):
        f, g, d = math.radians(a[2]), math.radians(b[2]), math.radians(a[1] - b[1])
        return EARTH_RADIUS_KM * 2 * math.asin(math.sqrt(min(1.0, math.sin((f - g) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(d / 2) ** 2)))

    good = [p for p in places if abs(p[2]) <= 90]
    want = {(a[0], b[0]): apart(a, b) for i, a in enumerate(good) for b in good[i + 1 :] if apart(a, b) <= 900}
    got = {(r["id_a"], r["id_b"]): r["distance"] for r in places_within(df, "id", "lon", "lat", 900.0, cell_points=40).collect()}
    assert got.keys() == want.keys() and (900, 901) in got and (902, 903) in got
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def inside(y, x, corners):
    odd = False
    for (y0, x0), (y1, x1) in zip(corners, corners[1:] + corners[:1]):
        if min(y0, y1) <= y < max(y0, y1) and x0 + (y - y0) * (x1 - x0) / (y1 - y0) > x:
            odd = not odd
    return odd


@pytest.mark.parametrize("cell", [20, 10**6])
def test_points_in_polygons(spark, cell):
    rng = random.Random(6)
    points = [(k, rng.choice("ab"), rng.uniform(0, 20), rng.uniform(0, 20)) for k in range(300)] + [(500, "a", 2.0, 2.0), (501, "a", 4.0, 2.0)]
    shapes = [(10, "a", [(2.0, 2.0), (2.0, 6.0), (4.0, 6.0), (4.0, 2.0)]), (11, "a", [(4.0, 2.0), (4.0, 6.0), (6.0, 6.0), (6.0, 2.0)])]
    shapes += [(20 + k, rng.choice("ab"), [(10 + rng.uniform(1, 9) * math.sin(t), 10 + rng.uniform(1, 9) * math.cos(t)) for t in sorted(rng.uniform(0, 6.28) for _ in range(9))]) for k in range(6)]
    odd = [(90, "a", [(0.0, 0.0), (1.0, 1.0)]), (91, "a", None), (92, "a", [(0.0, None), (1.0, 1.0), (9.0, 0.0)]), (93, None, [(0.0, 0.0), (0.0, 20.0), (20.0, 0.0)])]
    p = spark.createDataFrame([*points, (600, "a", None, 1.0)], "id long, g string, y double, x double")
    s = spark.createDataFrame(shapes + shapes[:1] + odd, "name long, g string, v array<struct<y: double, x: double>>")
    got = points_in_polygons(p, ["g"], "id", F.col("y"), F.col("x"), s, "name", F.col("v"), cell_points=cell).collect()
    want = {(k, n) for k, g, y, x in points for n, h, v in shapes if g == h and inside(y, x, v)}
    assert {(r["id"], r["polygon_id"]) for r in got} == want and len(got) == len(want)
    assert (500, 10) in want and (501, 11) in want and (501, 10) not in want


def test_sweep_in_pieces():
    rng = np.random.default_rng(7)
    ys, xs = rng.random(200), rng.random(200)
    edges = np.array([[0.1, 0.1, 0.9, 0.1], [0.9, 0.1, 0.9, 0.8], [0.9, 0.8, 0.1, 0.8], [0.1, 0.8, 0.1, 0.1]])
    whole = crossings(ys, xs, edges, np.zeros(4, dtype=int))
    parts = crossings(ys, xs, edges, np.zeros(4, dtype=int), chunk=30)
    assert sorted(whole[0].tolist()) == sorted(parts[0].tolist()) == np.flatnonzero((ys >= 0.1) & (ys < 0.9) & (xs >= 0.1) & (xs < 0.8)).tolist()


def test_current_rows(spark):
    rows = [(1, 5, "old"), (1, 7, "new"), (1, 7, "new"), (2, None, "a"), (2, 1, "b"), (3, 4, "x"), (3, 4, "y"), (None, 9, "z")]
    df = spark.createDataFrame(rows, "id long, version_rank int, body string")
    got = current_rows(df, "id", "version_rank")
    assert {(r["id"], r["body"]) for r in got.collect()} == {(1, "new"), (2, "b"), (3, "y")} and got.columns == df.columns
    assert current_rows(df.where("false"), "id", "version_rank").count() == 0


def test_names_and_numbers(spark):
    df = spark.createDataFrame([(" Nucleus ", 1.0), ("NUCLEUS", float("nan")), (None, None), ("nucleus", float("-inf"))], "s string, v double")
    assert [r[0] for r in df.select(stack_key(F.col("s"))).distinct().orderBy("lower(trim(s))").collect()] == [None, "nucleus"]
    assert [r[0] for r in df.select(is_number(F.col("v"))).collect()] == [True, False, False, False]
