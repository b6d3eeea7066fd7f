from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxelloom.operators import spatial


def test_few_points_and_many_polygons_are_spread(spark, monkeypatch):
    n = 20_000
    at = F.struct((F.col("id") % 200).cast("double").alias("y"), F.floor(F.col("id") / 200).cast("double").alias("x"))
    corner = lambda dy, dx: F.struct((at["y"] + dy).alias("y"), (at["x"] + dx).alias("x"))
    polygons = spark.range(n).select(F.col("id").alias("poly"), F.array(corner(0, 0), corner(0, 1.5), corner(1.5, 1.5), corner(1.5, 0)).alias("v"))
    points = spark.createDataFrame([(k, 10.0 * k + 0.25, 7.0 * k + 0.75) for k in range(10)], "id long, y double, x double")
    loads = []
    boxes = spatial._Cells.boxes

    def watched(self, shapes):
        out = boxes(self, shapes)
        loads.extend(r["count"] for r in out.groupBy("cell").count().collect())
        return out

    monkeypatch.setattr(spatial._Cells, "boxes", watched)
    got = {r[:] for r in spatial.points_in_polygons(points, [], "id", F.col("y"), F.col("x"), polygons, "poly", F.col("v"), cell_points=2_000).collect()}
    want = {(k, i) for k in range(10) for i in range(n) if i % 200 <= 10.0 * k + 0.25 < i % 200 + 1.5 and i // 200 <= 7.0 * k + 0.75 < i // 200 + 1.5}
    assert got == want and len(loads) >= 8 and max(loads) < 4_500


def test_sweep_against_ray_by_ray():
    rng = np.random.default_rng(5)
    ys, xs = rng.uniform(0, 10, 400), rng.uniform(0, 10, 400)
    edges, owner = [], []
    for k in range(60):
        corners = rng.uniform(0, 10, (rng.integers(3, 9), 2)) * rng.uniform(0.1, 1)
        edges += [np.concatenate([a, b]) for a, b in zip(corners, np.roll(corners, -1, axis=0))]
        owner += [k * 3] * len(corners)
    got = set(zip(*(a.tolist() for a in spatial.crossings(ys, xs, np.array(edges), np.array(owner), chunk=500))))
    want = set()
    for i, (y, x) in enumerate(zip(ys, xs)):
        for k in set(owner):
            own = [e for e, o in zip(edges, owner) if o == k]
            if sum(min(a, c) <= y < max(a, c) and b + (y - a) * (d - b) / (c - a) > x for a, b, c, d in own) % 2:
                want.add((i, k))
    assert got == want
    assert len(spatial.crossings(ys[:0], xs[:0], np.array(edges), np.array(owner))[0]) == 0
