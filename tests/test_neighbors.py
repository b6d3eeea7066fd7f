from __future__ import annotations

import random

from pyspark.sql import functions as F

from voxelloom.operators import neighbors


def test_far_regions_have_a_nearest_too(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, k % 3, rng.uniform(0, 30) + 5_000 * (k % 7 == 0), rng.uniform(0, 30) * (1 + 40 * (k % 5 == 0))) for k in range(60)]
    rows += [(100, 9, 0.0, 0.0), (101, 9, 3e5, 4e5), (102, 8, 1.0, 1.0), (103, 9, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "id long, g int, y double, x double")
    want = {}
    for i, g, y, x in rows:
        near = sorted(((y - v) ** 2 + (x - u) ** 2, j) for j, h, v, u in rows if h == g and j != i and 103 not in (i, j))
        want[i] = (near[0][1], round(near[0][0] ** 0.5, 6)) if near else (None, None)
    assert want[100] == (101, 500_000.0) and want[102] == want[103] == (None, None)
    for few in (neighbors.FEW, 0):
        monkeypatch.setattr(neighbors, "FEW", few)
        got = neighbors.nearest_distances(df, ["g"], "id", F.col("y"), F.col("x"), cell=20.0)
        assert {r["id"]: (r["nearest"], r["distance"] and round(r["distance"], 6)) for r in got.collect()} == want
