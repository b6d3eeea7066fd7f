from __future__ import annotations

import numpy as np

from voxelloom.llm import clusters


def test_missing_values_are_placed_by_the_known_ones(spark):
    """Three heaps in a row by a, of which the middle one is at the mean of both: without c, a still tells."""
    names = ["a", "c"]
    at = np.array([[-1.2, -1.2], [0.0, 0.0], [0.4, 3.0]])
    basis = clusters.hashed_basis(names)
    model = clusters.Model(names, np.zeros(2), np.ones(2), at @ basis, np.arange(3), np.full(3, np.inf), at @ basis)
    rows = [(k, *map(float, p), k) for k, p in enumerate(at)] + [(3, 0.4, None, 2), (4, None, 3.0, 2), (5, -1.2, None, 0), (6, None, -1.2, 0), (7, None, None, None)]
    df = spark.createDataFrame(rows, "id long, f0 double, f1 double, want int")
    got = {r["id"]: (r["cluster"], r["distance"]) for r in clusters.assign(df.drop("want"), model).collect()}
    assert {k: c for k, (c, _) in got.items()} == {r[0]: r[3] for r in rows}
    assert all(d is None if k == 7 else abs(d) < 1e-9 for k, (_, d) in got.items())
