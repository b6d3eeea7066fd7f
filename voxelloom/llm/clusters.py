"""Clusters of mutually similar records, each with its size and its most typical members.

Records become vectors of hashed weighted features. Distributed k-means, seeded in parallel with more candidates than
centroids are wanted, covers them with many small cells. Neighbouring cells with no gap between them belong to one cluster:
a ball around the middle between their centroids must hold about as many records as equal balls around the centroids.
Hence the number of clusters need not be known, and a long cluster isn't cut because it is long.

The number of cells follows the data too: a cell with a gap in it, seen along one of its own axes, is split there, and
k-means goes on with more cells, until none has one. Cells no denser than records spread evenly hold strays, which are in
no cluster, like records far outside the dense part of their cell.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.operators.current import is_number
from voxelloom.runtime import Scratch, fresh

#: Places of a hashed vector, and places that each feature is hashed to.
DIMENSIONS = 32
PROBES = 4
CELLS = 64
ROUNDS = 5
STEPS = 8
CHUNK = 8_192
#: Squared distances are counted by half powers of two, from 2 ** -SHIFT / 2 on.
RADII, SHIFT = 64, 44
CROWDED = 3.0
LEVEL = 0.5
BALLS = (0.25, 0.33, 0.45)
AMPLE = 20
#: A cell's records are counted along its axes in so many bins, to this many deviations on both sides.
BINS, SPAN = 20, 3.0
#: Beyond two shells around a cell's centroid that are sparser than an even spread by this factor its records are strays.
THIN = 16.0


def hashed_feature(name: str, dimensions: int = DIMENSIONS, probes: int = PROBES) -> np.ndarray:
    """The unit vector that a feature of this name adds, times its value: some signed places, found by hash."""
    out = np.zeros(dimensions)
    for k in range(probes):
        h = int.from_bytes(hashlib.blake2b(f"{k}:{name}".encode(), digest_size=8).digest(), "little")
        out[h % dimensions] += 1.0 if h >> 63 else -1.0
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else np.eye(dimensions)[0]


def hashed_basis(features: list[str]) -> np.ndarray:
    """The features' hashed vectors, turned so that only the directions that they span are left: distances stay."""
    u, s, _ = np.linalg.svd(np.stack([hashed_feature(f) for f in features]), full_matrices=False)
    return (u * s)[:, s > 1e-9 * s[0]]


@dataclass(frozen=True)
class Model:
    """Cells in hashed space, the cluster of each cell (-1 for strays), how far it reaches (squared), and each cluster's centroid."""

    features: list[str]
    means: np.ndarray
    scales: np.ndarray
    cells: np.ndarray
    cluster_of: np.ndarray
    reach: np.ndarray
    centroids: np.ndarray

    def vectors(self, values: np.ndarray) -> np.ndarray:
        return _vectors(values, self.features, self.means, self.scales)

    def assigned(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster or -1, distance from its centroid) of each record. Where values are missing, cells and centroids are
        compared in the known features only, and the squared distance is raised in proportion to all features."""
        x, known = self.vectors(values), np.isfinite(values)
        basis = hashed_basis(self.features)
        cluster, distance = np.full(len(x), -1), np.zeros(len(x))
        for mask in np.unique(known, axis=0):
            if not mask.any():
                continue
            rows = np.flatnonzero((known == mask).all(axis=1))
            part = np.eye(basis.shape[1]) if mask.all() else np.linalg.pinv(basis) @ (basis * mask[:, None])
            raised = len(mask) / mask.sum()
            squares = _squares(x[rows], self.cells @ part)
            cell = squares.argmin(axis=1)
            near = squares[np.arange(len(rows)), cell] * raised <= self.reach[cell]
            own = np.where(near, self.cluster_of[cell], -1)
            cluster[rows] = own
            if len(self.centroids):
                distance[rows] = np.sqrt(((x[rows] - self.centroids[own] @ part) ** 2).sum(axis=1) * raised)
        return cluster, distance


def _vectors(values: np.ndarray, features: list[str], means: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """A missing value adds nothing."""
    basis = hashed_basis(features)
    return np.nan_to_num((values - means) / scales, nan=0.0, posinf=0.0, neginf=0.0) @ basis


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :])


def _chunks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        values = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k in range(features)]) if batch.num_rows else np.zeros((0, features))
        for at in range(0, len(values), CHUNK):
            yield ids[at : at + CHUNK], values[at : at + CHUNK]


def _random(ids: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1) that only depend on id and seed."""
    mask = 0xFFFFFFFFFFFFFFFF
    x = ids.astype(np.uint64) + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & mask)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53) + 2.0**-54


def _gather(data: DataFrame, work: Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], list[np.ndarray]], features: int) -> list[np.ndarray]:
    """What `work` makes of each task's rows: a few arrays whose size depends on cells and features, not on rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = work(_chunks(batches, features))
        yield pa.RecordBatch.from_pydict({"k": list(range(len(made))), "v": [np.ascontiguousarray(m, dtype=float).ravel() for m in made]}, schema=pa.schema([("k", pa.int32()), ("v", pa.list_(pa.float64()))]))

    return data.mapInArrow(run, "k int, v array<double>")


def _summed(data: DataFrame, work: Callable, features: int) -> dict[int, np.ndarray]:
    """The arrays of all tasks added up, on the executors."""
    flat = _gather(data, work, features).select("k", F.posexplode("v").alias("p", "x")).groupBy("k", "p").agg(F.sum("x").alias("x"))
    rows = flat.toPandas().sort_values(["k", "p"])
    return {int(k): g["x"].to_numpy() for k, g in rows.groupby("k")}


def _seed(data: DataFrame, make: Callable[[np.ndarray], np.ndarray], features: int, wanted: int, rounds: int, seed: int) -> np.ndarray:
    """Candidates by parallel oversampling: in each round `wanted` records, chosen in proportion to their squared distance
    from the candidates so far. Each record draws log(u) / distance²; the largest draws are such a sample without
    replacement, and every task sends only its own largest."""
    known = make(np.zeros((0, features)))
    for r in range(rounds):
        take = 1 if r == 0 else wanted

        def draw(chunks: Iterator[tuple[np.ndarray, np.ndarray]], known: np.ndarray = known, take: int = take, r: int = r) -> list[np.ndarray]:
            keys, rows = np.zeros(0), np.zeros((0, features))
            for ids, values in chunks:
                x = make(values)
                d = _squares(x, known).min(axis=1) if len(known) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    key = np.where(d > 1e-12, np.log(_random(ids, seed + r)) / np.maximum(d, 1e-300), -np.inf)
                keys, rows = np.concatenate([keys, key]), np.concatenate([rows, values])
                top = np.argsort(-keys, kind="stable")[:take]
                keys, rows = keys[top], rows[top]
            ok = np.isfinite(keys)
            return [np.column_stack([keys[ok], rows[ok]])]

        sent = _gather(data, draw, features).where(F.size("v") > 0).select(F.explode(F.transform(F.sequence(F.lit(0), (F.size("v") / (features + 1)).cast("int") - 1), lambda i: F.slice("v", i * (features + 1) + 1, features + 1))).alias("v"))
        best = sent.orderBy(F.col("v")[0].desc(), "v").limit(take).toPandas()["v"]
        if not len(best):
            break
        known = np.concatenate([known, make(np.stack(best.to_list())[:, 1:])])
    return known


def _weights(data: DataFrame, make: Callable, features: int, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Records of each cell, their sum, the sum of squared distances, and the sums of products of two coordinates."""
    dims = centres.shape[1]

    def count(chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        n, s, cost, m = np.zeros(len(centres)), np.zeros_like(centres), 0.0, np.zeros((len(centres), dims * dims))
        for _, values in chunks:
            x = make(values)
            d = _squares(x, centres)
            own = d.argmin(axis=1)
            cost += d[np.arange(len(x)), own].sum()
            n += np.bincount(own, minlength=len(centres))
            # About the centre, so that small spreads far from the origin aren't rounded away.
            off = x - centres[own]
            order = np.argsort(own, kind="stable")
            at = np.searchsorted(own[order], np.arange(len(centres)))
            full = np.flatnonzero(np.bincount(own, minlength=len(centres)))
            if len(full):
                s[full] += np.add.reduceat(x[order], at[full], axis=0)
                m[full] += np.add.reduceat((off[:, :, None] * off[:, None, :]).reshape(len(x), -1)[order], at[full], axis=0)
        return [n, s, np.array([cost]), m]

    made = _summed(data, count, features)
    return made[0], made[1].reshape(centres.shape), float(made[2][0]), made[3].reshape(len(centres), dims, dims)


def _means(data: DataFrame, make: Callable, features: int, centres: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The centres after some steps of k-means, without those that no record is nearest to, and which they were."""
    before, which = float("inf"), np.arange(len(centres))
    for _ in range(steps):
        n, s, cost, _ = _weights(data, make, features, centres)
        live = n > 0
        centres, which = s[live] / n[live][:, None], which[live]
        if cost >= before * (1 - 1e-3):
            break
        before = cost
    return centres, which


def valley(counts: np.ndarray, level: float = LEVEL) -> tuple[float, int]:
    """(depth, bin) of the deepest gap in a histogram: a bin that has less than `level` times as many records as a peak on
    both sides, beyond what chance does; (1, -1) without one."""
    smooth = np.convolve(counts, [0.25, 0.5, 0.25], mode="same")
    left, right = np.maximum.accumulate(smooth), np.maximum.accumulate(smooth[::-1])[::-1]
    peak = np.minimum(left, right)
    ample = np.minimum(np.cumsum(counts), np.cumsum(counts[::-1])[::-1]) >= AMPLE
    gap = ample & (smooth <= level * peak) & (peak - smooth >= 3 * np.sqrt(np.maximum(peak, 1.0)))
    if not gap.any():
        return 1.0, -1
    depth = np.where(gap, smooth / np.maximum(peak, 1e-9), np.inf)
    # Of a wide gap the middle.
    at = np.flatnonzero(depth == depth.min())
    return float(depth.min()), int(at[len(at) // 2])


def _split(data: DataFrame, make: Callable, features: int, centres: np.ndarray, tried: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """The centres, with two in the place of each of those `tried` whose cell has a gap along one of its axes, and which are new."""
    n, s, _, m = _weights(data, make, features, centres)
    size = np.maximum(n, 1.0)
    mean = s / size[:, None]
    off = mean - centres
    spread, axes = np.linalg.eigh(m / size[:, None, None] - off[:, :, None] * off[:, None, :])
    width = np.sqrt(np.maximum(spread, 1e-18))
    cells, dims = centres.shape

    def count(chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        bins = np.zeros(cells * dims * BINS)
        for _, values in chunks:
            x = make(values)
            own = _squares(x, centres).argmin(axis=1)
            along = np.einsum("nd,nde->ne", x - mean[own], axes[own]) / width[own]
            at = np.clip(((along + SPAN) * (BINS / (2 * SPAN))).astype(int), 0, BINS - 1)
            bins += np.bincount(((own[:, None] * dims + np.arange(dims)) * BINS + at).ravel(), minlength=len(bins))
        return [bins]

    bins = _summed(data, count, features)[0].reshape(cells, dims, BINS)
    places = (np.arange(BINS) + 0.5) * (2 * SPAN / BINS) - SPAN
    out, new = [], []
    for k in range(cells):
        gaps = [(*valley(bins[k, axis], level), axis) for axis in range(dims)] if tried[k] else [(1.0, -1, 0)]
        _, at, axis = min(gaps, key=lambda g: (g[1] < 0, g[0]))
        sides = (slice(0, at + 1), slice(at + 1, None)) if at >= 0 else ()
        out += [mean[k] + axes[k][:, axis] * width[k, axis] * ((bins[k, axis, s] * places[s]).sum() / max(1.0, bins[k, axis, s].sum())) for s in sides] or [centres[k]]
        new += [True] * len(sides) or [False]
    return np.stack(out), np.array(new)


def _reduce_candidates(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of the weighted candidates, by weighted k-means with k-means++ seeding; the candidates are few."""
    rng = np.random.default_rng(seed)
    live = weights > 0
    x, w = candidates[live], weights[live]
    if len(x) <= k:
        return x
    centres = x[[int(w.argmax())]]
    while len(centres) < k:
        d = _squares(x, centres).min(axis=1) * w
        if not d.sum() > 0:
            break
        centres = np.concatenate([centres, x[[rng.choice(len(x), p=d / d.sum())]]])
    for _ in range(20):
        own = _squares(x, centres).argmin(axis=1)
        n = np.bincount(own, weights=w, minlength=len(centres))
        s = np.stack([np.bincount(own, weights=w * x[:, j], minlength=len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, s / np.maximum(n, 1e-300)[:, None], centres)
    return centres


def _near_counts(data: DataFrame, make: Callable, features: int, cells: np.ndarray) -> np.ndarray:
    """[cell, b]: records of each cell whose squared distance from its centroid is under 2 ** ((b - SHIFT) / 2)."""
    m = len(cells)

    def count(chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        n = np.zeros(m * RADII)
        for _, values in chunks:
            d = _squares(make(values), cells)
            own = d.argmin(axis=1)
            b = np.ceil(2 * np.log2(np.maximum(d[np.arange(len(d)), own], 1e-12))).astype(int) + SHIFT
            n += np.bincount(own * RADII + np.clip(b, 0, RADII - 1), minlength=len(n))
        return [n]

    return _summed(data, count, features)[0].reshape(m, RADII).cumsum(axis=1)


def _shells(features: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared radii of the balls that records are counted in, and the balls' volumes."""
    radius2 = 2.0 ** ((np.arange(RADII) - SHIFT) / 2)
    return radius2, math.pi ** (features / 2) / math.gamma(features / 2 + 1) * radius2 ** (features / 2)


def dense_cells(near: np.ndarray, features: int, even: float) -> np.ndarray:
    """Whether some ball around a cell's centroid, with a fair part of its records, is denser than CROWDED times what
    there would be if all records were spread evenly (`even` to a unit of volume). Cells of stray records are not."""
    _, volume = _shells(features)
    enough = near >= np.maximum(10, near[:, -1:] / 5)
    return (np.where(enough, near / volume, 0.0).max(axis=1)) >= CROWDED * even


def reaches(near: np.ndarray, features: int, even: float) -> np.ndarray:
    """The squared radius up to which each cell's records belong to it: from the radius that half of them are within,
    outwards beyond the first two shells in turn that are sparser than even / THIN, which stragglers may lie in."""
    radius2, volume = _shells(features)
    thin = np.diff(near, axis=1, prepend=0.0) / np.diff(volume, prepend=0.0) < even / THIN
    out = np.full(len(near), np.inf)
    for k, counts in enumerate(near):
        first = int(np.searchsorted(counts, counts[-1] / 2))
        ends = np.flatnonzero(thin[k, first + 1 : -1] & thin[k, first + 2 :])
        if len(ends):
            out[k] = radius2[min(RADII - 1, first + ends[0] + 3)]
    return out


def neighbours(cells: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Pairs of live cells with no other live centroid in the ball that has them at opposite ends."""
    at = np.flatnonzero(live)
    d = _squares(cells[at], cells[at])
    free = np.ones_like(d, dtype=bool)
    for k in range(len(at)):
        # A third centroid k is in the ball of i and j if d(i, k) + d(k, j) < d(i, j).
        inside = d[:, k][:, None] + d[k][None, :] < d
        inside[k], inside[:, k] = False, False
        free &= ~inside
    i, j = np.nonzero(np.triu(free, 1))
    return np.stack([at[i], at[j]], axis=1)


def _ball_counts(data: DataFrame, make: Callable, features: int, cells: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """[pair, 3]: records in balls of one size around the one centroid, the middle between both, and the other. The balls
    are as small, by their share of the way, as leaves AMPLE records around both centroids."""
    i, j = pairs.T
    apart = _squares(cells, cells)[i, j]

    def count(chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        n = np.zeros((len(BALLS), len(pairs), 3))
        for _, values in chunks:
            d = _squares(make(values), cells)
            a, b = d[:, i], d[:, j]
            middle = (a + b) / 2 - apart / 4
            for k, share in enumerate(BALLS):
                for place, x in enumerate((a, middle, b)):
                    n[k, :, place] += (x <= apart * share * share).sum(axis=0)
        return [n]

    n = _summed(data, count, features)[0].reshape(len(BALLS), len(pairs), 3)
    ample = np.minimum(n[:, :, 0], n[:, :, 2]) >= AMPLE
    ample[-1] = True
    return n[ample.argmax(axis=0), np.arange(len(pairs))]


def join_cells(cells: int, pairs: np.ndarray, balls: np.ndarray, level: float) -> np.ndarray:
    """The cluster of each cell: a pair is joined if the middle is at least `level` times as dense as its sparser end.
    Along any line through a heap with one summit the middle is at least as dense as the sparser end."""
    owner = list(range(cells))

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for (i, j), (a, middle, b) in zip(pairs.tolist(), balls.tolist()):
        if middle >= 1 and middle >= level * min(a, b):
            owner[root(j)] = root(i)
    return np.array([root(i) for i in range(cells)])


def fit(records: DataFrame, identity: str, features: dict[str, Column], *, cells: int = CELLS, rounds: int = ROUNDS, steps: int = STEPS, weights: dict[str, float] | None = None, level: float = LEVEL, seed: int = 5, scratch: Scratch | None = None) -> tuple[Model | None, DataFrame]:
    """(model, data): the model, and the records as (id, values…), written once.

    `features` are numeric columns by name, each scaled to unit deviation and then by its weight (1 by default). The
    model is fitted to all records that have every value; there is none (None) if there are no such records. `cells` is
    how many k-means begins with.
    """
    scratch = scratch or Scratch(records.sparkSession, "clusters")
    names = list(features)
    columns = [F.when(is_number(c.cast("double")), c.cast("double")).alias(f"f{k}") for k, c in enumerate(features.values())]
    data = scratch.save(records.where(F.col(identity).isNotNull()).select(F.col(identity).alias("id"), *columns), "values")
    whole = data.dropna()
    stats = whole.agg(F.count("*").alias("n"), *(f(f"f{k}") for k in range(len(names)) for f in (F.avg, F.stddev_pop, F.max, F.min))).first()
    if not stats[0]:
        return None, data
    means, spread = np.array(stats[1::4], dtype=float), np.array(stats[2::4], dtype=float)
    weight = np.array([(weights or {}).get(f, 1.0) for f in names])
    scales = np.where(spread > 0, spread, 1.0) / np.where(weight > 0, weight, 1e-9)
    make = lambda v: _vectors(v, names, means, scales)
    hashed = whole.select(F.when(F.lit(dict(whole.dtypes)["id"] in ("bigint", "int")), F.col("id")).otherwise(F.xxhash64("id")).cast("bigint").alias("id"), *(f"f{k}" for k in range(len(names))))

    size = len(names)
    candidates = _seed(hashed, make, size, 2 * cells, rounds, seed)
    centres, _ = _means(hashed, make, size, _reduce_candidates(candidates, _weights(hashed, make, size, candidates)[0], cells, seed), steps)
    tried = np.ones(len(centres), dtype=bool)
    while tried.any():
        centres, new = _split(hashed, make, size, centres, tried, level)
        if new.any():
            centres, which = _means(hashed, make, size, centres, 3)
            new = new[which]
        tried = new
    # A column with one value tells nothing, and takes no room from the others.
    width = np.where(spread > 0, np.clip((np.array(stats[3::4], dtype=float) - np.array(stats[4::4], dtype=float)) / scales, 1e-3, 6.0), 1.0)
    even = stats[0] / width.prod()
    near = _near_counts(hashed, make, size, centres)
    live = dense_cells(near, size, even)
    pairs = neighbours(centres, live)
    balls = _ball_counts(hashed, make, size, centres, pairs) if len(pairs) else np.zeros((0, 3))
    clusters = np.where(live, join_cells(len(centres), pairs, balls, level), -1)
    n, s, _, _ = _weights(hashed, make, size, centres)
    # Numbered by size, ties by place, so that the numbers don't depend on the seeding's order.
    found = np.unique(clusters[clusters >= 0])
    count = np.array([n[clusters == c].sum() for c in found])
    mid = np.stack([s[clusters == c].sum(axis=0) / max(1.0, n[clusters == c].sum()) for c in found]) if len(found) else centres[:0]
    order = np.lexsort((*mid.T.round(6), -count))
    number = {int(found[k]): r for r, k in enumerate(order)} | {-1: -1}
    return Model(names, means, scales, centres, np.array([number[int(c)] for c in clusters]), reaches(near, size, even), mid[order]), data


def assign(data: DataFrame, model: Model | None) -> DataFrame:
    """(id, cluster, distance) of the records that fit() returned: distance from the cluster's centroid.

    A record with missing values is placed by those it has. One without any, and a stray one, is in no cluster: both are
    null.
    """
    features = [c for c in data.columns if c != "id"]
    schema = T.StructType([data.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    if model is None:
        return data.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k in range(len(features))])[at : at + CHUNK] for at in range(0, batch.num_rows, CHUNK)]
            cluster, distance = [], []
            for values in parts:
                own, far = model.assigned(values)
                cluster.append(own)
                distance.append(far)
            if parts:
                gone = np.concatenate(cluster) < 0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(cluster), pa.int32(), mask=gone), pa.array(np.concatenate(distance), mask=gone)], ["id", "cluster", "distance"])

    return data.mapInArrow(run, schema)


def describe(members: DataFrame, typical: int = 5) -> DataFrame:
    """(cluster, size, typical): members nearest the centroid, nearest first, ties by id. Partial lists are made before
    the shuffle: no task sees more of a cluster than `typical` records from each task before it."""
    (part,) = fresh(members.columns, "part")
    held = members.where(F.col("cluster").isNotNull())
    sizes = held.groupBy("cluster").agg(F.count("*").alias("size"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if best is None else [best, batch])
            p = t.to_pandas().sort_values(["cluster", "distance", "id"], kind="stable").groupby("cluster").head(typical)
            best = pa.RecordBatch.from_pandas(p, schema=batch.schema, preserve_index=False)
        if best is not None:
            yield best

    few = held.select("id", "cluster", "distance").mapInArrow(nearest, held.select("id", "cluster", "distance").schema)
    lists = few.groupBy("cluster").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "id"))), 1, typical).alias(part))
    return sizes.join(lists, "cluster").select("cluster", "size", F.transform(part, lambda x: x["id"]).alias("typical"))
