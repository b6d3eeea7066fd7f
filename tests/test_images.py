"""Image operators on small arrays, against NumPy and the cases worked by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import components as comp
from voxelloom.operators import filters, overlap, regions, select
from voxelloom.operators import threshold as th
from voxelloom.operators.predicates import Range, checked_ranges, filter_regions
from voxelloom.operators.stencil import PADDING, gaussian_weights, stencil
from voxelloom.plans.pipelines import Segmentation, chain, coincidence, combined, segment, segment_iteratively, segment_series


def rows_of(spark, a, value="v", **more):
    axes = ["t", "z", "y", "x"][-a.ndim :]
    data = [(*map(int, at), (int if a.dtype.kind in "iub" else float)(a[at])) for at in np.ndindex(a.shape)]
    kind = "int" if value == "label" else "long" if a.dtype.kind in "iub" else "double"
    return spark.createDataFrame(data, ", ".join(f"{x} int" for x in axes) + f", {value} {kind}").withColumns({k: F.lit(v) for k, v in more.items()})


def array_of(df, shape, axes=("y", "x"), value="v", fill=0.0):
    out = np.full(shape, fill, dtype=float)
    for r in df.collect():
        out[tuple(r[a] for a in axes)] = r[value]
    return out


@pytest.fixture(scope="module")
def squares():
    a = np.zeros((100, 100), dtype=int)
    for k, (lo, hi) in enumerate([(10, 30), (40, 60), (70, 90)], 1):
        a[lo:hi, lo:hi] = k
    return a


# Intensities


def test_rescale(spark):
    a = np.array([[0, 5, 10]])
    assert array_of(filters.rescale(rows_of(spark, a), [], dtype="uint8"), (1, 3)).tolist() == [[0, 127, 255]]
    assert array_of(filters.rescale(rows_of(spark, a), []), (1, 3)).tolist() == [[0, 0.5, 1]]
    flat = rows_of(spark, np.full((2, 2), 128))
    assert array_of(filters.rescale(flat, []), (2, 2)).max() == 0 and array_of(filters.rescale(flat, [], normalize=False, dtype="uint8"), (2, 2)).tolist() == [[127, 127]] * 2
    twice = filters.rescale(filters.rescale(rows_of(spark, a), []), [])
    assert array_of(twice, (1, 3)).tolist() == [[0, 0.5, 1]]


@pytest.mark.parametrize(("center", "want"), [(False, [1.0, 3.0, 5.0]), (True, [1.5, 3.0, 4.5])])
def test_temporal_mean(spark, center, want):
    df = spark.createDataFrame([(t, 0, 0, 3 * t) for t in range(3)], "t int, y int, x int, v long")
    assert [r["v"] for r in filters.temporal_mean(df, 3, exclude_center=center).orderBy("t").collect()] == want
    with pytest.raises(ValueError):
        filters.temporal_mean(df, 1)


@pytest.mark.parametrize("mode", list(PADDING))
def test_borders(spark, mode):
    a = np.arange(12.0).reshape(3, 4) ** 2
    padded = np.pad(a, 2, mode=PADDING[mode])
    want = sum(padded[i : i + 3, j : j + 4] for i in range(5) for j in range(5))
    df = rows_of(spark, a)
    work = lambda p: sum(p[i : i + p.shape[0] - 4, j : j + p.shape[1] - 4] for i in range(5) for j in range(5))
    assert np.allclose(array_of(stencil(df, ["y", "x"], work, 2, mode=mode), (3, 4)), want)
    if mode != "wrap":
        assert np.allclose(array_of(stencil(df, ["y", "x"], work, 2, mode=mode, tile=2), (3, 4)), want)


def test_gaussians(spark):
    rng = np.random.default_rng(0)
    a = rng.random((9, 11))
    w = gaussian_weights(1.0)
    p = np.pad(a, 4, mode="symmetric")
    want = np.apply_along_axis(lambda r: np.convolve(r, w, "valid"), 1, np.apply_along_axis(lambda r: np.convolve(r, w, "valid"), 0, p))
    assert np.allclose(array_of(filters.gaussian(rows_of(spark, a), ["y", "x"], 1.0), a.shape), want)
    flat = filters.difference_of_gaussians(rows_of(spark, np.full((5, 5), 7.0)), ["y", "x"], 1.0, 3.0)
    assert np.abs(array_of(flat, (5, 5))).max() < 1e-9
    with pytest.raises(ValueError):
        filters.difference_of_gaussians(rows_of(spark, a), ["y", "x"], 3.0, 1.0)


def test_resizing(spark):
    assert filters.target_size(100, 200, None, 50) == (25, 50)
    a = np.arange(16.0).reshape(4, 4)
    df = rows_of(spark, a, k=0)
    assert np.allclose(array_of(filters.resize(df, ["k"], (4, 4), 4, 4), (4, 4)), a)
    assert np.allclose(array_of(filters.resize(df, ["k"], (4, 4), 2, 2), (2, 2)), a.reshape(2, 2, 2, 2).mean(axis=(1, 3)))
    assert np.allclose(array_of(filters.resize(df, ["k"], (4, 4), 8, 8, order=0), (8, 8)), np.kron(a, np.ones((2, 2))))
    assert np.allclose(array_of(filters.resize_cubic(df, ["k"], (4, 4), 4, 4), (4, 4)), a)
    with pytest.raises(ValueError):
        filters.resize(df, ["k"], (4, 4))


# Masks


def test_ranges(spark):
    df = rows_of(spark, np.array([[10, 50, 100, 200, 250]]))
    assert th.range_mask(df).count() == 5 and th.range_mask(df, 50, 200).count() == 3
    assert {r["v"] for r in th.range_mask(df.withColumn("k", F.lit(0)), 0.5, None, relative_to=["k"]).collect()} == {200, 250}


def test_otsu(spark):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.integers(0, 40, 300), rng.integers(120, 250, 200)]).reshape(20, 25)
    at = th.otsu_thresholds(rows_of(spark, a, k=0), ["k"]).first()["threshold"]

    def between(t):
        lo, hi = a[a <= t], a[a > t]
        return len(lo) * len(hi) * (lo.mean() - hi.mean()) ** 2 if len(hi) else 0

    assert at == max(sorted(set(a.ravel().tolist())), key=between)
    assert th.otsu_mask(rows_of(spark, a, k=0), ["k"]).count() == (a > at).sum()
    assert th.otsu_mask(rows_of(spark, np.full((3, 3), 5), k=0), ["k"]).count() == 0
    binned = th.otsu_thresholds(rows_of(spark, a.astype(float), k=0), ["k"], bins=64).first()["threshold"]
    assert 38 <= binned <= 125


@pytest.mark.parametrize("method", ["mean", "median", "niblack", "sauvola", np.max])
def test_local_thresholds(spark, method):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 100, (8, 9)).astype(float)
    w = np.lib.stride_tricks.sliding_window_view(np.pad(a, 1, mode="symmetric"), (3, 3)).reshape(8, 9, 9)
    m, s = w.mean(axis=2), w.std(axis=2)
    want = {"mean": m, "median": np.median(w, axis=2), "niblack": m - 0.2 * s, "sauvola": m * (1 + 0.2 * (s / 128 - 1))}.get(method if isinstance(method, str) else "", w.max(axis=2))
    got = th.local_thresholds(rows_of(spark, a), ["y", "x"], 3, method=method)
    assert np.allclose(array_of(got, a.shape, value="threshold"), want)
    if method == "mean":
        assert th.local_mask(rows_of(spark, a), ["y", "x"], 3, method="mean").count() == (a > want).sum()
        assert th.local_mean_mask(rows_of(spark, a, k=0), ["k"], (8, 9), 3).count() == (a > want).sum()
    with pytest.raises(ValueError):
        th.local_thresholds(rows_of(spark, a), ["y", "x"], 4)


# Labels


def flood(mask, connectivity):
    steps = comp.offsets(mask.ndim, connectivity)
    steps = steps + [tuple(-d for d in o) for o in steps]
    out, n = np.zeros(mask.shape, dtype=int), 0
    for at in np.ndindex(mask.shape):
        if mask[at] and not out[at]:
            n += 1
            todo = [at]
            out[at] = n
            while todo:
                p = todo.pop()
                for o in steps:
                    q = tuple(np.add(p, o))
                    if all(0 <= c < s for c, s in zip(q, mask.shape)) and mask[q] and not out[q]:
                        out[q] = n
                        todo.append(q)
    return out


@pytest.mark.parametrize(("shape", "connectivity", "tile"), [((17, 23), 1, None), ((17, 23), 2, None), ((17, 23), 1, 5), ((17, 23), 2, 4), ((5, 8, 9), 1, None), ((5, 8, 9), 3, 3)])
def test_components(spark, shape, connectivity, tile):
    mask = np.random.default_rng(3).random(shape) < (0.55 if len(shape) == 2 else 0.3)
    axes = ["z", "y", "x"][-len(shape) :]
    df = rows_of(spark, mask.astype(int), k=0).where("v = 1")
    got = comp.label_components(df.unionByName(df.limit(3)), axes, connectivity, tile=tile)
    assert (array_of(got, shape, axes, "label") == flood(mask, connectivity)).all()


def test_two_squares_and_nothing(spark):
    a = np.zeros((50, 50), dtype=int)
    a[10:20, 10:20] = a[30:40, 30:40] = 1
    df = rows_of(spark, a, k=0).where("v = 1")
    assert comp.label_components(df, ["y", "x"]).select("label").distinct().count() == 2
    assert comp.label_components(df.where("false"), ["y", "x"]).count() == 0
    with pytest.raises(ValueError):
        comp.label_components(df, ["y", "x"], 3).count()


def test_unique_remap_remove(spark, squares):
    two = spark.createDataFrame([(z, y, x, 1) for z in range(2) for y in range(3) for x in range(3)], "z int, y int, x int, label int")
    assert {(r["z"], r["label"]) for r in comp.unique_labels(two, ["z"]).collect()} == {(0, 1), (1, 2)}
    grid = np.array([[2, 4, 8, 5], [3, 7, 4, 4], [0, 1, 5, 3]])
    got = array_of(comp.remap_consecutive(rows_of(spark, grid, "label"), []), (3, 4), value="label")
    look = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 7: 6, 8: 7}
    assert got.tolist() == [[look[v] for v in row] for row in grid.tolist()]
    labels = rows_of(spark, squares, "label").where("label > 0")
    left = comp.remove_labels(labels, [1], [])
    assert {r["label"] for r in left.select("label").distinct().collect()} == {2, 3}
    renumbered = comp.remove_labels(labels, spark.createDataFrame([(1,)], "label int"), [], renumber=True)
    assert {r["label"] for r in renumbered.select("label").distinct().collect()} == {1, 2}
    with pytest.raises(ValueError):
        comp.remove_labels(labels, spark.createDataFrame([(1,)], "id int"), [])
    table = left.select("label").distinct()
    assert comp.label_mismatches(left, table, ["label"]).count() == 0 and comp.label_mismatches(labels, table, ["label"]).collect()[0]["side"] == "image"


def test_dilation(spark):
    df = rows_of(spark, np.pad(np.ones((20, 20), dtype=int), 40), k=0).where("v = 1")
    area = comp.dilate_to_area(df, ["k"], 5000, (100, 100)).count()
    assert 400 < area <= 5000
    assert comp.dilate_to_area(df, ["k"], 300, (100, 100)).count() == 400
    assert comp.dilate_once(df, ["k"]).count() == 400 + 80
    near = spark.createDataFrame([(0, 5, 5), (0, 5, 7)], "k int, y int, x int")
    assert comp.dilate_to_area(near, ["k"], 5, (20, 20), strict=True).count() >= 2


def test_masks_and_labels(spark):
    masks = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (5, 5, 2), (0, 0, 2)], "y int, x int, mask_id int")
    got = {(r["y"], r["x"]): r["label"] for r in select.masks_to_labels(masks, ["y", "x"]).collect()}
    assert got == {(0, 0): 3, (0, 1): 1, (5, 5): 2}
    labels = spark.createDataFrame([(0, 0, 0), (0, 1, 4), (0, 2, 9)], "y int, x int, label int")
    assert {r["label"]: r["mask_id"] for r in select.labels_to_masks(labels, []).collect()} == {4: 1, 9: 2}
    assert select.labels_to_masks(labels, [], include_background=True).count() == 3


# Properties


def test_square_properties(spark, squares):
    labels = rows_of(spark, squares, "label", k=0)
    names = ["label", "area", "centroid", "bbox", "aspect_ratio", "extent", "perimeter", "circularity", "solidity", "area_convex", "euler_number", "feret_diameter_max", "eccentricity"]
    r = regions.region_properties(labels, ["k"], ["y", "x"], names).where("label = 1").first()
    assert (r["area"], r["centroid_0"], r["bbox_0"], r["bbox_3"], r["extent"], r["euler_number"], r["area_convex"], r["solidity"]) == (400, 19.5, 10, 30, 1.0, 1, 400, 1.0)
    assert abs(r["aspect_ratio"] - 1) < 1e-9 and r["perimeter"] == 76.0 and abs(r["circularity"] - 4 * math.pi * 400 / 76**2) < 1e-12
    assert abs(r["feret_diameter_max"] - 20 * math.sqrt(2)) < 1e-9 and r["eccentricity"] < 1e-6


def test_odd_regions(spark):
    ring = np.zeros((7, 7), dtype=int)
    ring[1:6, 1:6] = 1
    ring[3, 3] = 0
    ring[0, 6] = 2
    df = rows_of(spark, ring, "label", k=0)
    r = {x["label"]: x for x in regions.region_properties(df, ["k"], ["y", "x"], ["euler_number", "aspect_ratio", "circularity", "solidity", "perimeter"]).collect()}
    assert r[1]["euler_number"] == 0 and math.isnan(r[2]["aspect_ratio"]) and math.isnan(r[2]["circularity"]) and r[2]["solidity"] == 1.0
    assert abs(r[1]["solidity"] - 24 / 25) < 1e-12


def test_volume_properties(spark):
    mask = np.zeros((3, 4, 4), dtype=int)
    mask[0, :2, :2] = mask[1, :3, :3] = mask[2] = 1
    df = rows_of(spark, mask, "label", k=0).where("label > 0")
    assert regions.cross_sections(df, ["k"]).first()["cross_sectional_area"] == 16
    two = df.where("z < 2 and y < 2 and x < 2")
    assert abs(regions.cross_sections(two, ["k"], [1.5, 0.8, 0.5]).first()["cross_sectional_area"] - 1.6) < 1e-12
    cube = rows_of(spark, np.ones((4, 4, 4), dtype=int), "label", k=0)
    r = regions.region_properties(cube, ["k"], ["z", "y", "x"], ["area", "circularity", "aspect_ratio"]).first()
    assert r["volume"] == 64 and abs(r["sphericity_faces"] - (math.pi / 6) ** (1 / 3)) < 1e-9 and abs(r["aspect_ratio"] - 1) < 1e-6
    rng = np.random.default_rng(5)
    pts = rng.integers(0, 9, (40, 3))
    cloud = spark.createDataFrame([(0, *map(int, p), 1) for p in np.unique(pts, axis=0)], "k int, z int, y int, x int, label int")
    lam = np.linalg.eigvalsh(np.cov(np.unique(pts, axis=0).T * np.array([[1.5], [1], [0.5]])))
    got = regions.region_properties(cloud, ["k"], ["z", "y", "x"], ["aspect_ratio"], [1.5, 1, 0.5]).first()["aspect_ratio"]
    assert abs(got - math.sqrt(lam[0] / lam[-1])) < 1e-9


def test_property_names():
    assert regions.checked_properties(None, 2) == ["label", "centroid"]
    assert regions.checked_properties(["area", "circularity"], 3) == ["label", "volume", "sphericity_faces"]
    with pytest.raises(ValueError):
        regions.checked_properties(["weight"], 2)


def test_filters(spark):
    df = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None), (4, 10.0), (5, 11.0)], "label int, area double")
    kept, removed = filter_regions(df, [Range("area", (5, 10))], [])
    assert {r["label"] for r in kept.collect()} == {1, 4} and {r["label"] for r in removed.collect()} == {2, 3, 5}
    assert {r["label"] for r in filter_regions(df, [Range("area")], [])[0].collect()} == {1, 4, 5}
    assert filter_regions(df, [], [])[1].count() == 0 and Range.around("area", 3, 1).bounds == (2, 4)
    with pytest.warns(UserWarning):
        assert filter_regions(df, [Range("weight", (0, 1))], [])[0].count() == 5
    with pytest.raises(ValueError):
        checked_ranges([Range("weight")], ["area"])
    with pytest.raises(ValueError):
        Range("area", (2, 1))


# Overlap


def test_scores(spark, squares):
    moved = np.roll(squares, (5, 5), axis=(0, 1))
    a, b = (rows_of(spark, x, "label", k=0).where("label > 0") for x in (squares, moved))
    pairs = {(r["label_a"], r["label_b"]): r for r in overlap.outline_pairs(a, b, ["k"], ["y", "x"]).collect()}
    assert len(pairs) == 9 and all(abs(pairs[i, i]["score"] - 225 / 575) < 1e-12 for i in (1, 2, 3)) and pairs[1, 2]["score"] == 0.0
    back = {(r["label_b"], r["label_a"]): r["score"] for r in overlap.outline_pairs(b, a, ["k"], ["y", "x"]).collect()}
    assert back == {k: r["score"] for k, r in pairs.items()}
    dice = {(r["label_a"], r["label_b"]): r["score"] for r in overlap.outline_pairs(a, b, ["k"], ["y", "x"], method="dice").collect()}
    assert all(abs(dice[k] - 2 * r["score"] / (1 + r["score"])) < 1e-12 for k, r in pairs.items())
    assert overlap.outline_pairs(a, b.where("false"), ["k"], ["y", "x"]).count() == 0
    both = overlap.consolidate(overlap.outline_pairs(a, a, ["k"], ["y", "x"]), ["k"], "a", "B", "iou").collect()
    assert [(r["B +"], r["iou B +"]) for r in both] == [(True, 1.0)] * 3
    with pytest.raises(ValueError):
        overlap.outline_pairs(a, b, ["k"], ["y", "x"], method="cosine")


@pytest.mark.parametrize(("a", "b", "want"), [((10, 10, 30, 30), (20, 20, 40, 40), True), ((10, 10, 20, 20), (30, 30, 40, 40), False), ((0, 0, 10, 10), (10, 0, 20, 10), False), ((10, 10, 5, 30, 30, 15), (20, 20, 10, 40, 40, 20), True), ((10, 10, 5, 20, 20, 10), (30, 30, 15, 40, 40, 20), False)])
def test_boxes(spark, a, b, want):
    n = len(a) // 2
    schema = "k int, label int, " + ", ".join(f"bbox_{i} int" for i in range(2 * n))
    x, y = (spark.createDataFrame([(0, 1, *box)], schema) for box in (a, b))
    for cell in (4, 7, 64):
        assert overlap.box_pairs(x, y, ["k"], n, cell=cell).count() == int(want)
    u = overlap.box_union(x.unionByName(y), ["k"], n).first()
    assert [u[f"bbox_{i}"] for i in range(2 * n)] == [*(min(p) for p in zip(a[:n], b[:n])), *(max(p) for p in zip(a[n:], b[n:]))]


# Pipelines


def test_chain(spark):
    double = lambda d: d.withColumn("v", F.col("v") * 2)
    assert chain(double, double)(spark.createDataFrame([(1,)], "v int")).first()["v"] == 4


def test_segmentation(spark):
    a = np.zeros((30, 30), dtype=int)
    a[2:6, 2:6], a[10:20, 10:20], a[25, 25] = 200, 200, 200
    df = rows_of(spark, a, k=0)
    how = Segmentation(mask=lambda v: th.range_mask(v, 100, None), ranges=[Range("area", (2, 50))])
    labels, props = segment(df, ["k"], how)
    assert [r["label"] for r in props.collect()] == [1] and labels.count() == 16 and "area" in props.columns
    outside = df.where("x > 3")
    assert segment(df, ["k"], how, included=outside)[0].count() == 8 and segment(df, ["k"], how, excluded=outside)[0].count() == 8
    hows = [how, Segmentation(mask=lambda v: th.range_mask(v, 100, None))]
    assert segment_series(df, ["k"], hows).where("step = 1").count() == 16 + 100 + 1
    steps = segment_iteratively(df, ["k"], hows, shape=(30, 30), most=30, output="list")
    assert steps[0].count() == 16 and steps[1].count() == 101
    assert combined(steps, ["k"], ["y", "x"], "combine").count() == 117 and combined(steps, ["k"], ["y", "x"], "last").count() == 101
    with pytest.raises(ValueError):
        combined(steps, ["k"], ["y", "x"], "mean")


def test_coincidence(spark, squares):
    labels = {n: rows_of(spark, np.roll(squares, s, axis=0), "label", k=0).where("label > 0") for n, s in (("A", 0), ("B", 2), ("C", 50))}
    props = {n: regions.region_properties(d, ["k"], ["y", "x"], ["area"]) for n, d in labels.items()}
    got = coincidence(labels, props, ["k"], ["y", "x"])["A"].where("label = 1").first()
    assert got["B +"] and abs(got["dice B +"] - 0.9) < 1e-12 and not got["C +"]


def test_reshaping(spark):
    df = spark.createDataFrame([("F", 0, y, x, 1.0) for y in range(2) for x in range(2)], "c string, z int, y int, x int, v double")
    assert select.squeeze(df, ["c", "z", "y"]).columns == ["y", "x", "v"]
    assert select.unsqueeze(df.select("y", "x", "v")).columns == ["t", "c", "z", "y", "x", "v"]
    assert {r["c"] for r in select.rename_channels(df, {"F": "G", "G": "F"}).collect()} == {"G"}
    assert set(select.unstack(df, "c", ["F", "O"])) == {"F", "O"} and select.substack(df.withColumn("t", F.col("y")), "T:2").count() == 2
