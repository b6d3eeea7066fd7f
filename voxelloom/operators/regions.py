"""Properties of labelled regions: one aggregation for all that are sums, kernels for those that need a region's shape."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.operators.components import component_ids

NAN = float("nan")


def _moments(axes: list[str], spacing: list[float]) -> dict[str, Column]:
    out = {}
    for i, a in enumerate(axes):
        for j, b in enumerate(axes[i:], i):
            out[f"cov_{a}{b}"] = (F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")) if i != j else F.var_samp(F.col(a).cast("double"))) * (spacing[i] * spacing[j])
    return out


def eigenvalues_2d(yy: Column, yx: Column, xx: Column) -> tuple[Column, Column]:
    """Greater and lesser eigenvalue of a symmetric 2 x 2 matrix."""
    root = F.sqrt((yy - xx) * (yy - xx) + 4 * yx * yx)
    return (yy + xx + root) / 2, (yy + xx - root) / 2


def eigenvalues_3d(m: dict[str, Column], z: str, y: str, x: str) -> tuple[Column, Column]:
    """Greatest and least eigenvalue of a symmetric 3 x 3 matrix, by the angles of its characteristic cubic."""
    a, b, c = m[z + z], m[y + y], m[x + x]
    d, e, f = m[z + y], m[y + x], m[z + x]
    q = (a + b + c) / 3
    p = F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6)
    det = (a - q) * ((b - q) * (c - q) - e * e) - d * (d * (c - q) - e * f) + f * (d * e - (b - q) * f)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))) / 3
    first = F.when(p > 0, q + 2 * p * F.cos(phi)).otherwise(q)
    last = F.when(p > 0, q + 2 * p * F.cos(phi + 2 * math.pi / 3)).otherwise(q)
    return first, last


#: Properties of an aggregation, by what they're called for planes; for volumes area is volume.
BASIC = ["label", "centroid", "bbox", "area", "num_pixels", "extent", "equivalent_diameter", "aspect_ratio", "eccentricity", "axis_major_length", "axis_minor_length", "orientation", "moments", "inertia_tensor", "coords", "slice"]
SHAPED = ["area_filled", "perimeter", "circularity", "solidity", "area_convex", "feret_diameter_max", "euler_number", "cross_sectional_area", "sphericity_faces"]
VOLUME_NAMES = {"area": "volume", "circularity": "sphericity_faces"}


#: A function of a region's mask in its box, a row of booleans for each line, that gives one number.
RegionFunction = Callable[[np.ndarray], float]


def checked_properties(names: list[str] | None, dims: int) -> list[str]:
    """What is asked for, label first: label and centroid if nothing is. For volumes area means volume and circularity
    sphericity, for planes the reverse."""
    names = list(names or ["label", "centroid"])
    swap = VOLUME_NAMES if dims >= 3 else {v: k for k, v in VOLUME_NAMES.items()}
    names = [swap.get(n, n) for n in names]
    known = {*BASIC, *SHAPED, *VOLUME_NAMES.values()}
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"no such properties: {unknown}")
    return list(dict.fromkeys(["label", *names]))


def basic_properties(labels: DataFrame, key: list[str], axes: list[str], spacing: list[float] | None = None, *, coords: bool = False) -> DataFrame:
    """(key, label, area, centroid_*, bbox_*, extent, equivalent_diameter, aspect_ratio, …) of labels above 0.

    area (volume for three axes) is the number of pixels times the spacing; centroid_i in units of the spacing; bbox
    half-open in pixels, all lower ends first. aspect_ratio = sqrt(least / greatest eigenvalue of the coordinates' sample
    covariance), not a number for regions with fewer pixels than axes or without extent along one. eccentricity and
    axis lengths (planes) from the covariance of pixels as squares of side 1 (a twelfth added on the diagonal); those of
    volumes are the axes of the ellipsoid with the pixels' covariance. inertia_ij: trace less covariance on the diagonal,
    the covariance with its sign turned beside it. With `coords` the pixels' places too, in order.
    """
    n, spacing = len(axes), [float(s) for s in (spacing or [1.0] * len(axes))]
    size = abs(math.prod(spacing))
    count = F.count(F.lit(1))
    aggregates = {"num_pixels": count}
    aggregates |= {f"centroid_{k}": F.avg(F.col(a)) * spacing[k] for k, a in enumerate(axes)}
    aggregates |= {f"bbox_{k}": F.min(a) for k, a in enumerate(axes)}
    aggregates |= {f"bbox_{k + n}": F.max(a) + 1 for k, a in enumerate(axes)}
    aggregates |= _moments(axes, spacing)
    if coords:
        aggregates["coords"] = F.sort_array(F.collect_list(F.struct(*axes)))
    out = labels.where(F.col("label") > 0).groupBy(*key, "label").agg(*(c.alias(a) for a, c in aggregates.items()))
    box = F.lit(1)
    for k in range(n):
        box = box * (F.col(f"bbox_{k + n}") - F.col(f"bbox_{k}"))
    area = "area" if n == 2 else "volume"
    out = out.withColumn(area, F.col("num_pixels") * size if spacing != [1.0] * n else F.col("num_pixels")).withColumn("extent", F.col("num_pixels") / box)
    out = out.withColumn("equivalent_diameter", F.pow(2 * n * F.col(area) / math.pi, F.lit(1.0 / n)) if n == 2 else F.cbrt(6 * F.col(area) / math.pi))
    if n == 2:
        out = out.withColumn("equivalent_diameter", F.sqrt(4 * F.col(area) / math.pi))
        y, x = axes
        yy, yx, xx = F.col(f"cov_{y}{y}"), F.col(f"cov_{y}{x}"), F.col(f"cov_{x}{x}")
        great, least = eigenvalues_2d(yy, yx, xx)
        whole = (F.col("num_pixels") - 1) / F.col("num_pixels")
        fill = [s * s / 12 for s in spacing]
        pyy, pyx, pxx = (F.coalesce(c * whole, F.lit(0.0)) for c in (yy, yx, xx))
        a, b = eigenvalues_2d(pyy + fill[0], pyx, pxx + fill[1])
        out = out.withColumns({"axis_major_length": 4 * F.sqrt(a), "axis_minor_length": 4 * F.sqrt(F.greatest(b, F.lit(0.0))), "eccentricity": F.sqrt(F.greatest(F.lit(0.0), 1 - b / a)), "orientation": 0.5 * F.atan2(2 * pyx, pyy + fill[0] - pxx - fill[1])})
    else:
        great, least = eigenvalues_3d({k[4:]: F.col(k) for k in _moments(axes, spacing)}, *axes)
        # An ellipsoid's half axis is sqrt(5) deviations.
        whole = (F.col("num_pixels") - 1) / F.col("num_pixels")
        out = out.withColumns({c: F.coalesce(2 * F.sqrt(5 * F.greatest(e * whole, F.lit(0.0))), F.lit(0.0)) for c, e in (("axis_major_length", great), ("axis_minor_length", least))})
    flat = (F.col("num_pixels") < n) | great.isNull() | ~(great > 0) | ~(least > 1e-12 * great)
    return out.withColumn("aspect_ratio", F.when(flat, F.lit(NAN)).otherwise(F.sqrt(least / great)))


def _inertia(axes: list[str]) -> dict[str, Column]:
    """The inertia tensor's entries by name, from the sample covariances."""
    whole = (F.col("num_pixels") - 1) / F.col("num_pixels")
    var = [F.coalesce(F.col(f"cov_{a}{a}") * whole, F.lit(0.0)) for a in axes]
    out = {}
    for i, a in enumerate(axes):
        for j, b in enumerate(axes[i:], i):
            out[f"inertia_{i}{j}"] = sum((v for k, v in enumerate(var) if k != i), F.lit(0.0)) if i == j else -F.coalesce(F.col(f"cov_{a}{b}") * whole, F.lit(0.0))
    return out


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes: places that no path along the axes leads to from outside."""
    open_ = np.argwhere(~np.pad(mask, 1))
    part = component_ids(open_, 1)
    out = np.ones([n + 2 for n in mask.shape], dtype=bool)
    out[tuple(open_[part == part[0]].T)] = False
    return out[tuple(slice(1, -1) for _ in mask.shape)]


def function_properties(labels: DataFrame, key: list[str], axes: list[str], functions: dict[str, RegionFunction]) -> DataFrame:
    """(key, label, …): a column for each function of a region's mask. One row a region goes to Python, with its pixels."""
    lists = labels.where(F.col("label") > 0).groupBy(*key, "label").agg(F.collect_list(F.struct(*axes)).alias("pixels")).select(*key, "label", *(F.col(f"pixels.{a}").alias(f"pixels_{a}") for a in axes))
    schema = T.StructType([*(labels.schema[c] for c in (*key, "label")), *(T.StructField(f, T.DoubleType()) for f in functions)])

    def mask_of(places: tuple) -> np.ndarray:
        at = [np.asarray(p) - np.min(p) for p in places]
        out = np.zeros([int(a.max()) + 1 for a in at], dtype=bool)
        out[tuple(at)] = True
        return out

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            masks = [mask_of(p) for p in zip(*(pdf[f"pixels_{a}"] for a in axes))]
            yield pdf[[*key, "label"]].assign(**{name: [float(f(m)) for m in masks] for name, f in functions.items()})

    return lists.mapInPandas(each, schema)


def cross_sections(labels: DataFrame, key: list[str], spacing: list[float] | None = None) -> DataFrame:
    """(key, label, cross_sectional_area): the greatest area of a region in one plane along z, times the plane's spacing."""
    planes = labels.where(F.col("label") > 0).groupBy(*key, "label", "z").agg(F.count("*").alias("n"))
    scale = float(spacing[-1] * spacing[-2]) if spacing else 1.0
    return planes.groupBy(*key, "label").agg((F.max("n") * scale).alias("cross_sectional_area"))


#: Lengths of border steps by the sum of a border pixel's own weight 1, 2 for each neighbour along an axis and 10 for each
#: diagonal one that is on the border too; other sums have none (fixed values).
STEP_LENGTHS = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: math.sqrt(2), 33: math.sqrt(2), 13: (1 + math.sqrt(2)) / 2, 23: (1 + math.sqrt(2)) / 2}

AXIAL = [(-1, 0), (1, 0), (0, -1), (0, 1)]
DIAGONAL = [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def _spread(df: DataFrame, key: list[str], steps: list[tuple[int, int, int]]) -> DataFrame:
    """Each pixel's weight at itself and its neighbours, added up."""
    places = F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(w).alias("w")) for dy, dx, w in steps))).alias("p")
    return df.select(*key, "label", places).select(*key, "label", "p.*").groupBy(*key, "label", "y", "x").agg(F.sum("w").alias("w"))


def perimeters(labels: DataFrame, key: list[str]) -> DataFrame:
    """(key, label, perimeter) of regions in planes: the border's pixels are those without all four neighbours, and its
    length is read from how many border pixels are next to each. Two aggregations, without joins."""
    pixels = labels.where(F.col("label") > 0).select(*key, "label", "y", "x")
    own = 100
    around = _spread(pixels, key, [(0, 0, own), *((dy, dx, 1) for dy, dx in AXIAL)])
    border = around.where((F.col("w") >= own) & (F.col("w") < own + 4)).drop("w")
    near = _spread(border, key, [(0, 0, own + 1), *((dy, dx, 2) for dy, dx in AXIAL), *((dy, dx, 10) for dy, dx in DIAGONAL)])
    code = F.col("w") - own
    length = F.lit(0.0)
    for value, text in STEP_LENGTHS.items():
        length = F.when(code == value, F.lit(text)).otherwise(length)
    return near.where(F.col("w") >= own).groupBy(*key, "label").agg(F.sum(length).alias("perimeter"))


def circularity(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * math.pi * area / (perimeter * perimeter)).otherwise(F.lit(NAN))


def faces(labels: DataFrame, key: list[str], axes: list[str], spacing: list[float] | None = None) -> DataFrame:
    """(key, label, surface): area of a region's faces that don't touch a pixel of the same label."""
    n, spacing = len(axes), list(spacing or [1.0] * len(axes))
    pixels = labels.where(F.col("label") > 0).select(*key, "label", *axes)
    # A face lies between two places; one shared by two pixels of the region appears twice.
    sides = [F.struct(F.lit(k).alias("along"), *((F.col(a) + (d if a == axes[k] else 0)).alias(a) for a in axes)) for k in range(n) for d in (0, 1)]
    each = pixels.select(*key, "label", F.explode(F.array(*sides)).alias("f")).groupBy(*key, "label", "f").agg(F.count("*").alias("n")).where("n = 1")
    area = F.lit(0.0)
    for k in range(n):
        area = F.when(F.col("f.along") == k, float(math.prod(s for j, s in enumerate(spacing) if j != k))).otherwise(area)
    return each.groupBy(*key, "label").agg(F.sum(area).alias("surface"))


def sphericity_faces(volume: Column, surface: Column) -> Column:
    """Surface of the ball of this volume over the area of the faces: 0.806 for a cube. Not the mesh of marching cubes."""
    return F.when(surface > 0, F.pow(F.lit(math.pi), F.lit(1 / 3)) * F.pow(6 * volume, F.lit(2 / 3)) / surface).otherwise(F.lit(NAN))


def euler_numbers(labels: DataFrame, key: list[str]) -> DataFrame:
    """(key, label, euler_number) of plane regions, 8-connected: objects less holes, as corners - edges + pixels."""
    pixels = labels.where(F.col("label") > 0).select(*key, "label", "y", "x")
    cells = [(0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 1)]
    edges = [(1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 0, 1)]
    parts = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for kind, dy, dx in [*cells, *edges, (3, 0, 0)]))).alias("p")
    sign = F.when(F.col("p.kind").isin(1, 2), -1).otherwise(1)
    return pixels.select(*key, "label", parts).distinct().groupBy(*key, "label").agg(F.sum(sign).alias("euler_number"))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, in turn, by monotone chains."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for q in rows.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def _hull_row(y: np.ndarray, x: np.ndarray) -> tuple[int, float]:
    rows = np.unique(y)
    lo, hi = np.full(len(rows), np.inf), np.full(len(rows), -np.inf)
    at = np.searchsorted(rows, y)
    np.minimum.at(lo, at, x)
    np.maximum.at(hi, at, x)
    ends = np.concatenate([np.column_stack([rows, lo]), np.column_stack([rows, hi])])
    around = np.concatenate([ends + d for d in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))])
    h = hull(around)
    inside = 0
    a, b = h, np.roll(h, -1, axis=0)
    for row in range(int(rows[0]), int(rows[-1]) + 1):
        cross = ((a[:, 0] <= row) & (b[:, 0] >= row)) | ((a[:, 0] >= row) & (b[:, 0] <= row))
        s, e = a[cross], b[cross]
        level = e[:, 0] == s[:, 0]
        t = np.where(level, 0.0, (row - s[:, 0]) / np.where(level, 1.0, e[:, 0] - s[:, 0]))
        xs = np.concatenate([s[:, 1] + t * (e[:, 1] - s[:, 1]), e[level, 1]])
        inside += int(math.floor(xs.max() + 1e-9) - math.ceil(xs.min() - 1e-9)) + 1
    corners = hull(np.concatenate([ends + d for d in ((0.5, 0.5), (0.5, -0.5), (-0.5, 0.5), (-0.5, -0.5))]))
    far = max(float(((corners[k:] - corners[k]) ** 2).sum(axis=1).max()) for k in range(len(corners)))
    return inside, math.sqrt(far)


def convex_properties(labels: DataFrame, key: list[str]) -> DataFrame:
    """(key, label, area_convex, solidity, feret_diameter_max) of plane regions.

    area_convex counts the pixels whose centre is in the hull of the middles of the region's pixel sides; solidity is
    the area over it; the greatest diameter is between corners of pixels. Only the two ends of each row of a region
    leave the JVM, as no other pixel can be a corner of the hull.
    """
    pixels = labels.where(F.col("label") > 0)
    rows = pixels.groupBy(*key, "label", "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    # One row for each region, as long as it is high: no group of its own for each in Python.
    outlines = rows.groupBy(*key, "label").agg(F.collect_list("y").alias("y"), F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"), F.sum("n").alias("n"))
    schema = T.StructType([*(labels.schema[c] for c in (*key, "label")), T.StructField("area_convex", T.LongType()), T.StructField("solidity", T.DoubleType()), T.StructField("feret_diameter_max", T.DoubleType())])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [_hull_row(np.concatenate([y, y]).astype(float), np.concatenate([lo, hi]).astype(float)) for y, lo, hi in zip(pdf["y"], pdf["lo"], pdf["hi"])]
            area = np.array([m[0] for m in made], dtype=np.int64)
            yield pdf[[*key, "label"]].assign(area_convex=area, solidity=pdf["n"].to_numpy() / area, feret_diameter_max=[m[1] for m in made])

    return outlines.mapInPandas(each, schema)


def intensity_properties(labels: DataFrame, voxels: DataFrame, key: list[str], axes: list[str], value: str = "v") -> DataFrame:
    """(key, label, intensity_min, intensity_max, intensity_mean) over the pixels that have a value."""
    joined = labels.where(F.col("label") > 0).join(voxels.select(*key, *axes, value), [*key, *axes])
    return joined.groupBy(*key, "label").agg(F.min(value).alias("intensity_min"), F.max(value).alias("intensity_max"), F.avg(value).alias("intensity_mean"))


def region_properties(labels: DataFrame, key: list[str], axes: list[str], names: list[str] | None = None, spacing: list[float] | None = None, *, extra: dict[str, RegionFunction] | None = None) -> DataFrame:
    """The properties asked for, by name; only what they need is computed. `extra` adds properties by functions of the
    region's mask, under names of their own."""
    names, extra = checked_properties(names, len(axes)), dict(extra or {})
    if taken := [n for n in extra if n in (*BASIC, *SHAPED, *VOLUME_NAMES.values(), *key)]:
        raise ValueError(f"names that are taken: {taken}")
    out = basic_properties(labels, key, axes, spacing, coords="coords" in names)
    out = out.withColumns(_inertia(axes)) if "inertia_tensor" in names else out
    on = [*key, "label"]
    if {"perimeter", "circularity"} & {*names}:
        out = out.join(perimeters(labels, key), on, "left").withColumn("circularity", circularity(F.col("num_pixels"), F.col("perimeter")))
    if {"area_convex", "solidity", "feret_diameter_max"} & {*names}:
        out = out.join(convex_properties(labels, key), on, "left")
    if "euler_number" in names:
        out = out.join(euler_numbers(labels, key), on, "left")
    if "cross_sectional_area" in names:
        out = out.join(cross_sections(labels, key, spacing), on, "left")
    if "sphericity_faces" in names:
        out = out.join(faces(labels, key, axes, spacing), on, "left").withColumn("sphericity_faces", sphericity_faces(F.col("volume"), F.col("surface")))
    functions = {**({"area_filled": lambda m: filled(m).sum()} if "area_filled" in names else {}), **extra}
    if functions:
        out = out.join(function_properties(labels, key, axes, functions), on, "left")
    wide = {"inertia_tensor": [c for c in out.columns if c.startswith("inertia_")], "slice": [f"bbox_{k}" for k in range(2 * len(axes))], "centroid": [f"centroid_{k}" for k in range(len(axes))], "bbox": [f"bbox_{k}" for k in range(2 * len(axes))], "moments": [c for c in out.columns if c.startswith("cov_")]}
    return out.select(*key, *dict.fromkeys(c for n in (*names, *extra) for c in wide.get(n, [n])))
