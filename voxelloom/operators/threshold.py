"""Masks from intensities. A mask is sparse: only its pixels are rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.operators.stencil import along, gaussian_weights, smoothed, stencil


def range_mask(df: DataFrame, low: float | None = None, high: float | None = None, *, relative_to: list[str] | None = None, value: str = "v") -> DataFrame:
    """Pixels with low <= value <= high; a missing bound bounds nothing. With `relative_to` (the slice's key) the bounds
    are shares of the slice's span."""
    if relative_to is None:
        for bound, keep in ((low, F.col(value) >= low if low is not None else None), (high, F.col(value) <= high if high is not None else None)):
            if bound is not None:
                df = df.where(keep)
        return df.where(F.col(value).isNotNull())
    ends = df.groupBy(*relative_to).agg(F.min(value).alias("lo"), (F.max(value) - F.min(value)).alias("span"))
    kept = df.join(ends, relative_to)
    for bound, up in ((low, True), (high, False)):
        if bound is not None:
            at = F.col("lo") + bound * F.col("span")
            kept = kept.where(F.col(value) >= at if up else F.col(value) <= at)
    return kept.drop("lo", "span")


def otsu_thresholds(df: DataFrame, key: list[str], value: str = "v", bins: int | None = None) -> DataFrame:
    """(key, threshold): the value that parts each slice with the greatest variance between both sides, the lowest of
    equals. By distinct values, or by the centres of `bins` equal bins between the slice's least and greatest value.

    The work is on histograms, counted before any shuffle; the sums of integers are exact.
    """
    data = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    level = F.col(value)
    if bins:
        ends = data.groupBy(*key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        data = data.join(ends, key)
        width = (F.col("hi") - F.col("lo")) / bins
        at = F.least(F.floor((level - F.col("lo")) / width), F.lit(bins - 1))
        level = F.when(width > 0, F.col("lo") + (at + 0.5) * width).otherwise(F.col("lo"))
    counts = data.groupBy(*key, level.alias("level")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy("level")
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
    mass = F.col("n") * F.col("level")
    sums = counts.select(*key, "level", F.sum("n").over(upto).alias("n0"), F.sum(mass).over(upto).alias("s0"), F.sum("n").over(whole).alias("n1"), F.sum(mass).over(whole).alias("s1"))
    rest = F.col("n1") - F.col("n0")
    apart = F.col("s0") / F.col("n0") - (F.col("s1") - F.col("s0")) / rest
    between = F.when(rest > 0, F.col("n0").cast("double") * rest * apart * apart).otherwise(F.lit(0.0))
    best = Window.partitionBy(*key).orderBy(F.col("between").desc(), "level")
    ranked = sums.withColumn("between", between).withColumn("place", F.row_number().over(best))
    return ranked.where("place = 1").select(*key, F.col("level").alias("threshold"))


def otsu_mask(df: DataFrame, key: list[str], value: str = "v", bins: int | None = None) -> DataFrame:
    """Pixels above their slice's threshold."""
    return df.join(otsu_thresholds(df, key, value, bins), key).where(F.col(value) > F.col("threshold")).drop("threshold")


def _odd(block: int) -> int:
    if block < 1 or block % 2 == 0:
        raise ValueError("the block's size must be odd")
    return block // 2


def _windows(a: np.ndarray, block: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(a, (block,) * a.ndim)


def local_thresholds(df: DataFrame, axes: list[str], block: int = 51, *, method: str | Callable[[np.ndarray], float] = "gaussian", offset: float = 0.0, mode: str = "reflect", value: str = "v", tile: int | None = None, k: float = 0.2, r: float | None = None) -> DataFrame:
    """df with `threshold` for each pixel, from the block around it.

    mean, median, gaussian (deviation (block - 1) / 6, cut off at four deviations), niblack (mean - k * deviation), sauvola
    (mean * (1 + k * (deviation / r - 1)), r = 128 by default), or a function of the block's values. Less `offset`.
    """
    half = _odd(block)
    box = np.full(block, 1.0 / block)

    def mean(a: np.ndarray) -> np.ndarray:
        for axis in range(a.ndim):
            a = along(a, box, axis)
        return a

    reach = half
    if method == "gaussian":
        w = gaussian_weights((block - 1) / 6)
        reach = len(w) // 2
        work = lambda a: smoothed(a, [w] * a.ndim, reach)
    elif method == "mean":
        work = mean
    elif method == "median":
        work = lambda a: np.median(_windows(a, block), axis=tuple(range(-a.ndim, 0)))
    elif method in ("niblack", "sauvola"):

        def work(a: np.ndarray) -> np.ndarray:
            m = mean(a)
            s = np.sqrt(np.maximum(0.0, mean(a * a) - m * m))
            return m - k * s if method == "niblack" else m * (1 + k * (s / (r or 128.0) - 1))

    elif callable(method):
        work = lambda a: np.apply_along_axis(method, -1, _windows(a, block).reshape(*(n - block + 1 for n in a.shape), -1))
    else:
        raise ValueError(f"no such method: {method}")
    at = stencil(df.withColumn("threshold", F.col(value).cast("double")).drop(value), axes, work, reach, mode=mode, value="threshold", tile=tile)
    key = [c for c in df.columns if c != value]
    return df.join(at.withColumn("threshold", F.col("threshold") - offset), key)


def local_mask(df: DataFrame, axes: list[str], block: int = 51, **options: object) -> DataFrame:
    """Pixels above the threshold of their surroundings."""
    value = options.get("value", "v")
    return local_thresholds(df, axes, block, **options).where(F.col(value) > F.col("threshold")).drop("threshold")


def local_mean_mask(df: DataFrame, key: list[str], shape: tuple[int, int], block: int, offset: float = 0.0, value: str = "v") -> DataFrame:
    """Pixels of planes of one shape above the mean of their block, with reflected borders, all by shuffled partial sums:
    first along y, then along x."""
    half = _odd(block)
    sums = df.select(*key, "y", "x", F.col(value).alias("s"))
    for axis, n in (("y", shape[0]), ("x", shape[1])):
        other = "x" if axis == "y" else "y"
        # A pixel counts at every place that it, or its reflection beyond the border, is within reach of.
        images = (F.col(axis), -1 - F.col(axis), 2 * n - 1 - F.col(axis))
        places = F.concat(*(F.sequence(image - half, image + half) for image in images))
        spread = sums.withColumn("at", F.explode(places)).where((F.col("at") >= 0) & (F.col("at") < n))
        sums = spread.groupBy(*key, F.col("at").alias(axis), other).agg(F.sum("s").alias("s"))
    return df.join(sums, [*key, "y", "x"]).where(F.col(value) > F.col("s") / (block * block) - offset).drop("s")


def include(mask: DataFrame, other: DataFrame, pixel: list[str]) -> DataFrame:
    """The mask's pixels that the other has too."""
    return mask.join(other.select(*pixel).distinct(), pixel, "left_semi")


def exclude(mask: DataFrame, other: DataFrame, pixel: list[str]) -> DataFrame:
    """The mask's pixels that the other has not."""
    return mask.join(other.select(*pixel).distinct(), pixel, "left_anti")


def union(masks: list[DataFrame], pixel: list[str]) -> DataFrame:
    out = masks[0].select(*pixel)
    for m in masks[1:]:
        out = out.unionByName(m.select(*pixel))
    return out.distinct()
