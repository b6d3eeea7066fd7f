"""Intensities: rescaling, temporal mean, difference of Gaussians, resizing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.model import slice_key
from voxelloom.operators.stencil import dense, gaussian_weights, smoothed, stencil

#: Ranges of integer types (fixed values).
INTEGERS = {"uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, 4294967295), "int8": (-128, 127), "int16": (-32768, 32767), "int32": (-2147483648, 2147483647)}


def with_extremes(df: DataFrame, stack: list[str], value: str = "v") -> DataFrame:
    """df with v_min and v_max of the whole stack: one aggregation and a join, so no task holds a stack."""
    ends = df.groupBy(*stack).agg(F.min(value).alias("v_min"), F.max(value).alias("v_max"))
    return df.join(ends, stack) if stack else df.join(F.broadcast(ends))


def unit(value: Column) -> Column:
    """0 to 1 between v_min and v_max; 0 where they are equal."""
    return F.when(F.col("v_max") > F.col("v_min"), (value - F.col("v_min")) / (F.col("v_max") - F.col("v_min"))).otherwise(F.lit(0.0))


def rescale(df: DataFrame, stack: list[str], *, normalize: bool = True, dtype: str | None = None, value: str = "v") -> DataFrame:
    """Values as `dtype` over the range of the whole stack.

    float (the default): 0 to 1; a constant stack is 0. Integers: over the type's range, cut off after the point; a
    constant stack is 0 to 1's lowest if normalised before, else the middle of the range. Nulls stay null.
    """
    out = with_extremes(df, stack, value)
    if dtype in (None, "float", "float32", "float64"):
        scaled = unit(F.col(value))
    else:
        low, high = INTEGERS[dtype]
        spread = F.least(F.greatest(unit(F.col(value)) * float(high - low) + float(low), F.lit(float(low))), F.lit(float(high))).cast("bigint")
        middle = F.lit(int((low + high) / 2)).cast("bigint")
        scaled = spread if normalize else F.when(F.col("v_max") > F.col("v_min"), spread).otherwise(middle)
    return out.withColumn(value, F.when(F.col(value).isNotNull(), scaled)).drop("v_min", "v_max")


def temporal_mean(df: DataFrame, window: int = 5, *, exclude_center: bool = True, time: str = "t", value: str = "v") -> DataFrame:
    """Each pixel's mean over `window` frames around its own (one more before than after if even); the first and last
    frame stand in for those beyond. Without its own value if exclude_center. The mean of integers is a double; rescale()
    makes integers of it again."""
    if window < (2 if exclude_center else 1):
        raise ValueError("the window is too short")
    key = slice_key(df.columns, [time], [value])
    w = Window.partitionBy(*key).orderBy(time)
    before, after = window // 2, window - 1 - window // 2
    frame = w.rowsBetween(-before, after)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(w)
    count = F.count(F.lit(1)).over(whole)
    lead = F.greatest(F.lit(0), before - place + 1)
    tail = F.greatest(F.lit(0), place + after - count)
    total = F.sum(value).over(frame) + lead * F.first(value).over(whole) + tail * F.last(value).over(whole)
    mean = (total - F.col(value)) / (window - 1) if exclude_center else total / window
    return df.withColumn(value, mean)


def gaussian(df: DataFrame, axes: list[str], sigma: float | list[float], *, mode: str = "reflect", value: str = "v", tile: int | None = None) -> DataFrame:
    """Each slice smoothed by a Gaussian, cut off at four deviations."""
    sigmas = [sigma] * len(axes) if isinstance(sigma, (int, float)) else list(sigma)
    weights = [gaussian_weights(s) for s in sigmas]
    reach = max(len(w) // 2 for w in weights)
    return stencil(df, axes, lambda a: smoothed(a, weights, reach), reach, mode=mode, value=value, tile=tile)


def difference_of_gaussians(df: DataFrame, axes: list[str], low: float = 1.0, high: float = 5.0, *, mode: str = "reflect", value: str = "v", tile: int | None = None) -> DataFrame:
    """Smoothed by `low` less smoothed by `high`, in one pass over each slice."""
    if not 0 <= low < high:
        raise ValueError("low must be less than high")
    narrow, wide = gaussian_weights(low), gaussian_weights(high)
    reach = len(wide) // 2
    n = len(axes)
    return stencil(df, axes, lambda a: smoothed(a, [narrow] * n, reach) - smoothed(a, [wide] * n, reach), reach, mode=mode, value=value, tile=tile)


def target_size(h: int, w: int, height: int | None, width: int | None) -> tuple[int, int]:
    """Both sizes, one of them perhaps from the other by the aspect."""
    if height is None and width is None:
        raise ValueError("give a height or a width")
    if height is None:
        return max(1, int(width / (w / h))), width
    return height, max(1, int(height * (w / h))) if width is None else width


def resize(df: DataFrame, key: list[str], shape: tuple[int, int], height: int | None = None, width: int | None = None, *, order: int = 1, value: str = "v") -> DataFrame:
    """Planes of `shape` (height, width) resampled at src = (dst + 0.5) * in / out - 0.5, beyond the border the nearest
    pixel: order 0 takes the nearest, 1 weighs two by two. Each pixel goes to the few it has a part in and parts are
    added up: one shuffle, no plane in one task. Missing pixels are 0."""
    (h, w), (oh, ow) = shape, target_size(*shape, height, width)
    taps = {}
    for axis, n, m in (("y", h, oh), ("x", w, ow)):
        src = (np.arange(m) + 0.5) * n / m - 0.5
        rows: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for dst, s in enumerate(src):
            if order == 0:
                rows[int(np.clip(np.floor(s + 0.5), 0, n - 1))].append((dst, 1.0))
            else:
                lo, part = int(np.floor(s)), float(s - np.floor(s))
                for at, weight in ((lo, 1 - part), (lo + 1, part)):
                    if weight > 0:
                        rows[int(np.clip(at, 0, n - 1))].append((dst, weight))
        taps[axis] = df.sparkSession.createDataFrame([(k, r) for k, r in enumerate(rows)], f"{axis} int, taps_{axis} array<struct<at: int, weight: double>>")
    if order not in (0, 1):
        raise ValueError("order 0 or 1 here; resize_cubic() for order 3")
    # One row for each line of the plane's own size.
    out = df.join(F.broadcast(taps["y"]), "y").join(F.broadcast(taps["x"]), "x")
    out = out.select(*key, value, F.explode("taps_y").alias("ty"), "taps_x").select(*key, value, "ty", F.explode("taps_x").alias("tx"))
    part = F.col(value) * F.col("ty.weight") * F.col("tx.weight")
    return out.groupBy(*key, F.col("ty.at").alias("y"), F.col("tx.at").alias("x")).agg(F.sum(part).alias(value))


def _cubic(n: int, m: int) -> np.ndarray:
    """Interpolation by cubic convolution with a = -0.5, beyond the border the nearest pixel."""
    src = (np.arange(m) + 0.5) * n / m - 0.5
    out = np.zeros((m, n))
    for dst, s in enumerate(src):
        base = int(np.floor(s))
        for at in range(base - 1, base + 3):
            d = abs(s - at)
            weight = 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0
            out[dst, min(max(at, 0), n - 1)] += weight
    return out


def resize_cubic(df: DataFrame, key: list[str], shape: tuple[int, int], height: int | None = None, width: int | None = None, *, anti_alias: bool = True, value: str = "v") -> DataFrame:
    """Planes resampled by cubic convolution, smoothed first by sigma = (in / out - 1) / 2 where they shrink."""
    (h, w), (oh, ow) = shape, target_size(*shape, height, width)
    by_y, by_x = _cubic(h, oh), _cubic(w, ow)
    sigmas = [max(0.0, (n / m - 1) / 2) for n, m in ((h, oh), (w, ow))]
    weights = [gaussian_weights(s) for s in sigmas]
    reach = max(len(k) // 2 for k in weights)
    schema = T.StructType([*(df.schema[c] for c in key), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField(value, T.DoubleType())])
    yy, xx = (a.ravel().astype(np.int32) for a in np.mgrid[0:oh, 0:ow])

    def plane(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = dense(pdf.fillna({value: 0.0}), ["y", "x"], value, [0, 0], [h, w])
        if anti_alias and reach:
            a = smoothed(np.pad(a, reach, mode="symmetric"), weights, reach)
        return pd.DataFrame({**dict(zip(key, name)), "y": yy, "x": xx, value: (by_y @ a @ by_x.T).ravel()})

    return df.groupBy(*key).applyInPandas(plane, schema)


def frame_bytes(df: DataFrame, frame: list[str], value: str = "v") -> DataFrame:
    """Values as bytes, each frame scaled by its own greatest; a frame without values above 0 is 0."""
    top = df.groupBy(*frame).agg(F.max(value).alias("frame_max"))
    scaled = F.when(F.col("frame_max") > 0, F.greatest(F.lit(0.0), F.col(value) / F.col("frame_max") * 255.0)).otherwise(F.lit(0.0))
    return df.join(top, frame).withColumn(value, scaled.cast("int")).drop("frame_max")
