"""Array work on planes and volumes, by whole slices or by tiles with a border of their neighbours' pixels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.model import slice_key

#: Border modes by the name NumPy pads them under (fixed values): reflect repeats the border pixel, mirror doesn't.
PADDING = {"reflect": "symmetric", "nearest": "edge", "mirror": "reflect", "wrap": "wrap", "constant": "constant"}


def pad(a: np.ndarray, widths: list[tuple[int, int]], mode: str) -> np.ndarray:
    """Padded as far as asked, also further than the array is long."""
    if mode not in PADDING:
        raise ValueError(f"border mode: one of {sorted(PADDING)}")
    return np.pad(a, widths, mode=PADDING[mode])


def dense(pdf: pd.DataFrame, axes: list[str], value: str, low: list[int], shape: list[int], fill: float = 0.0) -> np.ndarray:
    out = np.full(shape, fill, dtype=float)
    out[tuple(pdf[a].to_numpy() - lo for a, lo in zip(axes, low))] = pdf[value].to_numpy(dtype=float)
    return out


def stencil(df: DataFrame, axes: list[str], work: Callable[[np.ndarray], np.ndarray], reach: int, *, mode: str = "reflect", value: str = "v", tile: int | None = None) -> DataFrame:
    """df with `value` replaced by what `work` makes of each slice.

    `work` gets the slice padded by `reach` on every side and gives back an array without the padding. Slices are filled
    up to their box with 0 (missing pixels are 0), but only pixels that df has come out. With `tile`, a slice is cut
    into tiles that are worked on alone, each with the pixels within reach, so a slice needn't fit into a task; the
    border mode wrap needs pixels from the far side and can't be tiled. Null values are 0.
    """
    key = slice_key(df.columns, axes, [value])
    schema = T.StructType([*(df.schema[c] for c in (*key, *axes)), T.StructField(value, T.DoubleType())])
    if tile is None:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            low = [int(pdf[a].min()) for a in axes]
            shape = [int(pdf[a].max()) - lo + 1 for a, lo in zip(axes, low)]
            made = work(pad(dense(pdf.fillna({value: 0.0}), axes, value, low, shape), [(reach, reach)] * len(axes), mode))
            return pdf[[*key, *axes]].assign(**{value: made[tuple(pdf[a].to_numpy() - lo for a, lo in zip(axes, low))]})

        if not key:
            df = df.withColumn("one_slice", F.lit(0))
        return df.groupBy(*(key or ["one_slice"])).applyInPandas(whole, schema)
    if mode == "wrap":
        raise ValueError("wrap can't be tiled")
    spans = df.groupBy(*key).agg(*(f(a).alias(f"{a}_{n}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))))
    placed = df.join(spans, key) if key else df.join(F.broadcast(spans))
    for a in axes:
        first = F.floor((F.greatest(F.col(a) - reach, F.col(f"{a}_lo")) - F.col(f"{a}_lo")) / tile)
        last = F.floor((F.least(F.col(a) + reach, F.col(f"{a}_hi")) - F.col(f"{a}_lo")) / tile)
        placed = placed.withColumn(f"{a}_tile", F.explode(F.sequence(first, last)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        begin = [int(row[f"{a}_lo"] + row[f"{a}_tile"] * tile) for a in axes]
        end = [min(b + tile, int(row[f"{a}_hi"]) + 1) for a, b in zip(axes, begin)]
        low = [max(b - reach, int(row[f"{a}_lo"])) for a, b in zip(axes, begin)]
        high = [min(e + reach, int(row[f"{a}_hi"]) + 1) for a, e in zip(axes, end)]
        a = dense(pdf.fillna({value: 0.0}), axes, value, low, [h - lo for lo, h in zip(low, high)])
        # Only sides at the slice's border lack pixels.
        a = pad(a, [(reach - (b - lo), reach - (h - e)) for lo, b, e, h in zip(low, begin, end, high)], mode)
        made = work(a)
        core = reduce(np.logical_and, [(pdf[x] >= b) & (pdf[x] < e) for x, b, e in zip(axes, begin, end)])
        own = pdf[core]
        return own[[*key, *axes]].assign(**{value: made[tuple(own[x].to_numpy() - b for x, b in zip(axes, begin))]})

    return placed.groupBy(*key, *(f"{a}_tile" for a in axes)).applyInPandas(one, schema)


def each_slice(df: DataFrame, axes: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """(key, …): the rows that `work` makes of each slice's rows, with the columns of `schema`; a slice is one task's work."""
    key = [c for c in df.columns if c not in axes and c != "v"]
    fields = T.StructType([*(df.schema[c] for c in key), *T._parse_datatype_string(schema).fields]) if isinstance(schema, str) else schema

    def run(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = work(pdf)
        return made.assign(**dict(zip(key, name)))[fields.names]

    return df.groupBy(*key).applyInPandas(run, fields)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    return w / w.sum()


def along(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sum over a sliding window along one axis; the result is shorter by the window less one."""
    n = a.shape[axis] - len(weights) + 1
    out = np.zeros([n if k == axis else s for k, s in enumerate(a.shape)])
    for k, w in enumerate(weights):
        out += w * np.take(a, range(k, k + n), axis=axis)
    return out


def smoothed(a: np.ndarray, weights: list[np.ndarray], reach: int) -> np.ndarray:
    """Of an array padded by `reach`, the separable filter's result without the padding."""
    for axis, w in enumerate(weights):
        spare = reach - len(w) // 2
        a = np.take(a, range(spare, a.shape[axis] - spare), axis=axis)
        a = along(a, w, axis)
    return a
