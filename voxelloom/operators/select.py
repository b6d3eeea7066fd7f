"""Selecting, renaming and reshaping: axes are columns, so most reshaping is a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.functions.parse import AXES, substack_ranges


def substack(df: DataFrame, text: str | None, first_axis: str = "T") -> DataFrame:
    """Rows within the ranges; plain comparisons, which reach the scan."""
    for axis, (start, stop) in substack_ranges(text, first_axis).items():
        df = df.where((F.col(axis.lower()) >= start) & (F.col(axis.lower()) < stop))
    return df


def rename_channels(df: DataFrame, names: dict[str, str], column: str = "c") -> DataFrame:
    """Channels by their new names; those not named stay. Names are swapped at once, not one after the other."""
    if not names:
        return df
    out = F.col(column)
    lookup = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return df.withColumn(column, F.coalesce(F.try_element_at(lookup, out), out))


def grayscale(df: DataFrame, channel: str = "c", value: str = "v") -> DataFrame:
    """The mean over channels, as channel 0."""
    rest = [c for c in df.columns if c not in (channel, value)]
    return df.groupBy(*rest).agg(F.avg(value).alias(value)).withColumn(channel, F.lit(0))


def unstack(df: DataFrame, axis: str, values: list) -> dict:
    """A stack for each place along an axis, without that axis."""
    return {v: df.where(F.col(axis) == v).drop(axis) for v in values}


def squeeze(df: DataFrame, axes: list[str]) -> DataFrame:
    """Without the axes that have one place only (or none). One aggregation tells which."""
    if not axes:
        return df
    spans = df.agg(*(F.min(a).alias(f"{a}_lo") for a in axes), *(F.max(a).alias(f"{a}_hi") for a in axes)).first()
    return df.drop(*(a for a in axes if spans[f"{a}_lo"] == spans[f"{a}_hi"]))


def unsqueeze(df: DataFrame, target: str = AXES) -> DataFrame:
    """With all axes of the target order, those that were missing having the one place 0."""
    wanted = [a.lower() for a in target]
    out = df.withColumns({a: F.lit(0) for a in wanted if a not in df.columns})
    rest = [c for c in df.columns if c not in wanted]
    coordinates = [c for c in rest if c in ("image_id", "scene")]
    return out.select(*coordinates, *wanted, *(c for c in rest if c not in coordinates))


def masks_to_labels(masks: DataFrame, pixel: list[str], mask_id: str = "mask_id") -> DataFrame:
    """(pixel, label) of (pixel, mask_id), mask ids counted from 1; where masks overlap their ids add up."""
    return masks.groupBy(*pixel).agg(F.sum(mask_id).cast("int").alias("label"))


def labels_to_masks(labels: DataFrame, key: list[str], label: str = "label", include_background: bool = False) -> DataFrame:
    """A mask id for each label of a slice, in order of the labels; background has none unless asked for.

    The ranking is of distinct labels, not of pixels.
    """
    kept = labels if include_background else labels.where(F.col(label) != 0)
    by = Window.partitionBy(*key).orderBy(label) if key else Window.orderBy(label)
    ids = kept.select(*key, label).distinct().withColumn("mask_id", F.row_number().over(by))
    return kept.join(ids, [*key, label])


def resized_manifest(manifest: DataFrame, shape: Column) -> DataFrame:
    """The manifest of images resized to `shape` (array<int>, aligned to the last axes): shape, scale and pixel sizes
    change by the ratio of old to new. Axes that are gone are dropped from the front; new ones have size 1."""
    old = F.col("shape")
    n = F.size(shape)
    kept = F.concat(F.array_repeat(F.lit(1), F.greatest(F.lit(0), n - F.size(old))), F.slice(old, F.greatest(F.lit(1), F.size(old) - n + 1), F.least(n, F.size(old))))
    axes = F.slice("axes", F.greatest(F.lit(1), F.size("axes") - n + 1), F.least(n, F.size("axes")))
    ratios = F.map_from_arrays(axes, F.slice(F.zip_with(kept, shape, lambda a, b: a / b), F.greatest(F.lit(1), n - F.size("axes") + 1), F.size(axes)))

    def by(axis: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("new_ratios"), axis), F.lit(1.0))

    out = manifest.withColumn("new_ratios", ratios)
    return out.withColumns(
        {
            "shape": shape,
            "axes": axes,
            "scale": F.transform_values("scale", lambda axis, size: size * by(axis)),
            "physical_pixel_sizes": F.struct(*((F.col(f"physical_pixel_sizes.{a}") * by(F.lit(a))).alias(a) for a in "ZYX")),
        }
    ).drop("new_ratios")
