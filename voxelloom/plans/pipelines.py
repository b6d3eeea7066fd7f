"""Operators put together: a pipeline is a fold of functions from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.components import dilate_to_area, label_components, remove_labels, unique_labels
from voxelloom.operators.overlap import coincidence_features, join_features
from voxelloom.operators.predicates import Range, filter_regions
from voxelloom.operators.regions import region_properties
from voxelloom.operators.threshold import exclude, include, union
from voxelloom.runtime import Scratch

Step = Callable[[DataFrame], DataFrame]


def chain(*steps: Step) -> Step:
    """One step of several, the first one first."""
    return lambda df: reduce(lambda d, step: d.transform(step), steps, df)


@dataclass(frozen=True)
class Segmentation:
    """How a stack is segmented. `mask` makes a mask of intensities; regions must be within all `ranges`."""

    mask: Step
    axes: list[str] = field(default_factory=lambda: ["y", "x"])
    connectivity: int = 1
    ranges: list[Range] = field(default_factory=list)
    properties: list[str] = field(default_factory=lambda: ["label", "centroid"])
    unique: bool = False
    renumber: bool = False
    spacing: list[float] | None = None
    tile: int | None = None


def segment(voxels: DataFrame, key: list[str], how: Segmentation, *, included: DataFrame | None = None, excluded: DataFrame | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, regions): mask, in- and exclusion, components, properties, filter, and labels of kept regions only.

    The properties that ranges need are computed too. Labels are written once, as both results come from them.
    """
    scratch = scratch or Scratch(voxels.sparkSession, "segment")
    pixel = [*key, *how.axes]
    mask = how.mask(voxels).select(*pixel)
    if included is not None:
        mask = include(mask, included, pixel)
    if excluded is not None:
        mask = exclude(mask, excluded, pixel)
    labels = label_components(mask, how.axes, how.connectivity, tile=how.tile)
    if how.unique:
        labels = unique_labels(labels, key)
    labels = scratch.save(labels, "labels")
    wanted = dict.fromkeys([*how.properties, *(r.attribute for r in how.ranges)])
    regions = region_properties(labels, key, how.axes, list(wanted), how.spacing)
    kept, removed = filter_regions(regions, how.ranges, key)
    if how.ranges:
        labels = remove_labels(labels, removed, key, renumber=how.renumber)
    return labels, kept


OUTPUTS = ("last", "stack", "combine", "list")


def combined(results: list[DataFrame], key: list[str], axes: list[str], output: str) -> DataFrame | list[DataFrame]:
    """Several label images as one: the last; all with `step`; labels added up by pixel; or a list."""
    if output not in OUTPUTS:
        raise ValueError(f"output is one of {OUTPUTS}")
    if output == "list":
        return results
    if output == "last":
        return results[-1]
    numbered = [r.select(*key, *axes, "label").withColumn("step", F.lit(k)) for k, r in enumerate(results)]
    stacked = reduce(DataFrame.unionByName, numbered)
    return stacked if output == "stack" else stacked.groupBy(*key, *axes).agg(F.sum("label").cast("int").alias("label"))


def segment_series(voxels: DataFrame, key: list[str], hows: list[Segmentation], *, output: str = "stack") -> DataFrame | list[DataFrame]:
    """Segmented in several ways that don't know of each other."""
    return combined([segment(voxels, key, how)[0] for how in hows], key, hows[0].axes, output)


def segment_iteratively(voxels: DataFrame, key: list[str], hows: list[Segmentation], *, shape: tuple[int, int], most: int = 5000, output: str = "stack", dilate: bool = True) -> DataFrame | list[DataFrame]:
    """Segmented again and again; what was found before, grown to at most `most` pixels a region, is left out."""
    scratch = Scratch(voxels.sparkSession, "iterative")
    pixel = [*key, *hows[0].axes]
    found, results = None, []
    for k, how in enumerate(hows):
        labels = scratch.save(segment(voxels, key, how, excluded=found)[0], f"labels{k}")
        results.append(labels)
        grown = dilate_to_area(labels, key, most, shape) if dilate else labels
        found = scratch.save(union([grown] if found is None else [found, grown], pixel), f"found{k}")
    return combined(results, key, hows[0].axes, output)


def coincidence(labels: dict[str, DataFrame], regions: dict[str, DataFrame], key: list[str], axes: list[str], *, method: str = "dice", threshold: float = 0.1) -> dict[str, DataFrame]:
    """For each channel its regions with what overlaps them in every other channel: whether any label does by
    `threshold` or more, and the best score. Regions without pixels are left out."""
    names = list(labels)
    features: dict[str, list[DataFrame]] = {n: [] for n in names}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            of_a, of_b = coincidence_features(labels[a], labels[b], key, axes, (a, b), method=method, threshold=threshold)
            features[a].append(of_a)
            features[b].append(of_b)
    return {n: join_features(regions[n], features[n], [*key, "label"], labels[n]) for n in names}
