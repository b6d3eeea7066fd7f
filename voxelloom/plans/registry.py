"""Operators by name, with parameters from text: what a command line needs."""

from __future__ import annotations

import argparse
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions.parse import frame_range, renames, substack_ranges
from voxelloom.operators import filters, select, threshold
from voxelloom.operators.components import label_components, remap_consecutive, remove_labels, unique_labels
from voxelloom.operators.predicates import Range, filter_regions
from voxelloom.operators.regions import region_properties
from voxelloom.plans.pipelines import Segmentation, chain, coincidence, segment, segment_iteratively, segment_series
from voxelloom.runtime import Scratch
from voxelloom.sources.files import write_features
from voxelloom.sources.tiff import load_stacks, write_pairs

_OPERATORS: dict[str, tuple[str, Callable[..., DataFrame]]] = {}


def register(name: str, kind: str) -> Callable:
    """Under this name, whatever its case. A second one with the name takes the place of the first."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _OPERATORS[name.lower()] = (kind, f)
        return f

    return add


def operator(name: str) -> Callable[..., DataFrame]:
    """The operator; a name may end in "Config"."""
    short = re.sub("config$", "", name.lower())
    if short not in _OPERATORS:
        raise KeyError(f"no operator {name}; there are {', '.join(operators())}")
    return _OPERATORS[short][1]


def operators(kind: str | None = None) -> list[str]:
    return sorted(n for n, (k, _) in _OPERATORS.items() if kind in (None, k))


@register("DoG", "preprocess")
def _dog(df: DataFrame, sigma_low: float = 1.0, sigma_high: float = 5.0, mode: str = "reflect") -> DataFrame:
    return filters.difference_of_gaussians(df, ["y", "x"], sigma_low, sigma_high, mode=mode)


@register("TemporalMean", "preprocess")
def _temporal(df: DataFrame, window: int = 5, exclude_center: bool = True) -> DataFrame:
    return filters.temporal_mean(df, window, exclude_center=exclude_center)


@register("Rescale", "preprocess")
def _rescale(df: DataFrame, normalize: bool = True, dtype: str | None = None) -> DataFrame:
    return filters.rescale(df, [c for c in ("image_id", "scene") if c in df.columns], normalize=normalize, dtype=dtype)


@register("Grayscale", "preprocess")
def _gray(df: DataFrame) -> DataFrame:
    return select.grayscale(df)


@register("RangeThreshold", "segment")
def _range(df: DataFrame, low: float | None = 0.0, high: float | None = 1.0) -> DataFrame:
    return threshold.range_mask(df, low, high)


@register("OtsuThreshold", "segment")
def _otsu(df: DataFrame, bins: int | None = None) -> DataFrame:
    return threshold.otsu_mask(df, [c for c in df.columns if c not in ("y", "x", "v")], bins=bins)


@register("LocalThreshold", "segment")
def _local(df: DataFrame, block_size: int = 51, method: str = "gaussian", offset: float = 0.0, mode: str = "reflect") -> DataFrame:
    return threshold.local_mask(df, ["y", "x"], block_size, method=method, offset=offset, mode=mode)


@register("Labeller", "segment")
def _label(df: DataFrame, connectivity: int = 1) -> DataFrame:
    return label_components(df, ["y", "x"], connectivity)


@register("Relabeler", "segment")
def _relabel(df: DataFrame) -> DataFrame:
    return unique_labels(df, [c for c in df.columns if c not in ("y", "x", "label")])


def _key(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("y", "x", "v", "label")]


def _ranges(texts: dict[str, list[float]] | None) -> list[Range]:
    """Ranges of {"area": [3, 50]}."""
    return [Range(a, tuple(b)) for a, b in (texts or {}).items()]


@register("Resize", "preprocess")
def _resize(df: DataFrame, height: int | None = None, width: int | None = None, order: int = 1) -> DataFrame:
    h, w = df.agg(F.max("y") + 1, F.max("x") + 1).first()
    if order == 3:
        return filters.resize_cubic(df, _key(df), (h, w), height, width)
    return filters.resize(df, _key(df), (h, w), height, width, order=order)


@register("Gaussian", "preprocess")
def _gaussian(df: DataFrame, sigma: float = 1.0, mode: str = "reflect") -> DataFrame:
    return filters.gaussian(df, ["y", "x"], sigma, mode=mode)


@register("FrameBytes", "preprocess")
def _frame_bytes(df: DataFrame) -> DataFrame:
    return filters.frame_bytes(df, _key(df))


@register("Substack", "preprocess")
def _substack(df: DataFrame, ranges: str) -> DataFrame:
    return select.substack(df, ranges)


@register("LabelRemover", "segment")
def _remover(df: DataFrame, labels: list[int], renumber: bool = False) -> DataFrame:
    return remove_labels(df, labels, _key(df), renumber=renumber)


@register("RemapLabels", "segment")
def _remap(df: DataFrame) -> DataFrame:
    return remap_consecutive(df, _key(df))


def _how(mask: str | dict, connectivity: int, ranges: dict | None) -> Segmentation:
    step = StepConfig.parse(json.dumps(mask) if isinstance(mask, dict) else mask).step()
    return Segmentation(mask=step, connectivity=connectivity, ranges=_ranges(ranges))


@register("Segmenter", "segment")
def _segmenter(df: DataFrame, mask: str | dict = "OtsuThreshold", connectivity: int = 1, ranges: dict | None = None) -> DataFrame:
    return segment(df, _key(df), _how(mask, connectivity, ranges))[0]


@register("SeriesSegmenter", "segment")
def _series(df: DataFrame, masks: list, connectivity: int = 1, output: str = "combine") -> DataFrame:
    return segment_series(df, _key(df), [_how(m, connectivity, None) for m in masks], output=output)


@register("IterativeSegmenter", "segment")
def _iterative(df: DataFrame, masks: list, connectivity: int = 1, output: str = "combine", most: int = 5000) -> DataFrame:
    h, w = df.agg(F.max("y") + 1, F.max("x") + 1).first()
    return segment_iteratively(df, _key(df), [_how(m, connectivity, None) for m in masks], shape=(h, w), most=most, output=output)


@register("RegionAnalyzer", "analyze")
def _analyzer(df: DataFrame, properties: list[str] | None = None, spacing: list[float] | None = None) -> DataFrame:
    return region_properties(df, _key(df), ["y", "x"], properties, spacing)


@register("RegionFilter", "analyze")
def _filter(df: DataFrame, ranges: dict) -> DataFrame:
    return filter_regions(df, _ranges(ranges), [])[0]


@dataclass(frozen=True)
class StepConfig:
    """An operator by name and its parameters."""

    name: str
    parameters: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> StepConfig:
        """A bare name, or JSON with "classname" (or "name") and parameters. Backslashes before quotes are ignored."""
        text = text.strip()
        if not text.startswith(("{", '\\{', '"')):
            return cls(text)
        try:
            data = json.loads(text)
        except json.JSONDecodeError:
            data = json.loads(re.sub(r'\\(["{}\[\]:,])', r"\1", text))
        if isinstance(data, str):
            return cls(data)
        names = [data.pop(k) for k in ("classname", "name") if k in data]
        if not names:
            raise ValueError("which operator? give a classname")
        return cls(names[0], data)

    def step(self) -> Callable[[DataFrame], DataFrame]:
        f = operator(self.name)
        return lambda df: f(df, **self.parameters)


def build(texts: list[str], kind: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """The chain of the steps given; all of the kind, if one is."""
    steps = [StepConfig.parse(t) for t in texts]
    for s in steps:
        operator(s.name)
        if kind and re.sub("config$", "", s.name.lower()) not in operators(kind):
            raise ValueError(f"{s.name} is no {kind} step")
    return chain(*(s.step() for s in steps))


#: Ranges that the coincidence command keeps regions in unless others are given (fixed values).
COINCIDENCE_RANGES = {"area": [2.0, 5000.0]}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxelloom", description="Image stacks on Spark")
    p.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="a setting of the Spark session; may be repeated")
    p.add_argument("--log-level", default="WARN", choices=["DEBUG", "INFO", "WARN", "ERROR", "OFF"])
    commands = p.add_subparsers(dest="command", required=True)
    for name, allowed in (("preprocess", "preprocess"), ("segment", None), ("coincidence", None), ("train", None)):
        c = commands.add_parser(name)
        c.add_argument("-i", "--input", required=True, action="append", help="parquet of voxels, or a TIFF file or folder; may be repeated")
        c.add_argument("-o", "--output", required=True, help="folder of the result")
        c.add_argument("-s", "--step", action="append", default=[], help="operator, by name or as JSON; may be repeated")
        c.add_argument("--substack", help='as "T:4-10;Z:2-20", counted from 1')
        c.add_argument("--scene", type=int)
        c.add_argument("--grayscale", action="store_true")
        c.add_argument("--rename-channel", help='as "old:new;old2:new2"')
        c.add_argument("--overwrite", action="store_true")
        c.set_defaults(kind=allowed)
        if name in ("segment", "coincidence", "train"):
            c.add_argument("--range", action="append", default=[], metavar="PROPERTY:LOW:HIGH", help="only regions within; may be repeated")
        if name == "segment":
            c.add_argument("--regions", help="folder of the regions' table")
            c.add_argument("--property", action="append", default=[])
        if name == "coincidence":
            c.add_argument("--method", default="dice", choices=["dice", "iou"])
            c.add_argument("--threshold", type=float, default=0.1)
    return p


def _load(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The voxels of all inputs, one after the other: a union of scans."""
    names, out = renames(a.rename_channel), None
    for path in a.input:
        if re.search(r"\.parquet/?$", path):
            one = select.rename_channels(select.substack(spark.read.parquet(path), a.substack), names)
            one = one.where(F.col("scene") == a.scene) if a.scene is not None and "scene" in one.columns else one
            one = select.grayscale(one) if a.grayscale else one
        else:
            one = load_stacks(spark, path, scene=a.scene, substack=a.substack, names=names, gray=a.grayscale)
        out = one if out is None else out.unionByName(one)
    return out


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    substack_ranges(a.substack)
    renames(a.rename_channel)
    steps = build([t for t in a.step], a.kind)
    ranges = {n: [float(x), float(y)] for n, x, y in (r.split(":") for r in getattr(a, "range", []))}
    builder = SparkSession.builder.appName("voxelloom")
    for setting in a.set:
        builder = builder.config(*setting.split("=", 1))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(a.log_level)
    voxels, mode = _load(spark, a), "overwrite" if a.overwrite else "errorifexists"
    if a.command == "preprocess" or (a.command == "segment" and not a.regions):
        voxels.transform(steps).write.mode(mode).parquet(a.output)
        return 0
    key = _key(voxels)
    wanted = list(dict.fromkeys(["area", "centroid", *getattr(a, "property", [])]))
    how = Segmentation(mask=steps if a.step else operator("OtsuThreshold"), ranges=_ranges(ranges or (COINCIDENCE_RANGES if a.command == "coincidence" else {})), properties=wanted)
    labels, regions = segment(voxels, key, how)
    if a.command == "segment":
        labels.write.mode(mode).parquet(a.output)
        regions.write.mode(mode).parquet(a.regions)
        return 0
    if a.command == "train":
        write_pairs(voxels, labels, a.output, key, overwrite=a.overwrite).write.mode("overwrite").parquet(f"{a.output}/pairs")
        return 0
    scratch = Scratch(spark, "command")
    labels, regions = scratch.save(labels, "labels"), scratch.save(regions, "regions")
    channels = [r["c"] for r in regions.select("c").distinct().orderBy("c").limit(64).collect()]
    per = {str(c): [t.where(F.col("c") == c).drop("c") for t in (labels, regions)] for c in channels}
    made = coincidence({c: x[0] for c, x in per.items()}, {c: x[1] for c, x in per.items()}, [k for k in key if k != "c"], ["y", "x"], method=a.method, threshold=a.threshold)
    write_features(made, a.output, overwrite=a.overwrite)
    return 0


__all__ = ["StepConfig", "build", "frame_range", "main", "operator", "operators", "parser", "register"]
