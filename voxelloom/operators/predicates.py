"""Ranges of region properties, and which regions pass them."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """An inclusive range of one property; a text instead of bounds ("all") bounds nothing."""

    attribute: str
    bounds: tuple[float, float] | str = "all"

    def __post_init__(self) -> None:
        if not isinstance(self.bounds, str) and self.bounds[0] > self.bounds[1]:
            raise ValueError(f"{self.attribute}: the range ends before it starts")

    @classmethod
    def around(cls, attribute: str, value: float, tolerance: float) -> Range:
        return cls(attribute, (value - tolerance, value + tolerance))

    def holds(self) -> Column:
        """True or false; not-a-number and null are in no range, not even in "all"."""
        value = F.col(self.attribute).cast("double")
        low, high = (float("-inf"), float("inf")) if isinstance(self.bounds, str) else map(float, self.bounds)
        return F.coalesce(value.between(low, high) & ~F.isnan(value), F.lit(False))


def checked_ranges(ranges: list[Range], allowed: list[str]) -> list[Range]:
    if unknown := [r.attribute for r in ranges if r.attribute not in allowed]:
        raise ValueError(f"no such attributes: {unknown}")
    return ranges


def filter_regions(regions: DataFrame, ranges: list[Range], key: list[str], label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(kept regions, (key, label) of the others). Ranges of columns that aren't there are skipped with a warning."""
    if label not in regions.columns:
        raise ValueError(f"no column {label}")
    there = [r for r in ranges if r.attribute in regions.columns]
    for r in ranges:
        if r not in there:
            warnings.warn(f"no property {r.attribute}: its range is skipped", stacklevel=2)
    passes = reduce(lambda a, b: a & b, (r.holds() for r in there), F.lit(True))
    return regions.where(passes), regions.where(~passes).select(*key, label)
