"""Schemas of the relations, and what a slice is."""

from __future__ import annotations

from pyspark.sql import types as T

COORDINATES = ["image_id", "scene", "c", "t", "z", "y", "x"]

VOXELS = "image_id string, scene int, c int, t int, z int, y int, x int, v double"
LABELS = "image_id string, scene int, c int, t int, z int, y int, x int, label int"
TILES = "image_id string, scene int, c int, t int, z int, y0 int, x0 int, h int, w int, dtype string, data binary"
MANIFEST = (
    "image_id string, path string, scene int, dim_order string, axes array<string>, shape array<int>, dtype string, channel_names array<string>, channel_axis int,"
    " pixel_unit string, scale map<string,double>, physical_pixel_sizes struct<Z:double,Y:double,X:double>"
)


def slice_key(columns: list[str], axes: list[str], value: list[str]) -> list[str]:
    """The columns that name a slice: all but the slice's own axes and the values."""
    missing = [a for a in axes if a not in columns]
    if missing:
        raise ValueError(f"no such axes: {missing}")
    return [c for c in columns if c not in axes and c not in value]


def schema_with(fields: list[T.StructField], **more: T.DataType) -> T.StructType:
    return T.StructType([*fields, *(T.StructField(k, t) for k, t in more.items())])
