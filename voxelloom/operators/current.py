"""The current row of each key, and the names by which rows refer to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.runtime import fresh

SLICE = ["image_id", "scene", "t", "z"]


def current_rows(df: DataFrame, key: str, version: str) -> DataFrame:
    """Of the rows with one `key` the one with the greatest `version`.

    Rows equal in every column count once. Of different rows with the same version the one that sorts last by
    its other columns counts, so the result never depends on the order of reading. A null version is the oldest.
    Rows whose key is null name nothing and are left out. An empty table gives an empty one.

    The limit of one row per key is applied before the shuffle too, so that a key redelivered many times costs
    one row for each input task.
    """
    (rank,) = fresh(df.columns, "version_rank")
    ties = [f.name for f in df.schema if f.name not in (key, version) and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    w = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in ties))
    return df.where(F.col(key).isNotNull()).withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def stack_key(name: Column) -> Column:
    """The stack that a spelling means: without case and without blanks around it."""
    return F.lower(F.trim(name))


def is_number(c: Column) -> Column:
    """Neither null nor not-a-number nor infinite; false, never null."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))
