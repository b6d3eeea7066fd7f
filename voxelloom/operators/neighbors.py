"""Distances and densities of regions in their slices (beyond what image pipelines of this kind usually compute)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.operators.current import is_number
from voxelloom.runtime import Scratch


#: Slices of at most so many regions are compared whole by the regions that the first cells leave without a neighbour.
FEW = 256


def _squared() -> Column:
    return (F.col("py") - F.col("oy")) * (F.col("py") - F.col("oy")) + (F.col("px") - F.col("ox")) * (F.col("px") - F.col("ox"))


def _best(pairs: DataFrame) -> DataFrame:
    """(id, best) of pairs of `own` and `id`: the nearest, ties to the smaller id."""
    return pairs.where(F.col("own") != F.col("id")).groupBy(F.col("own").alias("id")).agg(F.min(F.struct("d2", F.col("id").alias("nearest"))).alias("best"))


def _best_within(seekers: DataFrame, points: DataFrame, group: list[str], cell: float, most: float) -> DataFrame:
    """(id, best) of the seekers that have another point within `most`, by cells of `cell` >= `most` and those around."""
    there = points.select(*group, "id", "py", "px", F.floor(F.col("py") / cell).alias("cy"), F.floor(F.col("px") / cell).alias("cx"))
    around = F.explode(F.array(*(F.struct((F.floor(F.col("py") / cell) + i).alias("cy"), (F.floor(F.col("px") / cell) + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("cell")
    seek = seekers.select(*group, F.col("id").alias("own"), F.col("py").alias("oy"), F.col("px").alias("ox"), around).select(*group, "own", "oy", "ox", "cell.*")
    return _best(seek.join(there, [*group, "cy", "cx"]).withColumn("d2", _squared()).where(F.col("d2") <= most * most))


def _best_of_all(seekers: DataFrame, points: DataFrame, group: list[str]) -> DataFrame:
    seek = seekers.select(*group, F.col("id").alias("own"), F.col("py").alias("oy"), F.col("px").alias("ox"))
    return _best(seek.join(points.select(*group, "id", "py", "px"), group).withColumn("d2", _squared()))


def nearest_distances(regions: DataFrame, group: list[str], identity: str, y: Column, x: Column, *, cell: float, most: float | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(identity, nearest, distance): the nearest other region of the group, ties to the smaller id; regions without one
    have nulls. With `most` only those within it count, and a cell must be at least as wide.

    By cells of `cell` and the cells around each. Without `most`, regions without a neighbour there are compared with
    all of their group, if it has few, and else seek again in cells twice as wide, until each region whose group has
    another one is answered.
    """
    if most is not None and cell < most:
        raise ValueError("a cell must be at least as wide as the distance")
    points = regions.select(*group, F.col(identity).alias("id"), y.alias("py"), x.alias("px"))
    if most is not None:
        best = _best_within(points, points, group, cell, most)
    else:
        scratch = scratch or Scratch(regions.sparkSession, "nearest")
        points = scratch.save(points, "points")
        placed = points.where(is_number(F.col("py")) & is_number(F.col("px")))
        several = placed.groupBy(*group).agg(F.count("*").alias("n"), (F.min("id") < F.max("id")).alias("two")).where("two").drop("two")
        left = scratch.save(placed.join(several, group), "left0")
        best, step = None, 0
        while left.limit(1).count():
            found = _best_within(left if not step else left.where(F.col("n") > FEW), placed, group, cell * 2.0**step, cell * 2.0**step)
            if step == 1:
                found = found.unionByName(_best_of_all(left.where(F.col("n") <= FEW), placed, group))
            found = scratch.save(found, f"found{step}")
            best = found if best is None else best.unionByName(found)
            step += 1
            left = scratch.save(left.join(found.select("id"), "id", "left_anti"), f"left{step}")
            scratch.drop(f"left{step - 1}")
        best = left.select("id", F.lit(None).cast(f"struct<d2:double,nearest:{dict(points.dtypes)['id']}>").alias("best")) if best is None else best
    return points.select("id").join(best, "id", "left").select(F.col("id").alias(identity), F.col("best.nearest").alias("nearest"), F.sqrt("best.d2").alias("distance"))


def densities(regions: DataFrame, group: list[str], area: Column) -> DataFrame:
    """(group, regions, density): regions for each unit of the slice's area."""
    return regions.groupBy(*group).agg(F.count("*").alias("regions"), (F.count("*") / F.first(area)).alias("density"))


def running_share(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with each row's place in its group as a share of the group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("share", F.row_number().over(w) / F.count(F.lit(1)).over(Window.partitionBy(*by)))
