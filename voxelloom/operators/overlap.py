"""How labels of two channels overlap: pixel by pixel or by their boxes, consolidated to features of each label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = {
    "iou": lambda common, a, b: F.when(a + b - common > 0, common / (a + b - common)).otherwise(F.lit(0.0)),
    "dice": lambda common, a, b: F.when(a + b > 0, 2 * common / (a + b)).otherwise(F.lit(0.0)),
}


def score(method: str, common: Column, a: Column, b: Column) -> Column:
    """IoU or Dice of two sizes and what they share; 0 if both are empty."""
    if method not in METHODS:
        raise ValueError(f"iou or dice, not {method}")
    return METHODS[method](common.cast("double"), a.cast("double"), b.cast("double"))


def outline_pairs(a: DataFrame, b: DataFrame, key: list[str], axes: list[str], *, method: str = "iou", threshold: float = 0.5, every: bool = True) -> DataFrame:
    """(key, label_a, label_b, score, above_threshold) of the labels of two channels in the same slice.

    Shared pixels are counted by an equi-join on the pixel. With `every`, pairs that share none come with score 0, as
    many as labels of the one channel times labels of the other in each slice; without, only pairs that share pixels.
    A slice where one side has no labels gives no pairs. A score equal to the threshold is above it.
    """
    left, right = (x.where(F.col("label") > 0).select(*key, *axes, F.col("label").alias(n)) for x, n in ((a, "label_a"), (b, "label_b")))
    common = left.join(right, [*key, *axes]).groupBy(*key, "label_a", "label_b").agg(F.count("*").alias("common"))
    sizes_a = left.groupBy(*key, "label_a").agg(F.count("*").alias("size_a"))
    sizes_b = right.groupBy(*key, "label_b").agg(F.count("*").alias("size_b"))
    if every:
        pairs = sizes_a.join(sizes_b, key).join(common, [*key, "label_a", "label_b"], "left")
    else:
        pairs = common.join(sizes_a, [*key, "label_a"]).join(sizes_b, [*key, "label_b"])
    s = score(method, F.coalesce("common", F.lit(0)), F.col("size_a"), F.col("size_b"))
    return pairs.select(*key, "label_a", "label_b", s.alias("score")).withColumn("above_threshold", F.col("score") >= threshold)


def boxes_overlap(n: int, a: str = "a_bbox_", b: str = "b_bbox_") -> Column:
    """Whether two half-open boxes share a place; boxes that only touch don't."""
    return reduce(lambda x, y: x & y, ((F.col(f"{a}{k}") < F.col(f"{b}{k + n}")) & (F.col(f"{b}{k}") < F.col(f"{a}{k + n}")) for k in range(n)))


def shared_box(n: int, a: str = "a_bbox_", b: str = "b_bbox_") -> Column:
    """Places that two boxes share."""
    return reduce(lambda x, y: x * y, (F.greatest(F.lit(0), F.least(F.col(f"{a}{k + n}"), F.col(f"{b}{k + n}")) - F.greatest(F.col(f"{a}{k}"), F.col(f"{b}{k}"))).cast("bigint") for k in range(n)))


def box_size(n: int, prefix: str) -> Column:
    return reduce(lambda x, y: x * y, ((F.col(f"{prefix}{k + n}") - F.col(f"{prefix}{k}")).cast("bigint") for k in range(n)))


def box_pairs(a: DataFrame, b: DataFrame, key: list[str], n: int, *, cell: int = 64) -> DataFrame:
    """Pairs of regions whose boxes overlap: (key, label_a, label_b, a_bbox_*, b_bbox_*).

    Boxes are looked up by the cells of a grid that they meet, so the join is by equality; a pair comes from the cell of
    the lower corner of what both share, hence once.
    """
    sides = []
    for df, s in ((a, "a"), (b, "b")):
        x = df.select(*key, F.col("label").alias(f"label_{s}"), *(F.col(f"bbox_{k}").alias(f"{s}_bbox_{k}") for k in range(2 * n)))
        for k in range(n):
            x = x.withColumn(f"cell_{k}", F.explode(F.sequence(F.floor(F.col(f"{s}_bbox_{k}") / cell), F.floor((F.col(f"{s}_bbox_{k + n}") - 1) / cell))))
        sides.append(x)
    cells = [f"cell_{k}" for k in range(n)]
    once = reduce(lambda x, y: x & y, (F.floor(F.greatest(F.col(f"a_bbox_{k}"), F.col(f"b_bbox_{k}")) / cell) == F.col(f"cell_{k}") for k in range(n)))
    return sides[0].join(sides[1], [*key, *cells]).where(boxes_overlap(n) & once).drop(*cells)


def box_scores(a: DataFrame, b: DataFrame, key: list[str], n: int, *, method: str = "iou", threshold: float = 0.5, cell: int = 64) -> DataFrame:
    """(key, label_a, label_b, score, above_threshold) by boxes, of the pairs whose boxes overlap."""
    pairs = box_pairs(a, b, key, n, cell=cell)
    s = score(method, shared_box(n), box_size(n, "a_bbox_"), box_size(n, "b_bbox_"))
    return pairs.select(*key, "label_a", "label_b", s.alias("score")).withColumn("above_threshold", F.col("score") >= threshold)


def box_union(boxes: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, bbox_*): the least box around all; groups without boxes have no row."""
    return boxes.groupBy(*by).agg(*(F.min(f"bbox_{k}").alias(f"bbox_{k}") for k in range(n)), *(F.max(f"bbox_{k + n}").alias(f"bbox_{k + n}") for k in range(n)))


def consolidate(pairs: DataFrame, key: list[str], side: str, other: str, method: str) -> DataFrame:
    """(key, label, "<other> +", "<method> <other> +"): for each label of one side whether any pair is above the
    threshold, and the best score."""
    by = pairs.groupBy(*key, F.col(f"label_{side}").alias("label"))
    return by.agg(F.bool_or("above_threshold").alias(f"{other} +"), F.max("score").alias(f"{method} {other} +"))


def coincidence_features(a: DataFrame, b: DataFrame, key: list[str], axes: list[str], names: tuple[str, str], *, method: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """What consolidate() gives of all pairs of labels, for the labels of both channels, without making the pairs that share
    nothing: a label that touches none has (false, 0.0), or nothing in a slice where the other channel has no labels."""
    pairs = outline_pairs(a, b, key, axes, method=method, threshold=threshold, every=False)
    out = []
    for own, other, side, name in ((a, b, "a", names[1]), (b, a, "b", names[0])):
        labels, there = own.where(F.col("label") > 0).select(*key, "label").distinct(), other.where(F.col("label") > 0)
        labels = labels.join(there.select(*key).distinct(), key, "left_semi") if key else labels.where(F.lit(bool(there.limit(1).count())))
        touched = labels.join(consolidate(pairs, key, side, name, method), [*key, "label"], "left")
        none = {f"{name} +": F.lit(0.0 >= threshold), f"{method} {name} +": F.lit(0.0)}
        out.append(touched.withColumns({c: F.coalesce(F.col(c), x) for c, x in none.items()}))
    return out[0], out[1]


def join_features(regions: DataFrame, features: list[DataFrame], on: list[str], present: DataFrame | None = None) -> DataFrame:
    """Regions with the features of the same label; only labels of `present`, if given."""
    out = regions
    for f in features:
        out = out.join(f, on, "left")
    return out.join(present.select(*on).distinct(), on, "left_semi") if present is not None else out


def split_by_feature(labels: DataFrame, features: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Labels' pixels with mask_id 1 where the feature holds, 2 where it doesn't."""
    marked = features.select(*on, F.when(F.col(flag), 1).otherwise(2).alias("mask_id"))
    return labels.join(marked, on)
