"""Image stacks out of the star schema's tables: sums at hashed places, filled up with zeros."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRID = {"c": ["F", "O"], "z": 7, "y": 32, "x": 32}
FRAMES = {"t": 30, "y": 16, "x": 5}
MONTHS = {"t": 83, "y": 16, "x": 16}


def places(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    """Every place of a box, from one range of numbers: no join."""
    total = 1
    for n in sizes.values():
        total *= n
    out, step = {}, total
    for axis, n in sizes.items():
        step //= n
        out[axis] = (F.floor(F.col("id") / step) % n).cast("int")
    return spark.range(total).select(*(c.alias(a) for a, c in out.items()))


def densify(df: DataFrame, sizes: dict[str, int], value: str = "v") -> DataFrame:
    """A row for each place of the box; 0 where df has none. A row beyond the box is an error, when the query runs."""
    beyond = reduce(lambda a, b: a | b, (~F.col(a).between(0, n - 1) for a, n in sizes.items()))
    places_of = {a: F.when(beyond, F.raise_error(F.lit(f"a place beyond the box {sizes}")).cast("int")).otherwise(F.col(a)) for a in list(sizes)[:1]}
    df = df.withColumns(places_of)
    return places(df.sparkSession, sizes).join(df, list(sizes), "left").withColumn(value, F.coalesce(value, F.lit(0)))


def _summed(df: DataFrame, axes: dict[str, Column], value: Column) -> DataFrame:
    return df.groupBy(*(c.cast("int").alias(a) for a, c in axes.items())).agg(F.sum(value).cast("bigint").alias("v"))


def grid(spark: SparkSession, d: str) -> DataFrame:
    """(c, z, y, x, v): two channels of quantities, 7 planes of 32 x 32."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").where(F.col("l_linestatus").isin(GRID["c"]) & F.col("l_linenumber").between(1, GRID["z"]))
    axes = {"k": (F.col("l_linestatus") == "O"), "z": F.col("l_linenumber") - 1, "y": F.col("l_partkey") % 32, "x": F.col("l_suppkey") % 32}
    full = densify(_summed(items, axes, F.col("l_quantity")), {"k": 2, "z": 7, "y": 32, "x": 32})
    return full.select(F.when(F.col("k") == 1, "O").otherwise("F").alias("c"), "z", "y", "x", "v")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """(t, y, x, v): 30 days of events, by user and kind; hundredths of the value."""
    events = spark.read.parquet(f"{d}/events.parquet")
    # The kinds of events are few; their places are counted over the distinct ones.
    ranked = events.select("event_type").distinct().withColumn("x", F.row_number().over(Window.orderBy("event_type")) - 1)
    axes = {"t": F.datediff(F.col("ts"), F.lit("2024-01-01")), "y": F.col("user_id") % 16, "x": F.col("x")}
    return densify(_summed(events.join(ranked, "event_type"), axes, F.round(F.col("value") * 100).cast("bigint")), FRAMES)


def months(spark: SparkSession, d: str) -> DataFrame:
    """(t, y, x, v): quantities by month since January 1995, 16 x 16."""
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    axes = {"t": (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1, "y": F.col("l_partkey") % 16, "x": F.col("l_suppkey") % 16}
    return densify(_summed(items, axes, F.col("l_quantity")), MONTHS)


def patches(spark: SparkSession, d: str) -> DataFrame:
    """(image, y, x, v): each embedding of 64 numbers as an image of 8 x 8."""
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    flat = vectors.select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("k", "v"))
    return flat.select("image", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    """The paths of images, each once."""
    return spark.read.parquet(f"{d}/image_manifest.parquet").select("path").where("path is not null").distinct()
