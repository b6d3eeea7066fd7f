"""Regions near each other in one slice, in micrometres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.operators.current import SLICE, current_rows
from voxelloom.operators.spatial import places_within, points_in_polygons, points_within

RADIUS_UM = 5.0

#: Units of pixel sizes, written in lower case, in micrometres (fixed values).
MICROMETRES = {"um": 1.0, "µm": 1.0, "μm": 1.0, "micron": 1.0, "microns": 1.0, "micrometer": 1.0, "micrometre": 1.0, "nm": 1e-3, "mm": 1e3}


def micrometres(unit: Column) -> Column:
    """The length of a unit, null for one that isn't known."""
    name = F.lower(F.trim(unit))
    out = F.when(F.lit(False), F.lit(1.0))
    for text, length in MICROMETRES.items():
        out = out.when(name == text, F.lit(length))
    return out


def pixel_sizes(manifest: DataFrame) -> DataFrame:
    """(image_id, scene, size_y, size_x) in micrometres; one row each. Sizes of scale stand in for missing ones."""
    unit = micrometres(F.col("pixel_unit"))

    def size(axis: str) -> Column:
        return F.coalesce(F.col(f"physical_pixel_sizes.{axis}"), F.try_element_at(F.col("scale"), F.lit(axis))) * unit

    sizes = manifest.select("image_id", "scene", size("Y").alias("size_y"), size("X").alias("size_x"))
    return sizes.where(F.col("size_y").isNotNull() & F.col("size_x").isNotNull()).groupBy("image_id", "scene").agg(F.min("size_y").alias("size_y"), F.min("size_x").alias("size_x"))


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    regions = spark.read.parquet(f"{d}/regions.parquet").select("region_id", *SLICE, "stack_name", "centroid_0", "centroid_1", "bbox_0", "bbox_1", "bbox_2", "bbox_3", "ingested_at")
    return current_rows(regions, "region_id", "ingested_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    placed = _centroids(spark, d).join(pixel_sizes(spark.read.parquet(f"{d}/image_manifest.parquet")), ["image_id", "scene"])
    near = points_within(placed, SLICE, "region_id", [F.col("centroid_0") * F.col("size_y"), F.col("centroid_1") * F.col("size_x")], RADIUS_UM, with_distance=False)
    return near.select(F.col("id_a").alias("region_id_a"), F.col("id_b").alias("region_id_b"))


def p5_containing(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of regions in which the centroids of other regions of the slice lie."""
    regions = _centroids(spark, d)
    corners = F.array(*(F.struct(F.col(y).alias("y"), F.col(x).alias("x")) for y, x in (("bbox_0", "bbox_1"), ("bbox_0", "bbox_3"), ("bbox_2", "bbox_3"), ("bbox_2", "bbox_1"))))
    inside = points_in_polygons(regions, SLICE, "region_id", F.col("centroid_0"), F.col("centroid_1"), regions, "region_id", corners)
    return inside.where(F.col("id") != F.col("polygon_id")).select(F.col("id").alias("region_id"), F.col("polygon_id").alias("container_region_id"))


def places_near(spark: SparkSession, d: str) -> DataFrame:
    """Customers within 50 km of each other along the surface, at places of a sphere made of their keys."""
    key = F.col("c_custkey")
    made = spark.read.parquet(f"{d}/customer.parquet").select(key.alias("id"), ((key * 7919 % 36000) / 100 - 180).alias("longitude"), ((key * 104729 % 18001) / 100 - 90).alias("latitude"))
    near = places_within(made, "id", "longitude", "latitude", 50.0)
    return near.select(F.col("id_a").alias("customer_a"), F.col("id_b").alias("customer_b"), F.round("distance", 4).alias("km"))


_CURRENT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ingested_at DESC) AS rn FROM regions WHERE region_id IS NOT NULL) WHERE rn = 1"
_UNITS = "CASE lower(trim(pixel_unit)) " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in MICROMETRES.items()) + " END"

SQL = {
    "p5_found": f"""
        WITH sizes AS (
          SELECT image_id, scene, min(coalesce(physical_pixel_sizes.Y, scale['Y']) * {_UNITS}) AS sy, min(coalesce(physical_pixel_sizes.X, scale['X']) * {_UNITS}) AS sx
          FROM image_manifest GROUP BY ALL),
        p AS (
          SELECT region_id, c.image_id, c.scene, t, z, centroid_0 * sy AS y, centroid_1 * sx AS x
          FROM ({_CURRENT}) c JOIN sizes s ON c.image_id = s.image_id AND c.scene = s.scene
          WHERE isfinite(centroid_0) AND isfinite(centroid_1))
        SELECT a.region_id AS region_id_a, b.region_id AS region_id_b
        FROM p a JOIN p b ON a.image_id = b.image_id AND a.scene = b.scene AND a.t = b.t AND a.z = b.z AND a.region_id < b.region_id
        WHERE (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 25.0 * (1 + 1e-9)""",
    "places_near": """
        WITH p AS (SELECT c_custkey AS id, radians(c_custkey * 7919 % 36000 / 100 - 180) AS lon, radians(c_custkey * 104729 % 18001 / 100 - 90) AS lat FROM customer),
        near AS (SELECT a.id AS customer_a, b.id AS customer_b, 2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((a.lat - b.lat) / 2), 2) + cos(a.lat) * cos(b.lat) * pow(sin((a.lon - b.lon) / 2), 2))) AS km FROM p a JOIN p b ON a.id < b.id)
        SELECT customer_a, customer_b, round(km, 4) AS km FROM near WHERE km <= 50.0""",
    "p5_containing": f"""
        WITH c AS ({_CURRENT})
        SELECT a.region_id AS region_id, b.region_id AS container_region_id
        FROM c a JOIN c b ON a.image_id = b.image_id AND a.scene = b.scene AND a.t = b.t AND a.z = b.z AND a.region_id <> b.region_id
        WHERE isfinite(a.centroid_0) AND isfinite(a.centroid_1) AND a.centroid_0 >= b.bbox_0 AND a.centroid_0 < b.bbox_2 AND a.centroid_1 >= b.bbox_1 AND a.centroid_1 < b.bbox_3""",
}

QUERIES = {"p5_found": p5_found, "p5_containing": p5_containing, "places_near": places_near}
