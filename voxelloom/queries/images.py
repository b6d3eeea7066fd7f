"""Queries of the image operators, over image stacks made of the star schema's tables, with the SQL of each."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.operators import components as comp
from voxelloom.operators import filters, neighbors, overlap, regions, select
from voxelloom.operators import threshold as th
from voxelloom.operators.predicates import Range, filter_regions
from voxelloom.operators.stencil import each_slice, gaussian_weights
from voxelloom.plans.pipelines import Segmentation, chain, coincidence, segment, segment_iteratively, segment_series
from voxelloom.runtime import Scratch
from voxelloom.sources.grids import frames, grid, months, patches

K = ["c", "z"]
P = ["y", "x"]
SHAPE = (32, 32)
ROUND = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded, not-a-number as null, -0.0 as 0.0."""
    return df.withColumns({c: F.round(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), ROUND) + 0.0 for c in columns})


GRID = """
    sums AS (
      SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS k, l_linenumber - 1 AS z, l_partkey % 32 AS y, l_suppkey % 32 AS x, sum(l_quantity)::BIGINT AS v
      FROM lineitem WHERE l_linestatus IN ('F', 'O') AND l_linenumber BETWEEN 1 AND 7 GROUP BY ALL),
    grid AS MATERIALIZED (
      SELECT CASE WHEN d.k = 1 THEN 'O' ELSE 'F' END AS c, d.z::INT AS z, d.y::INT AS y, d.x::INT AS x, coalesce(s.v, 0)::BIGINT AS v
      FROM (SELECT k, z, y, x FROM range(2) a(k), range(7) b(z), range(32) e(y), range(32) f(x)) d LEFT JOIN sums s ON s.k = d.k AND s.z = d.z AND s.y = d.y AND s.x = d.x)"""

FRAMES = """
    kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS x FROM (SELECT DISTINCT event_type FROM events)),
    frames AS MATERIALIZED (
      SELECT d.t::INT AS t, d.y::INT AS y, d.x::INT AS x, coalesce(s.v, 0)::BIGINT AS v
      FROM (SELECT t, y, x FROM range(30) a(t), range(16) b(y), range(5) e(x)) d
      LEFT JOIN (SELECT ts::DATE - DATE '2024-01-01' AS t, user_id % 16 AS y, x, sum(round(value * 100)::BIGINT)::BIGINT AS v FROM events JOIN kinds USING (event_type) GROUP BY ALL) s
      ON s.t = d.t AND s.y = d.y AND s.x = d.x)"""

MONTHS = """
    months AS MATERIALIZED (
      SELECT d.t::INT AS t, d.y::INT AS y, d.x::INT AS x, coalesce(s.v, 0)::BIGINT AS v
      FROM (SELECT t, y, x FROM range(83) a(t), range(16) b(y), range(16) e(x)) d
      LEFT JOIN (SELECT (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, l_partkey % 16 AS y, l_suppkey % 16 AS x, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY ALL) s
      ON s.t = d.t AND s.y = d.y AND s.x = d.x)"""

PATCHES = "patches AS (SELECT vec_id AS image, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i))"


def _otsu_sql(source: str, key: str) -> str:
    return f"""
    hist AS (SELECT {key}, v, count(*) AS n FROM {source} GROUP BY ALL),
    cum AS (SELECT {key}, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER p AS n1, sum(n * v) OVER p AS s1 FROM hist WINDOW w AS (PARTITION BY {key} ORDER BY v), p AS (PARTITION BY {key})),
    apart AS (SELECT {key}, v, n0, n1, CASE WHEN n1 > n0 THEN s0::DOUBLE / n0 - (s1 - s0)::DOUBLE / (n1 - n0) END AS d FROM cum),
    ranked AS (SELECT {key}, v, row_number() OVER (PARTITION BY {key} ORDER BY coalesce(n0::DOUBLE * (n1 - n0) * d * d, 0) DESC, v) AS place FROM apart),
    otsu AS (SELECT {key}, v AS threshold FROM ranked WHERE place = 1)"""


MASK = f"{GRID}, {_otsu_sql('grid', 'c, z')}, mask AS MATERIALIZED (SELECT g.c, g.z, g.y, g.x, g.v FROM grid g JOIN otsu o ON o.c = g.c AND o.z = g.z WHERE g.v > o.threshold)"


def _steps(dims: int, connectivity: int) -> str:
    return ", ".join(str(o) if dims > 1 else f"({o[0]})" for o in [*comp.offsets(dims, connectivity), *(tuple(-d for d in o) for o in comp.offsets(dims, connectivity))])


def _labels_sql(mask: str = "mask", connectivity: int = 1, name: str = "labels") -> str:
    return f"""
    reach_{name} AS (
      SELECT c, z, y, x, y * 32 + x AS root FROM {mask}
      UNION
      SELECT m.c, m.z, m.y, m.x, r.root FROM reach_{name} r, (VALUES {_steps(2, connectivity)}) o(dy, dx), {mask} m WHERE m.c = r.c AND m.z = r.z AND m.y = r.y + o.dy AND m.x = r.x + o.dx),
    {name} AS MATERIALIZED (SELECT c, z, y, x, (dense_rank() OVER (PARTITION BY c, z ORDER BY root))::INT AS label FROM (SELECT c, z, y, x, min(root) AS root FROM reach_{name} GROUP BY ALL))"""


LABELS = f"{MASK}, {_labels_sql()}"


def _mask(spark: SparkSession, d: str) -> DataFrame:
    return th.otsu_mask(grid(spark, d), K)


def _labels(spark: SparkSession, d: str, connectivity: int = 1) -> DataFrame:
    return comp.label_components(_mask(spark, d), P, connectivity)


def _channels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labels of both channels without the channel, written once."""
    labels = Scratch(spark, "channels").save(_labels(spark, d), "labels")
    return labels.where("c = 'F'").drop("c"), labels.where("c = 'O'").drop("c")


# Sources and selection


@query(f"WITH {GRID} SELECT * FROM grid")
def voxel_densify(spark, d):
    return grid(spark, d)


@query(f"WITH {MONTHS} SELECT * FROM months WHERE t >= 3 AND t < 10 AND y >= 1 AND y < 9")
def substack_select(spark, d):
    return select.substack(months(spark, d), "T:4-10;Y:2-9")


@query(f"WITH {MONTHS} SELECT * FROM months WHERE t >= 1 AND t < 40")
def first_axis_select(spark, d):
    return select.substack(months(spark, d), "2-40")


@query(f"WITH {GRID} SELECT CASE c WHEN 'F' THEN 'Dpn' ELSE c END AS c, z, y, x, v FROM grid")
def channel_rename(spark, d):
    return select.rename_channels(grid(spark, d), {"F": "Dpn", "X": "EDU"})


@query(f"WITH {GRID} SELECT z, y, x, avg(v) AS v, 0 AS c FROM grid GROUP BY z, y, x")
def grayscale_mean(spark, d):
    return select.grayscale(grid(spark, d))


@query(f"WITH {GRID} SELECT z, y, x, v FROM grid WHERE c = 'O'")
def unstack_channels(spark, d):
    return select.unstack(grid(spark, d), "c", ["F", "O"])["O"]


@query(f"WITH {GRID} SELECT y, x, v FROM grid WHERE z = 2 AND c = 'F'")
def squeeze_axes(spark, d):
    return select.squeeze(grid(spark, d).where("z = 2 and c = 'F'"), ["c", "z", "y"])


@query(f"WITH {FRAMES} SELECT t, 0 AS c, 0 AS z, y, x, v FROM frames")
def unsqueeze_axes(spark, d):
    return select.unsqueeze(frames(spark, d))


@query(f"WITH {GRID}, m AS (SELECT z, y, x, CASE c WHEN 'F' THEN 1 ELSE 2 END AS mask_id FROM grid WHERE v > 100) SELECT z, y, x, sum(mask_id)::INT AS label FROM m GROUP BY ALL")
def masks_to_labels(spark, d):
    masks = grid(spark, d).where("v > 100").withColumn("mask_id", F.when(F.col("c") == "F", 1).otherwise(2))
    return select.masks_to_labels(masks, ["z", *P])


@query(f"WITH RECURSIVE {LABELS} SELECT c, z, label, y, x, (dense_rank() OVER (PARTITION BY c, z ORDER BY label))::INT AS mask_id FROM labels")
def labels_to_masks(spark, d):
    return select.labels_to_masks(_labels(spark, d), K).select(*K, "label", *P, "mask_id")


@query("""
    SELECT image_id, path, scene, [shape[1], shape[2], shape[3], 100, 200] AS shape, physical_pixel_sizes.Y * (shape[4] / 100) AS size_y, physical_pixel_sizes.X * (shape[5] / 200) AS size_x
    FROM (SELECT DISTINCT * FROM image_manifest)""")
def manifest_resized(spark, d):
    manifest = spark.read.parquet(f"{d}/image_manifest.parquet").drop("acquired_at")
    once = manifest.withColumn("scale_pairs", F.sort_array(F.map_entries("scale"))).dropDuplicates([c for c in manifest.columns if c != "scale"] + ["scale_pairs"]).drop("scale_pairs")
    out = select.resized_manifest(once, F.concat(F.slice("shape", 1, 3), F.array(F.lit(100), F.lit(200))))
    return out.select("image_id", "path", "scene", "shape", F.col("physical_pixel_sizes.Y").alias("size_y"), F.col("physical_pixel_sizes.X").alias("size_x"))


# Intensities


@query(f"WITH {GRID}, e AS (SELECT c, min(v) AS lo, max(v) AS hi FROM grid GROUP BY c) SELECT c, z, y, x, round(CASE WHEN hi > lo THEN (v - lo)::DOUBLE / (hi - lo) ELSE 0 END, 6) AS v FROM grid JOIN e USING (c)")
def normalize_stack(spark, d):
    return rounded(filters.rescale(grid(spark, d), ["c"]), "v")


_BYTES = f"WITH {GRID}, e AS (SELECT c, min(v) AS lo, max(v) AS hi FROM grid GROUP BY c) SELECT c, z, y, x, (CASE WHEN hi > lo THEN floor((v - lo)::DOUBLE / (hi - lo) * 255.0) ELSE {{}} END)::BIGINT AS v FROM grid JOIN e USING (c)"


@query(_BYTES.format(0))
def rescale_uint8(spark, d):
    return filters.rescale(grid(spark, d), ["c"], dtype="uint8")


@query(_BYTES.format(127))
def rescale_no_normalize(spark, d):
    return filters.rescale(grid(spark, d), ["c"], normalize=False, dtype="uint8")


@query(f"WITH {PATCHES}, e AS (SELECT image, min(v) AS lo, max(v) AS hi FROM patches GROUP BY image) SELECT image, y, x, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS v FROM patches JOIN e USING (image)")
def normalize_patches(spark, d):
    return rounded(filters.rescale(patches(spark, d), ["image"]), "v")


def _temporal_sql(source: str, window: int, center: bool) -> str:
    before, after = window // 2, window - 1 - window // 2
    ends = "greatest(0, {} - row_number() OVER w) * first_value(v) OVER f + greatest(0, row_number() OVER w + {} - count(*) OVER f) * last_value(v) OVER f".format(before + 1, after)
    total = f"sum(v) OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING) + {ends}"
    value = f"({total})::DOUBLE / {window}" if center else f"({total} - v)::DOUBLE / {window - 1}"
    return f"SELECT t, y, x, round({value}, 6) AS v FROM {source} WINDOW w AS (PARTITION BY y, x ORDER BY t), f AS (PARTITION BY y, x ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(f"WITH {FRAMES} {_temporal_sql('frames', 5, False)}")
def temporal_mean_w5_exclude_center(spark, d):
    return rounded(filters.temporal_mean(frames(spark, d), 5), "v")


@query(f"WITH {FRAMES} {_temporal_sql('frames', 4, True)}")
def temporal_mean_w4_include_center(spark, d):
    return rounded(filters.temporal_mean(frames(spark, d), 4, exclude_center=False), "v")


@query(f"WITH {MONTHS} {_temporal_sql('months', 7, False)}")
def temporal_mean_months(spark, d):
    return rounded(filters.temporal_mean(months(spark, d), 7), "v")


def _taps(name: str, sigma: float) -> str:
    w = gaussian_weights(sigma)
    return f"{name}(k, w) AS (VALUES {', '.join(f'({k - len(w) // 2}, {x!r}::DOUBLE)' for k, x in enumerate(w.tolist()))})"


def _mirror(at: str, n: int) -> str:
    """The place that a reflected border stands for."""
    p = f"((({at}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"(CASE WHEN {p} < {n} THEN {p} ELSE {2 * n - 1} - {p} END)"


def _smooth_sql(source: str, out: str, taps: str, n: int = 32) -> str:
    rows = f"{out}_y AS MATERIALIZED (SELECT d.c, d.z, d.y, d.x, sum(t.w * s.v) AS v FROM {source} d, {taps} t, {source} s WHERE s.c = d.c AND s.z = d.z AND s.x = d.x AND s.y = {_mirror('d.y + t.k', n)} GROUP BY ALL)"
    return f"{rows}, {out} AS MATERIALIZED (SELECT d.c, d.z, d.y, d.x, sum(t.w * s.v) AS v FROM {out}_y d, {taps} t, {out}_y s WHERE s.c = d.c AND s.z = d.z AND s.y = d.y AND s.x = {_mirror('d.x + t.k', n)} GROUP BY ALL)"


DOG = f"{GRID}, {_taps('narrow', 1.0)}, {_taps('wide', 2.0)}, {_smooth_sql('grid', 'soft', 'narrow')}, {_smooth_sql('grid', 'softer', 'wide')}, dog AS MATERIALIZED (SELECT a.c, a.z, a.y, a.x, a.v - b.v AS v FROM soft a JOIN softer b ON a.c = b.c AND a.z = b.z AND a.y = b.y AND a.x = b.x)"


@query(f"WITH {GRID}, {_taps('narrow', 1.0)}, {_smooth_sql('grid', 'soft', 'narrow')} SELECT c, z, y, x, round(v, 6) AS v FROM soft")
def gaussian_smooth(spark, d):
    return rounded(filters.gaussian(grid(spark, d), P, 1.0), "v")


@query(f"WITH {DOG} SELECT c, z, y, x, round(v, 6) AS v FROM dog")
def dog_filter(spark, d):
    return rounded(filters.difference_of_gaussians(grid(spark, d), P, 1.0, 2.0), "v")


@query(f"WITH {DOG} SELECT c, z, y, x, round(v, 6) AS v FROM dog")
def dog_filter_tiled(spark, d):
    return rounded(filters.difference_of_gaussians(grid(spark, d), P, 1.0, 2.0, tile=12), "v")


@query(f"WITH {DOG}, e AS (SELECT c, min(v) AS lo, max(v) AS hi FROM dog GROUP BY c) SELECT c, z, y, x, round((v - lo) / (hi - lo), 6) AS v FROM dog JOIN e USING (c)")
def dog_normalized(spark, d):
    return rounded(chain(lambda v: filters.difference_of_gaussians(v, P, 1.0, 2.0), lambda v: filters.rescale(v, ["c"]))(grid(spark, d)), "v")


def _resize_sql(order: int, height: int, width: int) -> str:
    def lines(axis: str, n: int, m: int) -> str:
        src = f"((d + 0.5) * {n} / {m} - 0.5)"
        clip = lambda e: f"least(greatest({e}, 0), {n - 1})"
        if order == 0:
            return f"t{axis} AS (SELECT d, {clip(f'floor({src} + 0.5)')} AS s, 1.0::DOUBLE AS w FROM range({m}) r(d))"
        return f"t{axis} AS (SELECT d, {clip(f'floor({src})')} AS s, (1 - ({src} - floor({src})))::DOUBLE AS w FROM range({m}) r(d) UNION ALL SELECT d, {clip(f'floor({src}) + 1')}, ({src} - floor({src}))::DOUBLE FROM range({m}) r(d))"

    return f"WITH {GRID}, {lines('y', 32, height)}, {lines('x', 32, width)} SELECT c, z, ty.d::INT AS y, tx.d::INT AS x, round(sum(v * ty.w * tx.w), 6) AS v FROM grid JOIN ty ON ty.s = grid.y JOIN tx ON tx.s = grid.x GROUP BY ALL"


@query(_resize_sql(0, 20, 45))
def resize_nearest(spark, d):
    return rounded(filters.resize(grid(spark, d), K, SHAPE, 20, 45, order=0), "v")


@query(_resize_sql(1, 48, 48))
def resize_bilinear(spark, d):
    return rounded(filters.resize(grid(spark, d), K, SHAPE, 48, order=1), "v")


def _cubic_sql(n: int, m: int) -> str:
    """Lines of 4 taps each: cubic convolution with a = -0.5, beyond the border the nearest pixel."""
    near, far = "1.5 * k ** 3 - 2.5 * k ** 2 + 1", "-0.5 * k ** 3 + 2.5 * k ** 2 - 4 * k + 2"
    return f"(SELECT d, least(greatest(place, 0), {n - 1}) AS s, CASE WHEN k <= 1 THEN {near} WHEN k < 2 THEN {far} ELSE 0 END AS w FROM (SELECT d, floor(src)::INT + o AS place, abs(src - (floor(src) + o)) AS k FROM (SELECT d, (d + 0.5::DOUBLE) * {n} / {m} - 0.5 AS src FROM range({m}) r(d)), range(-1, 3) t(o)))"


@query(f"WITH {GRID}, {_taps('fine', 0.5)}, {_smooth_sql('grid', 'soft', 'fine')}, taps AS {_cubic_sql(32, 16)} SELECT c, z, ty.d::INT AS y, tx.d::INT AS x, round(sum(v * ty.w * tx.w), 6) AS v FROM soft JOIN taps ty ON ty.s = soft.y JOIN taps tx ON tx.s = soft.x GROUP BY ALL")
def resize_cubic(spark, d):
    return rounded(filters.resize_cubic(grid(spark, d), K, SHAPE, width=16), "v")


@query(f"WITH {FRAMES}, m AS (SELECT t, max(v) AS top FROM frames GROUP BY t) SELECT t, y, x, (CASE WHEN top > 0 THEN floor(greatest(0, v::DOUBLE / top * 255.0)) ELSE 0 END)::INT AS v FROM frames JOIN m USING (t)")
def frame_bytes(spark, d):
    return filters.frame_bytes(frames(spark, d), ["t"])


# Masks


@query(f"WITH {GRID} SELECT * FROM grid WHERE v BETWEEN 100 AND 160")
def range_threshold(spark, d):
    return th.range_mask(grid(spark, d), 100, 160)


@query(f"WITH {GRID} SELECT * FROM grid WHERE v >= 150")
def range_threshold_open(spark, d):
    return th.range_mask(grid(spark, d), 150, None)


@query(f"WITH {GRID}, e AS (SELECT c, z, min(v) AS lo, max(v) - min(v) AS span FROM grid GROUP BY c, z) SELECT c, z, y, x, v FROM grid JOIN e USING (c, z) WHERE v >= lo + 0.25 * span AND v <= lo + 0.75 * span")
def range_threshold_relative(spark, d):
    return th.range_mask(grid(spark, d), 0.25, 0.75, relative_to=K)


@query(f"WITH {GRID}, {_otsu_sql('grid', 'c, z')} SELECT c, z, threshold FROM otsu")
def otsu_threshold(spark, d):
    return th.otsu_thresholds(grid(spark, d), K)


@query(f"WITH {MASK} SELECT c, z, count(*) AS area FROM mask GROUP BY ALL")
def otsu_mask_area(spark, d):
    return _mask(spark, d).groupBy(*K).agg(F.count("*").alias("area"))


def _box(n: int, half: int, extra: str = "") -> str:
    """Sums over blocks with reflected borders."""
    offs = f"range({-half}, {half + 1})"
    values = "sum(s.v) AS v, sum(s.v * s.v) AS q" if extra else "sum(s.v) AS v"
    again = "sum(s.v) AS v, sum(s.q) AS q" if extra else "sum(s.v) AS v"
    return f"""
    rowsums AS MATERIALIZED (SELECT d.c, d.z, d.y, d.x, {values} FROM grid d, {offs} t(k), grid s WHERE s.c = d.c AND s.z = d.z AND s.x = d.x AND s.y = {_mirror('d.y + t.k', n)} GROUP BY ALL),
    box AS MATERIALIZED (SELECT d.c, d.z, d.y, d.x, {again} FROM rowsums d, {offs} t(k), rowsums s WHERE s.c = d.c AND s.z = d.z AND s.y = d.y AND s.x = {_mirror('d.x + t.k', n)} GROUP BY ALL)"""


@query(f"WITH {GRID}, {_box(32, 2)} SELECT g.c, g.z, g.y, g.x, g.v FROM grid g JOIN box b ON b.c = g.c AND b.z = g.z AND b.y = g.y AND b.x = g.x WHERE g.v > b.v / 25 - 3")
def local_mean_threshold(spark, d):
    return th.local_mean_mask(grid(spark, d), K, SHAPE, 5, 3.0)


LOCAL_GAUSS = f"{GRID}, {_taps('block', (7 - 1) / 6)}, {_smooth_sql('grid', 'around', 'block')}"


@query(f"WITH {LOCAL_GAUSS} SELECT c, z, y, x, round(v - 2, 6) AS threshold FROM around")
def local_gaussian_threshold(spark, d):
    return rounded(th.local_thresholds(grid(spark, d), P, 7, method="gaussian", offset=2.0).drop("v"), "threshold")


@query(f"""WITH {GRID}, near AS (SELECT d.c, d.z, d.y, d.x, median(s.v) AS threshold FROM grid d, range(-1, 2) i(k), range(-1, 2) j(k), grid s
    WHERE s.c = d.c AND s.z = d.z AND s.y = {_mirror('d.y + i.k', 32)} AND s.x = {_mirror('d.x + j.k', 32)} GROUP BY ALL) SELECT c, z, y, x, threshold FROM near""")
def local_median_threshold(spark, d):
    return th.local_thresholds(grid(spark, d), P, 3, method="median").drop("v")


def _deviation(formula: str) -> str:
    return f"WITH {GRID}, {_box(32, 3, 'q')}, m AS (SELECT c, z, y, x, v / 49.0::DOUBLE AS m, sqrt(greatest(0, q / 49.0::DOUBLE - (v / 49.0::DOUBLE) * (v / 49.0::DOUBLE))) AS s FROM box) SELECT c, z, y, x, round({formula}, 4) AS threshold FROM m"


def _local4(spark, d, method):
    return th.local_thresholds(grid(spark, d), P, 7, method=method).drop("v").withColumn("threshold", F.round("threshold", 4))


@query(_deviation("m - 0.2 * s"))
def niblack_threshold(spark, d):
    return _local4(spark, d, "niblack")


@query(_deviation("m * (1 + 0.2 * (s / 128.0 - 1))"))
def sauvola_threshold(spark, d):
    return _local4(spark, d, "sauvola")


@query(f"WITH {GRID} SELECT g.c, g.z, g.y, g.x FROM grid g WHERE v > 90 AND EXISTS (FROM grid i WHERE i.c = g.c AND i.z = g.z AND i.y = g.y AND i.x = g.x AND i.v < 150) AND NOT EXISTS (FROM grid e WHERE e.c = g.c AND e.z = g.z AND e.y = g.y AND e.x = g.x AND e.v BETWEEN 120 AND 130)")
def mask_include_exclude(spark, d):
    g = grid(spark, d)
    mask, pixel = g.where("v > 90").select(*K, *P), [*K, *P]
    return th.exclude(th.include(mask, g.where("v < 150"), pixel), g.where("v between 120 and 130"), pixel)


@query(f"WITH {MASK} SELECT DISTINCT c, z, (y + dy)::INT AS y, (x + dx)::INT AS x FROM mask, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dx) WHERE y + dy BETWEEN 0 AND 31 AND x + dx BETWEEN 0 AND 31")
def dilate_one_step(spark, d):
    return comp.dilate_once(_mask(spark, d), K, SHAPE)


@query()
def dilate_to_area(spark, d):
    return comp.dilate_to_area(_mask(spark, d).where("v > 140"), K, 12, SHAPE)


# Labels


@query(f"WITH RECURSIVE {LABELS} SELECT c, z, y, x, label FROM labels")
def components_4conn(spark, d):
    return _labels(spark, d)


@query(f"WITH RECURSIVE {MASK}, {_labels_sql(connectivity=2)} SELECT c, z, y, x, label FROM labels")
def components_8conn(spark, d):
    return _labels(spark, d, 2)


@query(f"WITH RECURSIVE {LABELS} SELECT c, z, y, x, label FROM labels")
def components_tiled(spark, d):
    return comp.label_components(_mask(spark, d), P, 1, tile=9)


@query(f"""WITH RECURSIVE {GRID}, bright AS MATERIALIZED (SELECT c, z, y, x FROM grid WHERE v >= (SELECT quantile_cont(v, 0.8) FROM grid)),
    reach AS (
      SELECT c, z, y, x, (z * 32 + y) * 32 + x AS root FROM bright
      UNION
      SELECT m.c, m.z, m.y, m.x, r.root FROM reach r, (VALUES {_steps(3, 1)}) o(dz, dy, dx), bright m WHERE m.c = r.c AND m.z = r.z + o.dz AND m.y = r.y + o.dy AND m.x = r.x + o.dx)
    SELECT c, z, y, x, (dense_rank() OVER (PARTITION BY c ORDER BY root))::INT AS label FROM (SELECT c, z, y, x, min(root) AS root FROM reach GROUP BY ALL)""")
def components_3d(spark, d):
    g = grid(spark, d)
    level = g.agg(F.percentile("v", F.lit(0.8)).alias("level"))
    return comp.label_components(g.join(F.broadcast(level)).where("v >= level").drop("level"), ["z", *P], 1)


@query(f"WITH RECURSIVE {LABELS}, tops AS (SELECT c, z, max(label) AS top FROM labels GROUP BY ALL), starts AS (SELECT c, z, coalesce(sum(top) OVER (ORDER BY c, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM tops) SELECT c, z, y, x, (label + start)::INT AS label FROM labels JOIN starts USING (c, z)")
def relabel_unique_offsets(spark, d):
    return comp.unique_labels(_labels(spark, d), K).select(*K, *P, "label")


@query(f"WITH RECURSIVE {LABELS} SELECT c, z, y, x, (dense_rank() OVER (PARTITION BY c, z ORDER BY label))::INT AS label FROM labels WHERE label % 3 <> 0")
def remap_consecutive(spark, d):
    return comp.remap_consecutive(_labels(spark, d).where("label % 3 <> 0"), K)


@query(f"WITH RECURSIVE {LABELS} SELECT c, z, y, x, CASE WHEN label % 2 = 0 THEN label + 1000 ELSE label END AS label FROM labels")
def remap_by_mapping(spark, d):
    labels = Scratch(spark, "remap").save(_labels(spark, d), "labels")
    mapping = labels.where("label % 2 = 0").select(*K, F.col("label").alias("old_label"), (F.col("label") + 1000).alias("new_label")).distinct()
    return comp.remap(labels, mapping, K)


@query(f"WITH RECURSIVE {LABELS} SELECT c, z, y, x, label FROM labels WHERE label NOT IN (1, 4, 9)")
def remove_labels(spark, d):
    return comp.remove_labels(_labels(spark, d), [1, 4, 9], K)


@query(f"WITH RECURSIVE {LABELS}, f AS (SELECT DISTINCT c, z, label FROM labels WHERE label <> 5) SELECT (SELECT count(*) FROM (SELECT DISTINCT c, z, label FROM labels EXCEPT SELECT * FROM f)) AS mismatches")
def labels_match_features(spark, d):
    labels = Scratch(spark, "match").save(_labels(spark, d), "labels")
    table = labels.where("label <> 5").select(*K, "label").distinct()
    return comp.label_mismatches(labels, table, [*K, "label"]).agg(F.count("*").alias("mismatches"))


@query(f"WITH RECURSIVE {LABELS} SELECT c, z, label, count(*) AS area FROM labels GROUP BY ALL HAVING label % 2 = 1")
def keep_present_labels(spark, d):
    labels = Scratch(spark, "keep").save(_labels(spark, d), "labels")
    table = labels.groupBy(*K, "label").agg(F.count("*").alias("area"))
    return comp.keep_labels(table, labels.where("label % 2 = 1"), [*K, "label"])


# Region properties

_PROPS = """
    props AS MATERIALIZED (
      SELECT c, z, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1,
             CASE WHEN count(*) > 1 THEN var_samp(y) END AS vy, CASE WHEN count(*) > 1 THEN var_samp(x) END AS vx, CASE WHEN count(*) > 1 THEN covar_samp(y, x) END AS vyx
      FROM labels GROUP BY ALL)"""


@query(f"WITH RECURSIVE {LABELS}, {_PROPS} SELECT c, z, label, area, round(cy, 6) AS centroid_0, round(cx, 6) AS centroid_1, y0 AS bbox_0, x0 AS bbox_1, y1 AS bbox_2, x1 AS bbox_3, round(area / ((y1 - y0) * (x1 - x0)), 6) AS extent, round(sqrt(4 * area / pi()), 6) AS equivalent_diameter FROM props")
def region_props_basic(spark, d):
    out = regions.region_properties(_labels(spark, d), K, P, ["area", "centroid", "bbox", "extent", "equivalent_diameter"])
    return rounded(out, "centroid_0", "centroid_1", "extent", "equivalent_diameter")


_EIGEN = "sqrt((vy - vx) * (vy - vx) + 4 * vyx * vyx)"


@query(f"WITH RECURSIVE {LABELS}, {_PROPS}, e AS (SELECT *, (vy + vx + {_EIGEN}) / 2 AS a, (vy + vx - {_EIGEN}) / 2 AS b FROM props) SELECT c, z, label, round(CASE WHEN area >= 2 AND a > 0 AND b > 1e-12 * a THEN sqrt(b / a) END, 6) AS aspect_ratio FROM e")
def region_aspect_ratio_2d(spark, d):
    return rounded(regions.region_properties(_labels(spark, d), K, P, ["aspect_ratio"]), "aspect_ratio")


@query(f"WITH RECURSIVE {LABELS}, {_PROPS} SELECT c, z, label, round(vy, 6) AS cov_yy, round(vyx, 6) + 0.0 AS cov_yx, round(vx, 6) AS cov_xx FROM props")
def region_moments(spark, d):
    return rounded(regions.region_properties(_labels(spark, d), K, P, ["moments"]), "cov_yy", "cov_yx", "cov_xx")


_POPULATION = "SELECT c, z, label, coalesce(vy * (area - 1) / area, 0) + 1 / 12 AS vy, coalesce(vx * (area - 1) / area, 0) + 1 / 12 AS vx, coalesce(vyx * (area - 1) / area, 0) AS vyx FROM props"


@query(f"WITH RECURSIVE {LABELS}, {_PROPS}, p AS ({_POPULATION}), e AS (SELECT *, (vy + vx + {_EIGEN}) / 2 AS a, (vy + vx - {_EIGEN}) / 2 AS b FROM p) SELECT c, z, label, round(sqrt(greatest(0, 1 - b / a)), 4) AS eccentricity, round(4 * sqrt(a), 6) AS axis_major_length, round(4 * sqrt(greatest(b, 0)), 6) AS axis_minor_length FROM e")
def region_eccentricity(spark, d):
    out = regions.region_properties(_labels(spark, d), K, P, ["eccentricity", "axis_major_length", "axis_minor_length"])
    return rounded(out, "axis_major_length", "axis_minor_length").withColumn("eccentricity", F.round("eccentricity", 4))


@query(f"WITH RECURSIVE {LABELS}, {_PROPS} SELECT c, z, label, round(coalesce(vx * (area - 1) / area, 0) + 1e-9, 6) AS inertia_00, round(1e-9 - coalesce(vyx * (area - 1) / area, 0), 6) AS inertia_01, round(coalesce(vy * (area - 1) / area, 0) + 1e-9, 6) AS inertia_11 FROM props")
def region_inertia(spark, d):
    # Many entries end in a 5 after the sixth place; a little more, on both sides, keeps them from being rounded by chance.
    names = ["inertia_00", "inertia_01", "inertia_11"]
    out = regions.region_properties(_labels(spark, d), K, P, ["inertia_tensor"])
    return rounded(out.withColumns({n: F.col(n) + 1e-9 for n in names}), *names)


@query(f"WITH RECURSIVE {LABELS} SELECT c, z, label, string_agg(y || ',' || x, ';' ORDER BY y, x) AS coords FROM labels GROUP BY ALL")
def region_coords(spark, d):
    out = regions.region_properties(_labels(spark, d), K, P, ["coords"])
    return out.withColumn("coords", F.array_join(F.transform("coords", lambda p: F.concat_ws(",", p["y"], p["x"])), ";"))


@query(f"""WITH RECURSIVE {LABELS},
    boxes AS (SELECT c, z, label, min(y) - 1 AS y0, min(x) - 1 AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, count(*) AS area FROM labels GROUP BY ALL),
    room AS MATERIALIZED (SELECT b.c, b.z, b.label, e.y, f.x FROM boxes b, range(-1, 33) e(y), range(-1, 33) f(x) WHERE e.y BETWEEN y0 AND y1 AND f.x BETWEEN x0 AND x1 AND NOT EXISTS (FROM labels l WHERE l.c = b.c AND l.z = b.z AND l.label = b.label AND l.y = e.y AND l.x = f.x)),
    outside AS (SELECT c, z, label, y0::BIGINT AS y, x0::BIGINT AS x FROM boxes UNION SELECT r.c, r.z, r.label, r.y, r.x FROM outside o, (VALUES {_steps(2, 1)}) s(dy, dx), room r WHERE r.c = o.c AND r.z = o.z AND r.label = o.label AND r.y = o.y + s.dy AND r.x = o.x + s.dx),
    free AS (SELECT c, z, label, count(*) AS n FROM outside GROUP BY ALL), rows_ AS (SELECT c, z, label, count(DISTINCT y) AS n FROM labels GROUP BY ALL)
    SELECT c, z, label, ((y1 - y0 + 1) * (x1 - x0 + 1) - free.n)::DOUBLE AS area_filled, rows_.n::DOUBLE AS lines FROM boxes JOIN free USING (c, z, label) JOIN rows_ USING (c, z, label)""")
def region_filled_and_extra(spark, d):
    return regions.region_properties(_labels(spark, d), K, P, ["area_filled"], extra={"lines": lambda mask: mask.any(axis=1).sum()})


@query(f"WITH {GRID} SELECT c, z, y, max(v)::DOUBLE AS top FROM grid GROUP BY ALL")
def slice_rows(spark, d):
    """A function from slices to rows: the greatest value of each line."""
    return each_slice(grid(spark, d), P, lambda pdf: pdf.groupby("y", as_index=False)["v"].max().rename(columns={"v": "top"}).astype({"top": float}), "y int, top double")


_VOLUMES = "volumes AS MATERIALIZED (SELECT c, z, y, x, (1 + v % 3)::INT AS label FROM grid)"


def _volumes(spark, d):
    """Three labels of volumes by intensity, which needn't be connected."""
    return grid(spark, d).select("c", "z", *P, (1 + F.col("v") % 3).cast("int").alias("label"))


@query(f"WITH {GRID}, {_VOLUMES}, planes AS (SELECT c, label, z, count(*) AS n FROM volumes GROUP BY ALL) SELECT c, label, round(max(n) * 0.4::DOUBLE, 6) AS cross_sectional_area FROM planes GROUP BY ALL")
def region_cross_section(spark, d):
    return rounded(regions.cross_sections(_volumes(spark, d), ["c"], [1.5, 0.8, 0.5]), "cross_sectional_area")


@query(f"""WITH {GRID}, {_VOLUMES} SELECT c, label, count(*) AS num_pixels, round(count(*) * 1.5 * 0.8 * 0.5, 6) AS volume, round(avg(z) * 1.5, 6) AS centroid_0, round(avg(y) * 0.8, 6) AS centroid_1, round(avg(x) * 0.5, 6) AS centroid_2,
    min(z) AS bbox_0, min(y) AS bbox_1, min(x) AS bbox_2, max(z) + 1 AS bbox_3, max(y) + 1 AS bbox_4, max(x) + 1 AS bbox_5 FROM volumes GROUP BY ALL""")
def region_props_3d(spark, d):
    out = regions.region_properties(_volumes(spark, d), ["c"], ["z", *P], ["num_pixels", "area", "centroid", "bbox"], [1.5, 0.8, 0.5])
    return rounded(out, "volume", "centroid_0", "centroid_1", "centroid_2")


_P2 = "((a - q) * (a - q) + (b - q) * (b - q) + (c3 - q) * (c3 - q) + 2 * (d * d + e * e + f * f)) / 6"


@query(f"""WITH {GRID}, {_VOLUMES},
    m AS (SELECT c, label, count(*) AS n, var_samp(z) AS a, var_samp(y) AS b, var_samp(x) AS c3, covar_samp(z, y) AS d, covar_samp(y, x) AS e, covar_samp(z, x) AS f FROM volumes GROUP BY ALL),
    q AS (SELECT *, (a + b + c3) / 3 AS q FROM m),
    p AS (SELECT *, sqrt({_P2}) AS p FROM q),
    r AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c3 - q) - e * e) - d * (d * (c3 - q) - e * f) + f * (d * e - (b - q) * f)) / (2 * p * p * p)))) / 3 AS phi FROM p)
    SELECT c, label, round(CASE WHEN n >= 3 THEN sqrt((q + 2 * p * cos(phi + 2 * pi() / 3)) / (q + 2 * p * cos(phi))) END, 6) AS aspect_ratio FROM r""")
def region_aspect_ratio_3d(spark, d):
    return rounded(regions.region_properties(_volumes(spark, d), ["c"], ["z", *P], ["aspect_ratio"]), "aspect_ratio")


@query(f"""WITH {GRID}, {_VOLUMES},
    m AS (SELECT c, label, var_pop(z) AS a, var_pop(y) AS b, var_pop(x) AS c3, covar_pop(z, y) AS d, covar_pop(y, x) AS e, covar_pop(z, x) AS f FROM volumes GROUP BY ALL),
    q AS (SELECT *, (a + b + c3) / 3 AS q FROM m),
    p AS (SELECT *, sqrt({_P2}) AS p FROM q),
    r AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c3 - q) - e * e) - d * (d * (c3 - q) - e * f) + f * (d * e - (b - q) * f)) / (2 * p * p * p)))) / 3 AS phi FROM p)
    SELECT c, label, round(sqrt(20 * (q + 2 * p * cos(phi))), 6) AS axis_major_length, round(sqrt(20 * (q + 2 * p * cos(phi + 2 * pi() / 3))), 6) AS axis_minor_length, round(b + c3, 6) AS inertia_00, round(-d, 6) + 0.0 AS inertia_01 FROM r""")
def region_axes_3d(spark, d):
    out = regions.region_properties(_volumes(spark, d), ["c"], ["z", *P], ["axis_major_length", "axis_minor_length", "inertia_tensor"])
    return rounded(out, "axis_major_length", "axis_minor_length", "inertia_00", "inertia_01").select("c", "label", "axis_major_length", "axis_minor_length", "inertia_00", "inertia_01")


@query(f"""WITH {GRID}, {_VOLUMES}, open AS (SELECT v.c, v.label, count(*) AS faces FROM volumes v, (VALUES {_steps(3, 1)}) o(dz, dy, dx)
      WHERE NOT EXISTS (FROM volumes n WHERE n.c = v.c AND n.label = v.label AND n.z = v.z + o.dz AND n.y = v.y + o.dy AND n.x = v.x + o.dx) GROUP BY ALL),
    n AS (SELECT c, label, count(*) AS n FROM volumes GROUP BY ALL)
    SELECT c, label, round(pow(pi(), 1 / 3) * pow(6 * n, 2 / 3) / faces, 6) AS sphericity_faces FROM open JOIN n USING (c, label)""")
def region_sphericity(spark, d):
    return rounded(regions.region_properties(_volumes(spark, d), ["c"], ["z", *P], ["circularity"]), "sphericity_faces")


_STEP_CASE = "CASE " + " ".join(f"WHEN code IN ({', '.join(str(k) for k, w in regions.STEP_LENGTHS.items() if w == v)}) THEN {v!r}" for v in sorted({*regions.STEP_LENGTHS.values()})) + " ELSE 0 END"
_PERIMETER = f"""
    border AS MATERIALIZED (SELECT l.c, l.z, l.label, l.y, l.x FROM labels l WHERE (SELECT count(*) FROM labels n, (VALUES {_steps(2, 1)}) o(dy, dx) WHERE n.c = l.c AND n.z = l.z AND n.label = l.label AND n.y = l.y + o.dy AND n.x = l.x + o.dx) < 4),
    codes AS (SELECT b.c, b.z, b.label, b.y, b.x, sum(CASE abs(n.y - b.y) + abs(n.x - b.x) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END) AS code FROM border b JOIN border n ON n.c = b.c AND n.z = b.z AND n.label = b.label AND abs(n.y - b.y) <= 1 AND abs(n.x - b.x) <= 1 GROUP BY ALL),
    perimeters AS (SELECT c, z, label, sum({_STEP_CASE}) AS perimeter FROM codes GROUP BY ALL)"""


@query(f"WITH RECURSIVE {LABELS}, {_PERIMETER}, areas AS (SELECT c, z, label, count(*) AS area FROM labels GROUP BY ALL) SELECT c, z, label, round(perimeter, 6) AS perimeter, round(CASE WHEN perimeter > 0 THEN 4 * pi() * area / (perimeter * perimeter) END, 6) AS circularity FROM perimeters JOIN areas USING (c, z, label)")
def region_perimeter_circularity(spark, d):
    labels = Scratch(spark, "perimeter").save(_labels(spark, d), "labels")
    return rounded(regions.region_properties(labels, K, P, ["perimeter", "circularity"]), "perimeter", "circularity")


@query(f"WITH RECURSIVE {LABELS} SELECT c, z, label, min(v) AS intensity_min, max(v) AS intensity_max, round(avg(v), 6) AS intensity_mean FROM labels JOIN grid USING (c, z, y, x) GROUP BY ALL")
def region_intensity_stats(spark, d):
    return rounded(regions.intensity_properties(_labels(spark, d), grid(spark, d), K, P), "intensity_mean")


@query(f"""WITH RECURSIVE {LABELS},
    corners AS (SELECT DISTINCT c, z, label, y + dy AS y, x + dx AS x FROM labels, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx)),
    sides AS (SELECT DISTINCT c, z, label, k, y + dy AS y, x + dx AS x FROM labels, (VALUES (1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 0, 1)) o(k, dy, dx)),
    parts AS (SELECT c, z, label, 1 AS n FROM corners UNION ALL SELECT c, z, label, -1 FROM sides UNION ALL SELECT c, z, label, 1 FROM labels)
    SELECT c, z, label, sum(n)::BIGINT AS euler_number FROM parts GROUP BY ALL""")
def region_euler_number(spark, d):
    return regions.euler_numbers(_labels(spark, d), K)


@query()
def region_solidity(spark, d):
    return rounded(regions.convex_properties(_labels(spark, d), K), "solidity", "feret_diameter_max")


@query(f"WITH RECURSIVE {LABELS}, {_PROPS} SELECT c, z, label, area FROM props WHERE area BETWEEN 3 AND 50 AND area / ((y1 - y0) * (x1 - x0)) >= 0.5")
def region_filter_kept(spark, d):
    props = regions.region_properties(_labels(spark, d), K, P, ["area", "extent"])
    return filter_regions(props, [Range("area", (3, 50)), Range("extent", (0.5, 1.0)), Range("label")], K)[0].drop("extent")


@query(f"WITH RECURSIVE {LABELS}, {_PROPS}, e AS (SELECT *, (vy + vx + {_EIGEN}) / 2 AS a, (vy + vx - {_EIGEN}) / 2 AS b FROM props) SELECT c, z, label FROM e WHERE NOT coalesce(area >= 2 AND a > 0 AND b > 1e-12 * a AND sqrt(b / a) BETWEEN 0.3 AND 0.9, false)")
def region_filter_removed(spark, d):
    props = regions.region_properties(_labels(spark, d), K, P, ["aspect_ratio"])
    return filter_regions(props, [Range.around("aspect_ratio", 0.6, 0.3)], K)[1]


# Overlap of channels

_TWO = "fl AS (SELECT z, y, x, label FROM labels WHERE c = 'F'), ol AS (SELECT z, y, x, label FROM labels WHERE c = 'O')"
_SIZES = f"{_TWO}, fs AS (SELECT z, label AS label_a, count(*) AS na FROM fl GROUP BY ALL), os AS (SELECT z, label AS label_b, count(*) AS nb FROM ol GROUP BY ALL), common AS (SELECT fl.z, fl.label AS label_a, ol.label AS label_b, count(*) AS k FROM fl JOIN ol ON fl.z = ol.z AND fl.y = ol.y AND fl.x = ol.x GROUP BY ALL)"


def _pairs_sql(formula: str, least: float) -> str:
    return f"{_SIZES}, pairs AS (SELECT z, label_a, label_b, coalesce({formula}, 0) AS score, coalesce({formula}, 0) >= {least} AS above_threshold FROM fs JOIN os USING (z) LEFT JOIN common USING (z, label_a, label_b))"


_IOU, _DICE = "k::DOUBLE / (na + nb - k)", "2 * k::DOUBLE / (na + nb)"


@query(f"WITH RECURSIVE {LABELS}, {_pairs_sql(_IOU, 0.5)} SELECT z, label_a, label_b, round(score, 6) AS score, above_threshold FROM pairs")
def overlap_outline_iou(spark, d):
    a, b = _channels(spark, d)
    return rounded(overlap.outline_pairs(a, b, ["z"], P), "score")


@query(f"WITH RECURSIVE {LABELS}, {_pairs_sql(_DICE, 0.1)} SELECT z, label_a, label_b, round(score, 6) AS score, above_threshold FROM pairs WHERE score > 0")
def overlap_outline_dice(spark, d):
    a, b = _channels(spark, d)
    return rounded(overlap.outline_pairs(a, b, ["z"], P, method="dice", threshold=0.1, every=False), "score")


_BOXES = "boxes AS (SELECT c, z, label, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM labels GROUP BY ALL), met AS (SELECT a.z, a.label AS label_a, b.label AS label_b, (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS k, (a.y1 - a.y0) * (a.x1 - a.x0) AS na, (b.y1 - b.y0) * (b.x1 - b.x0) AS nb FROM boxes a JOIN boxes b ON a.z = b.z AND a.c = 'F' AND b.c = 'O' AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.x0 < b.x1 AND b.x0 < a.x1)"


def _box_regions(spark, d):
    props = Scratch(spark, "boxes").save(regions.region_properties(_labels(spark, d), K, P, ["bbox"]), "boxes")
    return props.where("c = 'F'").drop("c"), props.where("c = 'O'").drop("c")


@query(f"WITH RECURSIVE {LABELS}, {_BOXES} SELECT z, label_a, label_b, round({_IOU}, 6) AS score, {_IOU} >= 0.5 AS above_threshold FROM met")
def overlap_bbox_iou(spark, d):
    a, b = _box_regions(spark, d)
    return rounded(overlap.box_scores(a, b, ["z"], 2, cell=8), "score")


@query(f"WITH RECURSIVE {LABELS}, {_BOXES} SELECT z, label_a, label_b, round({_DICE}, 6) AS score, {_DICE} >= 0.1 AS above_threshold FROM met")
def overlap_bbox_dice(spark, d):
    a, b = _box_regions(spark, d)
    return rounded(overlap.box_scores(a, b, ["z"], 2, method="dice", threshold=0.1, cell=8), "score")


@query(f"WITH RECURSIVE {LABELS}, {_BOXES} SELECT z, label_a, label_b FROM met")
def bbox_overlap_pairs(spark, d):
    a, b = _box_regions(spark, d)
    return overlap.box_pairs(a, b, ["z"], 2, cell=8).select("z", "label_a", "label_b")


@query("""
    WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ingested_at DESC) AS rn FROM regions) WHERE rn = 1)
    SELECT a.region_id AS label_a, b.region_id AS label_b FROM c a JOIN c b ON a.image_id = b.image_id AND a.scene = b.scene AND a.t = b.t AND a.z = b.z AND lower(trim(a.stack_name)) = 'nucleus' AND lower(trim(b.stack_name)) = 'membrane'
    WHERE a.bbox_0 < b.bbox_2 AND b.bbox_0 < a.bbox_2 AND a.bbox_1 < b.bbox_3 AND b.bbox_1 < a.bbox_3""")
def bbox_overlap_regions(spark, d):
    from voxelloom.operators.current import SLICE, current_rows, stack_key

    boxes = [f"bbox_{k}" for k in range(4)]
    rows = current_rows(spark.read.parquet(f"{d}/regions.parquet").select("region_id", *SLICE, "stack_name", *boxes, "ingested_at"), "region_id", "ingested_at")
    named = rows.select(*SLICE, F.col("region_id").alias("label"), stack_key(F.col("stack_name")).alias("stack"), *boxes)
    return overlap.box_pairs(named.where("stack = 'nucleus'"), named.where("stack = 'membrane'"), SLICE, 2).select("label_a", "label_b")


@query(f"WITH RECURSIVE {LABELS}, {_BOXES} SELECT c, z, min(y0) AS bbox_0, min(x0) AS bbox_1, max(y1) AS bbox_2, max(x1) AS bbox_3 FROM boxes GROUP BY ALL")
def bbox_union(spark, d):
    return overlap.box_union(regions.region_properties(_labels(spark, d), K, P, ["bbox"]), K, 2)


@query(f"WITH RECURSIVE {LABELS}, {_pairs_sql(_IOU, 0.2)} SELECT z, label_a AS label, bool_or(above_threshold) AS \"O +\", round(max(score), 6) AS \"iou O +\" FROM pairs GROUP BY ALL")
def coincidence_consolidated(spark, d):
    a, b = _channels(spark, d)
    return rounded(overlap.coincidence_features(a, b, ["z"], P, ("F", "O"), method="iou", threshold=0.2)[0], "iou O +")


_FLAGSHIP = f"WITH RECURSIVE {LABELS}, big AS (SELECT c, z, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM labels GROUP BY ALL HAVING count(*) BETWEEN 2 AND 5000), kept AS (SELECT l.* FROM labels l SEMI JOIN big USING (c, z, label)), {_pairs_sql(_DICE, 0.1).replace('FROM labels', 'FROM kept')}, f AS (SELECT z, label_a AS label, bool_or(above_threshold) AS plus, max(score) AS best FROM pairs GROUP BY ALL) SELECT z, label, area, round(cy, 6) AS centroid_0, round(cx, 6) AS centroid_1, plus AS o_positive, round(best, 6) AS dice_o FROM big LEFT JOIN f USING (z, label) WHERE c = 'F'"


@query(_FLAGSHIP)
def coincidence_features_join(spark, d):
    how = Segmentation(mask=lambda v: th.otsu_mask(v, K), ranges=[Range("area", (2, 5000))], properties=["area", "centroid"])
    labels, props = segment(grid(spark, d), K, how)
    scratch = Scratch(spark, "coincidence")
    labels, props = scratch.save(labels, "labels"), scratch.save(props, "regions")
    per = {c: (labels.where(F.col("c") == c).drop("c"), props.where(F.col("c") == c).drop("c")) for c in ("F", "O")}
    out = coincidence({c: x[0] for c, x in per.items()}, {c: x[1] for c, x in per.items()}, ["z"], P)["F"]
    return rounded(out.withColumnRenamed("O +", "o_positive").withColumnRenamed("dice O +", "dice_o"), "centroid_0", "centroid_1", "dice_o")


@query(f"WITH RECURSIVE {LABELS}, {_pairs_sql(_IOU, 0.2)}, f AS (SELECT z, label_a AS label, bool_or(above_threshold) AS plus FROM pairs GROUP BY ALL) SELECT z, y, x, (CASE WHEN plus THEN 1 ELSE 2 END)::INT AS label FROM fl JOIN f USING (z, label)")
def coincidence_positive_split(spark, d):
    a, b = _channels(spark, d)
    features, _ = overlap.coincidence_features(a, b, ["z"], P, ("F", "O"), method="iou", threshold=0.2)
    return select.masks_to_labels(overlap.split_by_feature(a, features, ["z", "label"], "O +"), ["z", *P])


def _bands() -> list[Segmentation]:
    return [Segmentation(mask=lambda v: th.range_mask(v, 150, None)), Segmentation(mask=lambda v: th.range_mask(v, 110, 149), connectivity=2)]


_SERIES = f"{GRID}, m0 AS MATERIALIZED (SELECT * FROM grid WHERE v >= 150), m1 AS MATERIALIZED (SELECT * FROM grid WHERE v BETWEEN 110 AND 149), {_labels_sql('m0', 1, 'l0')}, {_labels_sql('m1', 2, 'l1')}, steps AS (SELECT *, 0 AS step FROM l0 UNION ALL SELECT *, 1 FROM l1)"


@query(f"WITH RECURSIVE {_SERIES} SELECT c, z, y, x, label, step FROM steps")
def series_segment_stack(spark, d):
    return segment_series(grid(spark, d), K, _bands())


@query(f"WITH RECURSIVE {_SERIES} SELECT c, z, y, x, sum(label)::INT AS label FROM steps GROUP BY c, z, y, x")
def series_segment_combine(spark, d):
    return segment_series(grid(spark, d), K, _bands(), output="combine")


@query()
def iterative_segment(spark, d):
    return segment_iteratively(grid(spark, d), K, _bands(), shape=SHAPE, most=20)


# Neighbours


@query("""
    WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ingested_at DESC) AS rn FROM regions) WHERE rn = 1),
    p AS (SELECT region_id, image_id, scene, t, z, centroid_0 AS y, centroid_1 AS x FROM c WHERE isfinite(centroid_0) AND isfinite(centroid_1)),
    near AS (SELECT a.region_id, b.region_id AS nearest, (b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x) AS d2 FROM p a JOIN p b USING (image_id, scene, t, z) WHERE a.region_id <> b.region_id),
    best AS (SELECT region_id, nearest, d2 FROM near QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY d2, nearest) = 1)
    SELECT region_id, nearest, round(sqrt(d2), 6) AS distance FROM p LEFT JOIN best USING (region_id)""")
def nearest_neighbor_distance(spark, d):
    from voxelloom.operators.current import SLICE, current_rows, is_number

    rows = current_rows(spark.read.parquet(f"{d}/regions.parquet").select("region_id", *SLICE, "centroid_0", "centroid_1", "ingested_at"), "region_id", "ingested_at")
    rows = rows.where(is_number(F.col("centroid_0")) & is_number(F.col("centroid_1")))
    return rounded(neighbors.nearest_distances(rows, SLICE, "region_id", F.col("centroid_0"), F.col("centroid_1"), cell=20.0), "distance")


@query(f"WITH RECURSIVE {LABELS} SELECT c, z, count(DISTINCT label) AS regions, round(count(DISTINCT label) / 1024, 6) AS density FROM labels GROUP BY ALL")
def object_density(spark, d):
    props = regions.region_properties(_labels(spark, d), K, P, ["label"])
    return rounded(neighbors.densities(props, K, F.lit(math.prod(SHAPE))), "density")
