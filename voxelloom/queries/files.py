"""Queries about files, over the paths of the manifest, and about datasets, over the mail's sources and the regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions.strings import basename, parent, suffix_of
from voxelloom.operators import matching
from voxelloom.operators.current import SLICE, current_rows
from voxelloom.sources.files import matches, without_substrings
from voxelloom.sources.grids import paths

_PATHS = "paths AS (SELECT DISTINCT path FROM image_manifest WHERE path IS NOT NULL), p AS (SELECT path, replace(path, chr(92), '/') AS q FROM paths), n AS (SELECT path, regexp_extract(q, '[^/]*$') AS name, regexp_replace(q, '/?[^/]*$', '') AS folder FROM p)"


def _sides(spark, d):
    """Files whose name starts with a digit, and the others."""
    every = paths(spark, d)
    digit = basename(F.col("path")).rlike("^[0-9]")
    return every.where(digit), every.where(~digit)


_SIDES = f"{_PATHS}, a AS (SELECT * FROM n WHERE regexp_matches(name, '^[0-9]')), b AS (SELECT * FROM n WHERE NOT regexp_matches(name, '^[0-9]'))"
_SUFFIX = "CASE WHEN ends_with(name, '.ome.tif') THEN '.ome.tif' ELSE name END"
_CHARS = "list_distinct(string_split({}, ''))"
_SCORE = f"len(list_intersect({_CHARS.format('a.path')}, {_CHARS.format('b.path')})) / len(list_distinct(list_concat({_CHARS.format('a.path')}, {_CHARS.format('b.path')})))"


def path_parts(spark, d):
    p = F.col("path")
    return paths(spark, d).select("path", basename(p).alias("name"), parent(p).alias("folder"), suffix_of(basename(p), "*.ome.tif").alias("suffix"))


def path_include_exclude(spark, d):
    return paths(spark, d).where(matches(F.col("path"), ["*.tif", "*.TIF"]) & ~matches(F.col("path"), ["[0-4]*", "*run_7*"]))


def path_exclude(spark, d):
    return without_substrings(paths(spark, d), ["run_1", "series0"])


def path_suffix_match(spark, d):
    a, b = _sides(spark, d)
    return matching.match_by_suffix(a, b, "*.ome.tif", "*.ome.tif")


def path_place_match(spark, d):
    """Images and the label images that would lie beside them."""
    every = paths(spark, d)
    labels = every.select(F.concat(parent(F.col("path")), F.lit("/Labels_"), basename(F.col("path"))).alias("path"))
    return matching.match_by_place(every, labels, "*", "Labels_*")


def pair_zip(spark, d):
    return matching.zip_paths(*_sides(spark, d))


def path_similarity(spark, d):
    return matching.path_scores(*_sides(spark, d)).withColumn("score", F.round("score", 6))


def path_best_candidate(spark, d):
    a, b = _sides(spark, d)
    return matching.best_candidates(a, b, "*.ome.tif", "*.ome.tif")


def pair_mutual_best(spark, d):
    return matching.greedy_pairs(*_sides(spark, d)).withColumn("score", F.round("score", 6))


def train_val_split(spark, d):
    return matching.split_pairs(paths(spark, d), ["path"])


def drop_empty_planes(spark, d):
    rows = current_rows(spark.read.parquet(f"{d}/regions.parquet").select("region_id", *SLICE, "label", "area", "ingested_at"), "region_id", "ingested_at")
    return matching.drop_empty_planes(rows.withColumn("label", F.when(F.col("area") > 1000, F.col("label")).otherwise(0)), SLICE)


def sample_planes(spark, d):
    planes = spark.read.parquet(f"{d}/regions.parquet").select(*SLICE).distinct()
    return matching.sample_planes(planes, ["image_id"], 2, 17)


QUERIES = {f.__name__: f for f in (path_parts, path_include_exclude, path_exclude, path_suffix_match, path_place_match, pair_zip, path_similarity, path_best_candidate, pair_mutual_best, train_val_split, drop_empty_planes, sample_planes)}

SQL = {
    "path_parts": f"WITH {_PATHS} SELECT path, name, folder, CASE WHEN ends_with(name, '.ome.tif') THEN '.ome.tif' ELSE name END AS suffix FROM n",
    "path_include_exclude": f"WITH {_PATHS} SELECT path FROM n WHERE (name GLOB '*.tif' OR name GLOB '*.TIF') AND NOT name GLOB '[0-4]*' AND NOT path GLOB '[0-4]*' AND NOT path GLOB '*run_7*'",
    "path_exclude": f"WITH {_PATHS} SELECT path FROM n WHERE NOT contains(path, 'run_1') AND NOT contains(path, 'series0')",
    "path_suffix_match": f"WITH {_SIDES}, x AS (SELECT path, CASE WHEN ends_with(name, '.ome.tif') THEN '.ome.tif' ELSE name END AS suffix FROM a), y AS (SELECT path, CASE WHEN ends_with(name, '.ome.tif') THEN '.ome.tif' ELSE name END AS suffix FROM b) SELECT x.path AS path_a, y.path AS path_b FROM x JOIN y USING (suffix)",
    "path_place_match": f"""WITH {_PATHS}, x AS (SELECT folder, name, max(path) AS path_a FROM n GROUP BY ALL), y AS (SELECT folder, name, max(folder || '/Labels_' || name) AS path_b FROM n GROUP BY ALL)
        SELECT path_a, path_b FROM x JOIN y USING (folder, name)""",
    "pair_zip": f"WITH {_SIDES}, x AS (SELECT path AS path_a, row_number() OVER (ORDER BY path) AS k FROM a), y AS (SELECT path AS path_b, row_number() OVER (ORDER BY path) AS k FROM b) SELECT path_a, path_b FROM x JOIN y USING (k)",
    "path_similarity": f"WITH {_SIDES} SELECT a.path AS path_a, b.path AS path_b, round({_SCORE}, 6) AS score FROM a, b",
    "path_best_candidate": f"""WITH RECURSIVE {_SIDES},
        x AS (SELECT path, folder, {_SUFFIX} AS suffix, row_number() OVER (ORDER BY path) AS turn FROM a), y AS (SELECT path, folder, {_SUFFIX} AS suffix FROM b),
        pairs AS (SELECT a.turn, a.path AS path_a, b.path AS path_b, CASE WHEN a.suffix = b.suffix THEN 0 WHEN a.folder = b.folder THEN 1 ELSE 2 END AS tier, {_SCORE} AS score FROM x a, y b),
        ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY tier, score DESC, path_b) AS k FROM pairs WHERE tier < 2 OR score > 0),
        turns AS (
          SELECT 0::BIGINT AS turn, NULL::BIGINT AS k, []::VARCHAR[] AS used
          UNION ALL
          SELECT n.turn, n.k, CASE WHEN n.k IS NULL THEN used ELSE list_append(used, r.path_b) END
          FROM (SELECT t.turn + 1 AS turn, t.used, min(r.k) AS k FROM turns t LEFT JOIN ranked r ON r.turn = t.turn + 1 AND NOT list_contains(t.used, r.path_b) WHERE t.turn < (SELECT count(*) FROM a) GROUP BY ALL) n
          LEFT JOIN ranked r ON r.turn = n.turn AND r.k = n.k)
        SELECT path_a, path_b FROM ranked JOIN turns USING (turn, k)""",
    "sample_planes": "SELECT image_id, scene, t, z FROM (SELECT DISTINCT image_id, scene, t, z FROM regions) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY md5(concat_ws('|', '17', image_id, scene, t, z)), image_id, scene, t, z) <= 2",
    "pair_mutual_best": f"""WITH RECURSIVE {_SIDES},
        scored AS MATERIALIZED (SELECT path_a, path_b, score, row_number() OVER (ORDER BY score DESC, path_a, path_b) AS k FROM (SELECT a.path AS path_a, b.path AS path_b, {_SCORE} AS score FROM a, b)),
        taken AS (
          SELECT 0::BIGINT AS k, []::VARCHAR[] AS used_a, []::VARCHAR[] AS used_b
          UNION ALL
          SELECT n.k, list_append(used_a, path_a), list_append(used_b, path_b)
          FROM (SELECT used_a, used_b, min(s.k) AS k FROM taken t, scored s WHERE NOT list_contains(t.used_a, s.path_a) AND NOT list_contains(t.used_b, s.path_b) GROUP BY ALL) n JOIN scored s ON s.k = n.k)
        SELECT path_a, path_b, round(score, 6) AS score FROM scored JOIN taken USING (k)""",
    "train_val_split": f"WITH {_PATHS} SELECT path, CASE WHEN row_number() OVER (ORDER BY path) <= floor(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'val' END AS part FROM n",
    "drop_empty_planes": "SELECT DISTINCT image_id, scene, t, z FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ingested_at DESC) AS rn FROM regions) WHERE rn = 1 AND area > 1000 AND label > 0",
}
