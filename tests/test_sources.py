from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import matching
from voxelloom.operators.filters import temporal_mean
from voxelloom.operators.neighbors import nearest_distances
from voxelloom.operators.select import resized_manifest
from voxelloom.sources import files
from voxelloom.sources.tiff import SCHEMA, TiffSource, page_places, planes_to_voxels, scenes, write_stacks
from voxelloom.streaming.frames import each_batch, temporal_mean_stream


@pytest.fixture
def folder(tmp_path):
    for name in ("a.tif", "b.TIF", "sub/c.tif", "sub/deep/d.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * len(name))
    return tmp_path


def names(df):
    return [r["path"].rsplit("/", 1)[1] for r in df.collect()]


def test_file_lists(spark, folder):
    assert names(files.list_files(spark, [str(folder)])) == ["a.tif", "b.TIF", "c.tif", "d.txt"]
    assert names(files.list_files(spark, [str(folder), str(folder / "a.tif")], include=["*.tif"])) == ["a.tif", "c.tif"]
    assert names(files.list_files(spark, [str(folder)], exclude=["*/sub/*", "b*"])) == ["a.tif"]
    assert names(files.list_files(spark, [str(folder)], recursive=False)) == ["a.tif", "b.TIF"]
    assert names(files.list_files(spark, [str(folder)], files=False, directories=True)) == ["sub", "deep"]
    assert files.list_files(spark, [str(folder / "none")]).count() == 0
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, [str(folder / "none")], skip_missing=False)
    assert names(files.without_substrings(files.list_files(spark, [str(folder)]), ["deep", "b."])) == ["a.tif", "c.tif"]


def test_list_files_of_paths(spark, tmp_path):
    (tmp_path / "list.txt").write_text('"/a b/1.tif" /l/1.tif\n\n/c/2.tif\n')
    got = [(r["first"], r["second"]) for r in files.read_list(spark, str(tmp_path / "list.txt")).orderBy("line").collect()]
    assert got == [("/a b/1.tif", "/l/1.tif"), ("/c/2.tif", None)]


def test_tables_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "label int, area double")
    out = f"{tmp_path}/t"
    files.write_table(df, out)
    with pytest.raises(FileExistsError):
        files.write_table(df, out)
    files.write_table(df, out, form="parquet", overwrite=True)
    assert spark.read.parquet(out).first()[:] == (1, 2.0)
    assert files.write_features({"A": df}, str(tmp_path)) == [f"{tmp_path}/Features_A"]
    with pytest.raises(ValueError):
        files.write_table(df, out, form="xls")


def test_stacks_come_back(spark, tmp_path):
    spark.dataSource.register(TiffSource)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 60000, (2, 3, 2, 5, 7))
    rows = [("im 1", *map(int, at), float(a[at])) for at in np.ndindex(a.shape)]
    df = spark.createDataFrame(rows, "image_id string, t int, c int, z int, y int, x int, v double")
    paths = write_stacks(df, str(tmp_path), ["image_id"], dtype="uint16", names={0: "A", 1: "B", 2: "C"}, sizes={"X": -0.5}).collect()
    assert [r["path"] for r in paths] == [f"{tmp_path}/im-1.ome.tif"]
    planes = spark.read.format("voxelloom-tiff").option("pages", 5).load(str(tmp_path))
    assert planes.count() == 12 and scenes(planes).count() == 1
    back = planes_to_voxels(planes).toPandas()
    got = np.zeros(a.shape)
    got[tuple(back[x] for x in ("t", "c", "z", "y", "x"))] = back["v"]
    assert (got == a).all()
    with pytest.raises(Exception, match="FileExistsError"):
        write_stacks(df, str(tmp_path), ["image_id"]).collect()
    split = write_stacks(df, str(tmp_path / "split"), ["image_id"], split_channels=True).collect()
    assert len(split) == 3


def test_packed_big_endian_pages(spark, tmp_path):
    spark.dataSource.register(TiffSource)
    a = np.arange(12, dtype=">u2").reshape(3, 4)
    difference = np.concatenate([a[:, :1], np.diff(a.astype(int), axis=1)], axis=1).astype(">u2")
    body = zlib.compress(difference.tobytes())
    tags = [(256, 3, 4), (257, 3, 3), (258, 3, 16), (259, 3, 8), (273, 4, 8), (277, 3, 1), (278, 3, 3), (279, 4, len(body)), (317, 3, 2)]
    at = 8 + len(body)
    ifd = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags) + struct.pack(">I", 0)
    (tmp_path / "p.tif").write_bytes(struct.pack(">2sHI", b"MM", 42, at) + body + ifd)
    got = planes_to_voxels(spark.read.format("voxelloom-tiff").load(str(tmp_path / "p.tif"))).orderBy("y", "x").collect()
    assert [r["v"] for r in got] == list(range(12))
    assert spark.read.format("voxelloom-tiff").load(str(tmp_path / "nothing")).count() == 0 and SCHEMA.count(",") == 8


def test_page_order():
    text = '<OME><Image><Pixels DimensionOrder="XYCZT" SizeC="2" SizeZ="2" SizeT="1"><Channel Name="A"/></Pixels></Image></OME>'
    assert page_places(4, text) == [(0, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 1), (0, 1, 0, 1)]
    assert page_places(3, text) == page_places(3, "") == [(0, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0, 2)]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    frames = [(y, t, float((7 * t + y) % 11)) for t in range(8) for y in range(3)]
    df = spark.createDataFrame(frames, "y int, t int, v double")
    source = tmp_path / "in"
    source.mkdir()
    for k, (lo, hi) in enumerate([(0, 1), (1, 4), (4, 8)]):
        pd.DataFrame([f for f in frames if lo <= f[1] < hi], columns=["y", "t", "v"]).astype({"y": "int32", "t": "int32"}).to_parquet(source / f"{k}.parquet")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = temporal_mean_stream(stream, ["y"], 4).writeStream.format("memory").queryName("means").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = {(r["y"], r["t"]): r["v"] for r in temporal_mean(df, 4).where("t < 7").collect()}
    assert {(r["y"], r["t"]): r["v"] for r in spark.table("means").collect()} == want
    q = each_batch(stream, lambda b: b.groupBy("t").agg(F.max("v").alias("top")), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_matching(spark):
    a = spark.createDataFrame([("x/img_1.tif",), ("x/img_2.tif",), ("y/img_1.tif",)], "path string")
    b = spark.createDataFrame([("x/lab_1.tif",), ("y/lab_1.tif",), ("y/lab_3.tif",)], "path string")
    assert matching.match_by_suffix(a, b, "img_*", "lab_*").count() == 4
    assert {r[:] for r in matching.match_by_place(a, b, "img_*", "lab_*").collect()} == {("x/img_1.tif", "x/lab_1.tif"), ("y/img_1.tif", "y/lab_1.tif")}
    assert {r[:] for r in matching.best_candidates(a, b, "img_*", "lab_*").collect()} == {("x/img_1.tif", "x/lab_1.tif"), ("x/img_2.tif", "y/lab_1.tif"), ("y/img_1.tif", "y/lab_3.tif")}
    assert matching.zip_paths(a, b).count() == 3 and matching.zip_paths(a, b.limit(1)).count() == 1
    scores = matching.path_scores(a, b)
    best = matching.mutual_best(scores).collect()
    left, greedy = sorted(((-r["score"], r["path_a"], r["path_b"]) for r in scores.collect())), []
    while left:
        greedy.append(left[0])
        left = [p for p in left if p[1] != left[0][1] and p[2] != left[0][2]]
    assert {(r["path_a"], r["path_b"]) for r in best} == {g[1:] for g in greedy} and scores.count() == 9
    assert matching.mutual_best(scores.where("false")).count() == 0


def test_datasets(spark):
    pairs = spark.createDataFrame([(k,) for k in range(10)], "k int")
    assert [r["part"] for r in matching.split_pairs(pairs, ["k"], 0.75).orderBy("k").collect()] == ["train"] * 7 + ["val"] * 3
    planes = spark.createDataFrame([(p, z) for p in "ab" for z in range(9)], "p string, z int")
    one = matching.sample_planes(planes, ["p"], 5, 1)
    assert one.count() == 10 and one.exceptAll(matching.sample_planes(planes.repartition(3), ["p"], 5, 1)).count() == 0
    labels = spark.createDataFrame([(0, 0), (0, 2), (1, 0)], "z int, label int")
    assert [r["z"] for r in matching.drop_empty_planes(labels, ["z"]).collect()] == [0]


def test_nearest(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 100.0, 0.0)], "id int, y double, x double").withColumn("g", F.lit(0))
    got = {r["id"]: (r["nearest"], r["distance"]) for r in nearest_distances(df, ["g"], "id", F.col("y"), F.col("x"), cell=5.0, most=5.0).collect()}
    assert got == {1: (2, 5.0), 2: (1, 5.0), 3: (None, None)}
    with pytest.raises(ValueError):
        nearest_distances(df, ["g"], "id", F.col("y"), F.col("x"), cell=1.0, most=5.0)


def test_manifest_sizes(spark):
    df = spark.sql("SELECT array('T','C','Z','Y','X') AS axes, array(1,3,2,100,200) AS shape, map('Y', 0.5D, 'X', 0.25D) AS scale, named_struct('Z', CAST(NULL AS DOUBLE), 'Y', 0.5D, 'X', 0.25D) AS physical_pixel_sizes")
    r = resized_manifest(df, F.array(*map(F.lit, (1, 3, 2, 50, 50)))).first()
    assert r["scale"] == {"Y": 1.0, "X": 1.0} and r["physical_pixel_sizes"]["X"] == 1.0 and r["shape"] == [1, 3, 2, 50, 50]
    r = resized_manifest(df, F.array(F.lit(100), F.lit(200))).first()
    assert r["axes"] == ["Y", "X"] and r["scale"] == {"Y": 0.5, "X": 0.25}
