from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.plans import registry
from voxelloom.sources import files, grids
from voxelloom.sources.tiff import load_stacks, write_stacks


@pytest.fixture(scope="module")
def stack(spark, tmp_path_factory):
    """A TIFF file with two channels of two planes: squares of 4 x 4, shifted by one in the second channel."""
    folder = tmp_path_factory.mktemp("tiff")
    a = np.zeros((1, 2, 2, 20, 24))
    for c in range(2):
        for z in range(2):
            for k in range(3):
                a[0, c, z, 2 + 6 * k + c : 6 + 6 * k + c, 3 + 5 * z : 7 + 5 * z] = 200 + k
    rows = [("im", 0, int(t), int(c), int(z), int(y), int(x), float(a[t, c, z, y, x])) for t, c, z, y, x in np.ndindex(a.shape)]
    write_stacks(spark.createDataFrame(rows, "image_id string, scene int, t int, c int, z int, y int, x int, v double"), str(folder), ["image_id"], dtype="uint8").collect()
    return str(folder)


def test_loader_chooses_planes_first(spark, stack):
    some = load_stacks(spark, stack, substack="Z:2;Y:3-8", names={"1": "EDU"}, scene=0)
    assert some.count() == 2 * 6 * 24 and {r["c"] for r in some.select("c").distinct().collect()} == {"0", "EDU"}
    assert load_stacks(spark, stack, gray=True).count() == 2 * 20 * 24 and load_stacks(spark, stack, scene=1).count() == 0


def test_commands_from_tiff(spark, stack, tmp_path):
    assert registry.main(["preprocess", "-i", stack, "-o", f"{tmp_path}/pre", "-s", "Rescale", "--substack", "Z:1"]) == 0
    assert spark.read.parquet(f"{tmp_path}/pre").agg(F.max("v"), F.count("*")).first()[:] == (1.0, 2 * 20 * 24)
    assert registry.main(["segment", "-i", stack, "-o", f"{tmp_path}/seg", "--regions", f"{tmp_path}/regions", "--property", "extent", "--range", "area:4:100", "-s", "OtsuThreshold"]) == 0
    regions = spark.read.parquet(f"{tmp_path}/regions")
    assert regions.count() == 12 and {r["area"] for r in regions.collect()} == {16} and spark.read.parquet(f"{tmp_path}/seg").count() == 12 * 16
    assert registry.main(["coincidence", "-i", stack, "-o", f"{tmp_path}/co", "--threshold", "0.7"]) == 0
    table = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/co/Features_0")
    assert table.count() == 6 and {(r["1 +"], r["dice 1 +"]) for r in table.collect()} == {(True, 0.75)}
    assert registry.main(["train", "-i", stack, "-o", f"{tmp_path}/set"]) == 0
    pairs = spark.read.parquet(f"{tmp_path}/set/pairs").collect()
    assert len(pairs) == 4 and all(r["image"].rpartition("/")[2] == r["label"].rpartition("/")[2] for r in pairs)
    with pytest.raises(Exception, match="exist"):
        registry.main(["preprocess", "-i", stack, "-o", f"{tmp_path}/pre", "-s", "Rescale"])


def test_operators_by_name(spark, stack):
    voxels = load_stacks(spark, stack)
    assert len(registry.operators()) >= 20 and "regionanalyzer" in registry.operators("analyze")
    chain = registry.build(['{"classname": "SegmenterConfig", "mask": {"name": "RangeThreshold", "low": 100, "high": 255}}', '{"name": "LabelRemover", "labels": [2], "renumber": true}', '{"name": "RegionAnalyzer", "properties": ["area", "bbox"]}', '{"name": "RegionFilter", "ranges": {"area": [16, 16]}}'])
    assert {r["label"] for r in voxels.transform(chain).collect()} == {1, 2}
    assert voxels.transform(registry.build(['{"name": "Resize", "height": 10}'])).count() == 4 * 10 * 12
    series = registry.build(['{"name": "SeriesSegmenter", "masks": [{"name": "RangeThreshold", "low": 201, "high": 255}], "output": "last"}'])
    assert voxels.transform(series).select("label").distinct().count() == 2


def test_file_lists(spark, tmp_path):
    (tmp_path / "list.txt").write_text('a b\n\n"c d" e\r\nlast')
    assert [r[:] for r in files.read_list(spark, str(tmp_path / "list.txt")).orderBy("line").collect()] == [(1, "a", "b"), (3, "c d", "e"), (4, "last", None)]
    paths = spark.createDataFrame([("/r/one/x/a.tif",), ("/r/two\\b.tif",), ("c.tif",)], "path string")
    keyed = {r["path"]: r["key"] for r in files.relative_keys(paths, ["/r/one", "/r/two/"]).collect()}
    assert list(keyed.values()) == ["one/x/a.tif", "two/b.tif", "c.tif"]
    assert [r["path"] for r in paths.where(files.matches_regex(F.col("path"), ["^c", "two.b"])).collect()] == ["/r/two\\b.tif", "c.tif"]


def test_places_beyond_a_box_are_an_error(spark):
    df = spark.createDataFrame([(0, 1, 5), (1, 3, 6)], "y int, x int, v int")
    assert grids.densify(df, {"y": 2, "x": 4}).agg(F.sum("v")).first()[0] == 11
    with pytest.raises(Exception, match="beyond the box"):
        grids.densify(df, {"y": 2, "x": 3}).collect()
