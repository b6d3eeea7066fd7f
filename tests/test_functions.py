from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxelloom.functions.parse import axes_of, frame_range, renames, substack_ranges
from voxelloom.functions.strings import basename, glob_regex, parent, path_similarity, suffix_of
from voxelloom.plans.registry import StepConfig, build, operator, operators, parser


@pytest.mark.parametrize(("text", "want"), [("10", (9, 9)), ("2-40", (1, 39)), (None, (None, None)), ("", (None, None))])
def test_frame_ranges(text, want):
    assert frame_range(text) == want


@pytest.mark.parametrize("text", ["a-b", "abc", "-1", "40-2", "0"])
def test_bad_frame_ranges(text):
    with pytest.raises(ValueError):
        frame_range(text)


def test_substacks():
    assert substack_ranges("T:4-10;Z:2-20") == {"T": (3, 10), "Z": (1, 20)}
    assert substack_ranges("2-40", "Z") == {"Z": (1, 40)} and substack_ranges(None) == {}
    for bad in ("Q:1-2", "T:1;T:2", "T:", "T:0"):
        with pytest.raises(ValueError):
            substack_ranges(bad)


def test_renames():
    assert renames("Red:Dpn; Blue:EDU") == {"Red": "Dpn", "Blue": "EDU"} and renames(None) == {}
    for bad in ("a", ":x", "a:"):
        with pytest.raises(ValueError):
            renames(bad)


def test_axes():
    assert [axes_of(n) for n in (2, 3, 4, 5)] == ["YX", "ZYX", "CZYX", "TCZYX"] and axes_of(6).endswith("YX")
    with pytest.raises(ValueError):
        axes_of(1)


def test_paths(spark):
    df = spark.createDataFrame([("a\\b/Preprocessed_Red.tif",), ("x.tif",)], "path string")
    rows = df.select(basename(F.col("path")), parent(F.col("path"))).collect()
    assert [tuple(r) for r in rows] == [("Preprocessed_Red.tif", "a/b"), ("x.tif", "")]
    name = F.lit("Preprocessed_Red.tif")
    got = df.limit(1).select(*(suffix_of(name, p) for p in ("Preprocessed_*.tif", "*Preprocessed_Red.tif", "Preprocessed_*", "nothing", "other_*", "*_*"))).first()
    assert list(got) == ["Red.tif", "Preprocessed_Red.tif", "Red.tif", "Preprocessed_Red.tif", "Preprocessed_Red.tif", "Preprocessed_Red.tif"]
    assert df.limit(1).select(path_similarity(F.lit("abc"), F.lit("bcd")), path_similarity(F.lit(""), F.lit(""))).first()[:] == (0.5, 1.0)


def test_globs(spark):
    df = spark.createDataFrame([(n,) for n in ("a.tif", "b.tif", "ab.tif", "a.tiff", "[x].tif", "é.tif")], "n string")
    match = lambda g: {r[0] for r in df.where(F.col("n").rlike(glob_regex(g))).collect()}
    assert match("?.tif") == {"a.tif", "b.tif", "é.tif"} and match("[!a]*.tif") == {"b.tif", "[x].tif", "é.tif"} and match("*.tif*") == {r[0] for r in df.collect()}


def test_registry(spark):
    assert "dog" in operators("preprocess") and operator("DoGConfig") is operator("dog")
    assert StepConfig.parse('{"classname": "TemporalMean", "window": 3}') == StepConfig("TemporalMean", {"window": 3})
    assert StepConfig.parse('\\{\\"name\\": \\"DoG\\"}').name == "DoG" and StepConfig.parse("Grayscale").name == "Grayscale"
    with pytest.raises(KeyError):
        build(["nothing"])
    with pytest.raises(ValueError):
        build(["Labeller"], "preprocess")
    df = spark.createDataFrame([(0, t, 0, 0, float(3 * t)) for t in range(3)], "c int, t int, y int, x int, v double")
    out = build(['{"name": "TemporalMean", "window": 3}', "Rescale"], "preprocess")(df)
    assert [r["v"] for r in out.orderBy("t").collect()] == [0.0, 0.5, 1.0]
    assert parser().parse_args(["segment", "-i", "a", "-o", "b", "-s", "OtsuThreshold", "-s", "Labeller"]).step == ["OtsuThreshold", "Labeller"]
