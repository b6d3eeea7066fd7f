from __future__ import annotations

from voxelloom.operators import matching
from voxelloom.queries import files

PATHS = [f"series{k * 7 % 23}/run_{k % 5}/{n}" for k in range(24) for n in (f"{k * k}.ome.tif", f"{k % 4}.tif", "img" + "xyz"[k % 3] + f"_{k // 2}.tif")]
PATHS += ["other\\7.tif", "zz/lab.ome.tif", "zz/8q.ome.tif"]


def _share(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def _name(path):
    return path.replace("\\", "/").rpartition("/")[2]


def _sides(spark, d, paths):
    spark.createDataFrame([(p,) for p in paths], "path string").write.parquet(f"{d}/image_manifest.parquet")
    digit = [p for p in sorted(set(paths)) if _name(p)[0].isdigit()]
    return digit, sorted(set(paths) - set(digit))


def test_pairs_are_matched_beyond_their_folders(spark, tmp_path):
    a, b = _sides(spark, tmp_path, PATHS)
    scores = {(r["path_a"], r["path_b"]): r["score"] for r in files.path_similarity(spark, str(tmp_path)).collect()}
    assert scores == {(x, y): round(_share(x, y), 6) for x in a for y in b}
    left, greedy = sorted((-_share(x, y), x, y) for x in a for y in b), []
    while left:
        greedy.append((left[0][1], left[0][2], round(-left[0][0], 6)))
        left = [p for p in left if p[1] != left[0][1] and p[2] != left[0][2]]
    got = [r[:] for r in files.pair_mutual_best(spark, str(tmp_path)).collect()]
    assert len(got) == min(len(a), len(b)) and sorted(got) == sorted(greedy)
    none = spark.createDataFrame([], "path string")
    assert matching.greedy_pairs(none, none).count() == matching.greedy_pairs(none, spark.createDataFrame([("x",)], "path string")).count() == 0


def test_candidates_fall_back_and_are_used_once(spark, tmp_path):
    a, b = _sides(spark, tmp_path, PATHS)
    suffix = lambda p: ".ome.tif" if p.endswith(".ome.tif") else _name(p)
    folder = lambda p: p.replace("\\", "/").rpartition("/")[0]
    left, want = list(b), []
    for x in a:
        same = [y for y in left if suffix(y) == suffix(x)]
        same = same or [y for y in left if folder(y) == folder(x)] or [y for y in left if _share(x, y) > 0]
        if same:
            want.append((x, max(same, key=lambda y: _share(x, y))))
            left.remove(want[-1][1])
    got = [r[:] for r in files.path_best_candidate(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len({y for _, y in got}) == len(got) == min(len(a), len(b))
