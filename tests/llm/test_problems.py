"""The operators of llm on small cases: brute force, and nulls, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.llm import clusters, repetition
from voxelloom.llm.hooking import link_groups
from voxelloom.llm.mixing import mix
from voxelloom.llm.packing import evolve, pack_documents
from voxelloom.llm.percentiles import from_ordered_bits, histogram_percentiles, merge_histograms, ordered_bits, radix_histogram, select_ranks
from voxelloom.llm.repetition import above_level, adaptive_thresholds, merge_sketches, repeated_words, repetition_shares, repetitive, share_sketches
from voxelloom.llm.tokens import with_token_counts
from voxelloom.llm.topn import top_n


# Clusters


def _blobs(spark, n=300):
    rng = np.random.default_rng(3)
    rows = []
    for k, (a, c) in enumerate([(2.0, 0.1), (5.0, 0.5), (8.0, 0.9)]):
        rows += [(k * n + i, float(rng.normal(a, 0.1)), float(rng.normal(c, 0.01)), k) for i in range(n)]
    rows += [(10_000 + i, float(rng.uniform(0, 10)), float(rng.uniform(0, 1)), -1) for i in range(20)]
    rows += [(20_000, None, 0.1, 0), (20_001, float("nan"), float("inf"), -1), (None, 2.0, 0.1, 0)]
    return spark.createDataFrame(rows, "id long, a double, c double, cluster int")


def test_clusters_are_found_and_described(spark):
    df = _blobs(spark)
    model, data = clusters.fit(df, "id", {"a": F.col("a"), "c": F.col("c")}, cells=16)
    members = clusters.assign(data, model)
    got = {r["id"]: r["cluster"] for r in members.collect()}
    assert len(got) == 922 and got[20_001] is None
    for k in range(3):
        assert len({got[i] for i in range(k * 300, k * 300 + 300)}) == 1
    assert len({got[0], got[300], got[600]}) == 3
    lists = {r["cluster"]: r for r in clusters.describe(members, typical=3).collect()}
    mine = lists[got[0]]
    assert len(mine["typical"]) == 3 and mine["size"] >= 300
    near = sorted((r["distance"], r["id"]) for r in members.where(F.col("cluster") == got[0]).collect())[:3]
    assert mine["typical"] == [i for _, i in near]
    again = clusters.assign(*reversed(clusters.fit(df.repartition(7), "id", {"a": F.col("a"), "c": F.col("c")}, cells=16)))
    assert {r["id"]: r["cluster"] for r in again.where("id < 900").collect()} == {i: c for i, c in got.items() if i < 900}


def test_more_clusters_than_cells_at_first(spark):
    rng = np.random.default_rng(13)
    middles = np.array([(i, j, k) for i in range(5) for j in range(5) for k in range(4)], dtype=float)
    data = np.concatenate([m + rng.normal(0, 0.06, (120, 3)) for m in middles])
    strays = rng.uniform(-1, 6, (200, 3))
    rows = [(k, *map(float, v)) for k, v in enumerate(np.concatenate([data, strays]))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    model, table = clusters.fit(df, "id", {c: F.col(c) for c in "abc"}, cells=16)
    got = {r["id"]: r["cluster"] for r in clusters.assign(table, model).collect()}
    owners = [{got[i] for i in range(k * 120, k * 120 + 120)} - {None} for k in range(100)]
    assert all(len(o) == 1 for o in owners) and len(set().union(*owners)) == 100
    assert sum(got[i] is None for i in range(12_000)) <= 12 and sum(got[i] is None for i in range(12_000, 12_200)) >= 100


def test_gaps_in_histograms():
    bell = np.exp(-(np.arange(48) - 23.5) ** 2 / 60) * 300
    assert clusters.valley(bell) == (1.0, -1) and clusters.valley(np.zeros(48)) == (1.0, -1)
    two = np.exp(-(np.arange(48) - 10) ** 2 / 10) * 300 + np.exp(-(np.arange(48) - 38) ** 2 / 10) * 100
    assert 20 <= clusters.valley(two)[1] <= 28
    assert clusters.valley(np.random.default_rng(1).poisson(4, 48).astype(float)) == (1.0, -1)


def test_clusters_of_nothing_and_of_equal_records(spark):
    none = spark.createDataFrame([], "id long, a double")
    model, data = clusters.fit(none, "id", {"a": F.col("a")})
    assert model is None and clusters.assign(data, model).count() == 0
    same = spark.range(50).select("id", F.lit(1.0).alias("a"))
    model, data = clusters.fit(same, "id", {"a": F.col("a")})
    assert {r["cluster"] for r in clusters.assign(data, model).collect()} == {0}


# Percentiles

NUMBERS = [0.0, -0.0, 1.0, 2.0, 0.5, 3.7, 1e-310, 5e-324, 2.0**-1022, 1.7976931348623157e308, -1.0, -2.5, -1e-310, 1023.9999999999999, 1024.0, 1e15 + 0.5, 0.1]


def test_bits_sort_as_the_numbers_and_come_back(spark):
    rng = random.Random(1)
    numbers = NUMBERS + [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(500)] + [2.0**k for k in range(-1070, 1023, 7)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    rows = df.select("x", ordered_bits(F.col("x")).alias("b")).withColumn("y", from_ordered_bits(F.col("b"))).collect()
    for r in rows:
        (bits,) = struct.unpack("<q", struct.pack("<d", abs(r["x"])))
        assert r["b"] == (~bits if r["x"] < 0 else bits), r
        assert r["y"] == r["x"]
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double")
    assert {r[0] for r in bad.select(ordered_bits(F.col("x"))).collect()} == {None}


def test_ranks_against_sorting(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([0.0, 1.5, -3.0, rng.uniform(-1e6, 1e6), rng.random() * 1e-9])) for g in ("a", "b", None) for _ in range(400)]
    df = spark.createDataFrame(rows + [("a", None), ("a", float("nan"))], "g string, value double")
    targets = spark.createDataFrame([(g, r) for g in ("a", "b", "none") for r in (-1, 0, 1, 2, 200, 200, 399, 400, 401)], "g string, rank long")
    got = {(r["g"], r["rank"]): r["value"] for r in select_ranks(df, ["g"], "value", targets).collect()}
    want = {}
    for g in ("a", "b"):
        order = sorted(v for k, v in rows if k == g)
        want |= {(g, r): order[r - 1] for r in (1, 2, 200, 399, 400)}
    assert got == want


def test_merged_histograms_keep_the_bound(spark):
    rng = random.Random(4)
    values = [rng.lognormvariate(3, 2) for _ in range(3000)]
    df = spark.createDataFrame([(k % 3, v) for k, v in enumerate(values)], "day int, value double")
    parts = [radix_histogram(df.where(F.col("day") == d).withColumn("g", F.lit("x")), ["g"], "value", 20) for d in range(3)]
    whole = merge_histograms(parts, ["g"])
    for r in histogram_percentiles(whole, ["g"], [0.0, 0.1, 0.5, 0.99, 1.0], 20).collect():
        true = sorted(values)[max(1, math.ceil(r["quantile"] * 3000)) - 1]
        assert r["lower"] <= true <= r["upper"] and r["n"] == 3000
        assert r["upper"] / r["lower"] - 1 <= 2.0 ** (12 - 20)
    assert histogram_percentiles(radix_histogram(df.where("false"), ["day"], "value"), ["day"], [0.5]).count() == 0


# Groups of links


def _union_find(pairs):
    owner = {}

    def root(x):
        owner.setdefault(x, x)
        while owner[x] != x:
            x = owner[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            owner[y] = x
    return {x: root(x) for x in owner}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops"])
def test_groups_against_union_find(spark, kind):
    rng = random.Random(kind)
    pairs = {
        "chain": [(i, i + 1) for i in range(200)] + [(501, 500)],
        "star": [(77, i) for i in range(150)] + [(i, 77) for i in range(150)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(300)],
        "loops": [(1, 1), (2, 2), (2, 3), (3, 2), (3, 2), (9, None), (None, 4), (None, None)],
    }[kind]
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a long, b long, node string")
    assert {r["node"]: r["group"] for r in link_groups(df, "a", "b").collect()} == _union_find(pairs)


def test_groups_of_no_links(spark):
    assert link_groups(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# Top N


@pytest.mark.parametrize(("heavy", "parts"), [(20, 1), (10**9, 1), (10**9, 3), (10**9, 1_000)])
def test_top_n_against_sorting(spark, heavy, parts):
    rng = random.Random(5)
    rows = [(g, rng.choice([None, float("nan"), 0.1, 0.5, 0.9]), rng.randrange(5), k) for k in range(600) for g in [rng.choice(["hot"] * 6 + ["a", "b", None, "c"])]]
    df = spark.createDataFrame(rows, "g string, score double, salt int, place long")
    order = [F.col("score").desc_nulls_last(), F.col("salt"), F.col("place")]
    got = top_n(df, ["g"], order, 3, heavy_rows=heavy, heavy_parts=parts, part_rows=90, rank="tie_salt")
    want = {}
    for g in {r[0] for r in rows}:
        s = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, not (r[1] is not None and math.isnan(r[1])), 0.0 if r[1] is None or math.isnan(r[1]) else -r[1], r[2], r[3]))
        want |= {r[3]: i + 1 for i, r in enumerate(s[:3])}
    assert {r["place"]: r["tie_salt"] for r in got.collect()} == want
    assert got.columns == ["g", "score", "salt", "place", "tie_salt"]


def test_heavy_groups_are_sorted_by_range(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("g"), F.col("id").alias("s"))
    out = top_n(df, ["g"], [F.col("s").desc()], 2, unique=True)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "rangepartitioning" in plan
    assert sorted(r["s"] for r in out.where("g = -1").collect()) == [39_996, 39_999] and out.count() == 26_668


def test_top_n_ties_repeats_and_nothing(spark):
    df = spark.createDataFrame([("a", 1.0)] * 5 + [("b", 1.0)], "g string, s double")
    assert sorted(r["g"] for r in top_n(df, ["g"], [F.col("s")], 2, heavy_rows=2).collect()) == ["a", "a", "b"]
    assert top_n(df, ["g"], [F.col("s")], 0).count() == 0 and top_n(df.where("false"), ["g"], [F.col("s")], 2).count() == 0


# Packing


def test_evolution_keeps_items_and_reaches_the_bound():
    rng = random.Random(6)
    sizes = [x for a in (rng.randrange(100, 500) for _ in range(30)) for x in (a, 1000 - a)]
    best = evolve(sizes, 1000, 1, [])[0]
    assert sorted(i for b in best for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 1000 for b in best) and len(best) == 30


def test_packing_is_whole_and_only_long_documents_are_split(spark):
    rng = random.Random(7)
    sizes = [rng.randrange(0, 1500) for _ in range(400)] + [1000, 1001, 2000, 5321, None, -4, 0]
    df = spark.createDataFrame(list(enumerate(sizes)) + [(3, 700)], "doc_id long, size long")
    rows = pack_documents(df, 1000, block_items=60, epochs=2).collect()
    total, per = {}, {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["size"]
        per[r["container"]] = per.get(r["container"], 0) + r["size"]
    want = {k: max(0, s or 0) for k, s in enumerate(sizes)}
    want[3] += 700
    assert total == want and max(per.values()) <= 1000
    assert {r["doc_id"] for r in rows if r["pieces"] > 1} == {k for k, s in enumerate(sizes) if (s or 0) > 1000}
    assert len(per) <= 1.05 * sum(want.values()) / 1000 + 1


def test_packing_nothing(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, size long"), 10).count() == 0


# Token counts


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, "", 5), (3, None, 5), (4, "<|endoftext|> " * 3, 5), (5, "a b " * 200_000, 5)], "id long, text string, size int")
    out = with_token_counts(df, "text", "size", keep=["id", "size"])
    assert out.columns == ["id", "size", "size_"]
    got = {r["id"]: r["size_"] for r in out.collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 3 and got[5] >= 400_000


# Mixing


def test_mixture_reaches_targets_and_caps(spark):
    rng = random.Random(8)
    docs = [(k, s, rng.randrange(1, 100)) for k, s in enumerate(["big"] * 3000 + ["small"] * 300 + ["tiny"] * 20 + [None] * 50)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("tiny", 0.3, 4), ("gone", 0.0, 5)], "source string, target_share double, max_repeats int")
    copies, report = mix(df, targets, part_rows=500)
    rep = {r["source"]: r for r in report.collect()}
    total = sum(d[2] for d in docs)
    assert {s for s, r in rep.items() if r["short"]} == {"tiny", "gone"} | ({"small"} if 3 * sum(d[2] for d in docs if d[1] == "small") < 0.2 * total else set())
    used = copies.collect()
    assert len({r["doc_id"] for r in used}) == len(used)
    caps = {"big": 1, "small": 3, "tiny": 4}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in used)
    for s in ("big", "tiny"):
        want = min(rep[s]["wanted"], caps[s] * rep[s]["available"])
        got = sum(r["copies"] * r["size"] for r in used if r["source"] == s)
        assert abs(got - want) <= 0.02 * want + 100 and rep[s]["reached"] == got
    assert abs(sum(r["reached_share"] for r in rep.values()) - 1) < 1e-9


def test_mixture_hits_its_sizes_with_very_long_documents(spark):
    rng = random.Random(12)
    docs = [(s, n) for s in ("a", "b", "c", "d") for n in (rng.randrange(50, 400) for _ in range(300))]
    docs += [("a", 30_000), ("b", 30_000), ("b", 29_000), ("c", 200_000), *(("only", n) for n in (9_000, 10_000, 11_000, 12_000))]
    df = spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "doc_id long, source string, size long")
    targets = spark.createDataFrame([("a", 0.12, 1), ("b", 0.2, 3), ("c", 0.11, 2), ("d", 0.3, 2), ("only", 0.05, 1), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    for seed in (1, 2, 3):
        copies, report = mix(df, targets, seed=seed, part_rows=70)
        rep = {r["source"]: r for r in report.collect()}
        assert {s for s, r in rep.items() if r["short"]} == {"d", "none"}
        assert rep["d"]["copies"] == 2 * rep["d"]["documents"] and rep["d"]["reached"] == 2 * rep["d"]["available"]
        for s, r in rep.items():
            most = 6_000 if s == "only" else 0.005 * r["wanted"]
            assert r["short"] or abs(r["reached"] - r["wanted"]) <= most, r
        assert {(r["source"], r["copies"]) for r in copies.where("source = 'c' and size = 200000").collect()} == set()
    scaled = {r["source"]: r for r in mix(df, targets, rescale=True)[1].collect()}
    assert {s for s, r in scaled.items() if r["short"]} == {"none"}
    for s in "abd":
        assert abs(scaled[s]["reached"] - scaled[s]["wanted"]) <= 0.01 * scaled[s]["wanted"]
    assert scaled["d"]["reached"] >= 0.99 * 2 * scaled["d"]["available"]


def test_mixture_of_documents_without_size(spark):
    docs = spark.createDataFrame([(1, "a", 0), (2, "a", None), (3, "b", 5)], "doc_id long, source string, size long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1), ("c", 0.0, 1)], "source string, target_share double, max_repeats int")
    rep = {r["source"]: (r["short"], r["copies"], r["reached"]) for r in mix(docs, targets)[1].collect()}
    assert rep["a"] == (True, 4, 0) and not rep["b"][0] and rep["c"] == (True, 0, 0)


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", None, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    copies, report = mix(spark.createDataFrame([], "doc_id long, source string, size long"), targets)
    assert copies.count() == 0 and {r["source"]: (r["short"], r["reached"]) for r in report.collect()} == {"a": (True, 0), "b": (True, 0)}


# Repetition


def _brute(text, run=5):
    words, word = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            word += {"İ": "i"}.get(c, c.lower())
        elif word:
            words, word = [*words, word], ""
    seen, mark = set(), [False] * len(words)
    for i in range(len(words) - run + 1):
        key = tuple(words[i : i + run])
        if key in seen:
            mark[i : i + run] = [True] * run
        seen.add(key)
    return len(words), sum(mark)


def test_repeated_words_against_brute_force():
    rng = random.Random(9)
    texts = [None, "", " ", "a", "a b c d e", "a a a a a a", "A b C d E. a B c D e!", "x1y2z " * 9, "é_É é́ " * 7, "Ã¼ a²b ½ Ⅷ " * 8, "İi Iı ß " * 9] + [" ".join(rng.choice("abcdXY") for _ in range(rng.randrange(60))) for _ in range(200)] + [" ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(4000))]
    assert [repeated_words(t) for t in texts] == [_brute(t) for t in texts]


def test_very_long_text_is_measured_whole():
    body = " ".join(["alpha beta gamma delta epsilon zeta"] * 120_000)
    words, repeated = repeated_words(body)
    assert words == 720_000 and repeated == words - 6


def test_many_different_words_compare_exactly():
    words = ["".join(chr(97 + (k // 26**j) % 26) for j in range(4)) for k in range(30_000)]
    assert repeated_words(" ".join(words + words[:7]))[1] == 7


def test_adaptive_thresholds(spark):
    rows = [(k, "en" if k % 2 else "EN", "a", "one two three four five six " * (1 + k % 2)) for k in range(40)] + [(99, None, None, None), (100, "de", "b", "")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    shares = repetition_shares(df, "text", ["doc_id", "lang", "source"])
    strict = {r["doc_id"] for r in repetitive(shares, "lang", "source", quantile=0.5, least=0.0, most=1 / 3).collect()}
    assert strict == {k for k in range(40) if k % 2}
    assert repetitive(shares.where("false"), "lang", "source").count() == 0
    halves = [share_sketches(shares.where(c), ["source"]) for c in ("doc_id % 3 = 0", "doc_id % 3 <> 0")]
    merged = merge_sketches(halves[0].unionByName(halves[1]), ["source"])
    assert {r["source"]: r["n"] for r in merged.collect()} == {"a": 40, None: 1, "b": 1}
    assert {r["threshold"] for r in adaptive_thresholds(merged, ["source"], 0.99, 0.1, 0.4).collect()} == {0.1, 0.4}


def test_sketches_decide_what_is_above_a_level(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(k, rng.choice(["en", "En ", "de", None]), rng.choice(["a", "a", None]), rng.randrange(1, 300)) for k in range(6000)]
    rows = [(k, g, s, n, rng.choice([n // 3, n // 3 + 1, rng.randrange(n + 1)])) for k, g, s, n in rows] + [(9_000, "all", "x", 9, 9), (9_001, "none", "x", 9, 3)]
    df = spark.createDataFrame(rows, "lower int, lang string, source string, words int, repeated int").withColumn("share", F.col("repeated") / F.col("words"))
    df = df.unionByName(df.limit(1).withColumns({"lower": F.lit(-1), "share": F.lit(None).cast("double")}))
    exact = F.expr("3 * repeated > words")
    want = {k for k, _, _, n, r in rows if 3 * r > n}
    found = above_level(df, "lang", "source", 1 / 3, exact)
    assert {r["lower"] for r in found.collect()} == want and found.columns[-2:] == ["lower_", "upper"]
    # By the thresholds alone most are decided, and all of them rightly.
    sure = {r["lower"] for r in above_level(df, "lang", "source", 1 / 3, F.lit(False)).collect()}
    maybe = {r["lower"] for r in above_level(df, "lang", "source", 1 / 3, F.lit(True)).collect()}
    assert sure <= want <= maybe and 0 < len(maybe - sure) < 0.2 * len(rows) and len(sure) > 0.8 * len(want)
    assert above_level(df.where("false"), "lang", "source", 1 / 3, exact).count() == 0
    monkeypatch.setattr(repetition, "rank_bands", lambda s, by, level, error: s.select(*by, F.lit(0.9).alias("lower"), F.lit(0.9).alias("upper")))
    assert {r["lower"] for r in above_level(df, "lang", "source", 1 / 3, exact).collect()} != want


def test_many_ranks_of_one_group_with_one_value(spark):
    df = spark.range(3000).select(F.lit("g").alias("rank_"), F.when(F.col("id") < 2000, 0.0).otherwise(F.col("id").cast("double")).alias("value"))
    targets = spark.range(1, 3002).select(F.lit("g").alias("rank_"), F.col("id").alias("rank"))
    got = {r["rank"]: r["value"] for r in select_ranks(df, ["rank_"], "value", targets).collect()}
    assert got == {r: 0.0 if r <= 2000 else r - 1.0 for r in range(1, 3001)}


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "en", "s", "a b c d e " * 9, 0.5, 7)], "words long, lang string, source string, body string, share double, threshold int")
    shares = repetition_shares(df, "body", ["words", "lang", "source", "share", "threshold"])
    assert shares.columns == ["words", "lang", "source", "share", "threshold", "words_", "repeated", "share_"]
    out = repetitive(shares, "lang", "source", most=0.1, least=0.0, share="share_")
    assert out.columns[-1] == "threshold_" and out.first()["words"] == 1
