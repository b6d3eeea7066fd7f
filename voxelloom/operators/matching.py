"""Which image file belongs to which label file, and what of a dataset is for training."""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.functions.strings import basename, characters, parent, path_similarity, shared_characters, suffix_of
from voxelloom.runtime import Scratch


def match_by_suffix(a: DataFrame, b: DataFrame, pattern_a: str, pattern_b: str) -> DataFrame:
    """(path_a, path_b) of files whose names are alike but for the fixed part of the patterns: all pairs of a suffix."""
    left = a.select(F.col("path").alias("path_a"), suffix_of(basename(F.col("path")), pattern_a).alias("suffix"))
    right = b.select(F.col("path").alias("path_b"), suffix_of(basename(F.col("path")), pattern_b).alias("suffix"))
    return left.join(right, "suffix").select("path_a", "path_b")


def match_by_place(a: DataFrame, b: DataFrame, pattern_a: str, pattern_b: str) -> DataFrame:
    """(path_a, path_b) by folder and suffix; of several files of one side with the same, the last by path counts."""

    def last(df: DataFrame, name: str, pattern: str) -> DataFrame:
        x = df.select(F.col("path").alias(name), parent(F.col("path")).alias("folder"), suffix_of(basename(F.col("path")), pattern).alias("suffix"))
        return x.groupBy("folder", "suffix").agg(F.max(name).alias(name))

    return last(a, "path_a", pattern_a).join(last(b, "path_b", pattern_b), ["folder", "suffix"]).select("path_a", "path_b")


def zip_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path_a, path_b): the first with the first and so on, both in order of path; what is left over has no partner.

    The places are counted over all paths of a side in one task: lists of files, not data.
    """
    w = Window.orderBy("path")
    left, right = (x.select("path").withColumn("place", F.row_number().over(w)) for x in (a, b))
    return left.withColumnRenamed("path", "path_a").join(right.withColumnRenamed("path", "path_b"), "place").select("path_a", "path_b")


def path_scores(a: DataFrame, b: DataFrame, block: Column | None = None) -> DataFrame:
    """(path_a, path_b, score) of paths that have the same `block` (a column of path); of all, without it."""
    if block is None:
        # Spread over the tasks, as a short list would be one task otherwise, however many pairs it makes.
        tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = a.select(F.col("path").alias("path_a")).repartition(tasks), b.select(F.col("path").alias("path_b"))
        pairs = left.withColumn("x", characters(F.col("path_a"))).crossJoin(right.withColumn("y", characters(F.col("path_b"))))
        return pairs.select("path_a", "path_b", shared_characters(F.col("x"), F.col("y")).alias("score"))
    s = path_similarity(F.col("path_a"), F.col("path_b")).alias("score")
    left = a.select(F.col("path").alias("path_a"), block.alias("block"))
    right = b.select(F.col("path").alias("path_b"), block.alias("block"))
    return left.join(right, "block").select("path_a", "path_b", s)


def mutual_best(scores: DataFrame, *, scratch: Scratch | None = None) -> DataFrame:
    """(path_a, path_b, score): each path once, the best pairs first, ties by path. In rounds: pairs that are the best of
    both their sides are taken together, which is what taking one after the other comes to."""
    scratch = scratch or Scratch(scores.sparkSession, "matching")
    left = scratch.save(scores.where("score is not null"), "left0")
    out: DataFrame | None = None
    order = [F.col("score").desc(), "path_a", "path_b"]
    step = 0
    while left.limit(1).count():
        step += 1
        ranked = left.withColumn("ra", F.row_number().over(Window.partitionBy("path_a").orderBy(*order))).withColumn("rb", F.row_number().over(Window.partitionBy("path_b").orderBy(*order)))
        taken = scratch.save(ranked.where("ra = 1 and rb = 1").select("path_a", "path_b", "score"), f"taken{step}")
        out = taken if out is None else out.unionByName(taken)
        left = scratch.save(left.join(taken.select("path_a"), "path_a", "left_anti").join(taken.select("path_b"), "path_b", "left_anti"), f"left{step}")
        scratch.drop(f"left{step - 1}")
    return out if out is not None else left


_NONE = np.iinfo(np.int64).max


class _Sets:
    """The sets of characters of a list of paths, each once; a score depends on nothing else of the paths."""

    def __init__(self, paths: list[str], alphabet: dict[str, int]):
        number: dict[frozenset, int] = {}
        self.own = [number.setdefault(frozenset(p), len(number)) for p in paths]
        self.has = np.zeros((len(number), len(alphabet)), dtype=np.float32)
        for s, k in number.items():
            self.has[k, [alphabet[c] for c in s]] = 1
        self.sizes = self.has.sum(axis=1).astype(float)

    def scores(self, k: int, others: _Sets) -> np.ndarray:
        """Of set k with all the others' sets."""
        common = (others.has @ self.has[k]).astype(float)
        union = self.sizes[k] + others.sizes - common
        return np.where(union == 0, 1.0, common / np.maximum(union, 1))


def _both(a: list[str], b: list[str]) -> tuple[_Sets, _Sets]:
    alphabet = {c: k for k, c in enumerate(sorted({c for p in (*a, *b) for c in p}))}
    return _Sets(a, alphabet), _Sets(b, alphabet)


class _Pool:
    """Places of paths in order, by set. `taken` is shared by all pools of a list."""

    def __init__(self, places: Iterable[int], own: list[int], taken: np.ndarray):
        queues: dict[int, list[int]] = {}
        for p in places:
            queues.setdefault(own[p], []).append(p)
        self.taken, self.sets, self.queues = taken, np.array(list(queues), dtype=int), [iter(q) for q in queues.values()]
        self.heads = np.array([next(q) for q in self.queues], dtype=np.int64)

    def best(self, scores: np.ndarray) -> tuple[float, int] | None:
        """(score, place) of the best that is left, ties to the first place."""
        while len(self.sets):
            mine = np.where(self.heads < _NONE, scores[self.sets], -1.0)
            top = mine.max()
            if top < 0:
                break
            at = np.flatnonzero(mine == top)
            k = at[self.heads[at].argmin()]
            if not self.taken[self.heads[k]]:
                return float(top), int(self.heads[k])
            self.heads[k] = next(self.queues[k], _NONE)
        return None


def _pools(keys: list[Hashable], own: list[int], taken: np.ndarray) -> dict[Hashable, _Pool]:
    places: dict[Hashable, list[int]] = {}
    for p, key in enumerate(keys):
        places.setdefault(key, []).append(p)
    return {key: _Pool(at, own, taken) for key, at in places.items()}


def _greedy(a: list[str], b: list[str]) -> list[tuple[int, int, float]]:
    """(place in a, place in b, score) of two lists in order of path. The sets of a wait by their best score, which can
    only fall as paths are taken; a set whose score still holds when its turn comes gives the next pair."""
    x, y = _both(a, b)
    taken = np.zeros(len(b), dtype=bool)
    pool = _Pool(range(len(b)), y.own, taken)
    queues: dict[int, list[int]] = {}
    for p in reversed(range(len(a))):
        queues.setdefault(x.own[p], []).append(p)
    turns, out = [(-2.0, q[-1], k) for k, q in queues.items()], []
    heapq.heapify(turns)
    while turns:
        bound, place, k = heapq.heappop(turns)
        found = pool.best(x.scores(k, y))
        if found is None:
            break
        if -found[0] != bound:
            heapq.heappush(turns, (-found[0], place, k))
            continue
        out.append((place, found[1], found[0]))
        taken[found[1]] = True
        queues[k].pop()
        if queues[k]:
            heapq.heappush(turns, (bound, queues[k][-1], k))
    return out


def greedy_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path_a, path_b, score): of all pairs the best first, each path once, ties by path_a, then path_b; the shorter
    side comes out whole. Taken one after the other, in one task that holds both lists but no pairs: lists of files,
    not data."""
    sides = a.select(F.lit(True).alias("left"), "path").distinct().unionByName(b.select(F.lit(False).alias("left"), "path").distinct())

    def take(df: pd.DataFrame) -> pd.DataFrame:
        x, y = (sorted(df.loc[df["left"] == side, "path"]) for side in (True, False))
        return pd.DataFrame([(x[i], y[j], s) for i, j, s in _greedy(x, y)], columns=["path_a", "path_b", "score"])

    return sides.where("path is not null").groupBy().applyInPandas(take, "path_a string, path_b string, score double")


def best_candidates(a: DataFrame, b: DataFrame, pattern_a: str, pattern_b: str) -> DataFrame:
    """(path_a, path_b): each a in order of path takes the best b that is left, and each b goes to one a. The best is one
    of the same suffix; without any, one of the same folder; without any, one of any similarity above 0. Of several the
    most similar, then the first by path. In one task, as greedy_pairs()."""

    def side(df: DataFrame, left: bool, pattern: str) -> DataFrame:
        p = F.col("path")
        return df.select(F.lit(left).alias("left"), "path", suffix_of(basename(p), pattern).alias("suffix"), parent(p).alias("folder")).distinct()

    def take(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("path", kind="stable")
        x, y = (df[df["left"] == k] for k in (True, False))
        paths_a, paths_b = list(x["path"]), list(y["path"])
        sets_a, sets_b = _both(paths_a, paths_b)
        taken, out = np.zeros(len(paths_b), dtype=bool), []
        suffixes, folders = list(y["suffix"]), list(y["folder"])
        tiers = [_pools(keys, sets_b.own, taken) for keys in (suffixes, folders, [None] * len(folders))]
        for k, suffix, folder in zip(range(len(paths_a)), x["suffix"], x["folder"]):
            scores = sets_a.scores(sets_a.own[k], sets_b)
            for n, (pools, key) in enumerate(zip(tiers, (suffix, folder, None))):
                found = pools[key].best(scores) if key in pools else None
                if found and (n < 2 or found[0] > 0):
                    out.append((paths_a[k], paths_b[found[1]]))
                    taken[found[1]] = True
                    break
        return pd.DataFrame(out, columns=["path_a", "path_b"])

    both = side(a, True, pattern_a).unionByName(side(b, False, pattern_b)).where("path is not null")
    return both.groupBy().applyInPandas(take, "path_a string, path_b string")


def drop_empty_planes(labels: DataFrame, key: list[str]) -> DataFrame:
    """Planes that have a label."""
    return labels.groupBy(*key).agg(F.sum("label").alias("total")).where("total > 0").drop("total")


def sample_planes(planes: DataFrame, pair: list[str], n: int, seed: int) -> DataFrame:
    """n planes of each pair (all, if it has fewer), the same for the same seed: those whose text has the least MD5 sum."""
    w = Window.partitionBy(*pair).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in planes.columns))), *planes.columns)
    return planes.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= n).drop("draw")


def split_pairs(pairs: DataFrame, order: list[str], ratio: float = 0.8) -> DataFrame:
    """Pairs with `part`: train for the first floor(ratio * n) in the order given, else val."""
    total = pairs.agg(F.count("*").alias("total"))
    placed = pairs.withColumn("place", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(total))
    return placed.withColumn("part", F.when(F.col("place") <= F.floor(F.lit(ratio) * F.col("total")), "train").otherwise("val")).drop("place", "total")
