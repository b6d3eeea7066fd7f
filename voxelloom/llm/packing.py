"""Filling containers of fixed capacity with items of varying length by a grouping genetic algorithm.

An individual is a whole packing. Crossover injects well-filled bins of one parent into the other, removes the bins there
that hold one of the same items, and best-fits the items this displaces. Bins, not items, are what is inherited.

Items are dealt to blocks of bounded size by hash. Several islands evolve each block in tasks of their own; after each
epoch an island's elite migrates to the next one in a ring. A block whose packing needs no more bins than its sizes
demand is finished early: no packing is better. What lies in badly filled bins at the end of a round is dealt to new,
fewer blocks and packed again, until one block is left or nothing is gained.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.runtime import Scratch

BLOCK_ITEMS = 2_000
ISLANDS = 3
EPOCHS = 3
GENERATIONS = 12
POPULATION = 6
ELITE = 2
WELL_FILLED = 0.98
MOST_ROUNDS = 6

Packing = list[list[int]]


class _Open:
    """Bins with room, by the room they have."""

    def __init__(self, bins: Packing, room: list[int]):
        self.bins, self.room = bins, room
        self.order = sorted((r, b) for b, r in enumerate(room))

    def put(self, item: int, size: int, capacity: int) -> None:
        at = bisect_left(self.order, (size, -1))
        if at < len(self.order):
            room, b = self.order.pop(at)
        else:
            room, b = capacity, len(self.bins)
            self.bins.append([])
            self.room.append(capacity)
        self.bins[b].append(item)
        self.room[b] = room - size
        insort(self.order, (room - size, b))


def best_fit(bins: Packing, items: list[int], sizes: list[int], capacity: int) -> Packing:
    """Each item, in the order given, goes where the least room is left after it."""
    bins = [list(b) for b in bins]
    into = _Open(bins, [capacity - sum(sizes[i] for i in b) for b in bins])
    for i in items:
        into.put(i, sizes[i], capacity)
    return bins


def fitness(bins: Packing, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those filled less evenly, which leave larger gaps in one place."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    fills = np.array([sum(sizes[i] for i in x) for x in b])
    best = np.argsort(-fills, kind="stable")[: max(1, int(len(b) * rng.uniform(0.2, 0.6)))]
    injected = [b[k] for k in best[rng.random(len(best)) < 0.7]] or [b[best[0]]]
    taken = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in taken]
    return best_fit(injected + kept, sorted(displaced, key=lambda i: (-sizes[i], i)), sizes, capacity)


def mutate(bins: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """The emptiest bins and a few others are emptied; their items go in again, larger ones first but for a little noise."""
    fills = np.array([sum(sizes[i] for i in x) for x in bins])
    gone = set(np.argsort(fills, kind="stable")[: 1 + len(bins) // 50].tolist()) | set(rng.choice(len(bins), min(len(bins), 3), replace=False).tolist())
    loose = [i for k in gone for i in bins[k]]
    noise = dict(zip(loose, rng.uniform(0.8, 1.25, len(loose))))
    return best_fit([x for k, x in enumerate(bins) if k not in gone], sorted(loose, key=lambda i: (-sizes[i] * noise[i], i)), sizes, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, start: list[Packing], *, generations: int = GENERATIONS, population: int = POPULATION) -> list[Packing]:
    """The population after some generations, best first. It ends at once if as few bins as the sizes need are reached."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(sizes) // capacity) or 1
    down = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    people = list(start) or [best_fit([], down, sizes, capacity)]
    people.sort(key=lambda p: fitness(p, sizes, capacity), reverse=True)
    if len(people[0]) <= bound:
        return people
    while len(people) < population:
        noise = rng.uniform(0.7, 1.3, len(sizes))
        people.append(best_fit([], sorted(down, key=lambda i: (-sizes[i] * noise[i], i)), sizes, capacity))
    scored = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(people)), key=lambda x: (x[0], -x[1]), reverse=True)
    born = len(scored)
    for _ in range(generations):
        if -scored[0][0][0] <= bound:
            break
        picks = [min(rng.integers(0, len(scored), 2)) for _ in range(2)]
        child = crossover(scored[picks[0]][2], scored[picks[1]][2], sizes, capacity, rng)
        child = mutate(child, sizes, capacity, rng)
        born += 1
        scored.append((fitness(child, sizes, capacity), born, child))
        scored.sort(key=lambda x: (x[0], -x[1]), reverse=True)
        scored = scored[:population]
    return [p for _, _, p in scored]


def _numbered(bins: Packing, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(numbers: np.ndarray) -> Packing:
    out: Packing = [[] for _ in range(int(numbers.max()) + 1 if len(numbers) else 0)]
    for i, k in enumerate(numbers.tolist()):
        out[k].append(i)
    return out


ELITES = "block long, island int, place int, bins int, score double, bound int, numbers array<int>"


def _epoch(items: DataFrame, elites: DataFrame | None, capacity: int, epoch: int, seed: int, islands: int) -> DataFrame:
    """The elites of every island of the blocks in `items`, (block, uid, size), after one epoch."""
    spread = items.withColumn("island", F.explode(F.array(*(F.lit(k) for k in range(islands)))))

    def run(block: int, island: int, pdf: pd.DataFrame, known: list[np.ndarray]) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        sizes = pdf["size"].tolist()
        people = evolve(sizes, capacity, hash((seed, block, island, epoch)) & 0x7FFFFFFF, [_bins(k) for k in known])
        rows = []
        for place, p in enumerate(people[:ELITE]):
            minus, score = fitness(p, sizes, capacity)
            rows.append((block, island, place, -minus, score, -(-sum(sizes) // capacity) or 1, _numbered(p, len(sizes))))
        return pd.DataFrame(rows, columns=["block", "island", "place", "bins", "score", "bound", "numbers"])

    if elites is None:
        return spread.groupBy("block", "island").applyInPandas(lambda key, pdf: run(int(key[0]), int(key[1]), pdf, []), ELITES)
    # An island starts from its own elite and that of the one before it in the ring.
    arrived = elites.unionByName(elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")))

    def go_on(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values(["bins", "score", "place"], ascending=[True, False, True])
        return run(int(key[0]), int(key[1]), pdf, list(known["numbers"]))

    return spread.groupBy("block", "island").cogroup(arrived.groupBy("block", "island")).applyInPandas(go_on, ELITES)


def pack(items: DataFrame, capacity: int, *, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 11, scratch: Scratch | None = None) -> DataFrame:
    """(uid, container): a container for each row of `items`, (uid bigint, size bigint), 0 <= size <= capacity, uid unique.

    No container holds more than `capacity`. Items of size 0 go anywhere. Containers are strings, unique over all rounds.
    Every item is packed; how many there are only changes the number of blocks.
    """
    scratch = scratch or Scratch(items.sparkSession, "pack")
    spark = items.sparkSession
    left = scratch.save(items.select("uid", "size"), "left0")
    done: list[DataFrame] = []
    for step in range(MOST_ROUNDS):
        n = left.count()
        if not n and done:
            break
        blocks = -(-n // block_items) or 1
        dealt = scratch.save(left.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(seed + step)), F.lit(blocks)).cast("bigint")), f"dealt{step}")
        open_, elites, best = dealt, None, []
        for epoch in range(epochs):
            elites = scratch.save(_epoch(open_, elites, capacity, epoch, seed + step, islands), f"elites{step}-{epoch}")
            first = Window.partitionBy("block").orderBy("bins", F.col("score").desc(), "island", "place")
            top = elites.withColumn("first", F.row_number().over(first)).where("first = 1").drop("first")
            top = scratch.save(top, f"top{step}-{epoch}")
            finished = top.where("bins <= bound") if epoch + 1 < epochs else top
            best.append(finished)
            open_blocks = top.where("bins > bound").select("block")
            if epoch + 1 == epochs or not open_blocks.limit(1).count():
                break
            elites = elites.join(open_blocks, "block", "left_semi")
            open_ = dealt.join(open_blocks, "block", "left_semi")
        chosen = best[0]
        for b in best[1:]:
            chosen = chosen.unionByName(b)
        schema = T.StructType([*dealt.schema.fields, T.StructField("bin", T.IntegerType())])

        def apply(pdf: pd.DataFrame, choice: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("uid")
            return pdf.assign(bin=np.asarray(choice["numbers"].iloc[0], dtype=np.int32))

        packed = dealt.groupBy("block").cogroup(chosen.groupBy("block")).applyInPandas(apply, schema)
        fill = F.sum("size").over(Window.partitionBy("block", "bin"))
        named = packed.withColumn("well", fill >= WELL_FILLED * capacity).withColumn("container", F.concat_ws("-", F.lit(f"c{step}"), "block", "bin"))
        named = scratch.save(named.select("uid", "size", "container", "well"), f"packed{step}")
        scratch.drop(f"dealt{step}", *(f"{k}{step}-{e}" for k in ("elites", "top") for e in range(epochs)), f"left{step}")
        if blocks == 1 or step + 1 == MOST_ROUNDS:
            done.append(named.select("uid", "container"))
            break
        done.append(named.where("well").select("uid", "container"))
        left = named.where(~F.col("well")).select("uid", "size")
        if left.count() > 0.9 * n:
            done[-1] = named.select("uid", "container")
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(sizes: DataFrame, capacity: int, *, scratch: Scratch | None = None, **options: int) -> DataFrame:
    """(doc_id, piece, pieces, size, container), from (doc_id, size).

    A document longer than the capacity, and no other, is split: into full containers and a rest, which is packed like
    a document of its own. Null or negative sizes count as 0. Rows that repeat a doc_id are documents of their own.
    `pieces` is counted in the finished packing; one that lost or doubled a part of a document is an error.
    """
    scratch = scratch or Scratch(sizes.sparkSession, "packing")
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("bigint")
    rows = sizes.select("doc_id", size.alias("whole"), F.monotonically_increasing_id().alias("row"))
    last = F.greatest(F.lit(1), F.ceil(F.col("whole") / capacity)).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(1), last)))
    pieces = pieces.withColumn("size", F.least(F.lit(capacity), F.col("whole") - (F.col("piece") - 1).cast("bigint") * capacity))
    # Numbered once and written, so that the numbers stay what they are.
    pieces = scratch.save(pieces.select(F.monotonically_increasing_id().alias("uid"), "row", "doc_id", "piece", "size", "whole"), "pieces")
    full = pieces.where(F.col("size") == capacity).select("row", "doc_id", "piece", "size", "whole", F.concat(F.lit("f-"), "uid").alias("container"))
    part = pieces.where(F.col("size") < capacity)
    containers = pack(part.select("uid", "size"), capacity, scratch=scratch, **options)
    placed = scratch.save(full.unionByName(part.join(containers, "uid").select(*full.columns)), "placed")
    whole = F.sum("size") == F.first("whole")
    counted = placed.groupBy("row").agg(F.when(whole, F.count("*")).otherwise(F.raise_error(F.lit("a document isn't packed whole"))).cast("int").alias("pieces"))
    return placed.join(counted, "row").select("doc_id", "piece", "pieces", "size", "container")
