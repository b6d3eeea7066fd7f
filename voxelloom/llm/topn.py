"""The N first items of every group, by a total order, however large single groups are.

Exact counts of the groups part them into heavy and light ones. Light groups are ranked in ordinary windows. Rows of
heavy groups are sorted by range over (group, order, salt), which spreads one group over as many tasks as its rows
need, even where all its rows tie; each task keeps the first N rows of each group it meets, and a window ranks what is
left: N rows for each task that a group was spread over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.runtime import Scratch, fresh, small

#: A group is heavy if it has more than one of so many parts of all rows, or more than so many rows.
HEAVY_PARTS = 1_000
HEAVY_ROWS = 200_000
#: Rows of heavy groups that one task should sort.
PART_ROWS = 100_000


def _first_of_runs(n: int, key: str):
    """Of a sorted stream the first n rows of each run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            ends = pc.run_end_encode(keys)
            at, picked = 0, []
            for value, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
                if value != last:
                    last, seen = value, 0
                take = min(n - seen, end - at)
                if take > 0:
                    picked.append(batch.slice(at, take))
                seen += end - at
                at = end
            yield from picked

    return run


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, *, heavy_rows: int = HEAVY_ROWS, heavy_parts: int = HEAVY_PARTS, part_rows: int = PART_ROWS, rank: str | None = None, unique: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """The rows of df that are among the first n of their group; with `rank`, that column says which.

    Rows that tie in all of `order` are told apart by a hash of the whole row (`unique` says that none do and saves the
    hash for all but the heavy groups), so the result depends neither on partitions nor on order of reading; rows equal in every column can't be told apart and
    each counts. Groups with fewer than n rows come whole. Nulls in a key form a group like any value; nulls in the
    order sort as `order` says. n < 1 and empty tables give no rows. No row is left out for the size of its group.

    Which groups are heavy follows from the counts: those with more than one of `heavy_parts` parts of all rows, or more
    than `heavy_rows` rows; groups of at most n rows never are. Heavy rows are sorted in as many tasks as they fill with
    `part_rows` rows.
    """
    scratch = scratch or Scratch(df.sparkSession, "topn")
    (salt, place, count, text) = fresh([*df.columns, *([rank] if rank else [])], "tie_salt", "place", "group_rows", "group_text")
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    rows = scratch.save(df, "rows")
    tie = F.lit(0) if unique else F.xxhash64(*hashed)
    counts = rows.groupBy(*keys).agg(F.count("*").alias(count))
    limit = max(n, min(heavy_rows, rows.count() // heavy_parts))
    heavy = scratch.save(counts.where(F.col(count) > limit), "heavy")
    w = Window.partitionBy(*keys).orderBy(*order, F.col(salt))

    def first(x: DataFrame) -> DataFrame:
        out = x.withColumn(salt, tie).withColumn(place, F.row_number().over(w)).where(F.col(place) <= n).drop(salt)
        return out.withColumnRenamed(place, rank) if rank else out.drop(place)

    hot_rows = heavy.agg(F.sum(count)).first()[0]
    if not hot_rows:
        return first(rows)
    few = small(heavy.drop(count))

    def same(a: DataFrame, b: DataFrame) -> list[Column]:
        return [a[k].eqNullSafe(b[k]) for k in keys]

    light = rows.join(few, same(rows, few), "left_anti")
    hot = rows.join(few, same(rows, few), "left_semi").withColumn(text, F.to_json(F.struct(*keys))).withColumn(salt, F.xxhash64(*hashed))
    parts = max(2, -(-hot_rows // part_rows))
    spread = hot.repartitionByRange(parts, F.col(text), *order, F.col(salt)).sortWithinPartitions(F.col(text), *order, F.col(salt))
    kept = spread.mapInArrow(_first_of_runs(n, text), spread.schema).drop(text, salt)
    return first(light).unionByName(first(kept))
