"""One group identifier for all records that pairwise matches link directly or through others.

Deterministic Borůvka hooking. Edges are ordered by (smaller end, larger end). In each round every component selects
its smallest outgoing edge and hooks to the component at its other end; the hooks form trees, whose only cycle is the
smallest edge of the tree, selected from both of its ends; its smaller end becomes the root. Pointer doubling collapses
the trees, edges are relabelled with the roots and deduplicated, and edges inside one component vanish. Each round
at least halves the components that still have edges. As the smallest edge of a tree contains its smallest label, the
last label of a record is the smallest id of its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.runtime import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select("v", "u"))


def _collapse(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """node -> root, from node -> hook."""
    rounds = 0
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        # The two ends of a tree's smallest edge hook to each other; the smaller one is the root.
        root = (F.col("above") == F.col("node")) & (F.col("node") <= F.col("parent"))
        child_of_root = (F.col("above") == F.col("node")) & (F.col("node") > F.col("parent"))
        jumped = parents.join(up, "parent").select(
            "node",
            F.when(root, F.col("node")).when(child_of_root, F.col("parent")).otherwise(F.col("above")).alias("parent"),
            (~root & ~child_of_root & (F.col("above") != F.col("parent"))).alias("moved"),
        )
        rounds += 1
        saved = scratch.save(jumped, f"pointers{rounds % 2}")
        parents = saved.select("node", "parent")
        if not saved.where("moved").limit(1).count():
            return parents


def link_groups(links: DataFrame, left: str, right: str, *, scratch: Scratch | None = None) -> DataFrame:
    """(node, group): for each record with at least one link the smallest id among all records joined to it by links.

    Links have no direction; repeated ones count once; a link of a record with itself gives it a group (of its own, if it
    has no other link). A link with a null end joins nothing: its other end has no row unless another link names it. Ids
    are of any one ordered type. An empty table gives an empty one. Other columns are not read.

    Nothing but small flags comes to the driver. A record with very many links is reduced to its smallest partner
    before any shuffle; joins against its links are by a key that is unique on the other side, so that they can be
    split. Every round is written to the shared folder and read again.
    """
    scratch = scratch or Scratch(links.sparkSession, "groups")
    ends = links.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v"))
    ends = scratch.save(ends.distinct(), "edges")
    alone = ends.where("u = v").select(F.col("u").alias("node"))
    edges = ends.where("u < v")
    levels: list[DataFrame] = []
    while edges.limit(1).count():
        hooks = _both_ways(edges).groupBy("u").agg(F.min("v").alias("parent")).withColumnRenamed("u", "node")
        # Two hooks that differ in their ends make a path; _collapse breaks the one cycle of each tree.
        roots = scratch.save(_collapse(scratch.save(hooks, "hooks"), scratch), f"level{len(levels)}")
        scratch.drop("hooks", "pointers0", "pointers1")
        levels.append(roots)
        at_u, at_v = (roots.select(F.col("node").alias(c), F.col("parent").alias(f"root_{c}")) for c in "uv")
        moved = edges.join(at_u, "u").join(at_v, "v").where("root_u <> root_v")
        edges = scratch.save(moved.select(F.least("root_u", "root_v").alias("u"), F.greatest("root_u", "root_v").alias("v")).distinct(), f"edges{len(levels)}")
        if len(levels) > 1:
            scratch.drop(f"edges{len(levels) - 1}")
    if not levels:
        return alone.select("node", F.col("node").alias("group"))
    out = levels[-1].select("node", F.col("parent").alias("group"))
    for level in reversed(levels[:-1]):
        above = out.select(F.col("node").alias("parent"), F.col("group").alias("higher"))
        out = level.join(above, "parent", "left").select("node", F.coalesce("higher", "parent").alias("group"))
    # Only records that have no link but with themselves are still missing.
    lonely = alone.join(levels[0].select("node"), "node", "left_anti")
    return out.unionByName(lonely.select("node", F.col("node").alias("group")))
