"""Connected components of masks, and what can be done with their labels."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.model import slice_key
from voxelloom.runtime import Scratch


def offsets(dims: int, connectivity: int) -> list[tuple[int, ...]]:
    """Half of the neighbours of a pixel: those that come before it and differ along at most `connectivity` axes."""
    if not 1 <= connectivity <= dims:
        raise ValueError(f"connectivity is 1 to {dims}")
    return [o for o in itertools.product((-1, 0, 1), repeat=dims) if 0 < sum(map(abs, o)) <= connectivity and o < (0,) * dims]


def component_ids(places: np.ndarray, connectivity: int) -> np.ndarray:
    """For each pixel (row of integer coordinates) the position, in raster order, of its component's first pixel."""
    n, dims = places.shape
    low = places.min(axis=0) - 1
    spans = places.max(axis=0) - low + 2
    strides = np.append(np.cumprod(spans[::-1])[::-1][1:], 1)
    linear = (places - low) @ strides
    order = np.argsort(linear, kind="stable")
    line = linear[order]
    left, right = [], []
    for o in offsets(dims, connectivity):
        want = line + int(np.dot(o, strides))
        at = np.searchsorted(line, want)
        hit = (at < n) & (line[np.minimum(at, n - 1)] == want)
        left.append(np.flatnonzero(hit))
        right.append(at[hit])
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    out = np.empty(n, dtype=np.int64)
    out[order] = root
    return out


def label_components(mask: DataFrame, axes: list[str], connectivity: int = 1, *, tile: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(key, axes, label): labels of each slice count from 1 in raster order of the components' first pixels.

    `mask` has a row for each of its pixels; repeated ones count once, as do values that come along. Without `tile` each
    slice is one task's work. With it each tile is, and components are joined over the tiles' seams afterwards.
    """
    offsets(len(axes), connectivity)  # says so here if there is no such connectivity
    key = slice_key(mask.columns, axes, [c for c in mask.columns if c in ("v", "label", "threshold")])
    pixels = mask.select(*key, *axes).distinct()
    fields = [pixels.schema[c] for c in (*key, *axes)]
    if tile is None:
        schema = T.StructType([*fields, T.StructField("label", T.IntegerType())])

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            _, label = np.unique(component_ids(pdf[axes].to_numpy(dtype=np.int64), connectivity), return_inverse=True)
            return pdf[[*key, *axes]].assign(label=label.astype(np.int32) + 1)

        # Repeated pixels are dropped by distinct(), which spreads a slice; grouping gathers it again.
        return pixels.withColumn("one", F.lit(0)).groupBy(*(key or ["one"])).applyInPandas(whole, schema)

    scratch = scratch or Scratch(mask.sparkSession, "components")
    cells = [f"{a}_cell" for a in axes]
    cut = pixels.withColumns({c: F.floor(F.col(a) / tile).cast("int") for c, a in zip(cells, axes)})
    # A node is a component of a tile, named by its first pixel.
    firsts = [f"{a}_first" for a in axes]
    schema = T.StructType([*fields, *(T.StructField(c, T.IntegerType()) for c in firsts)])

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        places = pdf[axes].to_numpy(dtype=np.int64)
        order = np.lexsort(places.T[::-1])
        first = places[order[component_ids(places, connectivity)]]
        return pdf[[*key, *axes]].assign(**{c: first[:, k].astype(np.int32) for k, c in enumerate(firsts)})

    parts = scratch.save(cut.groupBy(*key, *cells).applyInPandas(part, schema), "parts")
    node = F.struct(*key, *firsts)
    border = None
    for a in axes:
        edge = (F.pmod(F.col(a), F.lit(tile)) == 0) | (F.pmod(F.col(a), F.lit(tile)) == tile - 1)
        border = edge if border is None else border | edge
    rim = parts.where(border).select(*key, *axes, node.alias("node"))
    steps = F.explode(F.array(*(F.struct(*(F.lit(d).alias(f"d{k}") for k, d in enumerate(o))) for o in offsets(len(axes), connectivity)))).alias("step")
    seen = rim.select(*key, *axes, F.col("node").alias("a"), steps)
    seen = seen.select(*key, *((F.col(x) + F.col(f"step.d{k}")).alias(x) for k, x in enumerate(axes)), "a")
    links = seen.join(rim, [*key, *axes]).where("a <> node").select("a", F.col("node").alias("b")).distinct()
    roots = merge_nodes(links, scratch)
    named = parts.select("*", node.alias("node")).join(roots, "node", "left").select(*key, *axes, F.coalesce("root", "node").alias("root"))
    order = Window.partitionBy(*key).orderBy("root")
    ids = named.select(*key, "root").distinct().withColumn("label", F.row_number().over(order))
    return named.join(ids, [*key, "root"]).select(*key, *axes, "label")


def merge_nodes(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): for each linked node the least node that it is joined to. In each round a node takes the least root
    among its neighbours', and then its root's root, so the rounds grow with the logarithm of a chain's length, about."""
    both = scratch.save(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "ways")
    roots = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "roots0")
    step = 0
    while True:
        step += 1
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "node")
        pulled = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("best"))
        # The old root learns of the better one too.
        told = pulled.groupBy("root").agg(F.min("best").alias("better")).withColumnRenamed("root", "node")
        joined = pulled.join(told, "node", "left").select("node", "root", F.least("best", F.coalesce("better", "best")).alias("best"))
        up = joined.select(F.col("node").alias("best"), F.col("best").alias("above"))
        jumped = joined.join(up, "best", "left").select("node", F.least("best", F.coalesce("above", "best")).alias("root"), (F.col("root") != F.least("best", F.coalesce("above", "best"))).alias("moved"))
        saved = scratch.save(jumped, f"roots{step}")
        scratch.drop(f"roots{step - 1}")
        roots = saved.select("node", "root")
        if not saved.where("moved").limit(1).count():
            return roots


def unique_labels(labels: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """Labels unique over all slices: each slice's start above the greatest of the slices before it, in order of key."""
    if not key:
        return labels
    tops = labels.groupBy(*key).agg(F.max(label).cast("bigint").alias("top"))
    # One row for each slice is ordered here, not the pixels.
    before = F.sum("top").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1))
    starts = tops.select(*key, F.coalesce(before, F.lit(0)).alias("start"))
    return labels.join(starts, key).withColumn(label, (F.col(label) + F.col("start")).cast("int")).drop("start")


def consecutive_mapping(labels: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """(key, old_label, new_label): labels above 0 numbered from 1 in their order; 0 has no row and stays."""
    ids = labels.where(F.col(label) != 0).select(*key, F.col(label).alias("old_label")).distinct()
    by = Window.partitionBy(*key).orderBy("old_label") if key else Window.orderBy("old_label")
    return ids.withColumn("new_label", F.row_number().over(by))


def remap(rows: DataFrame, mapping: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """Labels (of pixels or of region rows) by (key, old_label, new_label); those without a new one stay, 0 too."""
    look = mapping.select(*key, F.col("old_label").alias(label), "new_label").where(F.col(label) != 0)
    return rows.join(look, [*key, label], "left").withColumn(label, F.coalesce("new_label", label)).drop("new_label").select(*rows.columns)


def remap_consecutive(rows: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    return remap(rows, consecutive_mapping(rows, key, label), key, label)


def remove_labels(labels: DataFrame, removed: DataFrame | list[int], key: list[str], *, renumber: bool = False, label: str = "label") -> DataFrame:
    """Without the pixels of some labels: of a list, in every slice; of a table with the key and the label, where it says."""
    if isinstance(removed, DataFrame):
        if label not in removed.columns:
            raise ValueError(f"no column {label}")
        on = [*(k for k in key if k in removed.columns), label]
        out = labels.join(removed.select(*on).distinct(), on, "left_anti")
    else:
        out = labels.where(~F.col(label).isin(removed)) if removed else labels
    return remap_consecutive(out, key, label) if renumber else out


def keep_labels(rows: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Region rows whose label still has pixels."""
    return rows.join(labels.where(F.col(on[-1]) != 0).select(*on).distinct(), on, "left_semi")


def label_mismatches(labels: DataFrame, regions: DataFrame, on: list[str]) -> DataFrame:
    """(on, side): labels that only the image or only the table has; empty if both agree."""
    a, b = labels.where(F.col(on[-1]) != 0).select(*on).distinct(), regions.select(*on).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("image")).unionByName(b.exceptAll(a).withColumn("side", F.lit("table")))


def dilate_once(mask: DataFrame, key: list[str], shape: tuple[int, int] | None = None) -> DataFrame:
    """The mask and the four neighbours of each pixel, within `shape` if given."""
    grown = mask.select(*key, F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))))).alias("p")).select(*key, "p.y", "p.x").distinct()
    if shape:
        grown = grown.where((F.col("y") >= 0) & (F.col("y") < shape[0]) & (F.col("x") >= 0) & (F.col("x") < shape[1]))
    return grown


def grow_region(own: np.ndarray, blocked: np.ndarray, most: int) -> np.ndarray:
    """A region's pixels, rows of (y, x), after growing by its four neighbours as long as it changes and has at most `most`.
    Only the last step's pixels have neighbours that aren't known yet. `blocked` is a plane; the region may be blocked itself."""
    h, w = blocked.shape
    inside, rim = own[:, 0] * w + own[:, 1], own
    while len(inside) <= most:
        near = np.concatenate([rim + step for step in ((-1, 0), (1, 0), (0, -1), (0, 1))])
        near = near[((near >= 0) & (near < (h, w))).all(axis=1)]
        more = np.unique(near[:, 0] * w + near[:, 1])
        more = more[~blocked.ravel()[more] & ~np.isin(more, inside)]
        if not len(more) or len(inside) + len(more) > most:
            break
        inside, rim = np.concatenate([inside, more]), np.column_stack(np.divmod(more, w))
    return np.column_stack(np.divmod(inside, w))


def dilate_to_area(mask: DataFrame, key: list[str], most: int, shape: tuple[int, int], *, strict: bool = False) -> DataFrame:
    """Each 4-connected region of each plane, in order of labels, grows step by step as long as it would have at most
    `most` pixels; larger ones stay. It doesn't take pixels of regions grown before it; with `strict`, of none."""
    schema = T.StructType([*(mask.schema[c] for c in key), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType())])

    def grow(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        taken, every = np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)
        every[pdf["y"], pdf["x"]] = True
        for _, g in pdf.groupby("label"):
            own = g[["y", "x"]].to_numpy(dtype=np.int64)
            grown = grow_region(own, every if strict else taken, most)
            every[grown[:, 0], grown[:, 1]] = True
            taken[grown[:, 0], grown[:, 1]] = True
        y, x = np.nonzero(taken)
        return pd.DataFrame({**dict(zip(key, name)), "y": y.astype(np.int32), "x": x.astype(np.int32)})

    return label_components(mask, ["y", "x"], 1).groupBy(*key).applyInPandas(grow, schema)
