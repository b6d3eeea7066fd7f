"""Points near other points, and the regions that contain points.

Points go to cells: small groups share cells by hash, and a group with more points than one cell should hold is cut by
k-d splits. A cell also gets the points of its neighbours within the radius, so every cell answers alone, with its own
k-d trees. A pair comes from the cell its first point is at home in, hence once.

Places on a sphere become unit vectors in three dimensions, where "within a distance along the surface" is "within a
chord". Places in a plane are already vectors; they keep their own coordinates, as a projection would move the boundary.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.operators.current import is_number
from voxelloom.operators.kdtree import SLACK, KdTree, descend, descend_boxes, split_box
from voxelloom.runtime import Scratch, small

EARTH_RADIUS_KM = 6371.0088

#: Points that one cell should hold, and the most k-d leaves of all groups together: what the executors get sent of the
#: splits (about 40 bytes a leaf) is bounded by the second, whatever the data's size.
CELL_POINTS = 40_000
MOST_LEAVES = 32_768
SAMPLE_PER_LEAF = 24


def unit_vector(longitude: Column, latitude: Column) -> list[Column]:
    """The three coordinates on the unit sphere of a place given in degrees."""
    lon, lat = F.radians(longitude), F.radians(latitude)
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def chord(distance: float, sphere_radius: float) -> float:
    """The straight distance on the unit sphere of two places so far apart along the surface."""
    return 2.0 if distance >= math.pi * sphere_radius else 2 * math.sin(distance / (2 * sphere_radius))


def _points(df: DataFrame, side: int, group: list[str], identity: str, coordinates: list[Column]) -> DataFrame:
    out = df.select(
        F.struct(*(F.col(g) for g in group)).alias("g") if group else F.lit("").alias("g"),
        F.col(identity).alias("id"),
        F.lit(side).cast("tinyint").alias("side"),
        *(c.cast("double").alias(f"x{k}") for k, c in enumerate(coordinates)),
    )
    ok = F.col("id").isNotNull()
    for k in range(len(coordinates)):
        ok &= is_number(F.col(f"x{k}"))
    for name in group:
        ok &= F.col(f"g.{name}").isNotNull()
    return out.where(ok)


class _Cells:
    """How points are parted: small groups share cells by hash, larger ones have k-d leaves of their own."""

    def __init__(self, points: DataFrame, scratch: Scratch, dims: int, cell_points: int, most_leaves: int):
        spark = scratch.spark
        self.dims, kind = dims, points.schema["g"].dataType
        self.names = [f"x{k}" for k in range(dims)]
        self.text = F.to_json("g") if isinstance(kind, T.StructType) else F.col("g")
        counts = scratch.save(points.groupBy("g").agg(F.count("*").alias("n")), "counts")
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        target = max(cell_points, total // most_leaves + 1)
        self.bins = int(max(1, -(-total // target)))
        # There are fewer than total / target groups above the target, so no more than most_leaves.
        heavy = [(r["g"], k, r["n"]) for k, r in enumerate(counts.where(F.col("n") > target).orderBy(F.col("n").desc()).limit(most_leaves).collect())]
        self.keys = None
        if heavy:
            schema = T.StructType([T.StructField("g", kind), T.StructField("k", T.IntegerType()), T.StructField("n", T.LongType())])
            self.keys = small(spark.createDataFrame(heavy, schema), most_leaves)
            # A sample by hash only places the splits; every point takes part.
            rate = F.least(F.lit(1.0), SAMPLE_PER_LEAF * F.ceil(F.col("n") / target) / F.col("n"))
            picked = points.join(self.keys, "g").where(F.pmod(F.xxhash64("id", *self.names), F.lit(1 << 30)) < rate * float(1 << 30))
            sample = picked.select("k", *self.names).limit(2 * SAMPLE_PER_LEAF * (most_leaves + len(heavy))).toPandas()
            trees = {k: split_box(p.iloc[:, 1:].to_numpy(), int(-(-heavy[k][2] // target))) for k, p in sample.groupby("k")}
            self.trees = spark.sparkContext.broadcast(trees)

    def _parted(self, df: DataFrame, place: Callable[[pd.DataFrame, list], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
        """df, its group as text, with `cell` and `home`; `place` gives (row, leaf, home) of the rows of one large group."""
        columns = [c for c in df.columns if c != "g"]
        hashed = F.concat(F.lit("h"), F.pmod(F.xxhash64("g"), F.lit(self.bins)).cast("string"))
        rest = (df if self.keys is None else df.join(self.keys, "g", "left_anti")).select(hashed.alias("cell"), F.lit(True).alias("home"), *columns, self.text.alias("g"))
        if self.keys is None:
            return rest
        schema, trees = rest.schema, self.trees

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for k, part in pdf.groupby("k"):
                    who, leaf, home = place(part, trees.value.get(k, []))
                    if len(who):
                        yield part.iloc[who].assign(cell=np.char.add(f"k{k}-", leaf.astype(str)), home=home)[schema.names]

        large = df.join(self.keys, "g").select(*columns, self.text.alias("g"), "k")
        return rest.unionByName(large.mapInPandas(run, schema))

    def points(self, points: DataFrame, reach: float) -> DataFrame:
        """Every point at home in its cell, and copies (home false) in the cells within reach."""
        names = self.names
        return self._parted(points, lambda part, tree: descend(part[names].to_numpy(), tree, reach))

    def boxes(self, shapes: DataFrame) -> DataFrame:
        """Every shape, with the corners low_0… and high_0… of its box, in each cell that its box meets."""
        low, high = ([f"{n}_{k}" for k in range(self.dims)] for n in ("low", "high"))

        def place(part: pd.DataFrame, tree: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            who, leaf = descend_boxes(part[low].to_numpy(), part[high].to_numpy(), tree)
            return who, leaf, np.ones(len(who), dtype=bool)

        return self._parted(shapes, place)


def _near(points: DataFrame, scratch: Scratch, dims: int, radius: float, own: bool, cell_points: int, most_leaves: int, with_distance: bool) -> DataFrame:
    identity = points.schema["id"].dataType
    cells = _Cells(points, scratch, dims, cell_points, most_leaves).points(points, radius * (1 + SLACK))
    schema = T.StructType([T.StructField("id_a", identity), T.StructField("id_b", identity), T.StructField("distance", T.DoubleType())])
    names = [f"x{k}" for k in range(dims)]

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, home, side = pdf["id"].to_numpy(), pdf["home"].to_numpy(), pdf["side"].to_numpy()
        # One more axis holds the groups apart, by more than any group's extent: so the trees part groups first.
        places = pdf[names].to_numpy()
        apart = pd.factorize(pdf["g"])[0].astype(np.float64) * (np.ptp(places, axis=0).max() + 4 * radius + 1)
        space = np.column_stack([places, apart])
        found = []
        if own:
            for i, j in KdTree(space).pairs(None, radius):
                swap = ids[i] > ids[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                keep = home[i] & (ids[i] != ids[j])
                found.append((i[keep], j[keep]))
        else:
            left, right = np.flatnonzero((side == 0) & home), np.flatnonzero(side == 1)
            if len(left) and len(right):
                found += [(left[i], right[j]) for i, j in KdTree(space[left]).pairs(KdTree(space[right]), radius)]
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))
        return pd.DataFrame({"id_a": ids[i], "id_b": ids[j], "distance": np.sqrt(((space[i] - space[j]) ** 2).sum(axis=1))})

    out = cells.groupBy("cell").applyInPandas(pairs, schema)
    return out if with_distance else out.select("id_a", "id_b")


def points_within(df: DataFrame, group: list[str], identity: str, coordinates: list[Column], radius: float, *, others: DataFrame | None = None, cell_points: int = CELL_POINTS, most_leaves: int = MOST_LEAVES, scratch: Scratch | None = None, with_distance: bool = True) -> DataFrame:
    """Pairs of points of one group at most `radius` apart, the radius included: (id_a, id_b, distance).

    Without `others` the pairs are of two different ids of df, smaller id first, each once for every two rows that are
    so close: repeated rows give repeated pairs, so reduce to current rows first. With `others`, id_a is of df and id_b
    of `others`, which has the same columns. Points with a null, not-a-number or infinite coordinate, without an id or
    with a null in the group take no part. Empty tables give no pairs. Other columns are not read.
    """
    scratch = scratch or Scratch(df.sparkSession, "near")
    dims = len(coordinates)
    points = _points(df, 0, group, identity, coordinates)
    if others is not None:
        points = points.unionByName(_points(others, 1, group, identity, coordinates))
    return _near(scratch.save(points, "points"), scratch, dims, radius, others is None, cell_points, most_leaves, with_distance)


def places_within(df: DataFrame, identity: str, longitude: str, latitude: str, distance: float, *, sphere_radius: float = EARTH_RADIUS_KM, **options: object) -> DataFrame:
    """Pairs of places (degrees) at most `distance` apart along the surface: (id_a, id_b, distance), as points_within.

    A longitude counts modulo 360; a latitude beyond ±90 is no place and takes no part.
    """
    def proper(d: DataFrame) -> DataFrame:
        return d.where(F.abs(F.col(latitude)) <= 90)

    if options.get("others") is not None:
        options["others"] = proper(options["others"])
    out = points_within(proper(df), [], identity, unit_vector(F.col(longitude), F.col(latitude)), chord(distance, sphere_radius), **options)
    return out.withColumn("distance", 2 * F.asin(F.least(F.lit(1.0), F.col("distance") / 2)) * sphere_radius)


def crossings(ys: np.ndarray, xs: np.ndarray, edges: np.ndarray, polygon: np.ndarray, chunk: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(point, polygon) of the points inside, edges in order of their polygon: each polygon's sweep meets only the points
    in its box, which a k-d tree knows. A line sweeps over y; an edge is active for the points from its lower end, included,
    to its upper, excluded, and a point is inside if an odd number of its polygon's active edges lie to its right."""
    none = np.zeros(0, dtype=np.int64)
    if not len(ys) or not len(edges):
        return none, none
    y0, x0, y1, x1 = edges.T
    kinds, first = np.unique(polygon, return_index=True)
    box = np.column_stack([f.reduceat(np.stack(v), first, axis=1).T for f, v in ((np.minimum, (np.minimum(y0, y1), np.minimum(x0, x1))), (np.maximum, (np.maximum(y0, y1), np.maximum(x0, x1))))])
    levels, level = np.unique(ys, return_inverse=True)
    low, high = np.searchsorted(levels, np.minimum(y0, y1), "left"), np.searchsorted(levels, np.maximum(y0, y1), "left")
    # A place in all sweeps, one polygon after the other; each one's events in order of y.
    rank = np.searchsorted(kinds, polygon).astype(np.int64) * (len(levels) + 1)
    hits: list[np.ndarray] = []
    for k, point in KdTree(np.column_stack([ys, xs])).in_boxes(box[:, :2], box[:, 2:], chunk):
        events = k * (len(levels) + 1) + level[point]
        order = np.argsort(events, kind="stable")
        swept, point = events[order], point[order]
        start, stop = np.searchsorted(swept, rank + low, "left"), np.searchsorted(swept, rank + high, "left")
        live = np.flatnonzero(stop > start)
        ends = np.cumsum(stop[live] - start[live])
        at = 0
        while at < len(live):
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + chunk, "right")))
            e = live[at:upto]
            n = stop[e] - start[e]
            edge = np.repeat(e, n)
            p = point[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[e], n)]
            x = x0[edge] + (ys[p] - y0[edge]) * (x1[edge] - x0[edge]) / (y1[edge] - y0[edge])
            right = x > xs[p]
            hits.append(np.stack([p[right], polygon[edge[right]]]))
            at = upto
    if not hits:
        return none, none
    pair = np.concatenate(hits, axis=1)
    pair = pair[:, np.lexsort(pair)]
    new = np.flatnonzero(np.append(True, (pair[:, 1:] != pair[:, :-1]).any(axis=0))) if pair.shape[1] else none
    odd = np.diff(np.append(new, pair.shape[1])) % 2 == 1
    return pair[0][new[odd]], pair[1][new[odd]]


def points_in_polygons(points: DataFrame, group: list[str], identity: str, y: Column, x: Column, polygons: DataFrame, polygon_id: str, vertices: Column, *, cell_points: int = CELL_POINTS, most_leaves: int = MOST_LEAVES, scratch: Scratch | None = None) -> DataFrame:
    """The polygons that contain each point: (id, polygon_id), by plane sweep over the polygons' edges.

    `vertices` is array<struct<y, x>>, closed by itself. The lower and left border belong to a polygon, the upper and
    right don't, so of adjoining polygons only one has a point. Polygons with fewer than three corners or with a corner
    that isn't a number contain nothing. Points as in points_within. Rows of a repeated polygon id count as one polygon
    by the odd-even rule, rows equal in every column once.

    Cells are cut as in points_within, by points and polygons. A polygon goes, with all its edges, to each cell that its
    box meets.
    """
    scratch = scratch or Scratch(points.sparkSession, "inside")
    pts = scratch.save(_points(points, 0, group, identity, [y, x]), "points")
    good = F.forall("v", lambda p: is_number(p["y"].cast("double")) & is_number(p["x"].cast("double")))
    corners = F.transform(vertices, lambda p: F.struct(p["y"].cast("double").alias("y"), p["x"].cast("double").alias("x")))
    named = polygons.select(F.struct(*(F.col(g) for g in group)).alias("g") if group else F.lit("").alias("g"), F.col(polygon_id).alias("poly"), corners.alias("v"))
    keep = F.col("poly").isNotNull() & (F.size("v") >= 3) & good
    for name in group:
        keep &= F.col(f"g.{name}").isNotNull()
    sides = {k: F.transform("v", lambda p: p[c]) for k, c in enumerate("yx")}  # noqa: B023 - called at once
    shapes = named.where(keep).distinct().select("g", "poly", *(f(sides[k]).alias(f"{n}_{k}") for n, f in (("low", F.array_min), ("high", F.array_max)) for k in (0, 1)), sides[0].alias("vy"), sides[1].alias("vx"))
    # Both points and polygons are load, so many polygons about few points are parted too.
    shapes = scratch.save(shapes, "shapes")
    load = pts.select("g", F.xxhash64("id").alias("id"), "x0", "x1").unionByName(shapes.select("g", F.xxhash64("poly").alias("id"), F.col("low_0").alias("x0"), F.col("low_1").alias("x1")))
    cells = _Cells(load, scratch, 2, cell_points, most_leaves)
    homes = cells.points(pts, 0.0).where("home").select("cell", "g", "id", "x0", "x1")
    met = cells.boxes(shapes).select("cell", "g", "poly", "vy", "vx")
    schema = T.StructType([T.StructField("id", pts.schema["id"].dataType), T.StructField("polygon_id", shapes.schema["poly"].dataType)])

    def sweep(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        by_group = dict(list(s.groupby("g")))
        found = [p.iloc[:0][["id"]].assign(polygon_id=s["poly"].iloc[:0])]
        for g, here in p.groupby("g"):
            if (there := by_group.get(g)) is None:
                continue
            there = there.sort_values("poly", kind="stable")
            sizes = there["vy"].map(len).to_numpy()
            vy, vx = np.concatenate(there["vy"].to_list()), np.concatenate(there["vx"].to_list())
            last = np.cumsum(sizes) - 1
            after = np.arange(1, len(vy) + 1)
            after[last] = last - sizes + 1
            names, which = np.unique(there["poly"].to_numpy(), return_inverse=True)
            i, k = crossings(here["x0"].to_numpy(), here["x1"].to_numpy(), np.column_stack([vy, vx, vy[after], vx[after]]), np.repeat(which, sizes))
            found.append(pd.DataFrame({"id": here["id"].to_numpy()[i], "polygon_id": names[k]}))
        return pd.concat(found)

    return homes.groupBy("cell").cogroup(met.groupBy("cell")).applyInPandas(sweep, schema)
