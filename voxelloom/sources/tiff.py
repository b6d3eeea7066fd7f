"""TIFF stacks, without a library: a Spark data source that reads them by pages, and a writer.

Read: gray or RGB pages of 8, 16, 32 or 64 bits, in strips or tiles, either byte order, classic or big files; stored
plainly, deflated or packed by bits, with or without horizontal differences. The order of pages is that of the OME
description, if there is one, else pages are planes along z. Written: plain classic files with an OME description.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import Any, BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxelloom.functions.parse import substack_ranges
from voxelloom.operators.select import grayscale, rename_channels

#: Sizes of field types and numbers of tags (fixed values of the format).
SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, TILE_W, TILE_H, TILES, TILE_COUNTS, FORMAT = 256, 257, 258, 259, 270, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
PLAIN, DEFLATE, OLD_DEFLATE, PACK_BITS = 1, 8, 32946, 32773

SCHEMA = "path string, scene int, c int, t int, z int, h int, w int, dtype string, data binary"
PAGES_A_PARTITION = 64


def pages(f: BinaryIO) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tags) of each page."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    at = struct.unpack(order + word, head[8:16] if big else head[4:8])[0]
    wide, wide_count = struct.calcsize(word), struct.calcsize(count)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        f.seek(at)
        n = struct.unpack(order + count, f.read(wide_count))[0]
        block = f.read(n * entry + wide)
        tags = {}
        for k in range(n):
            e = block[k * entry : (k + 1) * entry]
            tag, kind = struct.unpack(order + "HH", e[:4])
            number = struct.unpack(order + word, e[4 : 4 + wide])[0]
            code = SIZES.get(kind)
            if code is None:
                continue
            length = struct.calcsize("<" + code) * number
            raw = e[4 + wide : 4 + wide + length]
            if length > wide:
                f.seek(struct.unpack(order + word, e[4 + wide : 4 + 2 * wide])[0])
                raw = f.read(length)
            tags[tag] = (raw.rstrip(b"\0").decode("utf-8", "replace"),) if kind == 2 else struct.unpack(f"{order}{number * len(code)}{code[0]}", raw)
        yield order, tags
        at = struct.unpack(order + word, block[n * entry :])[0]


def _unpacked(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def page_array(f: BinaryIO, order: str, tags: dict[int, tuple]) -> np.ndarray:
    """The page as (h, w), or (h, w, samples)."""
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    samples, bits = tags.get(SAMPLES, (1,))[0], tags.get(BITS, (8,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"{bits} bits a sample")
    dtype = np.dtype(f"{order}{kind}{bits // 8}")
    packing = tags.get(COMPRESSION, (PLAIN,))[0]
    unpack = {PLAIN: bytes, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACK_BITS: _unpacked}.get(packing)
    if unpack is None:
        raise ValueError(f"compression {packing} isn't read")
    tiled = TILES in tags
    bw, bh = (tags[TILE_W][0], tags[TILE_H][0]) if tiled else (w, min(h, tags.get(ROWS, (h,))[0]))
    offsets, counts = (tags[TILES], tags[TILE_COUNTS]) if tiled else (tags[STRIPS], tags[COUNTS])
    layers = samples if tags.get(PLANAR, (1,))[0] == 2 else 1
    each = samples // layers
    across, down = -(-w // bw), -(-h // bh)
    out = np.zeros((h, w, samples), dtype=dtype)
    for k, (at, size) in enumerate(zip(offsets, counts)):
        layer, rest = divmod(k, across * down)
        y, x = rest // across * bh, rest % across * bw
        f.seek(at)
        rows = bh if tiled else min(bh, h - y)
        block = np.frombuffer(unpack(f.read(size)), dtype=dtype, count=rows * bw * each).reshape(rows, bw, each)
        if tags.get(PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        part = block[: h - y, : w - x]
        out[y : y + part.shape[0], x : x + part.shape[1], layer * each : layer * each + each] = part
    out = out.astype(dtype.newbyteorder("="))
    return out[:, :, 0] if samples == 1 else out


def ome(description: str) -> list[dict[str, Any]]:
    """Of each image of an OME description its order, sizes, channel names and pixel sizes; none if it isn't one."""
    out = []
    for pixels in re.findall(r"<(?:\w+:)?Pixels\b.*?</(?:\w+:)?Pixels>", description, re.DOTALL):
        attributes = dict(re.findall(r'(\w+)="([^"]*)"', pixels.split(">", 1)[0]))
        names = [(re.search(r'\bName="([^"]*)"', c) or ["", ""])[1] for c in re.findall(r"<(?:\w+:)?Channel\b[^>]*>", pixels)]
        sizes = {a: int(attributes.get(f"Size{a}", 1)) for a in "TCZYX"}
        physical = {a: float(attributes[f"PhysicalSize{a}"]) for a in "ZYX" if f"PhysicalSize{a}" in attributes}
        out.append({"order": attributes.get("DimensionOrder", "XYZCT"), "sizes": sizes, "channels": names, "physical": physical, "unit": attributes.get("PhysicalSizeXUnit", "µm")})
    return out


def page_places(n: int, description: str) -> list[tuple[int, int, int, int]]:
    """(scene, c, t, z) of each page."""
    out = []
    for scene, image in enumerate(ome(description)):
        along = [a for a in image["order"] if a in "CTZ"]
        shape = [image["sizes"][a] for a in reversed(along)]
        for at in np.ndindex(*shape):
            place = dict(zip(reversed(along), at))
            out.append((scene, place.get("C", 0), place.get("T", 0), place.get("Z", 0)))
    return out if len(out) == n else [(0, 0, 0, z) for z in range(n)]


class _Pages(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first))
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        root = Path(options["path"].removeprefix("file://"))
        self.files = [root] if root.is_file() else sorted(p for p in root.rglob("*") if p.suffix.lower() in (".tif", ".tiff"))
        self.size = int(options.get("pages", PAGES_A_PARTITION))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.files:
            with open(path, "rb") as f:
                n = sum(1 for _ in pages(f))
            out += [_Pages(str(path), k, min(n, k + self.size)) for k in range(0, n, self.size)]
        return out or [_Pages("", 0, 0)]

    def read(self, part: _Pages) -> Iterator[tuple]:
        if not part.path:
            return
        with open(part.path, "rb") as f:
            every = list(pages(f))
            places = page_places(len(every), every[0][1].get(DESCRIPTION, ("",))[0])
            for k in range(part.first, part.last):
                a = page_array(f, *every[k])
                scene, c, t, z = places[k]
                for s, layer in enumerate([a] if a.ndim == 2 else np.moveaxis(a, 2, 0)):
                    yield part.path, scene, c + s, t, z, layer.shape[0], layer.shape[1], layer.dtype.str.lstrip("<|="), np.ascontiguousarray(layer).tobytes()


class TiffSource(DataSource):
    """spark.read.format("voxelloom-tiff").load(folder or file): a row for each plane. The folder is one that the
    executors see at the same place."""

    @classmethod
    def name(cls) -> str:
        return "voxelloom-tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def scenes(planes: DataFrame) -> DataFrame:
    """(path, scene) of the images that a file holds."""
    return planes.select("path", "scene").distinct()


def planes_to_voxels(planes: DataFrame) -> DataFrame:
    """A row for each pixel: the planes' other columns, y, x and v."""
    keep = [c for c in planes.columns if c not in ("h", "w", "dtype", "data")]
    schema = T.StructType([*(planes.schema[c] for c in keep), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                h, w = row.column("h")[0].as_py(), row.column("w")[0].as_py()
                v = np.frombuffer(row.column("data")[0].as_py(), dtype=np.dtype("<" + row.column("dtype")[0].as_py())).astype(float)
                y, x = (a.ravel().astype(np.int32) for a in np.mgrid[0:h, 0:w])
                same = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(h * w, dtype=np.int32)), row.column(c)).dictionary_decode() for c in keep]
                yield pa.RecordBatch.from_arrays([*same, pa.array(y), pa.array(x), pa.array(v)], [*keep, "y", "x", "v"])

    return planes.mapInArrow(run, schema)


def load_stacks(spark: SparkSession, path: str, *, scene: int | None = None, substack: str | None = None, names: dict[str, str] | None = None, gray: bool = False) -> DataFrame:
    """(image_id, scene, c, t, z, y, x, v) of the files of a folder: planes are chosen before their pixels become rows."""
    spark.dataSource.register(TiffSource)
    planes = spark.read.format(TiffSource.name()).load(path).withColumnRenamed("path", "image_id")
    ranges = substack_ranges(substack)
    for axis in "TCZ":
        if axis in ranges:
            low, high = ranges[axis]
            planes = planes.where((F.col(axis.lower()) >= low) & (F.col(axis.lower()) < high))
    if scene is not None:
        planes = planes.where(F.col("scene") == scene)
    voxels = planes_to_voxels(planes)
    for axis in "YX":
        if axis in ranges:
            low, high = ranges[axis]
            voxels = voxels.where((F.col(axis.lower()) >= low) & (F.col(axis.lower()) < high))
    return grayscale(voxels) if gray else rename_channels(voxels.withColumn("c", F.col("c").cast("string")), names) if names else voxels


def write_pairs(images: DataFrame, labels: DataFrame, folder: str, key: list[str], *, overwrite: bool = False) -> DataFrame:
    """(key, image, label): each plane that has labels as a file of its image and one of its labels, of the same name, in
    the folders images and labels."""
    planes = labels.where("label > 0").select(*key).distinct()
    pixels = images.join(planes, key, "left_semi").select(*key, "y", "x", "v")
    marked = pixels.select(*key, "y", "x").join(labels.select(*key, "y", "x", "label"), [*key, "y", "x"], "left").select(*key, "y", "x", F.coalesce("label", F.lit(0)).cast("double").alias("v"))
    made = [write_stacks(d, f"{folder}/{name}", key, dtype=kind, overwrite=overwrite).withColumnRenamed("path", name[:-1]) for d, name, kind in ((pixels, "images", "float32"), (marked, "labels", "int32"))]
    return made[0].join(made[1], key)


def tiff_bytes(planes: np.ndarray, axes: str, names: list[str], sizes: dict[str, float]) -> bytes:
    """A file of a (T, C, Z, Y, X) array."""
    t, c, z, h, w = planes.shape
    kind = {"u": "uint", "i": "int", "f": "float"}[planes.dtype.kind]
    physical = "".join(f' PhysicalSize{a}="{abs(s)}" PhysicalSize{a}Unit="µm"' for a, s in sizes.items())
    channels = "".join(f'<Channel ID="Channel:0:{k}" Name="{n}" SamplesPerPixel="1"/>' for k, n in enumerate(names))
    kind_name = kind if kind == "float" else f"{kind}{8 * planes.dtype.itemsize}"
    text = f'<?xml version="1.0" encoding="UTF-8"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image ID="Image:0"><Pixels ID="Pixels:0" DimensionOrder="{axes}" Type="{kind_name}" SizeX="{w}" SizeY="{h}" SizeZ="{z}" SizeC="{c}" SizeT="{t}"{physical}>{channels}<TiffData/></Pixels></Image></OME>'
    words = text.encode() + b"\0"
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    n = t * c * z
    entries = 11
    page = 2 + entries * 12 + 4
    data_at = 8 + page * n + len(words)
    size = h * w * planes.dtype.itemsize
    for k in range(n):
        tags = [(WIDTH, 4, 1, w), (HEIGHT, 4, 1, h), (BITS, 3, 1, 8 * planes.dtype.itemsize), (COMPRESSION, 3, 1, PLAIN), (262, 3, 1, 1), (DESCRIPTION, 2, len(words) if k == 0 else 1, 8 + page * n if k == 0 else 0), (STRIPS, 4, 1, data_at + k * size), (SAMPLES, 3, 1, 1), (ROWS, 4, 1, h), (COUNTS, 4, 1, size), (FORMAT, 3, 1, {"u": 1, "i": 2, "f": 3}[planes.dtype.kind])]
        out += struct.pack("<H", entries) + b"".join(struct.pack("<HHII", *x) for x in tags) + struct.pack("<I", 8 + page * (k + 1) if k + 1 < n else 0)
    out += words
    # The order of pages named XYZCT: z fastest, then c, then t.
    return bytes(out) + np.ascontiguousarray(planes.astype(planes.dtype.newbyteorder("<"))).tobytes()


def write_stacks(voxels: DataFrame, folder: str, key: list[str], *, dtype: str = "float32", split_channels: bool = False, names: dict[int, str] | None = None, sizes: dict[str, float] | None = None, overwrite: bool = False) -> DataFrame:
    """(key, path): each stack written as a file into a folder that the executors share, named by its key; with
    split_channels a file for each channel, named so before the ending. A stack is one task's work."""
    groups = [*key, "c"] if split_channels else key
    full = voxels.withColumns({a: F.lit(0) for a in ("c", "t", "z") if a not in voxels.columns})
    schema = T.StructType([*(full.schema[c] for c in groups), T.StructField("path", T.StringType())])

    def write(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        place = dict(zip(groups, at))
        spots = [pdf[a].to_numpy() - pdf[a].min() for a in ("t", "c", "z", "y", "x")]
        a = np.zeros([int(s.max()) + 1 for s in spots], dtype=dtype)
        a[tuple(spots)] = pdf["v"].to_numpy()
        channels = [(names or {}).get(int(k), f"channel{k}") for k in sorted(pdf["c"].unique())]
        stem = "_".join(re.sub(r"[^\w.-]", "-", str(place[c])) for c in key)
        path = Path(folder) / (f"{stem}.{channels[0]}.ome.tif" if split_channels else f"{stem}.ome.tif")
        if path.exists() and not overwrite:
            raise FileExistsError(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(tiff_bytes(a, "XYZCT", channels, sizes or {}))
        return pd.DataFrame([{**place, "path": str(path)}])

    return full.groupBy(*groups).applyInPandas(write, schema)
