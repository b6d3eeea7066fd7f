"""Lists of files, from folders, patterns and list files; results and where they may be written."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions.strings import basename, glob_regex


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether the name or the whole path fits any of the patterns with * ? [ ]."""
    out = F.lit(False)
    for p in patterns:
        out |= basename(path).rlike(glob_regex(p)) | path.rlike(glob_regex(p))
    return out


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, paths: list[str], *, include: list[str] | None = None, exclude: list[str] | None = None, recursive: bool = True, files: bool = True, directories: bool = False, skip_missing: bool = True) -> DataFrame:
    """(path, length), each path once and in order: files named, and what folders hold that fits `include`, without what
    fits `exclude`. Folders are listed by Spark's file source, which doesn't open the files; with `directories` their
    folders come too, with a null length. A missing path is left out, or FileNotFoundError if skip_missing is false."""
    found: list[DataFrame] = []
    for path in paths:
        p, fs = _file_system(spark, path)
        if not fs.exists(p):
            if skip_missing:
                continue
            raise FileNotFoundError(path)
        status = fs.getFileStatus(p)
        if not status.isDirectory():
            found.append(spark.createDataFrame([(status.getPath().toString(), status.getLen())], "path string, length long").withColumn("given", F.lit(True)))
            continue
        kept = F.lit(True) if not include else matches(F.col("path"), include)
        if files:
            source = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
            found.append(source.load(path).select("path", "length").where(kept).withColumn("given", F.lit(False)))
        if directories:
            rows, todo = [], [p]
            while todo:
                for s in fs.listStatus(todo.pop()):
                    if s.isDirectory():
                        rows.append((s.getPath().toString(), None))
                        todo += [s.getPath()] if recursive else []
            found.append(spark.createDataFrame(rows, "path string, length long").where(kept).withColumn("given", F.lit(False)))
    if not found:
        return spark.createDataFrame([], "path string, length long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    if not files:
        out = out.where(~F.col("given") & F.col("length").isNull())
    if exclude:
        out = out.where(~matches(F.col("path"), exclude))
    return out.groupBy("path").agg(F.first("length").alias("length")).orderBy("path")


def without_substrings(files: DataFrame, parts: list[str]) -> DataFrame:
    """Files whose path contains none of the texts."""
    for p in parts:
        files = files.where(~F.contains("path", F.lit(p)))
    return files


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, first, second) of a text file with one or two paths a line, quoted or not; empty lines have no row, but are
    counted: `line` is the number in the file, from 1. A list is read whole by one task: names of files, not data."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("order", "value"))
    lines = whole.withColumn("order", F.col("order") + 1)
    word = r"\"([^\"]*)\"|'([^']*)'|(\S+)"
    words = F.filter(F.regexp_extract_all("value", F.lit(f"({word})"), F.lit(1)), lambda w: F.length(w) > 0)
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[\"']|[\"']$", ""))
    rows = lines.select("order", bare.alias("w")).where(F.size("w") > 0)
    return rows.select(F.col("order").alias("line"), F.try_element_at("w", F.lit(1)).alias("first"), F.try_element_at("w", F.lit(2)).alias("second"))


def matches_regex(path: Column, patterns: list[str]) -> Column:
    """Whether any of the regular expressions is found in the path."""
    out = F.lit(False)
    for p in patterns:
        out |= path.rlike(p)
    return out


def relative_keys(files: DataFrame, roots: list[str]) -> DataFrame:
    """files with `key`: the name of the root that a file lies under, and its path from there; its name if under none."""
    p = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    key = basename(F.col("path"))
    for root in sorted(roots, key=len):
        bare = root.replace("\\", "/").rstrip("/")
        below = p.startswith(bare + "/")
        key = F.when(below, F.concat(F.lit(bare.rpartition("/")[2] + "/"), F.substr(p, F.lit(len(bare) + 2)))).otherwise(key)
    return files.withColumn("key", key)


def write_table(df: DataFrame, path: str, *, form: str = "csv", overwrite: bool = False, partition_by: list[str] | None = None) -> str:
    """As csv (with a header) or parquet; FileExistsError if something is there, unless overwrite."""
    if form not in ("csv", "parquet"):
        raise ValueError("csv or parquet")
    p, fs = _file_system(df.sparkSession, path)
    if fs.exists(p) and not overwrite:
        raise FileExistsError(path)
    out = df.write.mode("overwrite")
    if partition_by:
        out = out.partitionBy(*partition_by)
    if form == "csv":
        out.option("header", True).csv(path)
    else:
        out.parquet(path)
    return path


def write_features(features: dict[str, DataFrame], folder: str, *, overwrite: bool = False) -> list[str]:
    """A table for each channel."""
    return [write_table(df, f"{folder}/Features_{c}", overwrite=overwrite) for c, df in features.items()]


def unique_folder(base: str) -> str:
    return f"{base.rstrip('/')}/{uuid.uuid4()}"
