"""Where intermediate tables go, and how their size is checked before anything is broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"

#: A table is broadcast only if it was counted and has at most this many rows of a few numbers or short strings.
BROADCAST_ROWS = 50_000

_LOCAL_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master without the setting gets one of its own."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="voxelloom-"))
    return "file://" + _LOCAL_ROOT[0]


class Scratch:
    """Written tables that cut a lineage: they outlive a lost executor, and a later stage reads them instead of
    computing again. Dropped one by one with drop(), the rest when the session's Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.tables = spark, {}
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.drop(name)
        self.tables[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.tables.pop(name, None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # noqa: BLE001 - the JVM may have ended first
            pass


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows. Cheap on a saved table; limit() stops the count early."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that clash with none of those taken, whatever their case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
