from __future__ import annotations

import pytest

import __spark_entry__
from voxelloom.runtime import SETTING, Scratch, fresh, shared_root, small


def test_every_sql_has_a_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert not set(sql) - set(queries) and len(queries) >= 45 and all(callable(f) for f in queries.values())


def test_scratch_tables(spark):
    s = Scratch(spark, "test")
    one = s.save(spark.range(5), "t")
    first = s.tables["t"]
    s.save(one.where("id > 2"), "t")
    assert s.tables["t"] != first and spark.read.parquet(s.tables["t"]).count() == 2
    s.drop("t")
    assert not s.tables


class _Session:
    """What shared_root() asks of a session."""

    def __init__(self, folder, master):
        self.conf = {SETTING: folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "getConf": lambda c: {}})()


def test_the_sessions_folder_comes_first():
    assert shared_root(_Session("hdfs:///shared/", "yarn")) == "hdfs:///shared"
    assert shared_root(_Session(None, "local[2]")).startswith("file://")
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_root(_Session(None, master))


def test_sizes_are_checked_before_a_broadcast(spark):
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(small(spark.range(5), 5)).lower() and "broadcast" not in plan(small(spark.range(6), 5)).lower()


def test_fresh_names():
    assert fresh(["A", "b_"], "a", "b", "b") == ["a_", "b", "b__"]
