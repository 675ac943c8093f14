"""Staging and joins on hot keys."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodestone.functions import shuffle


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_hot_key_is_spread_and_nothing_else_changes(spark, rows, how):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(300)] + [(None, 1)], "k string, v int")
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k0", "c"), ("k3", "d"), (None, "e")], "k string, w string")
    assert rows(shuffle.salted_join(left, right, ["k"], how)) == rows(left.join(right, ["k"], how))
    assert rows(shuffle.salted_join(left.limit(0), right, ["k"], how)) == []


def test_small_tables_are_told_by_their_bytes(spark):
    t = spark.createDataFrame([("x" * 1_000,), (None,)], "t string")
    assert shuffle.is_small(t, 1_100) and not shuffle.is_small(t, 1_079) and shuffle.is_small(t.limit(0), 0)


def test_staged_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shuffle, "shared_dir", lambda _: str(tmp_path))
    assert shuffle.stage(spark.range(5).select(F.col("id") * 2)).count() == 5 and [*tmp_path.rglob("*.parquet")]
    shuffle.drop_staged(spark)
    assert not [*tmp_path.rglob("*.parquet")]


def test_a_cluster_without_a_shared_folder_is_an_error():
    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError):
        shuffle.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    local = SimpleNamespace(get=lambda k, *_: "/w/" if "warehouse" in k else None)
    assert shuffle.shared_dir(SimpleNamespace(conf=local, sparkContext=SimpleNamespace(master="local[4]"))) == "/w/_shared"
