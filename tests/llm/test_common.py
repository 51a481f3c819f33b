"""Shared helpers: ranks in groups of any size, stored tables, A-Z lower-casing."""

import os
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polyvox.llm import common


@pytest.mark.parametrize("known", [False, True])
def test_salted_rank(spark, monkeypatch, known):
    monkeypatch.setattr(common, "ROWS_PER_PART", 7)
    rows = [("hot", i % 90) for i in range(200)] + [("cold", 1), ("cold", 1), ("one", 5)]
    df = spark.createDataFrame(rows, "g string, id long").repartition(5)
    sizes = F.when(F.col("g") == "hot", 200).otherwise(2) if known else None
    got = defaultdict(list)
    for r in common.salted_rank(df, "g", ["id"], "rank", sizes).collect():
        got[r.g].append((r["rank"], r.id))
    assert {g: sorted(x for x, _ in v) for g, v in got.items()} == {"hot": list(range(200)), "cold": [0, 1], "one": [0]}
    assert sorted(i for _, i in got["hot"]) == sorted(i for g, i in rows if g == "hot")


def test_salted_rank_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "MAX_BROADCAST_GROUPS", 1)
    df = spark.createDataFrame([(f"g{i % 3}", i) for i in range(9)], "g string, id long")
    assert sorted(r["rank"] for r in common.salted_rank(df, "g", ["id"], "rank").collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_ascii_lower(spark):
    texts = ["ABC xyz", "ÀÉ Straße", "ǅungla Ⅷ Ⓐ", "İI", "", "ΑΣ", "é only lower É", None, "日本 AB"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [None if t is None else "".join(c.lower() if c.isascii() else c for c in t) for t in texts]
    assert [r.x for r in df.select(common.ascii_lower(F.col("t")).alias("x")).collect()] == want


def test_stored(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    again = common.stored(df, "test")
    assert sorted(map(tuple, again.collect())) == [(1, None), (2, "x")] and again.schema == df.schema
    assert common.stored(df.where("a > 5"), "empty").count() == 0


def test_discard(spark):
    table = common.stored(spark.range(5).toDF("n"), "gone")
    path = table.stored_at.removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(path)
    common.discard(table)
    assert not os.path.exists(path)


def test_slices():
    texts = ["a" * 10, None, "b" * 100, "", "c", "d" * 30, "é" * 20]
    batch = pa.RecordBatch.from_pydict({"n": list(range(7)), "text": texts})
    for most in (1, 10, 35, 1000):
        parts = list(common.slices(iter([batch, batch.slice(0, 0)]), "text", most))
        assert [t for p in parts for t in p.column("text").to_pylist()] == texts
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= most for p in parts)


def test_settings_are_put_back(spark):
    keys = list(common._WHILE_STORED)
    before = [spark.conf.get(k, None) for k in keys]
    inside = []
    table = spark.range(3).mapInArrow(lambda batches: batches, "id long")
    with common._own_settings(spark):
        inside = [spark.conf.get(k) for k in keys]
    common.stored(table, "settings")
    assert inside == ["1000", "-1", "-1"] and [spark.conf.get(k, None) for k in keys] == before
