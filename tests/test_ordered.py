"""Ordered windows without Spark's own: numbering, neighbours and running values against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import ordered


def rows(seed=1, n=500, hot=0.6):
    rng = random.Random(seed)
    return [(f"{i:04d}", rng.choice([None, "b", "c"]) if rng.random() > hot else "hot", rng.randrange(40), rng.choice([None, 1, 2])) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id string, k string, t int, x int").repartition(5)


def key(r):
    return (r[1] is not None, r[1] or "", r[2], r[0])


@pytest.mark.parametrize("size", [3, 64, ordered.BLOCK_ROWS])
@pytest.mark.parametrize("hot", [0.6, 1.0])
def test_numbers_and_neighbours(spark, size, hot):
    data = sorted(rows(hot=hot), key=key)
    got = {r["id"]: (r["pos"], r["number"]) for r in ordered.numbered(frame(spark, data), ["k"], "t", "id", size=size).collect()}
    count, want = {}, {}
    for p, r in enumerate(data):
        count[r[1]] = count.get(r[1], 0) + 1
        want[r[0]] = (p, count[r[1]])
    assert got == want
    look = {"before": ("id", -1), "after": ("x", 2), "far": ("id", -3)}
    got = {r["id"]: (r["before"], r["after"], r["far"]) for r in ordered.within_key(frame(spark, data), ["k"], ["t", "id"], look, size).collect()}

    def at(p, d, c):
        q = p + d
        return data[q][c] if 0 <= q < len(data) and data[q][1] == data[p][1] else None

    assert got == {r[0]: (at(p, -1, 0), at(p, 2, 3), at(p, -3, 0)) for p, r in enumerate(data)}


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_running_values(spark, size):
    data = sorted(rows(2), key=lambda r: (r[2], r[0]))
    x = ordered.running(ordered.positions(frame(spark, data), "t", "id"), {"total": ("sum", F.col("x")), "most": ("max", F.col("x")), "least": ("min", F.col("t"))}, size)
    got = {r["id"]: (r["total"], r["most"], r["least"]) for r in x.collect()}
    total = most = least = None
    want = {}
    for i, _, t, v in data:
        if v is not None:
            total, most = (total or 0) + v, max(most or v, v)
        least = t if least is None else min(least, t)
        want[i] = (total, most, least)
    assert got == want


def test_one_hot_key_is_spread_evenly(spark):
    df = spark.range(40_000).select(F.lit("hot").alias("k"), (F.col("id") % 97).alias("t"), F.col("id").cast("string").alias("id"))
    x = ordered.numbered(df, ["k"], "t", "id", size=1000)
    sizes = [r[0] for r in ordered.positions(df, "k", "t", "id").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert x.agg(F.min("number"), F.max("number"), F.countDistinct("number")).first()[:] == (1, 40_000, 40_000)
    blocks = [r[0] for r in x.groupBy(F.floor(F.col("pos") / 1000)).count().select("count").collect()]
    assert max(blocks) == 1000 and max(sizes) <= 2 * 40_000 / 4


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id string, k string, t int, x int")
    assert ordered.numbered(empty, ["k"], "t", "id").count() == 0 and ordered.within_key(empty, ["k"], ["t", "id"], {"b": ("x", 1)}).count() == 0
