"""The bucket table: merges, untouched buckets, repeated batches and one that dies before its manifest."""

import random

import pytest
from pyspark.sql import functions as F

from mnemolake.plans.storage import shared_dir
from mnemolake.sources.buckets import BucketTable

SCHEMA = "id string, t long, x long"


def table(spark, name, order=("t",), buckets=16):
    return BucketTable(spark, f"{shared_dir(spark)}/table-{name}", SCHEMA, "id", list(order) if order else None, buckets)


def rows(df):
    return {(r["id"], r["t"], r["x"]) for r in df.collect()}


def test_batches_merge_by_order(spark):
    rng, t, want = random.Random(1), table(spark, "order"), {}
    for k in range(4):
        batch = [(rng.choice([None, "a", "b"]) if i == 0 else f"k{rng.randrange(60)}", 1000 * rng.randrange(9) + 100 * k + i, i) for i in range(40)]
        for r in batch:
            if r[0] not in want or r[1] > want[r[0]][1]:
                want[r[0]] = r
        assert t.merge(spark.createDataFrame([(*r, "more") for r in batch], f"{SCHEMA}, other string"), k)
        assert rows(t.read()) == set(want.values())
    assert not t.merge(spark.createDataFrame([("k1", 10**6, 1)], SCHEMA), 3) and rows(table(spark, "order").read()) == set(want.values())


def test_only_touched_buckets_are_written(spark):
    t = table(spark, "touched", None)
    t.merge(spark.range(500).select(F.col("id").cast("string"), F.lit(0).cast("long").alias("t"), F.col("id").alias("x")), 0)
    before = t.manifest()["at"]
    t.merge(spark.createDataFrame([("7", -5, 70), ("new", 1, 1)], SCHEMA), 1)
    after = t.manifest()["at"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and len(before) == 16 and all("rows/1/" in after[b] for b in changed)
    assert {r for r in rows(t.read()) if r[0] in ("7", "new", "8")} == {("7", -5, 70), ("new", 1, 1), ("8", 0, 8)} and t.read().count() == 501


def test_a_batch_that_dies_midway_can_be_repeated(spark, monkeypatch):
    t = table(spark, "killed")
    t.merge(spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], SCHEMA), 0)

    def die(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_switch", die)
        with pytest.raises(KeyboardInterrupt):
            t.merge(spark.createDataFrame([("a", 2, 9), ("c", 2, 3)], SCHEMA), 1)
    assert rows(t.read()) == {("a", 1, 1), ("b", 1, 2)}
    assert t.merge(spark.createDataFrame([("a", 2, 9), ("c", 2, 3)], SCHEMA), 1)
    assert rows(t.read()) == {("a", 2, 9), ("b", 1, 2), ("c", 2, 3)}


def test_a_second_writer_of_the_same_number_fails(spark):
    t = table(spark, "writers")
    t.merge(spark.createDataFrame([("a", 1, 1)], SCHEMA), 0)
    with pytest.raises(RuntimeError, match="another writer"):
        t._switch({"number": 1, "batch": 5, "at": {}})
    assert table(spark, "none").read().count() == 0


def test_a_batch_is_written_through(spark, sf):
    from mnemolake.operators import ingest
    from mnemolake.plans import views

    memory, vector = (views.view(spark, sf, n) for n in ("memory", "vector"))
    got = {r["id"]: r for r in ingest.ingest_batch(memory, vector, 0.3).collect()}
    stored = {(r["wing"], r["content"]): r["id"] for r in sorted(memory.collect(), key=lambda r: r["id"], reverse=True) if int(r["id"]) % 5}
    near = {r["id"]: r["stored"] for r in ingest.near_duplicate_upsert(memory, vector, 0.3).collect()}
    raised = {r["id"]: r["importance"] for r in ingest.exact_duplicate_upsert(memory).where("action = 'raised'").collect()}
    seen, checked = set(), 0
    for r in sorted(memory.collect(), key=lambda r: r["id"]):
        if int(r["id"]) % 5 or not r["content"].strip():
            continue
        key = (r["wing"], r["content"])
        if key in seen:
            assert r["id"] not in got
            continue
        seen.add(key)
        row = got.pop(r["id"])
        if row["redacted"]:
            continue  # the stored text is unredacted
        want = ("raise", stored[key]) if key in stored else ("fuse", near[r["id"]]) if r["id"] in near else ("add", r["id"])
        assert (row["action"], row["target"]) == want
        if want[0] == "add":
            assert row["importance"] == pytest.approx(r["importance"]) and row["seen"] == row["times"]
        checked += row["dimensions"] > 0
    assert not got and checked > 20 and len(raised) >= 0
