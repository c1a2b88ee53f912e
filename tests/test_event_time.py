"""Event-time tables against plain Python: any order of arrival, late rows, repeated and broken batches, compaction."""

import random
import tempfile
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemolake.streaming.event_time import EventTable, sessions, windows

T0 = datetime(2024, 1, 1)
GAP = timedelta(hours=2)


def at(hours):
    return T0 + timedelta(hours=hours)


@pytest.fixture
def table(spark):
    def make(kind, delay="1 day"):
        shape, fold, schema = kind
        return EventTable(spark, tempfile.mkdtemp(prefix="spark-event-"), shape, fold, delay, schema)

    return make


def batch(spark, rows):
    return spark.createDataFrame(rows, "user string, at timestamp_ntz").withColumn("at", F.col("at").cast("timestamp"))


def sessions_by_hand(rows):
    out = Counter()
    by = {}
    for u, t in rows:
        by.setdefault(u, []).append(t)
    for u, ts in by.items():
        run = []
        for t in sorted(ts):
            if run and t > run[-1] + GAP:
                out[u, run[0], run[-1], len(run)] += 1
                run = []
            run.append(t)
        out[u, run[0], run[-1], len(run)] += 1
    return out


def test_sessions_in_any_order(spark, table):
    rnd = random.Random(3)
    rows = [(rnd.choice("aaab"), at(rnd.randrange(0, 4000) / 10)) for _ in range(300)]
    rows += [("c", at(0)), ("c", at(2)), ("c", at(4.001)), ("c", at(0))]  # exactly the gap, just over it, a repeated row
    rnd.shuffle(rows)
    t = table(sessions("2 hours", "user"))
    for k in range(3):
        t.merge(batch(spark, rows[k::3]), k)
        if k == 1:
            t.compact()
    got = Counter((r["user"], r["first"], r["last"], r["n"]) for r in t.read().collect())
    assert got == sessions_by_hand(rows)


def test_late_event_joins_two_sessions(spark, table):
    t = table(sessions("2 hours", "user"), "1 hour")
    t.merge(batch(spark, [("a", at(0)), ("a", at(3)), ("b", at(90))]), 0)
    assert {(r["user"], r["n"]) for r in t.closed().collect()} == {("a", 1)}
    t.merge(batch(spark, [("a", at(1.5))]), 1)
    assert [(r["first"], r["last"], r["n"], r["late"]) for r in t.read().where("user = 'a'").collect()] == [(at(0), at(3), 3, 1)]


def test_late_rows_are_told_and_kept(spark, table):
    t = table(windows("6 hours", ["user"], {"odd": F.hour("at") % 2}))
    t.merge(batch(spark, [("a", at(1)), ("a", at(50)), ("a", None)]), 0)
    assert t.watermark() == at(26)
    t.merge(batch(spark, [("a", at(2)), ("a", at(25)), ("b", at(19))]), 1)  # 2 is late; 19 too, whose window ends at 24; 25 is not
    rows = {(r["user"], r["w_start"]): (r["n"], r["odd"], r["late"]) for r in t.read().collect()}
    assert rows == {("a", at(0)): (2, 1, 1), ("a", at(48)): (1, 0, 0), ("a", at(24)): (1, 1, 0), ("b", at(18)): (1, 1, 1)}
    assert {(r["batch"], r["rows"], r["late"]) for r in t.progress().collect()} == {(0, 2, 0), (1, 3, 2)}
    assert t.watermark() == at(26)  # old rows do not turn it back
    assert {r["w_start"] for r in t.closed().collect()} == {at(0), at(18)}


def test_repeated_and_broken_batches(spark, table):
    t = table(windows("6 hours", ["user"], {}))
    one, two = batch(spark, [("a", at(1))]), batch(spark, [("a", at(1)), ("b", at(2))])
    t.merge(one, 0)
    t.merge(two, 1)
    before = sorted(t.read().collect())
    t.merge(two, 1)
    t.merge(one, 0)
    assert sorted(t.read().collect()) == before

    def stops(rows):
        raise RuntimeError("lost")

    # A batch that stops before its mark, its rows already written, is not read until it is run again.
    two.select(F.lit(at(0)).cast("timestamp").alias("w_start"), F.lit(at(6)).cast("timestamp").alias("ends"), "user", F.lit(9).cast("long").alias("n"), F.lit(0).cast("long").alias("late")).write.parquet(f"{t.path}/parts/2")
    assert sorted(t.read().collect()) == before
    t.compact()
    t.compact()
    t.merge(one, 1)  # folded already: changes nothing
    assert sorted(t.read().collect()) == before
    t.merge(one, 2)
    assert {r["user"]: r["n"] for r in t.read().collect()} == {"a": 3, "b": 1}
    broken = EventTable(spark, t.path, stops, t.fold, t.delay, t.schema)
    with pytest.raises(RuntimeError):
        broken.merge(one, 3)
    assert {r["user"]: r["n"] for r in t.read().collect()} == {"a": 3, "b": 1}


def test_nothing_yet(spark, table):
    t = table(sessions("2 hours", "user"))
    assert t.watermark() is None
    assert t.read().count() == 0
    t.compact()
    t.merge(batch(spark, []), 0)
    assert t.read().count() == 0 and t.watermark() is None
