"""Focus with event time against a plain minute-by-minute simulation, and what is left in the store."""

import pytest
from pyspark.sql import functions as F

from mnemolake.plans import views
from mnemolake.streaming import streams
from mnemolake.streaming.focus import PackedFocus, TimedFocus, leaver

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def by_hand(rows, size, idle):
    """(session, last minute, turn): activation, one minute after the other."""
    out = {}
    for s in {r["session_id"] for r in rows}:
        held, last = {}, None
        for at, turn, imp, val in sorted((r["at_ms"] // 60000, r["turn"], r["importance"], r["valence"]) for r in rows if r["session_id"] == s):
            if last is not None and at - last > idle:
                out.update({(s, last, t): a for t, (a, _) in held.items()})
                held = {}
            for _ in range(0 if last is None else at - last):
                held = {t: (min(1.0, a * 0.98 + (0.1 * v if v > 0.5 else 0)), v) for t, (a, v) in held.items()}
            held = {t: x for t, x in held.items() if x[0] >= 0.1}
            held.pop(turn, None)
            while len(held) >= size:
                weak = {t: a + v for t, (a, v) in held.items() if a < 0.3 and v < 0.3}
                other = [{t: a for t, (a, _) in held.items() if a < top} for top in (0.5, 0.8, 2)]
                first = next(x for x in [weak, *other] if x)
                held.pop(min(first, key=lambda t: (first[t], t)))
            held[turn] = (imp, val)
            last = at
        out.update({(s, last, t): a for t, (a, _) in held.items()})
    return out


@pytest.mark.parametrize(("size", "slices"), [(5, 5), (2, 1)])
def test_same_as_simulation(spark, sf, size, slices):
    message = views.view(spark, sf, "message")
    if size == 2:  # strong feelings too
        message = message.withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("!!!!"))).otherwise(F.col("text")))
    got = {(r["session_id"], r["last_ms"] // 60000, r["turn"]): r["activation"] for r in streams.focus_with_time(message, size=size, slices=slices).collect()}
    want = by_hand([r.asDict() for r in streams.timed(message).collect()], size, 30)
    assert set(got) == set(want) and len({(s, m) for s, m, _ in want}) > len({s for s, _, _ in want})  # some fell idle and came back
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_idle_sessions_leave_the_store(spark, tmp_path):
    rows = [(str(s), t, 60 * (s + t)) for s in range(30) for t in range(4)] + [("_end", 0, 10_000_000)]
    df = spark.createDataFrame(rows, "session_id string, turn long, sec long").select("session_id", "turn", F.timestamp_seconds("sec").alias("at"), (F.col("sec") * 1000).alias("at_ms"), F.lit(0.9).alias("importance"), F.lit(0.0).alias("valence"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        s = streams.in_slices(df.where("session_id <> '_end'"), "at", 3, df.where("session_id = '_end'"))
        out = s.withWatermark("at", "1 minute").groupBy("session_id").transformWithStateInPandas(TimedFocus(3, 30), "session_id string, last_ms long, turn long, activation double", "Append", "EventTime")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        assert max(held) >= 30 * 3 and held[-1] <= 6
        assert spark.read.parquet(str(tmp_path / "out")).count() == 30 * 3
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_who_leaves():
    assert leaver({1: (0.2, 0.0), 2: (0.1, 0.9), 3: (0.9, 0.0)}) == 1  # weak and dull before merely weak
    assert leaver({1: (0.45, 0.9), 2: (0.4, 0.9), 3: (0.7, 0.0)}) == 2
    assert leaver({1: (0.85, 0.0), 2: (0.7, 0.0)}) == 2
    assert leaver({2: (0.9, 0.0), 1: (0.9, 0.0)}) == 1


def test_turns_are_computed_once_for_all_slices(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(600).select("id", F.timestamp_seconds(F.col("id") * 60).alias("at")).mapInArrow(count, "id long, at timestamp")
    streams.in_slices(df, "at", 6)
    assert seen.value == 600


def test_a_session_is_one_value_and_three_calls(spark):
    calls, kept = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return kept.get("x")

        def update(self, x):
            calls.append("update")
            kept["x"] = x

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, at):
            calls.append("register")

        def deleteTimer(self, at):
            calls.append("delete")

    p = PackedFocus(2, 30)
    p.init(Handle())
    rows = [{"at_ms": 60_000 * t, "turn": t, "importance": 0.9, "valence": 0.0} for t in range(3)]
    assert list(p.handleInputRows(("s",), iter(rows), None)) == [] and calls == ["get", "update", "register"]
    late = {"at_ms": 60_000 * 50, "turn": 9, "importance": 0.5, "valence": 0.0}
    assert [(r["turn"], r["last_ms"]) for r in p.handleInputRows(("s",), iter([late]), None)] == [(1, 120_000), (2, 120_000)]
    assert calls[3:] == ["get", "update", "delete", "register"] and kept["x"][1] == [9]
