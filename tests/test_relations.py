"""I12 against brute force: windows of all lengths, hot keys, several passes."""

import random

import numpy as np
import pytest

from mnemolake.operators import timeline


def records(n=400, seed=4):
    rng = random.Random(seed)
    begin = ["in the début of a long t" + x for x in "abc"] + ["xinthe", "İinthe short 漢"]
    out = []
    for i in range(n):
        t = "".join(rng.choice("abh tne漢é") for _ in range(rng.choice([0, 3, 50])))
        for x in (*begin, "ththe", "onhe", "inthe"):
            if rng.random() < 0.15:
                t = x + t if rng.random() < 0.5 else t + x
        out.append((str(i), None if i % 50 == 0 else t, None if i % 40 == 1 else f"a{i % 3}", f"2024-01-0{1 + i % 2} 0{i % 7}:00:00"))
    return out


def by_hand(rows):
    m = [(i, None if t is None else t.lower(), a, at) for i, t, a, at in rows if a is not None and t is not None]
    out = []
    for i, c, a, at in m:
        for j, d, b, bt in m:
            if a == b and at[:10] == bt[:10] and (at, i) < (bt, j):
                out += [("cause", i, j)] * ("ththe" in c and "onhe" in d) + [("before", i, j)] * ("inthe" in c and c[:20] in d)
    return out


@pytest.mark.parametrize(("pairs", "pieces"), [(None, None), (10, 3)])
def test_same_as_brute_force(spark, monkeypatch, pairs, pieces):
    if pairs:
        monkeypatch.setattr(timeline.dealt_pairs, "__defaults__", (pairs,))
        monkeypatch.setattr(timeline.held_pieces, "__defaults__", (pieces,))
    rows = records()
    df = spark.createDataFrame(rows, "id string, content string, author string, at string").selectExpr("id", "content", "author", "cast(at as timestamp_ntz) created_at")
    got = [tuple(r) for r in timeline.text_relations(df, "ththe", "onhe", "inthe").collect()]
    want = by_hand(rows)
    assert sorted(got) == sorted(want) and len({k for k, _, _ in want}) == 2


def test_a_hot_key_is_dealt_to_parts(spark):
    one, two = (spark.range(300).selectExpr("'k' AS key", f"cast(id AS string) AS {c}") for c in "ab")
    x = timeline.dealt_pairs(one, two, ["key"], 1000)
    n = {r["part"]: r["count"] for r in x.groupBy("part").count().collect()}
    assert sum(n.values()) == 300 * 300 and len(n) >= 80 and max(n.values()) < 5000


def test_texts_are_not_exchanged(spark, sf):
    from mnemolake.plans import registry

    plan = registry.QUERIES["i12_text_relations"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan and "text#" not in plan


@pytest.mark.parametrize("size", [1, 5, 19, 20])
def test_window_hashes(size):
    codes = np.frombuffer(("abcabcabd" * 9).encode("utf-32-le"), np.uint32)
    h = timeline.window_hashes(codes, size)
    runs = [tuple(codes[k : k + size]) for k in range(len(codes) - size + 1)]
    assert len(h) == len(runs) and len(set(h.tolist())) == len(set(runs)) and len(set(zip(h.tolist(), runs, strict=True))) == len(set(runs))
    assert len(timeline.window_hashes(codes[: size - 1], size)) == 0
