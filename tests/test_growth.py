"""Joins whose work must grow with their input."""

import re

from mnemolake.operators import ingest


def below_joins(df):
    """The optimized plan from each of its joins on."""
    return re.split(r"\bJoin Inner", df._jdf.queryExecution().optimizedPlan().toString())[1:]


def test_fused_writes_meet_one_row_a_group(spark):
    import hashlib

    rows = [(str(i), "x" * 40 + "y" * (i % 17), "w") for i in range(300)]
    m = spark.createDataFrame(rows, "id string, content string, wing string")
    got = ingest.fuse_on_write(m)
    assert below_joins(got) and all("Aggregate [wing" in x for x in below_joins(got))
    new = [r for r in rows if int(r[0]) % 5 == 0]
    want = {}
    for i, text, _ in rows:
        if int(i) % 5:
            best = max(((len(max(text, t, key=len)), j, t if len(t) > len(text) else text) for j, t, _ in new))
            want[i] = (hashlib.md5(best[2].encode()).hexdigest(), len(new))
    assert {r["id"]: (r["digest"], r["fused_count"]) for r in got.collect()} == want


def test_unlike_sets_that_share_a_rare_word_are_ruled_out_before_whole_sets_are_sent(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from mnemolake.operators import similarity

    rng, rows = random.Random(3), []
    for i in range(300):
        ws = rng.sample(range(4000), rng.choice([5, 40, 200, 1500]))
        rows.append((f"{i:03d}", " ".join(f"w{x}" for x in ws)))
        rows.append((f"{i:03d}x", " ".join(f"w{x}" for x in ws[: len(ws) - len(ws) // 12] + [5000 + i])))
    sets, left = {i: set(t.split()) for i, t in rows}, []
    whole = similarity.near_in_parity

    def counted(pairs, th):
        left.append((pairs.count(), out := whole(pairs, th)))
        return out

    monkeypatch.setattr(similarity, "near_in_parity", counted)
    got = similarity.jaccard_pairs(spark.createDataFrame(rows, "id string, content string"), F.split("content", " "), 0.8)
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in got.collect()} == want and len(want) >= 200
    assert left[0][1].count() < 1.2 * len(want)


def test_lost_effects_need_no_pairs_of_causes_and_reached_effects(spark, monkeypatch):
    from mnemolake.operators import causal

    def refuse(links):
        raise AssertionError("all reached pairs were listed")

    monkeypatch.setattr(causal, "reachable", refuse)
    links = [("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "d"), ("b", "f"), ("f", "g"), ("a", "h"), ("x", "y"), ("y", "x")]
    got = causal.lost_without(spark.createDataFrame(links, "cause string, effect string"))
    want = {("c", "d"), ("c", "e"), ("d", "e"), ("b", "f"), ("b", "g"), ("f", "g"), ("a", "h")}
    assert {(r["cause"], r["effect"]) for r in got.collect()} == want


def test_a_block_of_vectors_is_sent_once_a_side(spark, monkeypatch):
    import numpy as np

    from mnemolake.operators import vectors as vv

    monkeypatch.setattr(vv, "SIDES", 4)
    v = np.random.default_rng(5).normal(size=(600, 16))
    got = vv.vector_pairs(spark.createDataFrame([(f"{i:03d}", x.tolist()) for i, x in enumerate(v)], "id string, v array<double>"), 0.5, block=10)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(np.round(u @ u.T, 9) >= 0.5, 1))
    assert {(r["a"], r["b"]) for r in got.collect()} == {(f"{a:03d}", f"{b:03d}") for a, b in zip(i, j)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Aggregate [x" in plan


def test_shared_keywords_are_counted_by_subsets(spark):
    from collections import Counter
    from itertools import combinations
    from random import Random

    from mnemolake.operators import conflict, similarity

    rng = Random(2)
    words = ["".join(x) for x in combinations("pqrst", 3)]
    rows = [(f"{i:03d}", " ".join(rng.sample(words, rng.choice([1, 2, 5, 8]))), rng.choice("xyz")) for i in range(120)]
    m = spark.createDataFrame(rows, "id string, content string, wing string")
    want = Counter()
    for (_, t, w), (_, u, v) in combinations(rows, 2):
        if w != v and len(set(t.split()) & set(u.split())) >= 2:
            want[min(w, v), max(w, v)] += 1
    assert {(r["a"], r["b"]): r["n"] for r in similarity.wing_cooccurrence(m).collect()} == want
    pairs = Counter(x for r in conflict.conflict_pairs(m, [(["pqr"], ["qrs"])]).collect() for x in (r["a"], r["b"]))
    assert {r["id"]: r["conflicts"] for r in conflict.conflict_counts(m, [(["pqr"], ["qrs"])]).collect()} == pairs and pairs


def test_near_trigram_sets_send_no_blocks_of_whole_sets(spark, monkeypatch):
    from mnemolake.operators import sets, similarity

    def refuse(*_):
        raise AssertionError("blocks of whole sets were made")

    monkeypatch.setattr(sets, "make_blocks", refuse)
    rows = [("1", "the quick brown fox jumps over the lazy dog again"), ("2", "the quick brown fox jumps over the lazy dog again!"), ("3", "something else"), ("4", "something else"), ("5", None), ("6", "ab")]
    got = similarity.dup_char3(spark.createDataFrame(rows, "id string, content string"))
    assert {(r["a"], r["b"]) for r in got.collect()} == {("1", "2"), ("3", "4")}
