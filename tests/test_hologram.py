"""D12 and D13 against the projections by hand."""

import math

from pyspark.sql import functions as F

from mnemolake.operators import search
from mnemolake.plans import views


def by_hand(r, slots):
    h, w, m = (2 * math.pi * x for x in (r["created_at"].hour / 24, r["created_at"].weekday() / 7, r["created_at"].month / 12))
    e = r["emotional_weight"]
    out = [[math.sin(h), math.cos(h), math.sin(w), math.cos(w), math.sin(m), math.cos(m)], [e, abs(e), max(e, 0), max(-e, 0)], [float(slots.count(i)) for i in range(128)]]
    return [[x / s for x in v] if (s := math.sqrt(sum(x * x for x in v))) else v for v in out]


def test_projections_and_scores(spark, sf):
    m = views.view(spark, sf, "memory").withColumn("wing", F.when(F.col("id") == "5", None).otherwise(F.when(F.col("id") == "12", F.col("author")).otherwise(F.col("wing"))))
    keyed = m.withColumn("slots", F.array(*[F.pmod(F.xxhash64(c), F.lit(128)) for c in ("wing", "room", "author")]))
    vectors = {r["id"]: by_hand(r, list(r["slots"])) for r in keyed.drop("content").collect()}
    got = {r["id"]: (r["temporal"], r["emotional"], r["source"]) for r in search.hologram_encode(m).collect()}
    assert got.keys() == vectors.keys()
    assert all(len(x) == len(y) and all(abs(a - b) < 1e-9 for a, b in zip(x, y, strict=True)) for i in got for x, y in zip(got[i], vectors[i], strict=True))

    def cos(x, y):
        n = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y))
        return sum(a * b for a, b in zip(x, y, strict=True)) / n if n else 0.0

    for qid in ("3", "12"):
        scores = sorted((round(-sum(w * cos(x, y) for w, x, y in zip((0.4, 0.3, 0.3), vectors[i], vectors[qid], strict=True)), 9), i) for i in vectors if i != qid)
        rows = search.hologram_search(m, ["3", "12"]).where(F.col("qid") == qid).orderBy("rk").collect()
        assert [(r["id"], r["score"]) for r in rows] == [(i, round(-s, 6)) for s, i in scores[:10]]


def test_no_norm_is_taken_for_every_component(spark, sf):
    """Formerly the plan of D13 hashed wing, room and author for each of 128 components, and again for each norm."""
    plan = search.hologram_search(views.view(spark, sf, "memory"), ["3"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") <= 4
