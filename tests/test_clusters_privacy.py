"""Average-link clusters against a plain implementation; a privacy budget shared by callers."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.operators import clusters, logs, privacy
from mnemolake.plans import views
from mnemolake.plans.storage import shared_dir


def plain(sim, most, least):
    groups = [[i] for i in range(len(sim))]
    while len(groups) > most:
        score, i, j = max((sim[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if score < least:
            break
        groups[-i] += groups.pop(-j)
    number = {i: k for k, g in enumerate(sorted(groups, key=min)) for i in g}
    return [number[i] for i in range(len(sim))]


@pytest.mark.parametrize("n", [1, 2, 3, 25, 60])
@pytest.mark.parametrize("least", [-2.0, 0.4])
def test_average_link_is_the_plain_one(n, least):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(4, 6))[rng.integers(0, 4, n)] + 0.4 * rng.normal(size=(n, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for most in (1, 3, 10):
        assert clusters.average_link(u @ u.T, most, least).tolist() == plain(u @ u.T, most, least)


def test_result_sets_are_clustered_whole(spark, sf):
    memory, vector = views.view(spark, sf, "memory"), views.view(spark, sf, "vector")
    results = spark.createDataFrame([(q, str(i)) for q, r in (("a", range(0, 90)), ("b", range(5, 8)), ("c", [300, 9999])) for i in r], "qid string, id string")
    got = {(r["qid"], r["id"]): r["cluster"] for r in clusters.cluster_results(results, memory, vector, 4, 0.2).collect()}
    m = {r["id"]: set(r["tags"]) for r in memory.collect()}
    v = {r["id"]: np.array(r["v"], float) for r in vector.collect()}
    for q, ids in (("a", sorted(map(str, range(90)))), ("b", ["5", "6", "7"])):
        sim = np.array([[0.6 * len(m[a] & m[b]) / len(m[a] | m[b]) + 0.4 * float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])) for b in ids] for a in ids])
        assert [got[q, i] for i in ids] == plain(sim, 4, 0.2)
    assert ("c", "9999") not in got


def test_the_sixth_of_five_answers_is_refused_whoever_asks(spark, sf):
    memory, path = views.view(spark, sf, "memory"), f"{shared_dir(spark)}/ledger-test"
    for k in range(5):
        ledger = privacy.PrivacyLedger(spark.newSession() if k % 2 else spark, path, 1.0)
        logs.dp_count(memory, ledger, 0.2)
    with pytest.raises(ValueError, match="exhausted"):
        logs.dp_histogram(memory, privacy.PrivacyLedger(spark.newSession(), path, 1.0), 0.2)
    assert privacy.PrivacyLedger(spark, path, 1.0).left == pytest.approx(0)


def test_callers_at_once_never_spend_more_than_there_is(spark):
    path, spent, refused = f"{shared_dir(spark)}/ledger-many", [], []

    def ask():
        for _ in range(4):
            try:
                spent.append(privacy.PrivacyLedger(spark, path, 1.0).spend(0.1))
            except ValueError:
                refused.append(1)  # spent, or another caller is just writing

    threads = [threading.Thread(target=ask) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(spent) <= 1.0 + 1e-9 and len(spent) + len(refused) == 24
    assert privacy.PrivacyLedger(spark, path, 1.0).left == pytest.approx(1.0 - sum(spent))


def test_geometric_noise(spark):
    x = spark.range(20_000).select(privacy.geometric(0.5, 3).alias("x"))
    r = x.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.sum(F.when(F.col("x").isNull(), 1).otherwise(0)).alias("bad")).first()
    a = np.exp(-0.5)
    assert abs(r["m"]) < 0.15 and abs(r["v"] - 2 * a / (1 - a) ** 2) < 1 and r["bad"] == 0
