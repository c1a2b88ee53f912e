"""Every registered query against its SQL in DuckDB, and those without SQL by what their rows must satisfy."""

import pytest

from mnemolake.plans import registry, views
from tests.harness import differences

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, sf, name):
    assert differences(registry.QUERIES[name](spark, sf), registry.ORACLES[name], sf) == ""


def memory_of(spark, sf):
    return {r["id"]: r for r in views.view(spark, sf, "memory").collect()}


def pieces_are_of_their_text(rows, spark, sf):
    texts = memory_of(spark, sf)
    return all(len(r["piece"]) > 50 and set(r["piece"].split("\n")) <= set(texts[r["id"]]["content"].split("\n")) for r in rows)


def projections_are_units(rows, spark, sf):
    norms = [sum(x * x for x in r[c]) for r in rows for c in ("temporal", "emotional", "source")]
    return {r["id"] for r in rows} == set(memory_of(spark, sf)) and all(n == 0 or abs(n - 1) < 1e-9 for n in norms)


def ranks_follow_scores(rows, spark, sf):
    by = {}
    for r in sorted(rows, key=lambda r: r["rk"]):
        by.setdefault(r["qid"], []).append((r["rk"], r["score"]))
    return all([k for k, _ in v] == list(range(1, len(v) + 1)) and all(a[1] >= b[1] for a, b in zip(v, v[1:], strict=False)) for v in by.values())


#: What holds for all rows of a query; those not named have tests of their own against brute force.
HOLDS = {
    "a8_chunk_headings": pieces_are_of_their_text,
    "a16_export_redacted": lambda rows, spark, sf: {(r["id"], r["wing"]) for r in rows} == {(i, r["wing"]) for i, r in memory_of(spark, sf).items()},
    "b2b_redact_pages": lambda rows, spark, sf: len(rows) <= views.view(spark, sf, "pages").count(),
    "d6_vector_topk_approx": ranks_follow_scores,
    "d12_hologram_encode": projections_are_units,
    "d13_hologram_search": ranks_follow_scores,
    "e10_cluster_vectors": lambda rows, spark, sf: sum(r["n"] for r in rows) == views.view(spark, sf, "vector").count() and all(-1 <= r["cohesion"] <= 1 for r in rows),
    "e12_cluster_hierarchical": lambda rows, spark, sf: len({(r["qid"], r["id"]) for r in rows}) == len(rows) and all(0 <= r["cluster"] for r in rows),
    "i14_what_if": lambda rows, spark, sf: all(0 <= r["lost"] <= r["effects"] for r in rows),
    "l6_stream_thresholds": lambda rows, spark, sf: sum(r["records"] for r in rows) == len(memory_of(spark, sf)) and all(("fuse" in r["actions"]) == (r["records"] >= 10) for r in rows),
    "l8_focus_buffer": lambda rows, spark, sf: all(r["activation"] > 0 for r in rows),
}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_sql(spark, sf, name):
    rows = registry.QUERIES[name](spark, sf).collect()
    assert rows and HOLDS.get(name, lambda *_: True)(rows, spark, sf)
