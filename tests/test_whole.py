"""Queries over the whole of their tables, against brute force."""

import re

import numpy as np
import pytest

from mnemolake.operators import filters, search
from mnemolake.plans import registry, views
from mnemolake.streaming import streams

registry.load()


def top_by_hand(spark, sf_dir, every=50, k=10, least=0.2):
    rows = [(r["id"], r["v"]) for r in views.view(spark, sf_dir, "vector").collect()]
    ids, v = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = set()
    for i, d in enumerate(ids):
        if int(d) % every == 0:
            s = np.round(v @ v[i], 9)
            out |= {(f"v{d}", ids[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:k] if s[j] >= least}
    return out


def pairs_of(df):
    return {(r["qid"], r["id"]) for r in df.collect()}


def test_exact_search_of_every_50th_in_blocks(spark, sf):
    wanted = top_by_hand(spark, sf)
    assert pairs_of(registry.QUERIES["d5_vector_topk"](spark, sf)) == wanted
    assert pairs_of(search.vector_topk_every(views.view(spark, sf, "vector"), 50, block=3)) == wanted


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_registered_approximate_search_recall(spark, size):
    """With the very parameters of the query, for all of its queries."""
    wanted = top_by_hand(spark, f"/root/testdata/{size}")
    got = pairs_of(registry.QUERIES["d6_vector_topk_approx"](spark, f"/root/testdata/{size}"))
    assert {q for q, _ in got} == {q for q, _ in wanted} and len(got & wanted) / len(wanted) >= 0.9


def test_links_of_all_records(spark, sf):
    rows = {r["id"]: r["content"] for r in views.view(spark, sf, "memory").select("id", "content").collect()}
    held = {}
    for i, t in rows.items():
        for w in set(re.findall("[\u4e00-\u9fff]+|[a-z0-9_]{2,}", (t or "").lower())):
            held.setdefault(w, []).append(i)
    wanted = set()
    for i, t in rows.items():
        m = re.search("([A-Za-z]{6,}) ([a-z]+)", t or "")
        others = [x for x in held.get(m[1].lower(), []) if x != i] if m else []
        if others:
            wanted.add((i, m[1].lower(), min(others)))
    got = {tuple(r) for r in registry.QUERIES["b9_resolve_wikilinks"](spark, sf).select("id", "target", "mentions").collect()}
    assert got == wanted and any(int(i) % 50 for i, _, _ in got)


def test_whole_questions(spark):
    long = "word " * 20
    df = spark.createDataFrame([("s", 3, "user", long + "asks 5 days ago, then the summary")], "session_id string, turn long, role string, text string")
    assert filters.mentioned_time(df).first()["day"] == "2024-01-27"
    assert filters.parse_queries(df).first()["intent"] == "summary"
    assert {r["term"] for r in filters.expand_terms(df).collect()} == {"then", "the"}
    assert filters.decompose_query(df, [", "]).count() == 2


def test_all_predicates_are_counted(spark, sf):
    edges = {(r["object_id"], r["predicate"], r["subject_id"]) for r in views.view(spark, sf, "relation").collect()}
    n = {}
    for o, p, _ in edges:
        n[o, p] = n.get((o, p), 0) + 1
    got = {tuple(r) for r in registry.QUERIES["g13_common_predicate_pairs"](spark, sf).select("target", "predicate", "subjects", "pairs").collect()}
    assert got == {(o, p, k, k * (k - 1) // 2) for (o, p), k in n.items()} and {"causes", "enables"} <= {x[1] for x in got}


@pytest.mark.parametrize("name", ["stream_event_counts", "stream_sessions", "stream_audit_alerts"])
def test_streams_are_written_as_they_are_dealt(spark, sf, monkeypatch, name):
    made, write = [], streams.as_stream
    monkeypatch.setattr(streams, "as_stream", lambda df, *a: made.append(df.rdd.getNumPartitions()) or write(df, *a))
    log = views.view(spark, sf, "access_log")
    gap = {"gap": "2 hours"} if name == "stream_sessions" else {}
    run = getattr(streams, name)
    assert sorted(map(str, run(log.repartition(5), **gap).collect())) == sorted(map(str, run(log, **gap).collect()))
    assert made[0] >= 6
