"""Reachability, effects lost without a cause, and chains, on random graphs with circles, against plain Python."""

import random

import pytest

from mnemolake.operators import causal


def graph(seed):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(14):02d}", f"n{rng.randrange(14):02d}") for _ in range(rng.choice([8, 16, 26]))}) + [("z1", "z2"), ("z2", "z1"), ("z2", "z3")]


def reach_by_hand(edges, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in edges:
            if a == todo[0] and b not in seen:
                seen.add(b)
                todo.append(b)
        todo.pop(0)
    return seen


def lost_by_hand(edges):
    edges = [(a, b) for a, b in edges if a != b]
    roots = {a for a, _ in edges} - {b for _, b in edges}

    def held(without):
        kept = [(a, b) for a, b in edges if without not in (a, b)]
        return (roots - {without}) | {n for r in roots - {without} for n in reach_by_hand(kept, r)}

    every = held(None)
    return {(c, e) for c in {a for a, _ in edges} for e in reach_by_hand(edges, c) & every if e != c and e not in held(c)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reach_and_loss_with_circles(spark, seed):
    edges = graph(seed)
    df = spark.createDataFrame(edges, "cause string, effect string")
    assert {tuple(r) for r in causal.reachable(df).select("cause", "effect").collect()} == {(a, b) for a in {x for x, _ in edges} for b in reach_by_hand(edges, a)}
    got = [tuple(r) for r in causal.lost_without(df).select("cause", "effect").collect()]
    assert len(got) == len(set(got)) and set(got) == lost_by_hand(edges)


def test_chains_of_a_graph_with_a_circle(spark):
    links = [("a", "b", 0.5), ("b", "c", 0.7), ("c", "a", 0.9), ("a", "a", 0.9), ("x", "a", 0.6), ("q", "r", 0.4), ("b", "d", 0.8)]
    got = {(r["path"], r["steps"], r["confidence"]) for r in causal.chains_of(spark.createDataFrame(links, "cause string, effect string, confidence double"), 2).collect()}
    assert got == {("a>b>c>a", 3, 0.7), ("b>c>a>b", 3, 0.7), ("c>a>b>c", 3, 0.7), ("x>a>b>c", 3, 0.6)}


def test_empty_graph(spark):
    df = spark.createDataFrame([], "cause string, effect string, confidence double")
    assert causal.lost_without(df).count() == 0 and causal.chains_of(df, 3).count() == 0
