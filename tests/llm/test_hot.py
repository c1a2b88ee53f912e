"""Hot buckets, clashing columns and texts longer than a slice, in near dedup and line dedup."""

import random

import numpy as np
import pytest

from mnemolake.llm import line_dedup, near_dedup
from tests.llm.test_exact import DOCS, components_by_hand, rows_of


def altered(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.random()}"
    return out


def family(seed, copies, size=120, spread=(1, 7)):
    rng = random.Random(seed)
    base = [f"t{seed}_{i}" for i in range(size)]
    return [" ".join(altered(rng, base, rng.randint(*spread))) for _ in range(copies)]


@pytest.mark.parametrize("large", [2, 12])
def test_large_buckets_are_split_by_rare_shingles(spark, large):
    docs = list(enumerate(family(1, 40) + family(2, 25) + family(3, 10, 30, (0, 1))))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS), large=large)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == components_by_hand(docs)


@pytest.mark.parametrize("large", [10, 1000])
def test_one_bucket_of_unlike_documents(spark, large):
    """All nodes under one key, few of them alike: links of the exact pairs, whichever way the bucket takes."""
    texts = family(5, 12) + [" ".join(f"u{i}_{k % 90}" for k in range(100)) for i in range(60)] + family(6, 12, 60, (0, 1))
    random.Random(1).shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, DOCS)
    feats = near_dedup.features(df, 1, 120)  # one band, so that all may be said to share it
    key = near_dedup.F.lit(7).cast("long")
    signatures = feats.select("doc_id", "n", "sig", near_dedup.F.array(key).alias("bands"))
    nodes = df.select(key.alias("key"), "doc_id", near_dedup.F.col("doc_id").alias("c"), near_dedup.F.lit(len(docs)).cast("long").alias("m"))
    nodes = nodes.drop("m").join(near_dedup.open_buckets(nodes), "key")
    links = near_dedup.settle(nodes, df, signatures, 120, (85, 100), 1e-6, large)
    parts = near_dedup.connected_components(links, "a", "b")
    low = {r["node"]: r["component"] for r in parts.collect()}
    assert [(d, low.get(d, d)) for d, _ in docs] == sorted((d, c) for d, _, c, _ in components_by_hand(docs))


def test_blocks_outside_the_main_component(spark, monkeypatch):
    """A large group of near copies of which most are too far from any one hub, in many small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    docs = list(enumerate(family(8, 150, 120, (3, 5)) + family(9, 60)))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS), large=20)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == components_by_hand(docs)


def test_stage_with_clashing_columns(spark):
    a, b = "a b c d e f g", "A b c d e f G"
    columns = ["__gone", "__again", "__row", "n", "kept", "c d"]
    rows = [(1, a, *range(6)), (2, b, *range(6)), (3, "other words", *range(6)), (3, "other words", *range(6)), (4, None, *range(6))]
    df = spark.createDataFrame(rows, ["doc_id", "text", *columns])
    got = near_dedup.keep_one_of_each(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4]


def test_near_duplicates_of_long_texts(spark):
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 250_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:-5000])), (3, " ".join(words[:100_000])), (4, "short")]
    assert len(docs[0][1]) > 1 << 20
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == components_by_hand(docs)


def test_lines_of_hot_and_many_sites(spark, monkeypatch):
    rows = [(i, "hot", f"head\nown {i}\n{'tail' if i % 2 else 'x' * 200_000}") for i in range(30)] + [(100 + i, f"s{i % 4}", "foot\nmine") for i in range(40)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, source string, text string, n_lines long")
    one = rows_of(line_dedup.drop_boilerplate(docs, counts=("n_lines", "n_dropped")), "doc_id", "text", "n_lines", "n_dropped")
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", 0)
    many = line_dedup.drop_boilerplate(docs, counts=("n_lines", "n_dropped"))
    assert many.columns == ["doc_id", "source", "text", "n_lines", "n_dropped"] and rows_of(many, "doc_id", "text", "n_lines", "n_dropped") == one
    assert {r[1] for r in one if r[0] % 2 and r[0] < 30} == {f"own {i}" for i in range(1, 30, 2)} and {(r[2], r[3]) for r in one if r[0] >= 100} == {(2, 2)}


@pytest.mark.parametrize("large", [20, 1000])
def test_nodes_ruled_out_by_their_own_shingles(spark, monkeypatch, large):
    """Near copies of which some have so many words of their own that they can't be linked, and one doc_id of two texts."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    docs = list(enumerate(family(11, 120, 120, (1, 12)) + family(12, 40, 60, (1, 4))))
    df = spark.createDataFrame(docs, DOCS)
    got = near_dedup.near_duplicates(df, large=large)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == components_by_hand(docs)
    key = near_dedup.F.lit(1).alias("key")
    nodes = df.unionByName(df.where("doc_id = 3").withColumn("text", near_dedup.F.lit("p q r s t u"))).select(key, "doc_id", "text", near_dedup.F.col("doc_id").alias("c"))
    sets = near_dedup.shingle_sets(nodes.select("doc_id", "text"))
    nodes = nodes.select("key", "doc_id", "c").distinct()
    left = near_dedup.linkable(nodes, sets, near_dedup.shingle_rows(nodes, sets), (85, 100)).collect()
    assert 2 < sum(r["core"] for r in left) < len(left) < len(docs) and any(r["doc_id"] == 3 and r["core"] for r in left)
