"""Repeated strings of other lengths, hot anchors, clashing columns and long texts, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.llm import suffix_dedup
from tests.llm.test_exact import DOCS, repeated_by_hand


def found(df, **settings):
    got = suffix_dedup.repeated_strings(df, **settings).select("doc_id", "n_bytes", F.size("spans").alias("n"), "kept").collect()
    return sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got), key=str)


@pytest.mark.parametrize("length", [24, 30, 50, 100, 128, 200, 500])
def test_lengths(spark, length):
    rng = random.Random(length)
    base = ["".join(rng.choice("abc ") for _ in range(1200)) for _ in range(4)] + ["ab" * 600, "xyz" * 400, "q" * 700]
    docs = []
    for i in range(60):
        a = rng.randint(0, 500)
        docs.append((i * 7 % 61, rng.choice(base)[a : a + rng.randint(length // 2, 700)] + "".join(rng.choice("ab") for _ in range(30)) + rng.choice(base)[: rng.randint(0, 300)]))
    docs += [(0, "ab" * 260), (70, "ab" * 132), (71, "ab" * 240), (72, None)]
    assert found(spark.createDataFrame(docs, DOCS), length=length) == repeated_by_hand(docs, length)


def test_too_short_a_length(spark):
    with pytest.raises(ValueError):
        suffix_dedup.repeated_strings(spark.createDataFrame([], DOCS), length=20)


@pytest.mark.parametrize("most", [0, 20])
def test_hot_anchors_are_dealt_string_by_string(spark, most):
    rng = random.Random(most)
    hot = "Copyright by all of the contributors of this work "
    docs = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 60))) + hot[: rng.randint(20, 50)] + rng.choice(["", "2024", hot, "q" * 90])) for i in range(300)]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], f"{DOCS}, chunk int, tie int, kept int")
    assert found(df, most=most) == repeated_by_hand(docs)


def test_a_text_longer_than_a_slice(spark):
    rng = np.random.default_rng(2)
    long = bytes(rng.integers(97, 123, suffix_dedup.SLICE_BYTES + 300_000).astype(np.uint8)).decode()
    docs = [(1, long[500_000:500_200]), (2, long), (3, "é" + long[-100:]), (4, long[:49]), (5, long[:50])]
    assert found(spark.createDataFrame(docs, DOCS)) == repeated_by_hand(docs)


def test_counts_as_bytes():
    n = np.array([1, 2, 3, 10, 1000, 1 << 20])
    back = suffix_dedup._from_byte(suffix_dedup._to_byte(n))
    assert (abs(back / n - 1) < 0.1).all() and back[0] == 1 and back[1] == 2
