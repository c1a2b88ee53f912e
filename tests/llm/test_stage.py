"""Near dedup at a threshold of its own, and repeated rows."""

import random

import numpy as np

from mnemolake.llm import near_dedup, topk
from tests.llm.test_exact import TOKEN, lower, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by_hand(docs, num, den):
    sets = []
    for _, t in docs:
        w = TOKEN.findall(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    low = {d: d for d, _ in docs}
    again = True
    while again:
        again = False
        for i in range(len(docs)):
            for j in range(i):
                a, b = docs[i][0], docs[j][0]
                if low[a] != low[b] and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    low[a] = low[b] = min(low[a], low[b])
                    again = True
    return {d for d, x in low.items() if d == x}


def test_stage_joins_from_four_fifths(spark):
    rng, texts = random.Random(4), []
    for _ in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for cut in (0, 8, 14, 17, 19, 21, 23, 27):  # similarity falls with what is replaced at the end
            texts.append(" ".join(base[: 200 - cut] + [f"w{rng.randrange(10**6)}" for _ in range(cut)]))
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], DOCS)
    wanted = kept_by_hand(docs, 80, 100)
    assert wanted != kept_by_hand(docs, 85, 100)
    assert {r["doc_id"] for r in near_dedup.keep_one_of_each(df, **near_dedup.FOUR_FIFTHS).collect()} == wanted


def test_of_repeated_rows_one_stays(spark):
    rows = [(1, "b c d e f g", "en", "s", 1)] * 3 + [(2, "x", "en", "s", 1), (2, "u v", "fr", "s", 3), (2, None, "fr", "s", 3), (None, "k", "en", "s", 1), (None, "k", "en", "s", 1)]
    got = near_dedup.keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[0], rows[4], *rows[6:]]))


def test_groups_stay_small_whatever_a_cell_holds(spark):
    """turn_rows bounds what one group of a task holds; the result doesn't depend on it."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(600, 4)))], "vec_id long, embedding array<float>")
    v = topk.quantised(df)
    q = v.where("vec_id % 50 = 0")
    assert rows_of(topk.top_k(v, q, turn_rows=20), "query_id", "rank", "vec_id", "score") == rows_of(topk.top_k(v, q), "query_id", "rank", "vec_id", "score")
