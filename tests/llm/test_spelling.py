"""Spelling variants against brute force: every pair of words compared by definition."""

import random
import re
import zlib

import numpy as np
import pytest

from mnemolake.llm import spelling

RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def words_by_hand(docs, least=3, shortest=5):
    counts = {}
    for i, t in docs:
        for w in RUNS.findall(t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            if i is not None:
                h = zlib.crc32(f"{i}:{w}".encode())
                if h % 97 == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= shortest:
                counts[w] = counts.get(w, 0) + 1
    return {w: n for w, n in counts.items() if n >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(counts):
    form = {}
    for w, n in counts.items():
        close = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form[w] = (len(close), close[0][1] if close and -close[0][0] >= 2 * n else None)
    out = set()
    for w, n in counts.items():
        root = w
        while form[root][1] is not None:
            root = form[root][1]
        out.add((w, form[w][1], root, n, form[w][0], counts.get(form[w][1])))
    return out


def some_docs(seed=1, n=300):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcéÀs") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["x" * 40, "y" * 50 + "z" * 20, "aaaaa", "aaaaaa"]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.choice([0, 5, 60])):
            w = base[min(int(rng.expovariate(0.08)), len(base) - 1)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abcÀ") + w[k + 1 :]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w]))
        docs.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    return [*docs, (1000, None), (1001, ""), (None, "hello hello hello hallo"), (5, docs[5][1]), (1002, "hello " * 30_000)]


def result(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("most", [spelling.FILTER_BYTES, 128])
def test_variants_by_definition(spark, most):
    docs = some_docs()
    df = spark.createDataFrame([(*d, 1, "q", 2) for d in docs], "doc_id long, text string, n long, word string, run int")
    words = spelling.count_words(df)
    want = words_by_hand(docs)
    assert {(r["word"], r["n"]) for r in words.collect()} == set(want.items()) and len(want) > 100
    found = result(spelling.group_variants(words, most=most))
    assert found == variants_by_hand(want)


def test_long_chains_and_ties(spark):
    counts = {"aaaaaaa": 1 << 12, **{"aaaaaaa"[:k] + "b" * (7 - k): 1 << (k + 4) for k in range(7)}, "mmmmmx": 9, "mmmmmy": 9, "mmmmm": 2, "é" * 5: 4, "é" * 6: 8}
    assert result(spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == variants_by_hand(counts)
    assert ("bbbbbbb", "abbbbbb", "aaaaaaa", 16, 1, 32) in variants_by_hand(counts)


def test_rounds_stay_in_their_bound():
    shards, rounds = spelling.plan_rounds({5: 1000, 6: 100_000, 7: 10, 33: 300}, most=4096)
    assert sorted(x for r in rounds for x in r) == [(s, p) for s, (parts, _) in sorted(shards.items()) for p in range(parts)]
    assert all(sum(shards[s][1] * 64 for s, _ in r) <= 4096 for r in rounds) and len(rounds) > 40


def test_filters_have_few_false_positives_and_no_false_negatives(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(20_000)})
    shards, _ = spelling.plan_rounds({8: len(words)})
    built = spelling.build_filters(spark.createDataFrame([(w,) for w in words], "word string"), shards).collect()
    bits = np.zeros(shards[8][1] * 64, np.uint8)
    for r in built:
        at = r["segment"] * spelling.SEGMENT * 64
        bits[at : at + spelling.SEGMENT * 64] = np.frombuffer(r["bits"], np.uint8)[: len(bits) - at]
    alphabet = np.array([ord(c) for c in "abcdefghij"], np.uint64)
    got, known = list(spelling.edits(words[:2000], {(8, 0): bits}, shards, alphabet)), set(words)
    true = {(r, e) for r, e in got if e in known}
    want = {(r, w[:i] + c + w[i + 1 :]) for r, w in enumerate(words[:2000]) for i in range(8) for c in "abcdefghij" if c > w[i] and w[:i] + c + w[i + 1 :] in known}
    assert true == want and len(got) - len(true) < 0.005 * 2000 * 8 * 4.5


def test_empty_table_and_one_word(spark):
    assert spelling.group_variants(spelling.count_words(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    assert result(spelling.group_variants(spark.createDataFrame([("alone", 4)], "word string, n long"))) == {("alone", None, "alone", 4, 0, None)}


def test_query_on_the_small_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(spelling.op11_spelling_variants(spark, sf)) == variants_by_hand(words_by_hand(docs))
