"""Findings of round 4: rows as before, of work that follows the input."""

import hashlib
import math
import time
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from mnemolake.operators import ingest, parity, similarity
from mnemolake.plans import registry
from mnemolake.sources import files


def test_trigram_weights_of_long_texts(spark):
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("abcdefgh é\U0001f600Ω"), 600_000))
    rows = [("1", long), ("2", "ABc\x00\x00a"), ("3", "ab"), ("4", ""), ("5", None), ("6", "abab"), ("6", "bab"), (None, "abc")]

    def buckets(text):
        t = (text or "").lower()
        grams = [t[k : k + 3] for k in range(len(t) - 2)] if len(t) > 2 else list(t)
        return Counter(int(hashlib.md5(g.encode()).hexdigest()[:7], 16) % 384 for g in grams)

    held = {}
    for i, t in rows:
        if i:
            held[i] = held.get(i, Counter()) + buckets(t)
    wanted = {(i, b): k / math.sqrt(sum(x * x for x in c.values())) for i, c in held.items() for b, k in c.items()}
    began = time.time()
    got = {(r["id"], r["bucket"]): r["weight"] for r in ingest.trigram_weights(spark.createDataFrame(rows, "id string, content string").repartition(2)).collect()}
    assert time.time() - began < 60  # the square of a text's length took minutes
    assert got.keys() == wanted.keys() and all(math.isclose(got[k], wanted[k], rel_tol=1e-12) for k in wanted)


def test_markdown_gives_back_texts_that_look_like_markup(spark):
    contents = ["plain [[x]]", "### title", "## wing", "#", "", "  ", "\n\n", "\n## a\n### b [[", "\\N", "\\", "\\# [[", "\\n\\b", "★★", None, "\t", "a\r\n\n b"]
    rows = [(str(k), c, "en", 1.0 + k % 3) for k, c in enumerate(contents)]
    rows += [(None, "no name", "en", 2.0), (None, "nor here", None, 2.0), ("a\\n\nb\\", "odd name", "\\N", 2.0), ("\\N", "odd", "w\nv", 2.0), ("", "[[", "", 0.0), ("x", "no stars", "en", None), ("x", None, "en", 0.0), ("x", "", "en", None)]
    m = spark.createDataFrame(rows, "id string, content string, wing string, importance double").withColumn("tags", F.array(F.lit("t")))
    con = duckdb.connect()
    con.execute("CREATE TABLE memory (id VARCHAR, content VARCHAR, wing VARCHAR, importance DOUBLE)")
    con.executemany("INSERT INTO memory VALUES (?, ?, ?, ?)", rows)
    sql = registry.ORACLES["a4_markdown_round_trip"]
    wanted = Counter(con.execute(sql[sql.rindex("SELECT id, wing, len(") :]).fetchall())
    for records in (2, 100):
        assert Counter(map(tuple, files.markdown_round_trip(m, records).collect())) == wanted


def brute(sets, th, gap=None):
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    ids = sorted(first.values())
    near = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in ids for b in ids if a < b and (gap is None or abs(len(sets[a]) - len(sets[b])) <= gap)]
    return {(a, b): s for a, b, s in near if s >= th - 1e-12}


def test_sets_meet_by_parities_in_many_sides(spark, monkeypatch):
    monkeypatch.setattr(parity, "LEAST_SIDE", 8)
    monkeypatch.setattr(parity, "SIDES", 5)
    monkeypatch.setattr(parity, "ROWS", 3)
    monkeypatch.setattr(parity, "COLS", 7)
    monkeypatch.setattr(parity, "AGAIN_WORDS", 16)
    rng, sets = np.random.default_rng(7), {}
    for k in range(160):
        base = set(rng.choice(5000, int(rng.choice([1, 2, 5, 30, 90, 400, 1300])), replace=False).tolist())
        sets[f"{k:03d}"] = base
        if k % 2:
            sets[f"{k:03d}x"] = set(sorted(base)[: max(1, len(base) - len(base) // 9)]) | set(rng.choice(9000, len(base) // 40, replace=False).tolist())
        if k % 10 == 0:
            sets[f"{k:03d}c"] = set(base)
    rows = [(i, [f"m{x}" for x in s]) for i, s in sets.items()] + [("none", []), ("null", None)]
    df = spark.createDataFrame(rows, "id string, s array<string>")
    for th, gap in ((0.8, None), (0.85, None), (0.5, None), (0.3, 3), (0.8, 40)):
        got = {(r["a"], r["b"]): r["similarity"] for r in similarity.jaccard_pairs(df, F.col("s"), th, gap).collect()}
        wanted = brute(sets, th, gap)
        assert got.keys() == wanted.keys() and len(wanted) > 10 and all(math.isclose(got[k], wanted[k]) for k in wanted)


def test_sets_that_are_much_alike_are_not_listed_in_pairs(spark):
    rng = np.random.default_rng(8)
    # Texts of few syllables: every two share much, so that rare trigrams would make next to all of them candidates.
    texts = [" ".join("".join(rng.choice([c + v for c in "bdkmlstr" for v in "aei"], 3)) for _ in range(60)) for _ in range(400)]
    texts += [t[:-12] + "badobado" for t in texts[:40]]
    m = spark.createDataFrame([(f"{k:03d}", t) for k, t in enumerate(texts)], "id string, content string")
    sets = {f"{k:03d}": {t[j : j + 3] for j in range(len(t) - 2)} for k, t in enumerate(texts)}
    rows = parity.trigram_hashes(m, 0.85)
    left = parity.parity_pairs(parity.representatives(rows), 0.85).count()
    wanted = brute(sets, 0.85)
    got = {(r["a"], r["b"]): r["similarity"] for r in similarity.dup_char3(m).where("similarity < 1").collect()}
    assert {k for k, s in wanted.items() if s > 0.85} == got.keys()
    assert left < 0.1 * len(sets) * (len(sets) - 1) / 2


def test_texts_are_cut_to_words_once(spark, sf, monkeypatch):
    seen, inner = [], parity.hashed_sets
    whole = similarity.word_sets
    monkeypatch.setattr(similarity, "hashed_sets", lambda *x: seen.append("array") or inner(*x))
    monkeypatch.setattr(similarity, "word_sets", lambda df, pattern, th: seen.append("text") or whole(df, pattern, th))
    for name in ("e3_dup_jaccard", "e4_dup_words_greedy", "e7_group_duplicates", "e8_merge_duplicates"):
        registry.QUERIES[name](spark, sf)
    assert seen == ["text"] * 4


def test_words_of_texts_are_those_of_the_expressions(spark):
    from mnemolake.functions.columns import tokens, words

    texts = ["Ab a b_c 12 x9 中文 字 ÉCOLE été", "", None, "a", "\t\n one\x0btwo\x0c THREE\r", "İstanbul ΣΑΣ ẞ", "中 中 文文 a1中b2"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, content string")
    for pattern, column in ((parity.TOKENS, tokens("content")), (parity.WORDS, F.array_distinct(words("content")))):
        n = {r["id"]: r["n"] for r in parity.word_sets(df, pattern, 0.8).collect()}
        assert n == {r["id"]: r["n"] for r in df.select("id", F.size(column).alias("n")).where("n > 0").collect()} and n
