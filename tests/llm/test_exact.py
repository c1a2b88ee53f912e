"""Operators against brute force on small tables with nulls, ties, repeated rows, empty and long texts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemolake.llm import decontamination, near_dedup, packing, suffix_dedup, token_files, topk
from mnemolake.llm.common import Encoder
from mnemolake.llm.token_counts import count_tokens, prove_whole_tokens

DOCS = "doc_id long, text string"
BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = ["", "a  b", " x", "x ", "a\tb", "<|endoftext|> hi", "don't", "a\n\nb", "ünï 漢字 ok", "İstanbul ΣΑΣ x", "é a", "a b", "1234 5", "'s 's", " \n ", "a \nb", "\n", "A\x01b \x01", "x" * 5000]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# -- repeated strings ------------------------------------------------------------------------------------------------


def repeated_by_hand(docs, length=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            k = first.get(b[p : p + length])
            if i is not None and (k is None or i < k):
                first[b[p : p + length]] = i
    out = []
    for i, t in docs:
        b = (t or "").encode()
        cov = bytearray(len(b))
        for p in range(len(b) - length + 1):
            k = first.get(b[p : p + length])
            if k is not None and (i is None or k < i):
                cov[p : p + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cov, strict=True) if not c)
        out.append((i, len(b), sum(1 for j in range(len(b)) if cov[j] and (j == 0 or not cov[j - 1])), kept))
    return sorted(out, key=str)


def test_repeated_strings(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé ") for _ in range(400)) for _ in range(6)]
    docs = []
    for i in range(120):
        b, a = rng.choice(base), rng.randint(0, 300)
        docs.append((i * 7 % 113, b[a : a + rng.randint(30, 200)] + rng.choice(["", "x" * rng.randint(40, 130), rng.choice(base)[:80]])))
    docs += [(500, None), (None, base[0]), (501, ""), (7, docs[3][1]), (None, "z" * 80), (3, "z" * 80), (1000, "q" * 200), (999, "q" * 120), (2000, base[1] * 40)]
    got = suffix_dedup.repeated_strings(spark.createDataFrame(docs, DOCS)).select("doc_id", "n_bytes", F.size("spans").alias("n"), "kept")
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got.collect()), key=str) == repeated_by_hand(docs)


def test_repeated_strings_of_empty_table(spark):
    assert suffix_dedup.repeated_strings(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_suffix_buckets_and_cover(most):
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(97, 99, 1500).astype(np.uint8)] * 3 + [np.full(300, 97, np.uint8), np.zeros(90, np.uint8)])
    at = np.arange(len(text) - 140)
    got, raw, seen = suffix_dedup.equal_strings(text, at, 50, most), text.tobytes(), {}
    want = [seen.setdefault(raw[p : p + 50], len(seen)) for p in at]
    assert len(set(zip(got.tolist(), want, strict=True))) == len(seen) == len(set(got.tolist()))


def test_cover_has_every_difference():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


# -- top-k -----------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.1) + (i % 3) for _ in range(8)]) for i in range(500)]
    rows += [(50, [0.1] * 8), (50, [0.1] * 8), (None, [1.0] * 8), (900, None), (950, [None] * 8), (951, [float("nan")] * 8), (952, [float("inf")] * 8), (1000, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in map(tuple, df.collect()) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, q) in enumerate(kept):
        if i is not None and i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v)), 10**18 if j is None else j) for e, (j, v) in enumerate(kept) if e != a)[:5]  # noqa: B905
            want += [(i, r + 1, None if j == 10**18 else j, -s) for r, (s, j) in enumerate(best)]
    v = topk.quantised(df)
    assert rows_of(topk.top_k(v, v.where("vec_id % 50 = 0")), "query_id", "rank", "vec_id", "score") == sorted(want, key=str)


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    v = topk.quantised(df)
    assert rows_of(topk.top_k(v, v.where("vec_id = 0")), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 256 * 256)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
    assert topk.top_k(v, v.limit(0)).count() == 0


def test_top_k_of_empty_vectors_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<float>"
    v = topk.quantised(spark.createDataFrame([(i, []) for i in (0, 1, 2)], schema))
    assert rows_of(topk.top_k(v, v.where("vec_id = 0")), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 0), (0, 2, 2, 0)]
    v = topk.quantised(spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, []), (2, [-1.0])], schema))
    got = rows_of(topk.top_k(v, v.where("vec_id = 0")), "query_id", "rank", "vec_id", "score")
    assert got == sorted([(0, 1, 0, 65536), (0, 2, 1, 0), (0, 3, 2, -65536)] * 2)


def test_top_k_beyond_64_bits(spark):
    v = topk.quantised(spark.createDataFrame([(0, [1e19]), (1, [1.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(v, v)


# -- decontamination -------------------------------------------------------------------------------------------------

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contaminated_by_hand(docs, items):
    windows = {}
    for i, t in items:
        w = WORDS.findall(lower(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i or "")
    out = []
    for d, t in docs:
        w = WORDS.findall(lower(t))
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if who := windows.get(tuple(w[k : k + n])):
                    found |= who
                    hit[k : k + n] = [1] * n
        out.append((d, len(w), sum(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination(spark, block):
    rng = random.Random(5)
    v = ["the", "a", "é1", "xy", "zz", "Q9"]
    items = [(str(i), " ".join(rng.choice(v) for _ in range(rng.choice([3, 14, 20, 40])))) for i in range(12)] + [("100", ""), ("101", None), (None, "zz zz zz zz zz")]
    docs = []
    for i in range(150):
        words = [rng.choice([*v, "no"]) for _ in range(rng.randint(0, 60))] + ([rng.choice(items)[1] or ""] if i % 3 == 0 else [])
        docs.append((i, rng.choice([".", "-", " "]).join(words)))
    docs += [(None, "the a"), (5, None), (6, ""), (7, items[2][1])]
    found = decontamination.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id string, text string"), block_bytes=block)
    got = sorted(((r[0], r["found"]["n_words"], r["found"]["n_hit"], sorted(r["found"]["items"])) for r in found.collect()), key=str)
    assert got == contaminated_by_hand(docs, items)


def test_decontamination_spans_and_clashing_columns(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Before, {passage.upper()}; after é", 9), (2, "clean text", 9), (3, None, None)], "doc_id long, text string, found int")
    bench = spark.createDataFrame([("7", passage)], "item_id string, text string")
    cut = {r["doc_id"]: r for r in decontamination.cut_spans(docs, bench).collect()}
    assert cut[1]["text"] == "Before, ; after é" and cut[2]["text"] == "clean text" and cut[3]["text"] is None and cut[1]["found"] == 9
    assert rows_of(decontamination.drop_contaminated(docs, bench), "doc_id", "found") == [(2, 9), (3, None)]
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == 3


# -- near-duplicates -------------------------------------------------------------------------------------------------

TOKEN = re.compile("[^\x20\x09-\x0d]+")


def components_by_hand(docs, percent=85):
    sets = []
    for _, t in docs:
        w = TOKEN.findall(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is not None and docs[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    best = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            best[top(i)] = min(best.get(top(i), d), d)
    return sorted(((d, len(sets[i]), best[top(i)] if d is not None else None, d is None or d == best[top(i)]) for i, (d, _) in enumerate(docs)), key=str)


def test_near_duplicates(spark):
    rng = random.Random(7)
    vocabulary, docs = [f"w{i}É" for i in range(300)], []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 40, 200, 400]))]
        for _ in range(rng.choice([1, 2, 12, 30])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3]) * max(1, len(t) // 200)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            docs.append((len(docs) * 7 % 997, rng.choice([" ", "\n", "\t"]).join(t)))
    docs += [(None, docs[0][1]), (2000, None), (2001, " "), (2002, "A b"), (2003, "a B"), (2004, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == components_by_hand(docs)


def test_near_duplicates_whose_hub_fails(spark):
    """A bucket's smallest node is near few others, so links must come from the blocks."""
    rng = random.Random(11)
    base = [f"t{i}" for i in range(120)]
    docs = []
    for i in range(40):
        t = list(base)
        for k in range(3 if i % 2 else 4):
            t[(17 * i + 29 * k) % 120] = f"x{rng.random()}"
        docs.append((i, " ".join(t)))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == components_by_hand(docs)


def test_near_duplicates_of_empty_table_and_stage(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (2, "A b c d e f", 2), (3, None, 3), (None, "a b c d e f", 4)], "doc_id long, text string, n int")
    assert rows_of(near_dedup.keep_one_of_each(docs), "doc_id", "n") == [(1, 1), (3, 3), (None, 4)]


def test_thresholds_of_the_posterior():
    steps = near_dedup.fewest_matches(120, 0.85, 1e-6)
    assert [n for n, _ in steps] == [24, 48, 72, 96, 120]
    for n, least in steps:  # a pair of just the threshold is lost with a chance far under one in a thousand
        lost = sum(math.comb(n, m) * 0.85**m * 0.15 ** (n - m) for m in range(least))
        assert lost < 1e-4


# -- tokens ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_the_library(spark, sf, path):
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD
    library = Tokenizer.from_file(path)
    want = [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = Encoder(path)
    assert encoder.encode(texts) == want
    encoder.LIMIT = 10  # beyond it nothing more is kept
    encoder.first, encoder.spaced = {}, {}
    assert encoder.encode(texts) == want


def test_token_counts(spark):
    library = Tokenizer.from_file(WORD)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "the cat"), (0, None)]
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 3) for i, t in docs), key=str)
    assert rows_of(count_tokens(spark.createDataFrame(docs, DOCS), WORD, limit=3), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert count_tokens(spark.createDataFrame([], DOCS), WORD).count() == 0


def test_proven_tokens_are_single():
    library, proven = Tokenizer.from_file(WORD), prove_whole_tokens(WORD)
    some = sorted(proven)[::400]
    assert len(proven) > 20_000 and all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in some)


def test_packing(spark):
    library = Tokenizer.from_file(BYTE)
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["alpha", "be", "gamma ray", "δ"]) for _ in range(rng.choice([0, 3, 50, 700, 2500])))) for i in range(60)] + [(None, "x"), (3, None), (61, "x " * 6000)]
    rows = packing.pack(spark.createDataFrame(docs, DOCS), BYTE).collect()
    ids = {}
    for i, t in docs:
        x = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(x), 2048):
            ids.setdefault((i, s, len(x), zlib.crc32(np.array(x[s : s + 2048], "<u4").tobytes()), len(x[s : s + 2048])), []).append(1)
    assert sorted(((r["doc_id"], r["start"], r["doc_tokens"], r["ids_crc32"], r["length"]) for r in rows), key=str) == sorted((k for k, v in ids.items() for _ in v), key=str)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], DOCS), BYTE).count() == 0


def test_shortest_pack_first_places_all():
    rng = np.random.default_rng(4)
    histogram = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 101), 40, replace=False), rng.integers(1, 1000, 40), strict=True)}
    patterns = packing.shortest_pack_first(histogram, 100)
    placed = {}
    for count, lengths in patterns:
        assert sum(lengths) <= 100
        for n in lengths:
            placed[n] = placed.get(n, 0) + count
    assert placed == histogram
    assert packing.shortest_pack_first({}, 100) == []


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_planes_round_trip(unit, tmp_path):
    rng = np.random.default_rng(0)
    docs = [(1, rng.integers(0, 49408, 5000)), (None, np.zeros(0, int)), (2, np.array([2**32 - 1, 0, 7])), (3, np.zeros(0, int)), (4, rng.integers(0, 9, 100))]
    path = tmp_path / "x.ids"
    with path.open("wb") as f:
        w = token_files.Writer(f, unit, block=512)
        for d, ids in docs:
            w.add(d, ids.astype("<u4").tobytes())
        assert w.close() == sum(len(i) for _, i in docs)
    with path.open("rb") as f:
        got = [(d, np.concatenate([*p, np.zeros(0, "<u4")]).tolist()) for d, p in token_files.read_file(f)]
    assert got == [(d, i.tolist()) for d, i in docs]


def test_token_files(spark, tmp_path):
    library = Tokenizer.from_file(WORD)
    docs = [(i * 13 % 101, t) for i, t in enumerate([*ODD, *["a b c"] * 50])] + [(None, "first"), (1000, None)]
    files = token_files.write_token_files(spark.createDataFrame(docs, DOCS), WORD, str(tmp_path))
    got = sorted(token_files.read_token_files(spark, files).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted(((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t in docs for x in [[*library.encode(t or "", add_special_tokens=False).ids, 2]]), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == want
    assert token_files.read_token_files(spark, token_files.write_token_files(spark.createDataFrame([], DOCS), WORD, str(tmp_path / "none"))).count() == 0


def test_digests_of_the_query(spark, sf):
    from mnemolake.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op1_suffix_dedup"](spark, sf).collect():
        if not r["n_removed"]:
            assert r["kept_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest() and r["n_bytes"] == len((docs[r["doc_id"]] or "").encode())
