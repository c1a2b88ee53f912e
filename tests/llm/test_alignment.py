"""Token alignment and pair counts by definition, the perfect hash, trees and rounds."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from mnemolake.llm import alignment as al, common
from mnemolake.llm.token_counts import _byte_of_character

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY, PIECES = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
LIBRARY.encode_special_tokens = True
BYTE, ADDED = _byte_of_character(), LIBRARY.get_vocab_size()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def groups_of(text):
    """[(A ids, B ids)] of each group; none where the bytes differ."""
    if not text:
        return []
    a, b = LIBRARY.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    bytes_a = [b"".join(BYTE[ord(c)] for c in LIBRARY.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(PIECES.id_to_piece, b)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    out, i, j, x, y = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            x, i = x + len(bytes_a[i]), i + 1
            out[-1][0].append(a[i - 1])
        else:
            y, j = y + len(bytes_b[j]), j + 1
            out[-1][1].append(b[j - 1])
        if x == y:
            out.append(([], []))
    return out[:-1]


def by_hand(docs):
    each = [groups_of(t) for _, t in docs]
    count = defaultdict(int)
    for groups in each:
        for pair in {(a, b) for ga, gb in groups for a in ga for b in gb}:
            count[pair] += 1
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (i, _), groups in zip(docs, each, strict=True):
        found = [(a, b) for ga, gb in groups for a in ga for b in gb]
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(found), sum(count[p] == most[p[0]] for p in found), sum(count[p] for p in found), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


ODD = ["", None, " ", "  ", "a", " a ", "a  b   c", "a\n\nb\t c ", "▁", "a ▁b", "x▁ y", "<s> hi </s> <|endoftext|> <unk>", "漢字 テスト", "🙂🙂 ok", "é é ﬁ ½", "\x00 \x01", "don't 1234 5,6", " " * 40 + "x", "x" * 3000, "=" * 700, "İstanbul ΣΑΣ", "한국어 " * 30, "​ a　b", "<0x41> A"]


def some_docs(seed, n):
    rng = random.Random(seed)
    parts = ["the", "of", "Straße", "été", "tokenization", "  ", "\n", "42", "don't", "—", "…", "漢字", "unbelievable", "(x)", "http://a.b/c?d=1", "🙂", "<|endoftext|>", "naïveté", "\t\t"]
    return [(i, " ".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 60])))) for i in range(n)]


@pytest.mark.parametrize("size", [64, al.UNIT_BYTES])
def test_alignment_by_definition(spark, size, monkeypatch):
    monkeypatch.setattr(al, "UNIT_BYTES", size)
    monkeypatch.setattr(al, "SMALL", 3 if size == 64 else 256)
    docs = [*some_docs(1, 200), *[(1000 + k, t) for k, t in enumerate(ODD)], (None, "no id here"), (5, "twice the same"), (5, "twice the same")]
    df = spark.createDataFrame([(*d, 1, "k", "s") for d in docs], "doc_id long, text string, n_a int, keys string, shard string")
    assert result(al.align_documents(df, A, B)) == by_hand(docs)


def test_tasks_that_write_early_trees_of_many_levels_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(al, "HELD_PAIRS", 40)
    monkeypatch.setattr(al, "UNIT_BYTES", 200)
    monkeypatch.setattr(al, "FAN_IN", 2)
    docs = [*some_docs(2, 120), (3, "repeated rows"), (3, "repeated rows"), (4, None), (None, None), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = by_hand(docs)
    assert result(al.align_documents(df, A, B)) == want
    assert result(al.align_documents(df, A, B, most=14 * 200)) == want


def test_long_texts_in_windows(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(0, " ".join(rng.choice(["alpha", "beta", "x  y", "Straße", "\n\nz", "12"]) for _ in range(4000))), (1, "alpha beta " * 900 + "▁"), (2, "short alpha"), (3, "n" * 3000)]
    want = by_hand(docs)
    monkeypatch.setattr(common, "SLICE_BYTES", 1500)
    aligner = al.Aligner(A, B)
    assert len({k for _, _, k, *_ in aligner.units(*al.spaced(common.pa.array([docs[0][1]])))}) > 3
    assert result(al.align_documents(spark.createDataFrame(docs, "doc_id long, text string"), A, B)) == want


def test_empty_tables(spark):
    assert al.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    docs = [(1, None), (2, "")]
    assert result(al.align_documents(spark.createDataFrame(docs, "doc_id long, text string"), A, B)) == by_hand(docs)


@pytest.mark.parametrize("n", [1, 2, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 32, 2 * n, dtype=np.uint64).astype(np.uint32))
    keys, others = keys[::2], keys[1::2]
    shard = al.shard_of(keys)
    made = al.PerfectHash({s: al.hash_levels(keys[shard == s]) for s in set(shard.tolist())})
    slots = made.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys))) and made.n == len(keys)
    for s in set(shard.tolist()):
        assert sorted((slots[shard == s] - made.first[s]).tolist()) == list(range(int((shard == s).sum())))
    bits = 64 * len(made.words)
    assert n < 50_000 or bits < 4.8 * len(keys)
    stored = np.empty(len(keys), np.uint32)
    stored[slots] = keys
    counts = al.Counts(made, stored, np.arange(len(keys)) + 1, al.highest(stored, np.arange(len(keys)) + 1))
    assert not counts.look_up(others)[0].any() and (counts.look_up(keys)[0] == slots + 1).all()
    memo, both = al.Memo(counts), np.concatenate([keys, others, np.zeros(1, np.uint32)])
    for some in (both[::3], np.repeat(both, 2), both[::-1]):
        assert all((x == y).all() for x, y in zip(memo.look_up(some), counts.look_up(some), strict=True))


def test_rounds_hold_their_bound():
    rounds = al.rounds_of({s: 100 * s for s in range(20)}, 14 * 2000)
    assert sorted(s for r in rounds for s in r) == list(range(20)) and all(sum(100 * s for s in r) <= 2000 for r in rounds)
    assert al.rounds_of({1: 10, 2: 10}, 5) == [[1], [2]]


def test_query_on_the_small_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(al.op13_alignment(spark, sf)) == by_hand(docs)
