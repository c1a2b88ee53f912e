"""Fingerprints: edited texts and order by hand, peeled differences against sets of digests, retries that grow."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from mnemolake.llm import common, fingerprints as fp

DOCS = "doc_id long, text string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) + rng.choice(["", "", "", ".", ".\n"]) for _ in range(n))


def digest_set(text):
    return set(fp.digests(np.frombuffer(text.encode(), np.uint8)).tolist())


def likeness_by_hand(a, b):
    a, b = digest_set(a), digest_set(b)
    size = lambda s: sum(x & 0xFFFF for x in s)
    return 1 - size(a ^ b) / (size(a) + size(b)) if a or b else 1.0


def versions_by_hand(docs):
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(likeness_by_hand(t, edited), 9), round(likeness_by_hand(t, following), 9)))
    return Counter(out)


def result(df):
    return Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect())


def test_paragraphs_cover_the_text_and_their_digests_are_distinct():
    rng = random.Random(2)
    for n in (0, 1, 5, 300):
        raw = np.frombuffer((words(rng, n) * 3).encode(), np.uint8)
        ends = fp.cuts(raw)
        assert (ends[-1:] == len(raw)).all() and (np.diff(ends) > 0).all()
        assert len(np.unique(fp.digests(raw))) == len(ends) and fp.weights(fp.digests(raw)).sum() == len(raw)
    assert fp.cuts(np.frombuffer(b"a" * 100, np.uint8)).tolist() == [100] and len(fp.cuts(np.frombuffer(words(rng, 2000).encode(), np.uint8))) > 300
    assert fp.weights(fp.digests(np.frombuffer(b"x" * 70_000, np.uint8))).tolist() == [65535]


def test_peeling_recovers_the_difference():
    rng = random.Random(3)
    text = words(rng, 900)
    parts = text.split(" ")
    for edits in (0, 1, 5, 20):
        other = parts[:]
        for _ in range(edits):
            other[rng.randrange(len(other))] = "changed"
        other = " ".join(other)
        a, b = fp.Texts([text.encode()]), fp.Texts([other.encode()])
        got = fp.compare(a.fingerprint(0), b.fingerprint(0))
        want = (sorted(digest_set(text) - digest_set(other)), sorted(digest_set(other) - digest_set(text)))
        assert got == want if edits <= 5 else got in (None, want)
    assert fp.compare(a.fingerprint(0), fp.Texts([words(rng, 900).encode()]).fingerprint(0)) is None


def test_sketches_fold_and_subtract():
    rng = random.Random(4)
    t = fp.Texts([words(rng, 400).encode(), words(rng, 30).encode(), b""])
    large, begin = t.some(np.array([0]), np.array([1024]))
    small, _ = t.some(np.array([0]), np.array([64]))
    assert all((x == y).all() for x, y in zip(large.fold(64), small, strict=True)) and begin.tolist() == [0, 1024]
    assert not any(x.any() for x in t.sketch(0) - t.sketch(0)) and len(t.sketch(2).n) == fp.LEAST_CELLS
    cells, n, size = fp.read(t.fingerprint(1))
    assert all((x == y).all() for x, y in zip(cells, t.sketch(1), strict=True)) and (n, size) == (t.n[1], t.size[1])


def test_failed_pairs_are_tried_again_larger():
    rng = random.Random(5)
    texts = [words(rng, n) for n in (5, 50, 500, 5000)]
    a, b = fp.Texts([t.encode() for t in texts]), fp.Texts([t.encode() for t in texts[::-1]])
    rows = np.arange(4)
    key, of, sign, used = fp.differences(a, rows, b, rows)
    for k in range(4):
        assert set(key[(of == k) & (sign > 0)].tolist()) == digest_set(texts[k]) - digest_set(texts[3 - k])
        assert set(key[(of == k) & (sign < 0)].tolist()) == digest_set(texts[3 - k]) - digest_set(texts[k])
    assert (used > np.minimum(fp.cells_for(a.n), fp.cells_for(b.n))).all()


@pytest.mark.parametrize("size", [64, common.SLICE_BYTES])
@pytest.mark.parametrize("n", [1, 2, 3, 200])
def test_versions_by_hand(spark, n, size, monkeypatch):
    monkeypatch.setattr(fp, "SLICE_BYTES", size)
    rng = random.Random(n)
    docs = [(i * 37 % 1009, words(rng, rng.choice([0, 1, 4, 90]))) for i in range(n)]
    if n == 200:
        docs += [(2000, None), (None, "no id\nat all"), (None, ""), (2001, "漢" * 9), (docs[7][0], docs[7][1]), (docs[9][0], "another text"), (3000, "x y " * 60_000), (3001, docs[0][1]), (3002, docs[0][1])]
    df = spark.createDataFrame([(*d, 5, "p", True) for d in docs], f"{DOCS}, n_chars int, part string, halo boolean")
    out = fp.edited_versions(df)
    assert result(out) == versions_by_hand(docs)
    texts = {}
    for r in out.collect():
        texts.setdefault(r["edited_sha256"], set()).add(r["edited_fingerprint"])
    assert all(len(x) == 1 for x in texts.values())
    own = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(df).collect()}
    if n == 200:
        assert own[3001] == own[3002] == own[docs[0][0]] and own[3000] != own[3001]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert fp.edited_versions(empty).count() == 0 and fp.fingerprints(empty).count() == 0 and fp.version_differences(empty, empty).count() == 0


def test_version_differences(spark):
    rng = random.Random(8)
    old = [(i, words(rng, 60)) for i in range(20)] + [(None, "x"), (50, None), (51, "same. text")]
    new = [(i, t if i == 3 else " ".join(t.split(" ")[5:])) for i, t in old[:20]] + [(None, "x"), (50, "now. text"), (51, "same. text"), (51, "same. other")]
    got = fp.version_differences(spark.createDataFrame(old, DOCS), spark.createDataFrame([(*r, 0.5) for r in new], f"{DOCS}, likeness double")).collect()
    signed = lambda s: sorted(np.array(sorted(s), np.uint64).astype(np.int64).tolist())
    want = [(i, signed(digest_set(a or "") - digest_set(b or "")), signed(digest_set(b or "") - digest_set(a or ""))) for i, a in old for j, b in new if i == j and i is not None]
    assert sorted((r["doc_id"], r["removed"], r["added"]) for r in got) == sorted(want)
    assert {r["doc_id"] for r in got if r["likeness"] == 1} == {3, 51}


def test_query_on_the_small_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = fp.op12_fingerprints(spark, sf)
    assert result(rows) == versions_by_hand(docs)
    long = [r for r in rows.collect() if r["n_chars"] > 1000]
    assert sum(r["near_edited"] > 0.3 for r in long) > 0.95 * len(long)
