"""The encoder against the tokenizers library: random texts, windows of long ones, and a memory that forgets."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from mnemolake.llm import common, packing, token_counts, token_files
from tests.llm.test_exact import BYTE, WORD, rows_of

PARTS = ["a", "s", "t", "re", "ve", "ll", "m", "d", "'", "'", " ", " ", "\n", "\t", "\r", "1", "23", ".", ",", "é", "É", "×", "÷", "–", "…", "“", " ", "ß", "œ", "漢", "<|", "<|endoftext|>"]
PARTS += ["A", "S", "_", "-", "ñ", "\x01", "İ", "ª", "x" * 70, " " * 3, "e\N{COMBINING ACUTE ACCENT}", "\x7f", "Ǆ", "Σ", "the", " of"]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("size", [64, 1 << 20])
def test_random_texts(path, size, monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", size)
    rng, library = random.Random(size), Tokenizer.from_file(path)
    whole = {t.encode(): k for t, k in token_counts.prove_whole_tokens(path).items()}
    plain, proven = common.Encoder(path), common.Encoder(path, whole)
    plain.LIMIT = 40
    for turn in range(40):
        some = PARTS[: rng.choice([10, 20, len(PARTS)])]
        texts = ["".join(rng.choice(some) for _ in range(rng.choice([0, 3, 30, 400]))) for _ in range(60)]
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in plain.encode(texts)] == want, turn
        assert proven.count_bytes(*common.text_bytes(common.pa.array(texts))).tolist() == [len(x) for x in want]


def test_texts_longer_than_a_slice(spark, monkeypatch, tmp_path):
    rng, library = random.Random(3), {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
    words = ["don't", "été", "42", "the", "of", "…", "x\n\ny", "Straße", "--", "unbelievable"]
    texts = [" ".join(rng.choice(words) for _ in range(600_000)), "n" * 100_000, None, "short one"]
    assert len(texts[0]) > 2 * (1 << 20)
    monkeypatch.setattr(common, "SLICE_BYTES", 1 << 20)
    assert len(common.Encoder(BYTE).windows(np.frombuffer(texts[0].encode(), np.uint8))) > 1
    for p in (BYTE, WORD):
        assert [len(x) // 4 for x in common.Encoder(p).encode(texts)] == [len(library[p].encode(t or "", add_special_tokens=False).ids) for t in texts]
    # Clashing names of further columns change nothing.
    docs = spark.createDataFrame([(i, t, 1, 2, "p") for i, t in enumerate(texts)], "doc_id long, text string, length long, n_tokens long, part string")
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, WORD).collect()}
    assert counted == {i: len(library[WORD].encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    files = token_files.write_token_files(docs, WORD, str(tmp_path / "ids"))
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in token_files.read_token_files(spark, files).collect()} == counted
    packed = {}
    for d, n in rows_of(packing.pack(docs, BYTE), "doc_id", "length"):
        packed[d] = packed.get(d, 0) + n
    assert packed == {i: 1 + len(library[BYTE].encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
