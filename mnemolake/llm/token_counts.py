"""Token counts by the whole-token shortcut.

Offline, on the driver, every vocabulary string is encoded alone; those that give exactly one token are proven whole and
broadcast, bounded by the vocabulary. Counting then splits texts into pre-tokens, counts a proven one as 1 and merges
only the rest.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mnemolake.llm.common import SLICE_BYTES, Encoder, slices, table, text_bytes, tidy

LIMIT_TOKENS = 2048


def _byte_of_character() -> dict[int, bytes]:
    """The byte that each character of a byte-level vocabulary stands for: itself where it prints in Latin-1, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    return {**{b: bytes([b]) for b in shown}, **{256 + k: bytes([b]) for k, b in enumerate(hidden)}}


@cache
def prove_whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings that the library encodes alone as one token, each with that token's id.

    A string that ends no word, isn't text, or doesn't stay as it is (upper case where the tokenizer lower-cases) isn't proven.
    """
    encoder, byte = Encoder(path), _byte_of_character()
    vocabulary = encoder.library.get_vocab(with_added_tokens=False)
    if encoder.kind == "words":
        vocabulary = {t.removesuffix("</w>"): k for t, k in vocabulary.items() if t.endswith("</w>")}
    tried = {}
    for t, k in vocabulary.items():
        raw = b"".join(byte.get(ord(c), b"\xff") for c in t)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if text.strip() and text.replace(" ", "").isprintable() and not (encoder.lowers and text != text.lower()):
            tried[text] = k
    n, ids = encoder.each([t.encode() for t in tried])
    first = np.cumsum(n) - n
    return {t: k for (t, k), m, at in zip(tried.items(), n.tolist(), first.tolist(), strict=True) if m == 1 and ids[at] == k}


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_TOKENS) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. No shuffle.

    Null and empty texts count 0 bytes and 0 tokens; repeated rows are counted each; other columns are not read;
    an empty table gives an empty result; a very long text is counted window by window.
    """
    proven = df.sparkSession.sparkContext.broadcast({t.encode(): k for t, k in prove_whole_tokens(path).items()})

    def run(batches):
        encoder = Encoder.of(path, proven.value)
        for b in batches:
            raw, offsets = text_bytes(b.column(1))
            sizes = np.diff(offsets)
            for i, j in slices(b, sizes, SLICE_BYTES):
                n = encoder.count_bytes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sizes[i:j], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
