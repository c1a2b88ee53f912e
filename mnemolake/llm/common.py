"""Shared helpers of the training-data operators: shared storage, Arrow batching, tokenizer caching."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mnemolake.plans.storage import materialize, shared_dir

#: Text that is taken up at a time where Python works on it; what a worker holds beyond it is bounded by Encoder.LIMIT.
SLICE_BYTES = 4 << 20

__all__ = ["SLICE_BYTES", "Encoder", "give_back", "materialize", "shared_dir", "slices", "table", "text_bytes", "tidy", "width"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def give_back() -> None:
    """Return freed memory to the system: a worker lives on beside the stages that follow."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every platform has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """The same function of Arrow batches, which gives memory back when its partition ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def slices(table_: pa.Table | pa.RecordBatch, sizes: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about target bytes each (one row at least), so that working memory doesn't follow the batch size."""
    total, start = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > target:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of the texts, offsets); a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return raw[first:last], (offsets - first if len(offsets) else np.zeros(1, np.int64))


#: The split pattern of the "words" kind, a fixed value of such tokenizer files.
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Classes of bytes: white space, letters, digits, all else. Bytes from 0x80 on are parts of Latin letters unless told otherwise.
_GROUP = np.full(256, 3, np.uint8)
_GROUP[[9, 10, 13, 32]] = 0
_GROUP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_GROUP[48:58] = 2
# Bytes that send a text to the library: control characters, and lead bytes of all but the Latin letters below U+0280.
_ODD = np.zeros(256, bool)
_ODD[:32] = True
_ODD[[9, 10, 13]] = False
_ODD[[0x7F, *range(0xC0, 0xC3), *range(0xCA, 0x100)]] = True
_ODD[0xE2] = False  # dashes, quotation marks, bullets and dots are told by their other two bytes
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def _typographic(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the byte E2, whether a character from U+2010 to U+2026 begins there)."""
    at = np.flatnonzero(raw == 0xE2)
    at = at[at + 2 < len(raw)]
    return at, (raw[at + 1] == 0x80) & (raw[at + 2] >= 0x90) & (raw[at + 2] <= 0xA6)


def ragged(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[begin[k] : begin[k] + n[k]] of all k, one behind the other."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((begin - (ends - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return flat[at]


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, remembering those of pre-tokens.

    The pre-tokens of many texts are found at once from the classes of their bytes and numbered by an Arrow dictionary
    that goes on from the remembered ones; new ones are given to the library once each, and all ids are put in place by
    one gather. Texts whose bytes alone don't decide (control characters, special strings, scripts other than Latin)
    go to the library whole.

    whole: ids of pre-tokens that need no merging, proven beforehand.
    """

    LIMIT = 1 << 19  # remembered pre-tokens; beyond it those used last stay, half as many
    LIMIT_BYTES = 64 << 20  # and bytes of them
    _made: dict[tuple[str, bool], "Encoder"] = {}

    @classmethod
    def of(cls, path: str, whole: dict[bytes, int] | None = None) -> "Encoder":
        """The worker's own encoder, which it keeps for the tasks to come."""
        if (path, whole is None) not in cls._made:
            cls._made[path, whole is None] = cls(path, whole)
        return cls._made[path, whole is None]

    def __init__(self, path: str, whole: dict[bytes, int] | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path) as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        steps = pre.get("pretokenizers", [])
        self.kind = "other"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.kind = "spaced"
        elif steps and steps[0].get("behavior") == "Removed" and steps[0].get("pattern", {}).get("Regex") == WORDS_PATTERN:
            self.kind = "words"
        self.lowers = any(n.get("type") == "Lowercase" for n in [norm, *norm.get("normalizers", [])])
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.odd = _ODD.copy()
        if self.kind == "words":
            self.odd[0xC4:0xCA] = True  # their lower-case forms differ by more than one bit
        self.whole = whole or {}
        self.forget()
        self.mark = "\n" if self.kind == "spaced" else " \x01 "
        self.mark_ids = self.plain(self.mark.strip(" "))

    def plain(self, text: str) -> bytes:
        """Ids of a text straight from the library, as little-endian unsigned 32-bit numbers."""
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def forget(self, keep: np.ndarray | None = None) -> None:
        """Drop the remembered pre-tokens, but for some."""
        if keep is None:
            self.known, self.n, self.ids, self.used, self.turn = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, np.int32), 0
        else:
            self.ids = ragged(self.ids, (np.cumsum(self.n) - self.n)[keep], self.n[keep])
            self.known, self.n, self.used = self.known.take(pa.array(keep)), self.n[keep], self.used[keep]

    def each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each pre-token, all ids) from the library, many in one call: a mark that none holds tells them apart."""
        if self.kind == "words":
            pieces = [p.strip() for p in pieces]
        out: list[bytes | None] = [None] * len(pieces)
        rest = []
        for k, p in enumerate(pieces):
            if p in self.whole:
                out[k] = self.whole[p].to_bytes(4, "little")
            elif not p or p.isspace():
                out[k] = self.plain(p.decode()) if self.kind == "spaced" else b""
            else:
                rest.append(k)
        sizes, flat = [], []
        for i in range(0, len(rest), 2000):
            part = [pieces[k] for k in rest[i : i + 2000]]
            ids = np.frombuffer(self.plain(self.mark.encode().join(part).decode()), "<u4")
            cuts = np.flatnonzero(ids == np.frombuffer(self.mark_ids, "<u4")[0])
            if len(self.mark_ids) == 4 and len(cuts) == len(part) - 1:
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                flat.append(np.delete(ids, cuts))
            else:
                got = [self.plain(p.decode()) for p in part]
                sizes.append(np.array([len(g) // 4 for g in got]))
                flat.append(np.frombuffer(b"".join(got), "<u4"))
        if len(rest) == len(pieces):
            return (np.concatenate(sizes), np.concatenate(flat)) if rest else (np.zeros(0, np.int64), np.zeros(0, "<u4"))
        n = np.array([0 if o is None else len(o) // 4 for o in out], np.int64)
        own = np.frombuffer(b"".join([o for o in out if o]), "<u4")
        begin = np.cumsum(n) - n
        if rest:
            n[rest] = np.concatenate(sizes)
            begin[rest] = len(own) + np.cumsum(n[rest]) - n[rest]
        return n, ragged(np.concatenate([own, *flat]), begin, n)

    def number(self, pieces: pa.BinaryArray) -> np.ndarray:
        """The number of each pre-token in self.known, which takes in the new ones; n and ids go along."""
        if not len(pieces):
            return np.zeros(0, np.int32)
        if len(self.known) > self.LIMIT or self.known.nbytes > self.LIMIT_BYTES:
            self.forget(np.sort(np.argsort(-self.used, kind="stable")[: self.LIMIT // 2]) if self.known.nbytes <= self.LIMIT_BYTES else None)
        self.turn += 1
        old = len(self.known)
        coded = pa.chunked_array([self.known, pieces]).dictionary_encode().chunks[-1]  # an empty chunk may be left out
        number = coded.indices.to_numpy()
        if len(coded.dictionary) > old:
            self.known = coded.dictionary
            n, ids = self.each(self.known[old:].to_pylist())
            self.n, self.ids = np.concatenate([self.n, n]), np.concatenate([self.ids, ids])
            self.used = np.concatenate([self.used, np.zeros(len(n), np.int32)])
        self.used[number] = self.turn
        return number

    def regular(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text: do its bytes alone decide on its pre-tokens?"""
        if self.kind == "other":
            return np.zeros(len(offsets) - 1, bool)
        bad = np.concatenate([self.odd[raw], [False, False]])
        head = np.concatenate([raw, np.zeros(2, np.uint8)])
        bad[:-1] |= (head[:-1] == 0xC3) & ((head[1:] == 0x97) | (head[1:] == 0xB7))  # the signs of times and division
        at, fine = _typographic(head)
        bad[at[~fine]] = True
        for s in {x[:2] for x in self.special if x}:
            bad[:-1] |= (head[:-1] == s[0]) & ((head[1:] == s[1]) if len(s) > 1 else True)
        return np.diff(np.searchsorted(np.flatnonzero(bad), offsets)) == 0

    def starts(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places where pre-tokens of regular texts begin; they tile the bytes. first: does a text begin at the byte?

        A space goes with what follows it. The "words" kind drops white space, so there it only parts pre-tokens.
        """
        n, group = len(raw), _GROUP[raw]
        at, _ = _typographic(raw)
        for k in range(3):
            group[at + k] = 3
        begin = first.copy()
        begin[1:] |= group[1:] != group[:-1]
        if self.kind == "words":
            begin |= group == 2  # each digit by itself
        last = np.flatnonzero((group[:-1] == 0) & (group[1:] != 0) & ~first[1:])  # ends a blank run within its text
        begin[last] = True
        begin[last[raw[last] == 32] + 1] = False
        quote = np.flatnonzero(raw[:-1] == 39)
        spaced = (quote > 0) & (raw[quote - 1] == 32) & ~first[quote]
        opens = begin[quote] | spaced if self.kind == "words" else begin[quote]
        quote = quote[opens & ~first[quote + 1]]
        if len(quote):  # contractions, at the beginning of a pre-token only
            one, ahead = raw[quote + 1], np.minimum(quote + 2, n - 1)
            two = np.where((quote + 2 < n) & ~first[ahead], raw[ahead], 0)
            long = (((one == 114) | (one == 118)) & (two == 101)) | ((one == 108) & (two == 108))  # 're 've 'll
            size = np.where(np.isin(one, list(b"stmd")), 2, np.where(long, 3, 0))
            quote, size = quote[size > 0], size[size > 0]
            begin[quote + 1] = False
            end = quote + size
            begin[end[end < n]] = True
        return np.flatnonzero(begin)

    def lowered(self, raw: np.ndarray) -> np.ndarray:
        """Lower case of regular texts of the "words" kind: ASCII, and the Latin letters whose lead byte is C3."""
        out = _ASCII_LOWER[raw]
        upper = np.flatnonzero(raw[:-1] == 0xC3) + 1
        upper = upper[(raw[upper] >= 0x80) & (raw[upper] <= 0x9E)]
        out[upper] += 32
        return out

    def windows(self, raw: np.ndarray) -> list[int]:
        """Ends of the windows of a long text, cut only before a space between two ASCII letters or digits."""
        cuts, at = [], 0
        while len(raw) - at > 2 * SLICE_BYTES:
            look, size, inner = at + SLICE_BYTES, 1 << 12, np.zeros(0, np.int64)
            while not len(inner) and look < len(raw):
                part = raw[look : look + size]
                plain = (part < 128) & ((_GROUP[part] == 1) | (_GROUP[part] == 2))
                inner = np.flatnonzero(plain[:-2] & (part[1:-1] == 32) & plain[2:])
                look += 0 if len(inner) else max(1, len(part) - 2)
            if not len(inner):
                break
            at = look + int(inner[0]) + 1
            cuts.append(at)
        return [*cuts, len(raw)]

    def numbers(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Pre-tokens of regular texts, a bounded number of bytes at a time: (first text, pre-tokens in it and in each
        later one, numbers of the pre-tokens). A very long text comes several times."""
        i = 0
        while i < len(offsets) - 1:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
            block, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            for a, b in pairwise([0, *(self.windows(block) if j == i + 1 else [len(block)])]):
                part = self.lowered(block[a:b]) if self.lowers else np.ascontiguousarray(block[a:b])
                if j == i + 1:
                    own = np.array([0, b - a])
                first = np.zeros(b - a + 1, bool)
                first[own] = True
                begin = self.starts(part, first[:-1]) if b > a else np.zeros(0, np.int64)
                ends = np.concatenate([begin, [b - a]]).astype(np.int32)
                tiles = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(part)])
                yield i, np.diff(np.searchsorted(begin, own)), self.number(tiles)
            i = j

    def _apart(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
        """(bytes and offsets of the regular texts, their rows, (row, ids) of the others)."""
        sizes, good = np.diff(offsets), self.regular(raw, offsets)
        whole = [(k, self.plain(raw[offsets[k] : offsets[k + 1]].tobytes().decode())) for k in np.flatnonzero(~good & (sizes > 0)).tolist()]
        if not good.all():
            raw, sizes = raw[np.repeat(good, sizes)], sizes[good]
        return raw, np.concatenate([[0], np.cumsum(sizes)]), np.flatnonzero(good), whole

    def encode_bytes(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = [b""] * (len(offsets) - 1)
        raw, offsets, rows, whole = self._apart(raw, offsets)
        for k, ids in whole:
            out[k] = ids
        for i, counts, number in self.numbers(raw, offsets):
            n = self.n[number]
            own = ragged(self.ids, (np.cumsum(self.n) - self.n)[number], n).tobytes()
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)].tolist()
            for r, a, b in zip(rows[i : i + len(counts)].tolist(), [0, *ends], ends, strict=False):
                out[r] += own[4 * a : 4 * b]
        return out

    def count_bytes(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many ids each text has."""
        out = np.zeros(len(offsets) - 1, np.int64)
        raw, offsets, rows, whole = self._apart(raw, offsets)
        for k, ids in whole:
            out[k] = len(ids) // 4
        for i, counts, number in self.numbers(raw, offsets):
            total = np.concatenate([[0], np.cumsum(self.n[number])])[np.concatenate([[0], np.cumsum(counts)])]
            out[rows[i : i + len(counts)]] += np.diff(total)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The same as encode_bytes for a list of texts."""
        return self.encode_bytes(*text_bytes(pa.array(texts, pa.string())))
