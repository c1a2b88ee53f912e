"""Alignment of two tokenizers' tokens, and corpus-wide counts of the id pairs that meet.

Both tokenizers' tokens tile the same bytes; where both end, a group ends, and every pair of a group's tokens is linked.
The first pass gathers the distinct id pairs, over which a minimal perfect hash is built shard by shard (by the first
id): levels of bit arrays in which a pair that has a place to itself is settled, the rest goes on to the next level.
Document counts are dense vectors indexed by it, summed in a tree. The second pass aligns the documents again and looks
counts up in hash, keys and vectors; the stored key at a slot tells a pair that was never seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import Encoder, materialize, table, text_bytes, tidy
from mnemolake.llm.token_counts import _byte_of_character

SHARDS = 64
FAN_IN = 32  # vectors or key lists that one task of a tree sums
ROUND_BYTES = 96 << 20  # of keys, counts and hash that one broadcast holds
HELD_PAIRS = 1 << 20  # distinct pairs that a task of the first pass holds before it writes them
UNIT_BYTES = 3 << 20  # text that is aligned at a time
MEMO = 1 << 18  # pairs whose counts a task of the second pass has at hand
SMALL = 256  # links of a group that are listed one by one


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# -- minimal perfect hashing -----------------------------------------------------------------------------------------


def _level_places(keys: np.ndarray, level: int, bits: np.ndarray | int) -> np.ndarray:
    return (_mixed(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.asarray(bits, np.uint64)).astype(np.int64)


def hash_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays (as 64-bit words) in which each of the distinct keys has a bit of its own at just one level."""
    levels, left = [], keys
    while len(left):
        words = max(1, -(-len(left) * 3 // 2 // 64))
        at = _level_places(left, len(levels), words * 64)
        alone = np.bincount(at, minlength=words * 64) == 1
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~alone[at]]
    return levels


class PerfectHash:
    """Slots 0 to n - 1 of n distinct pairs, from the levels of each shard; slots of a shard are consecutive."""

    def __init__(self, shards: dict[int, list[np.ndarray]]):
        depth = max(map(len, shards.values()), default=0)
        self.size, self.base = np.zeros((SHARDS, depth), np.int64), np.zeros((SHARDS, depth), np.int64)
        parts, at = [], 0
        for s, levels in sorted(shards.items()):
            for k, words in enumerate(levels):
                self.size[s, k], self.base[s, k] = 64 * len(words), 64 * at
                parts.append(words)
                at += len(words)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)
        self.n = int(self.rank[-1])
        starts = {s: int(self.rank[self.base[s, 0] // 64]) for s in shards if shards[s]}
        self.first = np.array([starts.get(s, 0) for s in range(SHARDS)], np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each pair; of a pair that isn't among the hashed ones -1 or any slot."""
        out, shard, left = np.full(len(keys), -1, np.int64), shard_of(keys), np.arange(len(keys))
        for level in range(self.size.shape[1]):
            bits = self.size[shard[left], level]
            left, bits = left[bits > 0], bits[bits > 0]
            at = self.base[shard[left], level] + _level_places(keys[left], level, bits)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.rank[at[hit] >> 6] + np.bitwise_count(below)
            left = left[~hit]
        return out


def shard_of(keys: np.ndarray) -> np.ndarray:
    """By the first id alone, so that a shard knows the highest count of each of its first ids."""
    return ((keys >> np.uint32(16)) % np.uint32(SHARDS)).astype(np.int32)


# -- tokens ----------------------------------------------------------------------------------------------------------


class PieceEncoder(Encoder):
    """Ids of sentencepiece, remembered by word.

    Where no piece has a space behind another character, nothing is merged across the beginning of a run of spaces, so
    that what lies between two such places is encoded by itself; other models get texts whole. Each text must begin
    with a space, the one that the model adds.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        known = all("▁" not in p.lstrip("▁") for p in self.pieces) and self.library.normalize("  ﬁ ½ \t x ") == "▁▁▁ﬁ▁½▁\t▁x▁"
        self.kind, self.lowers, self.whole, self.special = "pieces" if known else "other", False, {}, []
        self.space = np.array([self.library.piece_to_id("▁")], "<u4").tobytes()
        self.forget()

    def plain(self, text: str) -> bytes:
        return self.space if text == " " else np.asarray(self.library.encode(text[1:], num_threads=1), "<u4").tobytes()

    def each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self.library.encode([p[1:].decode() for p in pieces], num_threads=1)
        got = [g if p != b" " else [int(np.frombuffer(self.space, "<u4")[0])] for p, g in zip(pieces, got, strict=True)]
        return np.array([len(g) for g in got], np.int64), np.array([k for g in got for k in g], "<u4")

    def regular(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.full(len(offsets) - 1, self.kind == "pieces")

    def starts(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        blank = raw == 32
        begin = first.copy()
        begin[1:] |= blank[1:] & ~blank[:-1]
        return np.flatnonzero(begin)


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Aligned(NamedTuple):
    """Tokens of some texts in groups; a, b: ids; in_a, in_b: the group of each; groups: the text of each group."""

    a: np.ndarray
    b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray
    groups: np.ndarray


class Aligner:
    """Both encoders and the bytes of their tokens; a worker keeps it."""

    @classmethod
    @cache
    def of(cls, path_a: str, path_b: str) -> "Aligner":
        return cls(path_a, path_b)

    def __init__(self, path_a: str, path_b: str):
        self.first, self.second = Encoder(path_a), PieceEncoder(path_b)
        self.first.library.encode_special_tokens = True
        self.first.forget()
        byte = _byte_of_character()
        vocabulary = self.first.library.get_vocab(with_added_tokens=False)
        spelled = [b""] * (1 + max(self.first.library.get_vocab(with_added_tokens=True).values()))
        for t, k in vocabulary.items():
            spelled[k] = b"".join(byte.get(ord(c), c.encode()) for c in t)
        self.bytes_a, self.bytes_b = pa.array(spelled, pa.large_binary()), pa.array([piece_bytes(p) for p in self.second.pieces], pa.large_binary())
        if len(spelled) > 1 << 16 or len(self.second.pieces) > 1 << 16:
            raise ValueError("a pair of ids must fit into 32 bits")
        self.size_a, self.size_b = (np.diff(np.frombuffer(t.buffers()[1], np.int64)) for t in (self.bytes_a, self.bytes_b))
        self.names = [pa.array([f"{k}{end}" for k in range(max(len(spelled), len(self.second.pieces)))], pa.large_string()) for end in (",", "|", ";")]
        self.names = pa.concat_arrays(self.names)

    @staticmethod
    def same(spelled: pa.Array, ids: np.ndarray, ends: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text: are its tokens' bytes the text's? ends: behind each text's last byte, as its tokens have it."""
        joined = np.frombuffer(spelled.take(pa.array(ids.astype(np.int64))).buffers()[2] or b"", np.uint8)
        if np.array_equal(ends, offsets[1:]) and np.array_equal(joined[: offsets[-1]], raw):
            return np.ones(len(ends), bool)
        begin = np.concatenate([[0], ends[:-1]])
        return np.array([np.array_equal(joined[x:y], raw[u:v]) for x, y, u, v in zip(begin.tolist(), ends.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], bool)

    def align(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Aligned]:
        """(is each text's alignment whole?, the tokens of those where it is). Texts begin with their space."""
        ids_a, ids_b = self.first.encode_bytes(raw, offsets), self.second.encode_bytes(raw, offsets)
        good = np.ones(len(ids_a), bool)
        for ids, spelled, size in ((ids_a, self.bytes_a, self.size_a), (ids_b, self.bytes_b, self.size_b)):
            flat = np.frombuffer(b"".join(ids), "<u4")
            count = np.cumsum([len(x) // 4 for x in ids])
            good &= self.same(spelled, flat, np.concatenate([[0], np.cumsum(size[flat])])[count], raw, offsets)
        rows = np.flatnonzero(good)
        a, b = (np.frombuffer(b"".join([ids[r] for r in rows.tolist()]), "<u4") for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        total = int(end_a[-1]) if len(end_a) else 0
        ends = np.zeros((2, total + 1), bool)
        ends[0, end_a], ends[1, end_b] = True, True
        shared = ends[0] & ends[1]
        in_a, in_b = (np.cumsum(shared[e]) - shared[e] for e in (end_a, end_b))
        stop = np.cumsum(np.diff(offsets)[rows])
        return good, Aligned(a, b, in_a, in_b, rows[np.searchsorted(stop, np.flatnonzero(shared), side="left")])

    def units(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray, Aligned]]:
        """(first row, row behind the last, number of this unit of a long text, units of it, good, aligned), a bounded number of bytes at a time.

        A very long text comes in several (see Encoder.windows), cut before a space between two ASCII letters or digits,
        where both tokenizers begin a token.
        """
        sizes = np.diff(offsets)
        i = 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + UNIT_BYTES, side="right")) - 1)
            block, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            cuts = [0, *self.first.windows(block)] if j == i + 1 and self.second.kind == "pieces" else [0, len(block)]
            for k, (x, y) in enumerate(pairwise(cuts)):
                good, aligned = self.align(np.ascontiguousarray(block[x:y]), own if len(cuts) == 2 else np.array([0, y - x]))
                yield i, j, k, len(cuts) - 1, good, aligned
            i = j

    def written(self, t: Aligned) -> tuple[bytes, np.ndarray]:
        """(`a1,a2|b1;a3|b2,b3;` of all groups, where each group ends in it)."""
        ga, gb = np.bincount(t.in_a, minlength=len(t.groups)), np.bincount(t.in_b, minlength=len(t.groups))
        behind_a, behind_b = np.cumsum(ga), np.cumsum(gb)
        if not len(t.groups):
            return b"", np.zeros(0, np.int64)
        n = len(self.names) // 3
        code = np.empty(len(t.a) + len(t.b), np.int64)
        at_a = np.arange(len(t.a)) + (behind_b - gb)[t.in_a]
        at_b = np.arange(len(t.b)) + behind_a[t.in_b]
        code[at_a], code[at_b] = t.a, t.b
        code[(behind_a + behind_b - gb) - 1] += n
        code[(behind_a + behind_b) - 1] += 2 * n
        out = self.names.take(pa.array(code))
        ends = np.frombuffer(out.buffers()[1], np.int64)
        return out.buffers()[2].to_pybytes(), ends[behind_a + behind_b]


def links(t: Aligned) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, pair, how often) of all links; pairs of a group may come once with their number, never all pairs of a large one."""
    ga, gb = np.bincount(t.in_a, minlength=len(t.groups)), np.bincount(t.in_b, minlength=len(t.groups))
    first_a, first_b = np.cumsum(ga) - ga, np.cumsum(gb) - gb
    small = ga * gb <= SMALL
    of = np.flatnonzero(small[t.in_a])
    group = t.in_a[of]
    many = gb[group]
    left = np.repeat(of, many)
    right = np.repeat(first_b[group] - (np.cumsum(many) - many), many) + np.arange(len(left))
    yield t.groups[t.in_a[left]], (t.a[left] << np.uint32(16)) | t.b[right], np.ones(len(left), np.int64)
    for g in np.flatnonzero(~small).tolist():
        ia, ca = np.unique(t.a[first_a[g] : first_a[g] + ga[g]], return_counts=True)
        ib, cb = np.unique(t.b[first_b[g] : first_b[g] + gb[g]], return_counts=True)
        step = max(1, (1 << 20) // len(ib))
        for x in range(0, len(ia), step):
            keys = ((ia[x : x + step, None] << np.uint32(16)) | ib[None, :]).ravel()
            yield np.full(len(keys), t.groups[g]), keys, (ca[x : x + step, None] * cb[None, :]).ravel()


def spaced(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a space and the text for each text that isn't empty."""
    raw, offsets = text_bytes(col)
    sizes = np.diff(offsets)
    out = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
    made = np.full(int(out[-1]), 32, np.uint8)
    own = np.ones(len(made), bool)
    own[out[:-1][sizes > 0]] = False
    made[own] = raw
    return made, out


# -- counting --------------------------------------------------------------------------------------------------------


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def gather_pairs(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(shard, keys, counts): what each task of the first pass has found, pre-aggregated; counts are of documents."""

    def run(batches):
        aligner = Aligner.of(path_a, path_b)
        keys: list[np.ndarray] = [np.zeros(0, np.uint32)]
        counts: list[np.ndarray] = [np.zeros(0, np.int64)]
        size, long, whole = 0, [], True
        for b in batches:
            for _, _, k, units, good, aligned in aligner.units(*spaced(b.column(0))):
                own = [(d.astype(np.uint64) << np.uint64(32)) | p for d, p, _ in links(aligned)]
                pairs = np.unique(np.concatenate(own))
                if units > 1:  # of a long text: its pairs count once, and only if all of it aligns
                    long, whole = ([pairs], bool(good[0])) if k == 0 else ([np.unique(np.concatenate([*long, pairs]))], whole and bool(good[0]))
                    if k < units - 1 or not whole:
                        continue
                    pairs = long[0]
                found, n = np.unique((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True)
                keys.append(found)
                counts.append(n)
                size += len(found)
                if size > HELD_PAIRS:
                    k_, c_ = _summed(keys, counts)
                    if len(k_) > HELD_PAIRS // 2:
                        yield from chunks(k_, c_)
                        k_, c_ = k_[:0], c_[:0]
                    keys, counts, size = [k_], [c_], len(k_)
        yield from chunks(*_summed(keys, counts))

    def chunks(k, c):
        shard = shard_of(k)
        for s in np.unique(shard).tolist():
            own = shard == s
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([k[own].astype("<u4").tobytes()], pa.binary()), pa.array([c[own].astype("<i8").tobytes()], pa.binary())], ["shard", "keys", "counts"])

    return texts.mapInArrow(tidy(run), "shard int, keys binary, counts binary")


def tree(rows: DataFrame, column: str, add, label: str) -> DataFrame:
    """One row (shard, column) for each shard: FAN_IN rows of a shard at a time are put together, level by level."""
    rows = rows.select("shard", column)
    most = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0

    def put_together(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table([[key[0].as_py()], [add([x.as_py() for x in t[column]])]], schema=pa.schema([("shard", pa.int32()), (column, pa.binary())]))

    while True:
        groups = -(-most // FAN_IN)
        rows = rows.withColumn("of", F.pmod(F.xxhash64(column), F.lit(max(1, groups))) if groups > 1 else F.lit(0)).groupBy("shard", "of").applyInArrow(put_together, f"shard int, {column} binary")
        if groups <= 1:
            return rows
        rows, most = materialize(rows, label), groups


def distinct_keys(parts: list[bytes]) -> bytes:
    return np.unique(np.frombuffer(b"".join(parts), "<u4")).tobytes()


def summed_vectors(parts: list[bytes]) -> bytes:
    out = np.frombuffer(parts[0], "<i8").copy()
    for p in parts[1:]:
        out += np.frombuffer(p, "<i8")
    return out.tobytes()


def hash_shards(keys: DataFrame) -> DataFrame:
    """(shard, n, levels, ordered): each shard's hash levels, and its keys in the order of their slots."""

    def run(batches):
        for b in batches:
            for s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, "<u4")
                levels = hash_levels(own)
                made = PerfectHash({s: levels})
                ordered = np.empty(len(own), "<u4")
                ordered[made.slots(own)] = own
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary())), pa.array([ordered.tobytes()], pa.binary())], ["shard", "n", "levels", "ordered"])

    return keys.select("shard", "keys").mapInArrow(run, "shard int, n long, levels array<binary>, ordered binary")


def dense_vectors(chunks: DataFrame, sent, sizes: dict[int, int]) -> DataFrame:
    """(shard, vector): document counts at each slot of a shard, summed within each task."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                vector = total.setdefault(s, np.zeros(sizes[s], np.int64))
                vector[sent.value.slots(np.frombuffer(k, "<u4")) - sent.value.first[s]] += np.frombuffer(c, "<i8")
        for s, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([vector.tobytes()], pa.binary())], ["shard", "vector"])

    return chunks.select("shard", "keys", "counts").mapInArrow(run, "shard int, vector binary")


class Counts(NamedTuple):
    """Hash, keys, counts, and whether a count is its first id's highest, of the shards of one round."""

    hash: PerfectHash
    keys: np.ndarray
    counts: np.ndarray
    best: np.ndarray

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, is it the highest?) of each pair: 0 and False for one that wasn't counted."""
        slot = self.hash.slots(pairs)
        there = slot >= 0
        there[there] = self.keys[slot[there]] == pairs[there]
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        count[there], best[there] = self.counts[slot[there]], self.best[slot[there]]
        return count, best


class Memo:
    """Counts looked up before, in one table where a pair has one place; the rest is looked up, and each takes its place."""

    def __init__(self, counts: Counts):
        self.counts = counts
        self.keys, self.there = np.zeros(MEMO, np.uint32), np.zeros(MEMO, bool)
        self.count, self.best = np.zeros(MEMO, np.int64), np.zeros(MEMO, bool)

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = ((pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - MEMO.bit_length() + 1)).astype(np.int32)
        count, best = self.count[at], self.best[at]
        new = np.flatnonzero((self.keys[at] != pairs) | ~self.there[at])
        if len(new):
            some = pairs[new]
            count[new], best[new] = found = self.counts.look_up(some)
            at = at[new]
            # Of several pairs that want one place the last one has it, in all four columns.
            last = np.full(MEMO, -1, np.int32)
            last[at] = np.arange(len(at), dtype=np.int32)
            own = last[last >= 0]
            at = at[own]
            self.keys[at], self.there[at], self.count[at], self.best[at] = some[own], True, found[0][own], found[1][own]
        return count, best


def highest(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each pair: is its count the highest of its first id?"""
    most = np.zeros(1 << 16, np.int64)
    np.maximum.at(most, keys >> np.uint32(16), counts)
    return counts == most[keys >> np.uint32(16)]


def rounds_of(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Shards that are looked up together, so that keys, counts, marks and hash (14 bytes a pair) stay within most bytes.

    A shard by itself holds at most 65536 / SHARDS first ids with as many second ids as the other vocabulary has.
    """
    rounds, left = [], 0
    for s, n in sorted(sizes.items()):
        if not rounds or 14 * n > left:
            rounds.append([])
            left = most
        rounds[-1].append(s)
        left -= 14 * n
    return rounds


def count_pairs(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", most: int = ROUND_BYTES) -> Iterator[Counts]:
    """The counted pairs of all documents, a round of shards at a time; one round unless there are millions of pairs."""
    spark = docs.sparkSession
    chunks = materialize(gather_pairs(docs.select(docs[text_col].alias("text")), path_a, path_b), "pairs")
    hashed = materialize(hash_shards(tree(chunks, "keys", distinct_keys, "keys").repartition(SHARDS, "shard")), "hashed")
    sizes = {r["shard"]: r["n"] for r in hashed.select("shard", "n").collect()}
    for shards in rounds_of(sizes, most):
        some = hashed.where(F.col("shard").isin(shards))
        levels = {r["shard"]: [np.frombuffer(x, "<u8") for x in r["levels"]] for r in some.select("shard", "levels").toLocalIterator()}
        perfect = PerfectHash(levels)
        sent = spark.sparkContext.broadcast(perfect)
        vectors = tree(materialize(dense_vectors(chunks.where(F.col("shard").isin(shards)), sent, sizes), "vectors"), "vector", summed_vectors, "vectors")
        keys, counts = np.zeros(perfect.n, np.uint32), np.zeros(perfect.n, np.int64)
        for r in some.select("shard", "ordered").join(vectors, "shard").toLocalIterator():
            at = slice(int(perfect.first[r["shard"]]), int(perfect.first[r["shard"]]) + sizes[r["shard"]])
            keys[at], counts[at] = np.frombuffer(r["ordered"], "<u4"), np.frombuffer(r["vector"], "<i8")
        yield Counts(perfect, keys, counts, highest(keys, counts))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most: int = ROUND_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    Both passes read whole texts with no shuffle of texts. Texts that are null, empty, or that either tokenizer doesn't
    give back byte for byte have zeros and ''. Repeated rows are documents each; a very long text is aligned window by
    window; an empty table gives an empty result; other columns aren't read. With more pairs than one broadcast may hold
    the second pass runs once for each round of shards, its sums added by row.
    """
    spark, own = docs.sparkSession, docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def second_pass(sent):
        def run(batches):
            aligner = Aligner.of(path_a, path_b)
            known = Memo(sent.value) if sent is not None else None
            for b in batches:
                n = b.num_rows
                sums = np.zeros((6, n), np.int64)  # n_a, n_b, n_groups, n_links, n_best, count_sum
                digest = [""] * n
                running = None
                for i, j, k, units, good, t in aligner.units(*spaced(b.column(1))):
                    part = np.zeros((6, j - i), np.int64)
                    for row, group in ((0, t.in_a), (1, t.in_b)):
                        part[row] = np.bincount(t.groups[group], minlength=j - i)
                    part[2] = np.bincount(t.groups, minlength=j - i)
                    for text, pairs, times in links(t):
                        count, best = known.look_up(pairs) if known is not None else (np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool))
                        for row, x in ((3, times), (4, times * best), (5, times * count)):
                            np.add.at(part[row], text, x)
                    sums[:, i:j] += part
                    data, ends = aligner.written(t)
                    stop = np.concatenate([[0], ends])[np.searchsorted(t.groups, np.arange(j - i), side="right")]
                    start = np.concatenate([[0], stop[:-1]])
                    for r, x, y in zip(range(j - i), start.tolist(), stop.tolist(), strict=True):
                        if units == 1:
                            digest[i + r] = hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else ""
                        else:
                            running = (hashlib.sha256(), True) if k == 0 else running
                            running[0].update(data[x : y if k < units - 1 else y - 1])
                            running = (running[0], running[1] and bool(good[0]))
                            if k == units - 1:
                                digest[i] = running[0].hexdigest() if running[1] else ""
                                if not running[1]:
                                    sums[:, i] = 0
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in sums), pa.array(digest, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

        return own.mapInArrow(tidy(run), schema)

    done = [second_pass(spark.sparkContext.broadcast(c)) for c in count_pairs(docs, path_a, path_b, text_col, most)]
    if len(done) <= 1:
        return done[0] if done else second_pass(None)
    # Rows of one id and equal texts have the same sums in each round, so their number divides out.
    same = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    each = done[0].select(*same, "n_best", "count_sum", F.lit(0).alias("round"))
    for k, d in enumerate(done[1:], 1):
        each = each.unionByName(d.select(*same, "n_best", "count_sum", F.lit(k).alias("round")))
    total = each.groupBy(*same).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.count(F.when(F.col("round") == 0, 1)).alias("rows"))
    total = total.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"))
    return total.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") / F.col("rows")).cast("long").alias("n_best"), (F.col("count_sum") / F.col("rows")).cast("long").alias("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
