"""Exact self-join of sets by high Jaccard similarity: all sets of fitting sizes meet, by a few words of parity each.

A set's parity counts its members by hash in so many bits, modulo 2. Two sets' parities differ in no more bits than the sets
differ in members, and sets of unlike members differ in about half of them, so a pair of less similarity is ruled out by
a few machine words and without its members. What the first words leave is tried by four times as many. Sets are dealt to sides by size; a task takes two sides whose sizes are near
enough. What a side sends is its parities, about two to three bits for a member; pairs that are left are tried on whole sets.
Every pair of fitting sizes is compared, so time grows with the square of the sets, by about a nanosecond a word.

Members are 64-bit hashes: a similarity would be wrong only where two members of one pair of sets share a hash.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.operators.sets import codes, packed_trigrams
from mnemolake.plans.storage import materialize

SIDE = 65_536  # sets of a side, at most
LEAST_SIDE = 1024  # and at least, where there are SIDES of them
SIDE_BYTES = 16 << 20  # of its parities, about
SIDES = 32  # at least, if there are as many sets as that takes
AGAIN = 4  # times as many bits are looked at where the first ones leave a pair
BAND = 1.01  # sizes of a band are within about this factor
ROWS, COLS = 32, 4096  # sets of either side that are compared at a time
AGAIN_WORDS = 1 << 20  # of either side that are looked at again at a time
FINE = 4  # bits of a fine parity for a member, at least
HELD = 1 << 19  # words whose hashes a worker remembers
SCHEMA = "id string, key string, n long, bits binary, fine binary, s binary"
TOKENS = "[一-鿿]+|[a-z0-9_]{2,}"
WORDS = "[^ \t\n\r\f]+"


def widths(n: np.ndarray, th: float) -> np.ndarray:
    """Bits of a first parity of a set of n members: a power of two from 64 on, of which half less three deviations are more than may differ."""
    differ = 2 * n * (1 - th) / (1 + th)
    return 2 ** np.ceil(np.log2(np.maximum(64, (1.5 + np.sqrt(2.25 + 2 * differ)) ** 2))).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all their bits, one to one."""
    x = x.view(np.uint64).copy()
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def parities(h: np.ndarray, owner: np.ndarray, wide: np.ndarray) -> list[bytes]:
    """For each set the parity of its members in so many bits."""
    cuts = np.concatenate([[0], np.cumsum(wide)])
    odd = np.bincount(cuts[owner] + (h & (wide[owner] - 1)), minlength=cuts[-1]).astype(np.uint8) & 1
    packed = np.packbits(odd).tobytes()
    return [packed[i // 8 : j // 8] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _rows(ids: pa.Array, sets: list[np.ndarray], th: float) -> pa.RecordBatch:
    """Of ids and the sorted hashes of their sets, those that have members."""
    keep = [k for k, s in enumerate(sets) if len(s)]
    sets = [sets[k] for k in keep]
    n = np.array([len(s) for s in sets], np.int64)
    h, owner = (np.concatenate(sets), np.repeat(np.arange(len(n)), n)) if sets else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    fine = np.maximum(512, 2 ** np.ceil(np.log2(np.maximum(FINE * n, 1))).astype(np.int64))
    raw = [s.tobytes() for s in sets]
    keys = [hashlib.blake2b(x, digest_size=16).hexdigest() for x in raw]
    # The two parities read other bits of the hashes, so that the finer one rules out what the first lets pass by chance.
    return pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(keys, pa.string()), pa.array(n), pa.array(parities(h, owner, AGAIN * widths(n, th)), pa.binary()), pa.array(parities(h >> 20, owner, fine), pa.binary()), pa.array(raw, pa.binary())], ["id", "key", "n", "bits", "fine", "s"])


def hashed_sets(df: DataFrame, members: Column, th: float) -> DataFrame:
    """(id, key, n, bits, fine, s) of the set of the members of each row that has any, as a written table.

    key names the set; s is its members' hashes, sorted; bits and fine are its parities.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                yield _rows(b.column(0), [np.unique(x.values.to_numpy()) if x.is_valid else np.zeros(0, np.int64) for x in b.column(1)], th)

    return materialize(df.select("id", F.transform(members, lambda t: F.xxhash64(t)).alias("h")).mapInArrow(run, SCHEMA), "sets")


def word_sets(df: DataFrame, pattern: str, th: float) -> DataFrame:
    """hashed_sets() of the matches of a pattern (TOKENS, WORDS) in the lower-cased content: each text is read once, within its row."""

    def run(batches):
        find, held = re.compile(pattern).findall, {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = []
                for text in b.column(1).to_pylist():
                    words = set(find(text or ""))
                    for w in words:
                        if w not in held:
                            held[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little", signed=True)
                    sets.append(np.sort(np.fromiter((held[w] for w in words), np.int64, len(words))))
                    if len(held) > HELD:
                        held.clear()
                yield _rows(b.column(0), sets, th)

    return materialize(df.select("id", F.lower("content").alias("low")).mapInArrow(run, SCHEMA), "sets")


def trigram_hashes(df: DataFrame, th: float) -> DataFrame:
    """hashed_sets() of the runs of three characters of the content; different runs have different hashes."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                points = [codes(t or "") for t in b.column(1).to_pylist()]
                yield _rows(b.column(0), [np.sort(mixed(np.unique(packed_trigrams(c)))) if len(c) > 2 else np.zeros(0, np.int64) for c in points], th)

    return materialize(df.select("id", "content").mapInArrow(run, SCHEMA), "sets")


def representatives(sets: DataFrame) -> DataFrame:
    """(key, id, n, bits) of every distinct set, as a written table; id is the smallest that has it."""
    return materialize(sets.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "distinct-sets")


def members(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, cls): the smallest id of the same set."""
    return sets.select("id", "key").join(reps.select("key", F.col("id").alias("cls")), "key").select("id", "cls")


class Side:
    """Sets by size: their keys, sizes, and parities as columns of words, runs of one width together."""

    def __init__(self, keys: list[str], n: np.ndarray, bits: list[bytes]):
        order = np.argsort(n, kind="stable")
        self.n, self.keys = n[order], [keys[k] for k in order.tolist()]
        bits = [bits[k] for k in order.tolist()]
        wide = np.array([len(x) for x in bits], np.int64)
        starts = np.flatnonzero(np.concatenate([[True], wide[1:] != wide[:-1]])) if len(wide) else np.zeros(0, np.int64)
        ends = np.concatenate([starts[1:], [len(wide)]])
        self.runs = [(i, j, {int(wide[i]) // 8: np.ascontiguousarray(np.frombuffer(b"".join(bits[i:j]), np.uint64).reshape(j - i, -1).T)}) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]

    @staticmethod
    def folded(forms: dict[int, np.ndarray], words: int) -> np.ndarray:
        """The parities in fewer words: halves are added."""
        if words not in forms:
            twice = Side.folded(forms, 2 * words)
            forms[words] = np.ascontiguousarray(twice[:words] ^ twice[words:])
        return forms[words]

    @staticmethod
    def rows(forms: dict[int, np.ndarray], words: int) -> np.ndarray:
        """The same with a set's words beside each other."""
        if -words not in forms:
            forms[-words] = np.ascontiguousarray(Side.folded(forms, words).T)
        return forms[-words]


def near_keys(a: Side, b: Side, th: float, gap: int | None, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the sets of a and b, by size, that neither sizes nor parities rule out; of one side with itself, i < j."""
    share, rows, cols = (1 - th) / (1 + th), [], []
    word, few, left_over = (np.empty(ROWS * COLS + 8, kind) for kind in (np.uint64, np.uint8, np.bool_))
    for i0, i1, left in a.runs:
        for i in range(i0, i1, ROWS):
            up = min(i + ROWS, i1)
            small, large = int(a.n[i]), int(a.n[up - 1])
            low, high = th * small - 1e-6, large / th + 1e-6
            if gap is not None:
                low, high = max(low, small - gap), min(high, large + gap)
            first, last = np.searchsorted(b.n, low, "left"), np.searchsorted(b.n, high, "right")
            if same:
                first = max(first, i)
            for j0, j1, right in b.runs:
                more = min(max(left), max(right))
                words = more // AGAIN
                for j in range(max(j0, first), min(j1, last), COLS):
                    end = min(j + COLS, j1, last)
                    x, y = Side.folded(left, words)[:, i - i0 : up - i0], Side.folded(right, words)[:, j - j0 : end - j0]
                    shape, size = (up - i, end - j), (up - i) * (end - j)
                    w, c, keep = (v[:size].reshape(shape) for v in (word, few, left_over))
                    # Three words differ in 192 bits at most, which a byte holds.
                    differ = np.empty(shape, np.uint8 if words <= 3 else np.uint16 if words < 1024 else np.uint32)
                    for k in range(words):
                        np.bitwise_xor(x[k][:, None], y[k][None, :], out=w)
                        np.bitwise_count(w, out=c if k else differ)
                        if k:
                            differ += c
                    most = (large + int(b.n[end - 1])) * share + 1e-6
                    np.less_equal(differ, min(math.floor(most), np.iinfo(differ.dtype).max), out=keep)
                    # Eight of them are looked at at a time, as few are left.
                    left_over[size : size + 8] = False
                    at = np.flatnonzero(left_over[: -(-size // 8) * 8].view(np.uint64))
                    at = (at[:, None] * 8 + np.arange(8)).ravel()
                    r, s = np.divmod(at[left_over[at]], shape[1])
                    na, nb = a.n[r + i], b.n[s + j]
                    most = (na + nb) * share + 1e-6
                    keep = (differ[r, s] <= most) & (np.minimum(na, nb) >= th * np.maximum(na, nb) - 1e-9)
                    if gap is not None:
                        keep &= np.abs(na - nb) <= gap
                    if same:
                        keep &= r + i < s + j
                    r, s, most = r[keep] + i, s[keep] + j, most[keep]
                    for k in range(0, len(r), turn := max(1, AGAIN_WORDS // more)):
                        u, v = Side.rows(left, more)[r[k : k + turn] - i0], Side.rows(right, more)[s[k : k + turn] - j0]
                        near = np.bitwise_count(u ^ v).sum(1) <= most[k : k + turn]
                        rows.append(r[k : k + turn][near])
                        cols.append(s[k : k + turn][near])
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, cols))


def sides(reps: DataFrame, th: float, gap: int | None = None) -> tuple[DataFrame, list[tuple[int, int]]]:
    """((key, n, bits, side) of distinct sets, pairs of sides that sizes don't keep apart).

    Sides are made on the driver from a row for each band of sizes, of which there are some thousand at most.
    """
    spark = reps.sparkSession
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND))
    bands = sorted(tuple(r) for r in reps.groupBy(band.alias("band")).agg(F.count("*").alias("sets"), F.min("n").alias("least"), F.max("n").alias("most")).collect())
    side = min(SIDE, max(LEAST_SIDE, sum(b[1] for b in bands) // SIDES))
    held, at = [], []  # (least, most) of each side; (band, first side, sides)
    room = 0
    for key, count, least, most in bands:
        own = min(side, max(1, SIDE_BYTES * 8 // (AGAIN * int(widths(np.array([most]), th)[0]))))
        if count > room:
            more = math.ceil(count / own)
            at.append((key, len(held), more))
            held += [(least, most)] * more
            room = own - count if more == 1 else 0
        else:
            at.append((key, len(held) - 1, 1))
            held[-1] = (held[-1][0], most)
            room = min(room, own) - count
    pairs = [(x, y) for x in range(len(held)) for y in range(x, len(held)) if held[x][1] >= th * held[y][0] - 1e-6 and (gap is None or held[y][0] - held[x][1] <= gap)]
    places = spark.createDataFrame(at, "band long, first int, more int")
    # A row for each band of sizes.
    placed = reps.withColumn("band", band).join(F.broadcast(places), "band")
    return placed.select("key", "n", "bits", (F.col("first") + F.pmod(F.xxhash64("key"), F.col("more"))).cast("int").alias("side")), pairs


def parity_pairs(reps: DataFrame, th: float, gap: int | None = None) -> DataFrame:
    """(a, b, na, nb): keys and sizes of all pairs of distinct sets that neither sizes (with gap, their difference too) nor parities rule out."""
    spark = reps.sparkSession
    placed, pairs = sides(reps, th, gap)
    ends = [(k, x, y) for x, y in pairs for k in {x, y}]
    # Which sides meet: its rows follow the number of tasks, not of sets.
    sent = placed.join(F.broadcast(spark.createDataFrame(ends, "side int, x int, y int")), "side").repartition(max(1, min(len(pairs), 4096)), "x", "y")
    kinds = pa.schema([("a", pa.string()), ("b", pa.string()), ("na", pa.int64()), ("nb", pa.int64())])

    def meet(t: pa.Table) -> pa.Table:
        x, y, side = t["x"][0].as_py(), t["y"][0].as_py(), t["side"].to_numpy()
        one, two = (Side(own["key"].to_pylist(), own["n"].to_numpy(), own["bits"].to_pylist()) for own in (t.filter(pa.array(side == k)) for k in (x, y)))
        i, j = near_keys(one, two, th, gap, x == y)
        return pa.table([[one.keys[k] for k in i.tolist()], [two.keys[k] for k in j.tolist()], one.n[i], two.n[j]], schema=kinds)

    return sent.groupBy("x", "y").applyInArrow(meet, "a string, b string, na long, nb long")


def words_of(column: pa.Array):
    """(rows, width) -> the parities of rows of that many words as a matrix; the widths of all rows in words."""
    column = column.cast(pa.binary())
    starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint64, len(data) // 8)
    return (lambda rows, width: data[starts[rows][:, None] + np.arange(width)]), np.diff(starts)


def similarities(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b, sa, sb) of whole sets."""

    def run(batches):
        for b in batches:
            s = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                both = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in (x, y)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                s.append(shared / (len(both) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a string, b string, similarity double")
