"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

The vocabulary's Bloom filters are sharded by word length and blocked (a word's bits lie in 64 bytes). Every word's
deletions and replacements are probed against them inside Arrow tasks; hashes of edits are made from the word's own
prefix hashes, strings only for the positives. Those are shuffled to an exact join with the vocabulary, which removes
false positives. Insertions are the deletions of the longer word, so they need no probes. The filters of one broadcast
hold at most FILTER_BYTES; a larger vocabulary is taken in several rounds, each with the filters of other lengths or of
another hash range of one length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import materialize, table, tidy, width

LETTERS = "A-Za-zÀ-ÿ"
FILTER_BYTES = 32 << 20
SEGMENT = 1024  # blocks of 64 bytes that one task sets
LONG = 32  # longer words share a shard, with so many bits that false positives hardly occur
PROBES = 1 << 20  # hashes made at a time

_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _shard(length):
    return np.minimum(length, LONG + 1)


def _bits_of(shard: int) -> tuple[int, int]:
    """(bits a word, bits set in its block)."""
    return (16, 6) if shard <= LONG else (64, 14)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _prefixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each beginning of each word, powers): the hash of all is the sum of code * power[characters behind]."""
    n, length = codes.shape
    out = np.zeros((n, length + 1), np.uint64)
    for i in range(length):
        out[:, i + 1] = out[:, i] * _P + codes[:, i]
    power = np.ones(length + 1, np.uint64)
    np.multiply.accumulate(np.full(length, _P, np.uint64), out=power[1:])
    return out, power


def _placed(hashes: np.ndarray, blocks: int, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(block, the k places within its 512 bits) of each hash."""
    block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    out, g = [], _mixed(hashes + _P)
    for j in range(k):
        if j and j % 7 == 0:
            g = _mixed(g + _P)
        out.append((g >> np.uint64(9 * (j % 7))) & np.uint64(511))
    return block.astype(np.int64), out


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int32)


def by_length(words: list[str]):
    """(length, rows, code points) of each length among the words."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, _codes([words[r] for r in rows.tolist()])


def plan_rounds(counts: dict[int, int], most: int = FILTER_BYTES) -> tuple[dict[int, tuple[int, int]], list[list[tuple[int, int]]]]:
    """({shard: (parts, blocks of a part)}, rounds of (shard, part)) so that no round's filters take more than most bytes."""
    shards, rounds, left = {}, [], 0
    for shard, n in sorted(counts.items()):
        blocks = max(1, -(-n * _bits_of(shard)[0] // 512))
        parts = max(1, -(-blocks * 64 // most))
        blocks = -(-blocks // parts)
        shards[shard] = (parts, blocks)
        for part in range(parts):
            if blocks * 64 > left:
                rounds.append([])
                left = most
            rounds[-1].append((shard, part))
            left -= blocks * 64
    return shards, rounds


def build_filters(words: DataFrame, shards: dict[int, tuple[int, int]]) -> DataFrame:
    """(shard, part, segment, bits): each segment of at most 64 KB is set by one task from the words that fall in it."""

    def place(batches):
        for b in batches:
            for length, rows, codes in by_length(b.column(0).to_pylist()):
                shard = int(_shard(length))
                parts, blocks = shards[shard]
                h = _mixed(_prefixes(codes)[0][:, -1])
                block, places = _placed(h, blocks, _bits_of(shard)[1])
                at = np.ascontiguousarray(np.stack([block % SEGMENT * 512 + p.astype(np.int64) for p in places], 1), "<i4")
                packed = pa.Array.from_buffers(pa.binary(4 * len(places)), len(rows), [None, pa.py_buffer(at)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int32)), pa.array(_part(h, parts)), pa.array((block // SEGMENT).astype(np.int32)), packed], ["shard", "part", "segment", "at"])

    def set_bits(key: tuple, t: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT * 64, np.uint8)
        at = np.frombuffer(b"".join(t["at"].to_pylist()), "<i4")
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pa.table([*([k.as_py()] for k in key), [bits.tobytes()]], schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("segment", pa.int32()), ("bits", pa.binary())]))

    placed = words.select("word").mapInArrow(place, "shard int, part int, segment int, at binary")
    return placed.groupBy("shard", "part", "segment").applyInArrow(set_bits, "shard int, part int, segment int, bits binary")


def edits(words: list[str], filters: dict[tuple[int, int], np.ndarray], shards: dict[int, tuple[int, int]], alphabet: np.ndarray):
    """(row, edit) of the deletions, and of the replacements by a greater character, that a filter of this round holds."""

    def held(shard: int, hashes: np.ndarray) -> np.ndarray:
        parts, blocks = shards[shard]
        part, k = _part(hashes, parts) if parts > 1 else None, _bits_of(shard)[1]
        keep = np.zeros(0, np.int64)
        for p in range(parts):
            if (bits := filters.get((shard, p))) is None:
                continue
            mine = np.arange(len(hashes)) if part is None else np.flatnonzero(part == p)
            block, places = _placed(hashes[mine], blocks, k)
            left = np.arange(len(mine))
            for place in places:
                at = place[left]
                left = left[(bits[block[left] * 64 + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            keep = np.concatenate([keep, mine[left]])
        return keep

    for length, rows, codes in by_length(words):
        shorter, same = int(_shard(length - 1)), int(_shard(length))
        wanted = {s for s, _ in filters}
        step = max(1, PROBES // len(alphabet))
        for a in range(0, len(rows), step):
            some, own = codes[a : a + step], rows[a : a + step]
            prefix, power = _prefixes(some)
            whole = prefix[:, -1]
            for i in range(length):
                behind = power[length - 1 - i]
                if shorter in wanted and shorter in shards:
                    can = np.flatnonzero(some[:, i] != some[:, i - 1]) if i else np.arange(len(own))  # within a run of one character all deletions are the same
                    h = prefix[can, i] * behind + (whole[can] - prefix[can, i + 1] * behind)
                    for r in own[can[held(shorter, _mixed(h))]].tolist():
                        yield r, words[r][:i] + words[r][i + 1 :]
                if same in wanted:
                    greater = alphabet[None, :] > some[:, i, None]
                    which, letter = np.nonzero(greater)
                    h = whole[which] + (alphabet[letter] - some[which, i]) * behind
                    hit = held(same, _mixed(h))
                    for r, c in zip(own[which[hit]].tolist(), alphabet[letter[hit]].tolist(), strict=True):
                        yield r, f"{words[r][:i]}{chr(c)}{words[r][i + 1 :]}"


def near_pairs(words: DataFrame, most: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n), each pair of words one inserted, deleted or replaced code point apart once.

    words: (word, n), distinct, no nulls. The driver gets the count of each shard (LONG + 1 at most), the characters that
    occur, and for each round filters of at most most bytes.
    """
    spark = words.sparkSession
    length = F.least(F.length("word"), F.lit(LONG + 1)).cast("int")
    counts = {r[0]: r[1] for r in words.groupBy(length.alias("shard")).count().collect()}
    if not counts:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r[0]) for r in letters.collect()), np.uint64)
    shards, rounds = plan_rounds(counts, most)
    built = materialize(build_filters(words, shards), "filters")
    tasks = min(4 * width(spark), max(1, sum(counts.values()) // 2000))
    dealt = words.repartition(tasks, "word")
    found = None
    for number, own in enumerate(rounds):
        filters = {key: np.zeros(shards[key[0]][1] * 64, np.uint8) for key in own}
        here = F.struct("shard", "part").isin([F.struct(F.lit(s).alias("shard"), F.lit(p).alias("part")) for s, p in own]) if len(rounds) > 1 else F.lit(True)
        for r in built.where(here).toLocalIterator():
            bits = np.frombuffer(r["bits"], np.uint8)
            at = r["segment"] * SEGMENT * 64
            to = filters[r["shard"], r["part"]]
            to[at : at + len(bits)] = bits[: len(to) - at]
        sent = spark.sparkContext.broadcast(filters)

        def probe(batches, sent=sent):
            for b in batches:
                texts, counted = b.column(0).to_pylist(), b.column(1).to_numpy()
                rows, made = [], []
                for r, e in edits(texts, sent.value, shards, alphabet):
                    rows.append(r)
                    made.append(e)
                    if len(rows) == 65536:
                        yield out(texts, counted, rows, made)
                        rows, made = [], []
                yield out(texts, counted, rows, made)

        def out(texts, counted, rows, made):
            return pa.RecordBatch.from_arrays([pa.array([texts[r] for r in rows], pa.string()), pa.array(counted[rows] if rows else [], pa.int64()), pa.array(made, pa.string())], ["word", "n", "edit"])

        positive = dealt.select("word", F.col("n").cast("long").alias("n")).mapInArrow(tidy(probe), "word string, n long, edit string")
        if len(rounds) > 1:  # so that no two filters are needed at once
            positive = materialize(positive, f"positive-{number}")
        found = positive if found is None else found.unionByName(positive)
    other = words.select(F.col("word").alias("other"), F.col("n").cast("long").alias("other_n"))
    return found.join(other, found["edit"] == other["other"]).select("word", "n", "other", "other_n")


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, shortest: int = 5, every: int = 97) -> DataFrame:
    """(word, n) of the runs of letters, A-Z in lower case, of whole texts: shortest code points or more, least times or more.

    One character goes from a run for whose crc32 of `<id>:<run>` every is a divisor (0: none goes). A null text has no
    runs; without an id nothing goes; repeated rows count each. Nothing is collected per document or per word.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col(text_col), upper, upper.lower()), F.lit(f"([{LETTERS}]+)"), F.lit(1))).alias("run")).where(F.length("run") >= shortest)
    word = F.col("run")
    if every:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % every == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def follow(links: DataFrame) -> DataFrame:
    """(word, root) from links (word, form) without cycles: chains are halved round by round, each round a written table."""
    now = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = materialize(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            return now


def group_variants(words: DataFrame, ratio: int = 2, most: int = FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of a table (word, n) of distinct words.

    A word's form is the near word of largest n, ties to the smallest in code-point order, if that n is at least ratio
    (2 or more) times the word's own; root is the end of its chain of forms. An empty table gives an empty result; other
    columns aren't read. A word has at most some thousand near words (its length times the letters), so neither a pair
    count nor a group grows with the square of the vocabulary; a root with very many words is split by AQE's skew join.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    pairs = materialize(near_pairs(words, most), "near-pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best")).alias("best"))
    formed = materialize(formed.select("word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n")), "forms")
    roots = follow(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(table(spark, sf_dir, "documents")))
