"""Benchmark decontamination with an FM-index for each shard of documents.

A shard is a bounded slice of a partition. Its text is the sequence of word numbers; words that no benchmark
item holds, and runs too short for any window, can't be in an occurrence and only separate runs. Over that
text stand a suffix array, its BWT in a wavelet matrix, and suffix positions sampled at every eighth word and
at run starts. Windows are searched backwards through the matrix's ranks, all of one length at a time;
occurrences are found by walking to a sampled position and merged to spans of words.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.llm.common import slices, table, text_bytes, tidy

WINDOW = 13
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 32 << 20
SAMPLE = 8
SEPARATOR = 1
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(raw: bytes) -> list[bytes]:
    """Words after lower-casing A-Z: runs of digits, a-z and bytes of other characters."""
    return raw.translate(_TABLE).split()


class Windows:
    """The distinct windows of benchmark items, as numbers of their words, by length."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str] = []
        number: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text.encode())]
            if not ids:
                continue
            if item not in number:
                number[item] = len(self.items)
                self.items.append(item)
            for i in range(max(1, len(ids) - width + 1)):
                owners[tuple(ids[i : i + width])].add(number[item])
        lengths: dict[int, list] = defaultdict(list)
        for w, who in owners.items():
            lengths[len(w)].append((w, sorted(who)))
        self.groups = []
        for n in sorted(lengths):
            got = lengths[n]
            counts = np.array([len(who) for _, who in got])
            self.groups.append((n, np.array([w for w, _ in got], np.int64), np.concatenate([[0], np.cumsum(counts)]), np.array([x for _, who in got for x in who])))
        self.least = min(lengths, default=0)


class FMIndex:
    """Of a sequence of symbols from 2 on with separators between runs; the last symbol is a separator."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        sep = text == SEPARATOR
        # Each separator is a rank of its own, below all words, so no comparison passes the end of a run.
        rank = np.where(sep, np.cumsum(sep) - 1, text.astype(np.int64) + int(sep.sum()))
        step, order = 1, np.argsort(rank, kind="stable")
        while True:
            key = rank[order]
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if int(new[-1]) == n - 1:
                break
            ahead = np.zeros(n, np.int64)
            ahead[:-step] = rank[step:] + 1
            rank = rank * (n + 1) + ahead
            order = np.argsort(rank, kind="stable")
            step *= 2
        self.bwt_of(text[order - 1], symbols)
        starts = np.ones(n, bool)
        starts[1:] = sep[:-1]
        self.sampled = (starts | (np.arange(n) % SAMPLE == 0))[order]
        self.place = order[self.sampled]
        self.sampled_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.n = n

    def bwt_of(self, bwt: np.ndarray, symbols: int) -> None:
        """The wavelet matrix: from the top bit on, counts of ones, with zeros moved before ones for the next level."""
        self.levels = []
        for bit in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]), int(len(bwt) - ones.sum())))
            bwt = np.concatenate([bwt[ones == 0], bwt[ones == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of each symbol stand before place i of the BWT."""
        start = np.zeros_like(i)
        for bit, ones, zeros in self.levels:
            up = ((symbol >> bit) & 1).astype(bool)
            i, start = (np.where(up, zeros + ones[x], x - ones[x]) for x in (i, start))
        return i - start

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for bit, ones, zeros in self.levels:
            up = ones[i + 1] > ones[i]
            out |= up.astype(np.int64) << bit
            i = np.where(up, zeros + ones[i], i - ones[i])
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, end row) of those that occur."""
        which = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[which, j]
            lo, hi = self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)
            alive = lo < hi
            which, lo, hi = which[alive], lo[alive], hi[alive]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, which, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(which):
            done = self.sampled[rows]
            out[which[done]] = self.place[self.sampled_rank[rows[done]]] + steps
            which, rows = which[~done], rows[~done]
            c = self.symbol(rows)
            rows = self.before[c] + self.rank(c, rows)
            steps += 1
        return out


def find(windows: Windows, numbers: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For word numbers of a shard (0: not in the vocabulary) and the first word of each document (and the end):
    a flag for each word that is in an occurrence, and the (document, item) pairs found."""
    total = len(numbers)
    hit, pairs = np.zeros(total, bool), np.zeros((0, 2), np.int64)
    if not windows.groups or not total:
        return hit, pairs
    inside = numbers > 0
    cut = np.zeros(total + 1, bool)
    cut[first_word] = True
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | cut[1:-1]]))
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:] | cut[1:-1], [True]])) + 1
    long = ends - starts >= windows.least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return hit, pairs
    sizes = ends - starts + 1
    base = np.concatenate([[0], np.cumsum(sizes)])
    where = np.arange(base[-1]) - np.repeat(base[:-1] - starts, sizes)
    text = np.full(base[-1], SEPARATOR, np.int64)
    body = np.ones(base[-1], bool)
    body[base[1:] - 1] = False
    text[body] = numbers[where[body]]
    index = FMIndex(text, len(windows.vocabulary) + 2)
    edge = np.zeros(total + 1, np.int64)
    found = []
    for n, patterns, owner_at, owners in windows.groups:
        which, lo, hi = index.search(patterns)
        if not len(which):
            continue
        count = hi - lo
        rows = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]) - lo, count)
        at = where[index.locate(rows)]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        doc = np.searchsorted(first_word, at, side="right") - 1
        seen = np.unique(np.stack([doc, np.repeat(which, count)], 1), axis=0)
        n_own = owner_at[seen[:, 1] + 1] - owner_at[seen[:, 1]]
        own = np.arange(n_own.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n_own)[:-1]]) - owner_at[seen[:, 1]], n_own)
        found.append(np.stack([np.repeat(seen[:, 0], n_own), owners[own]], 1))
    if found:
        hit, pairs = np.cumsum(edge[:-1]) > 0, np.unique(np.concatenate(found), axis=0)
    return hit, pairs


def spans_of(raw: bytes, hit: np.ndarray) -> list[dict]:
    """Maximal runs of hit words as byte ranges of the text."""
    places = [(m.start(), m.end()) for m in _WORD.finditer(raw.translate(_TABLE))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _merge(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*a, *b], key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, found: str = "found") -> DataFrame:
    """All columns of docs and one struct column more: n_words, n_hit, items (ids), spans (byte ranges). No shuffle.

    The benchmark is a stated query set: it is read in blocks of at most block_bytes of text (an item that is longer
    is a block of its own), each sent to all tasks, and documents pass through once for each block. Null text has
    no words. An item's null id is the empty string; rows with the same item_id are one item. Repeated documents are
    judged each, an empty benchmark finds nothing, and docs may have further columns of any name but the new one's.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-int(size) * 2 // block_bytes) if size > block_bytes else 1
    names, out = docs.columns, docs
    for k in range(n_blocks):
        own = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        windows = spark.sparkContext.broadcast(Windows([tuple(r) for r in own.collect()], width))
        out = _search(out, windows, names, found, first=k == 0)
    return out


def _search(docs: DataFrame, windows, names: list[str], new: str, first: bool) -> DataFrame:
    at = names.index("text")
    found_type = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        w = windows.value
        get = w.vocabulary.get
        for b in batches:
            _, offsets = text_bytes(b.column(at))
            for i, j in slices(b, np.diff(offsets), SHARD_BYTES):
                part = b.slice(i, j - i)
                raws = [(t or "").encode() for t in part.column(at).to_pylist()]
                split = [words_of(r) for r in raws]
                first_word = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
                numbers = np.fromiter((get(x, 0) for s in split for x in s), np.int64, int(first_word[-1]))
                hit, pairs = find(w, numbers, first_word)
                named: dict[int, list[str]] = defaultdict(list)
                for d, item in pairs.tolist():
                    named[d].append(w.items[item])
                rows = []
                earlier = [None] * len(raws) if first else part.column(len(names)).to_pylist()
                for d, raw in enumerate(raws):
                    own = hit[first_word[d] : first_word[d + 1]]
                    row = {"n_words": len(own), "n_hit": int(own.sum()), "items": named.get(d, []), "spans": []}
                    if row["n_hit"]:
                        row["spans"] = spans_of(raw, own)
                    if earlier[d]:
                        row["items"] = sorted({*row["items"], *earlier[d]["items"]})
                        if row["spans"] and earlier[d]["spans"]:
                            places = _merge(row["spans"], earlier[d]["spans"])
                            row["n_hit"] = sum(len(words_of(raw[s["start"] : s["end"]])) for s in places)
                            row["spans"] = places
                        elif earlier[d]["spans"]:
                            row["spans"], row["n_hit"] = earlier[d]["spans"], earlier[d]["n_hit"]
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(rows, found_type)], [*names, new])

    found = T.StructType.fromDDL("n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>")
    return docs.mapInArrow(tidy(run), T.StructType([*(docs.schema[n] for n in names), T.StructField(new, found)]))


def is_contaminated(found: str = "found") -> Column:
    return (F.col(f"{found}.n_hit") > 0) & (20 * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that the contamination rule leaves, with the columns they had."""
    found = "_" * (1 + max(map(len, docs.columns))) + "found"
    return decontaminate(docs, benchmark, found=found).where(~is_contaminated(found)).drop(found)


def cut_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document, its text without the hit spans."""
    names = docs.columns
    found = "_" * (1 + max(map(len, names))) + "found"

    def run(batches):
        at = names.index("text")
        for b in batches:
            texts = []
            for t, f in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                for s in reversed(f["spans"] if t else []):
                    raw = t.encode()
                    t = (raw[: s["start"]] + raw[s["end"] :]).decode()
                texts.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1 : len(names)]], names)

    return decontaminate(docs, benchmark, found=found).mapInArrow(run, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )
