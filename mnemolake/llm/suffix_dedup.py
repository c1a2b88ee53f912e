"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A string of `length` bytes that starts in two documents holds the same anchor in both: the byte position in it
whose following GRAM bytes hash lowest. The corpus is cut accordingly into segments, maximal runs of strings with
one anchor, and equal strings always lie in segments of equal anchor hash.

1. Each chunk of documents sends the hashes of its anchors to buckets, which answer which of them another
   document has too (one bit for each hash sent). All else can't be repeated and goes no further.
2. Segments of the shared anchors go to buckets, each distinct one once a chunk, with its smallest doc_id.
3. A bucket is a block of text. Its suffixes are sorted one suffix bucket at a time: by their first 16 bytes,
   then by a ternary partition of all ties at once, which compares two suffixes by the ranks, computed
   beforehand, of the two cover samples that the difference cover provides within 21 bytes of both. Runs of
   sorted suffixes that share `length` bytes are one string, and its smallest doc_id decides.
4. Answers return to the chunks, which merge the removed strings into runs.

Chunks and buckets follow the bytes of the input; only segments, hashes and bits are exchanged, so what moves is a
small part of the text and no task holds more than its chunk or bucket. An anchor with more than HOT segments would
make one bucket too large: its segments are cut into single strings, which are dealt over all buckets by their own hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import table, text_bytes, width
from mnemolake.llm.near_dedup import mix

LENGTH = 50
GRAM = 24  # long enough to be rare in a language's text, so that few anchors are shared by chance
PERIOD = 21
COVER = (0, 1, 4, 14, 16)  # every difference modulo 21 is one of two of these
SLICE_BYTES = 1 << 20
SUFFIX_BUCKET = 1 << 20
#: Bytes of text a chunk, and a bucket, holds at least on average where the session's shuffle partitions don't make it fewer.
CHUNK_BYTES, BUCKET_BYTES = 32 << 20, 64 << 20
#: Segments of one anchor from which on they are dealt string by string.
HOT = 1 << 16
_NO_ID = np.iinfo(np.int64).max


def _shifts() -> np.ndarray:
    """delta[i, j]: the least d with i + d and j + d both in the cover, modulo the period."""
    out = np.full((PERIOD, PERIOD), PERIOD, np.int64)
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    for i in range(PERIOD):
        for j in range(PERIOD):
            out[i, j] = next(d for d in range(PERIOD) if inside[(i + d) % PERIOD] and inside[(j + d) % PERIOD])
    return out


SHIFT = _shifts()


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Mixed hash of the GRAM bytes from each position on."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.lib.stride_tricks.as_strided(raw, (n + GRAM - 8, 8), (1, 1)).copy().view("<u8").ravel()
    return mix(words[:n] * np.uint64(0x9FB21C651E98DF25) + words[8 : n + 8] * np.uint64(0xD6E8FEB86659FD93) + words[16 : n + 16] * np.uint64(0xA0761D6478BD642F))


def segments(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first string, strings in it, anchor hash) of each segment.

    Strings are named by their first byte; the bytes of a segment run from its first string to the end of its last.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = length - GRAM + 1  # positions of an anchor in a string
    n = len(raw) - length + 1
    if n <= 0:
        return none
    h = _gram_hashes(raw)
    low, span = h, 1
    while span * 2 <= grams:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n], low[grams - span : grams - span + n])
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]) - offsets[:-1], sizes)
    if not len(start):
        return none
    value = low[start]
    cut = np.ones(len(start), bool)
    cut[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    # Strings of one minimum without a break may hold several anchors of that hash (periodic text); pieces are cut
    # by place only where a run is long, and every piece keeps the hash, so equal strings still meet.
    first = np.flatnonzero(cut)
    count = np.diff(np.concatenate([first, [len(start)]]))
    if count.max() > 2 * length:
        pieces = -(-count // length)
        at = np.repeat(first, pieces) + length * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        first, count = at, np.minimum(length, np.repeat(first + count, pieces) - at)
    return doc[first], start[first], count, value[first]


def _string_hashes(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the first, the last and the bytes between of each string raw[p : p + length]."""
    view = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))
    out = np.full(len(at), np.uint64(length))
    for k in (*range(0, length - 7, 8), length - 8):
        out = mix((out ^ view[at + k].view("<u8").ravel()) * np.uint64(0x9FB21C651E98DF25))
    return out


def _to_byte(n: np.ndarray) -> np.ndarray:
    """Counts as bytes, exact up to 2 and to a twelfth beyond: eight steps to each doubling."""
    return np.minimum(np.round(np.log2(np.maximum(n, 1)) * 8), 255).astype(np.uint8)


def _from_byte(b: np.ndarray) -> np.ndarray:
    return np.exp2(b.astype(np.float64) / 8)


def _pieces(t: pa.Table):
    """Documents of a chunk in a fixed order, in slices: (doc ids, bytes, offsets, rows)."""
    if not t.num_rows:
        return
    ids = t["doc_id"].combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    raw, offsets = text_bytes(t["text"])
    order = np.lexsort((t["tie"].to_numpy(), ids))
    sizes = np.diff(offsets)[order]
    edge = np.concatenate([[0], np.cumsum(sizes)])
    begin = 0
    while begin < len(order):
        end = max(begin + 1, int(np.searchsorted(edge, edge[begin] + SLICE_BYTES, side="right")) - 1)
        rows = order[begin:end]
        part = np.concatenate([raw[offsets[r] : offsets[r + 1]] for r in rows.tolist()])
        yield ids[rows], part, np.concatenate([[0], np.cumsum(sizes[begin:end])]).astype(np.int64), rows
        begin = end


class Chunk:
    """What both later passes over a chunk compute again: its anchors, and the distinct segments of shared anchors."""

    def __init__(self, t: pa.Table, n_buckets: int, length: int):
        self.n_buckets, self.length = n_buckets, length
        self.slices = [(ids, raw, offsets, rows, segments(raw, offsets, length)) for ids, raw, offsets, rows in _pieces(t)]
        values = [s[3] for *_, s in self.slices]
        docs = [ids[s[0]] for ids, _, _, _, s in self.slices]
        v, d = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((values, np.uint64), (docs, np.int64)))
        bucket = v % np.uint64(n_buckets)
        order = np.lexsort((d, v, bucket))
        v, d, bucket = v[order], d[order], bucket[order]
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(v)]]) - 1
        self.hashes = v[first]
        self.bucket = bucket[first].astype(np.int64)
        self.twice = d[first] != d[last]  # in two documents of this chunk already
        self.many = _to_byte(last - first + 1)
        self.edges = np.searchsorted(self.bucket, np.arange(n_buckets + 1))

    def parts(self):
        for b in np.flatnonzero(np.diff(self.edges)).tolist():
            yield b, slice(int(self.edges[b]), int(self.edges[b + 1]))

    def shared(self, answers: dict[int, bytes]) -> None:
        """Keep the segments of shared anchors, gathered by their bytes; those of hot anchors string by string."""
        flags, hot = np.zeros(len(self.hashes), bool), np.zeros(len(self.hashes), bool)
        for b, s in self.parts():
            if b in answers:
                flags[s], hot[s] = _flags(answers[b], 2 * (s.stop - s.start)).reshape(2, -1)
        wanted, hot = np.sort(self.hashes[flags]), np.sort(self.hashes[hot])
        keys, owner, size, where, blobs = [], [], [], [], []
        for n, (ids, raw, _, _, (doc, start, count, value)) in enumerate(self.slices):
            at = np.searchsorted(wanted, value)
            keep = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == value) if len(wanted) else np.zeros(0, np.int64)
            if not len(keep):
                continue
            doc, start, count, value = doc[keep], start[keep], count[keep], value[keep]
            if len(hot):
                k = np.where(hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value, count, 1)
                step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                single = np.repeat(k > 1, k)
                doc, start, count, value = np.repeat(doc, k), np.repeat(start, k) + step, np.where(single, 1, np.repeat(count, k)), np.repeat(value, k)
                alone = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value)
                value[alone] = _string_hashes(raw, start[alone], self.length)
            view = raw.tobytes()
            blobs += [view[s : s + c + self.length - 1] for s, c in zip(start.tolist(), count.tolist(), strict=True)]
            keys.append(value)
            owner.append(ids[doc])
            size.append(count)
            where.append(np.stack([np.full(len(doc), n), doc, start], 1))
        self.blobs: list[bytes] = []
        self.members = np.zeros((0, 3), np.int64)
        self.kind = np.zeros(0, np.int64)
        self.strings = self.least = self.place = self.owner = np.zeros(0, np.int64)
        if not blobs:
            return
        number: dict[bytes, int] = {}
        kind = np.fromiter((number.setdefault(x, len(number)) for x in blobs), np.int64, len(blobs))
        self.blobs = list(number)
        own, all_sizes, all_keys = np.concatenate(owner), np.concatenate(size), np.concatenate(keys)
        self.anchor = np.zeros(len(number), np.uint64)
        self.anchor[kind] = all_keys
        self.owner, self.kind, self.members = own, kind, np.concatenate(where)
        self.least = np.full(len(number), _NO_ID)
        np.minimum.at(self.least, kind, own)
        self.strings = np.zeros(len(number), np.int64)
        self.strings[kind] = all_sizes
        place = np.zeros(len(number), np.int64)
        place[kind] = (all_keys % np.uint64(self.n_buckets)).astype(np.int64)
        self.place = place

    def by_bucket(self):
        order = np.argsort(self.place, kind="stable")
        edges = np.searchsorted(self.place[order], np.arange(self.n_buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            yield b, order[edges[b] : edges[b + 1]]


# -- one block of text ---------------------------------------------------------------------------------------------


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number whose order is theirs."""
    view = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
    return view[at].view(">u8").ravel().astype(np.uint64)


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 on; equal ranks for equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def cover_ranks(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """At each sample of the cover its rank among samples by the bytes from there on: by 21, then doubled until they
    are `length` or more."""
    used = len(text) - 32
    sample = np.flatnonzero(np.isin(np.arange(used) % PERIOD, COVER))
    rank = _dense(_words(text, sample), _words(text, sample + 8), _words(text, sample + PERIOD - 8))
    step = PERIOD
    while step < length:
        slot = np.full(used + step + PERIOD, -1, np.int64)
        slot[sample] = np.arange(len(sample))
        ahead = slot[sample + step]
        rank = _dense(rank, np.where(ahead >= 0, rank[ahead], 0))
        step *= 2
    out = np.zeros(used + 2 * PERIOD, np.int64)
    out[sample] = rank
    return out


def sort_suffixes(text: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The suffixes at `at` in order: by 21 bytes, then ties by cover ranks.

    All groups of ties are partitioned at once round a pivot of their own; what equals its pivot is settled.
    """
    keys = [_words(text, at + k) for k in (0, 8, PERIOD - 8)]
    order = np.lexsort(keys[::-1])
    tied = np.zeros(len(order), bool)
    tied[1:] = True
    for k in keys:
        tied[1:] &= k[order[1:]] == k[order[:-1]]
    group = np.cumsum(~tied)
    place = at[order]
    todo = np.flatnonzero(np.bincount(group)[group] > 1)
    group = group[todo]
    while len(todo):
        p = place[todo]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(group)]]))
        pivot = np.repeat(p[starts + sizes // 2], sizes)
        shift = SHIFT[p % PERIOD, pivot % PERIOD]
        side = np.sign(rank[p + shift] - rank[pivot + shift])
        by = np.lexsort((side, group))
        place[todo], side = p[by], side[by]
        number = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])])) - 1
        again = (side != 0) & (np.bincount(number)[number] > 1)
        todo, group = todo[again], number[again]
    return place


def equal_strings(text: np.ndarray, at: np.ndarray, length: int = LENGTH, most: int = SUFFIX_BUCKET) -> np.ndarray:
    """A class number for each string text[p : p + length], p in at (ascending); equal strings have equal numbers.

    text must end with at least length + 32 zero bytes. Suffix buckets are ranges of the first eight bytes.
    """
    out = np.zeros(len(at), np.int64)
    if not len(at):
        return out
    rank = cover_ranks(text, length)
    head = _words(text, at)
    bounds = np.unique(np.sort(head[:: max(1, len(head) // 4096)])[:: max(1, 4096 * most // max(len(head), 1))])[1:]
    bucket = np.searchsorted(bounds, head, side="right")
    by = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by], np.arange(len(bounds) + 2))
    used = 0
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if i == j:
            continue
        own = by[i:j]
        place = sort_suffixes(text, at[own], rank)
        same = np.ones(len(place) - 1, bool)
        for k in (*range(0, length - 7, 8), length - 8):
            w = _words(text, place + k)
            same &= w[1:] == w[:-1]
        number = np.concatenate([[0], np.cumsum(~same)]) + used
        used = int(number[-1]) + 1
        out[own] = number[np.argsort(place, kind="stable")]
    return out


def answer_block(blobs: list[bytes], anchors: np.ndarray, strings: np.ndarray, least: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each segment of a block the number of its strings, one bool each: does a smaller doc_id have the string?

    Equal segments are one, and what its smallest doc_id has is gone from the others. A segment that is the only one
    of its anchor shares no string with another; the rest is the text whose suffixes are sorted.
    """
    number: dict[bytes, int] = {}
    kind = np.fromiter((number.setdefault(x, len(number)) for x in blobs), np.int64, len(blobs))
    some = np.zeros(len(number), np.int64)
    some[kind] = np.arange(len(kind))
    smallest = np.full(len(number), _NO_ID)
    np.minimum.at(smallest, kind, least)
    count = strings[some]
    _, anchor, shared = np.unique(anchors[some], return_inverse=True, return_counts=True)
    sort = np.flatnonzero(shared[anchor] > 1)

    first = np.concatenate([[0], np.cumsum(count)])
    gone = np.zeros(int(first[-1]), bool)
    if len(sort):
        kinds = list(number)
        text = np.concatenate([np.frombuffer(b"".join([kinds[k] for k in sort.tolist()]), np.uint8), np.zeros(length + 32, np.uint8)])
        k = count[sort]
        begin = np.cumsum(k + length - 1) - (k + length - 1)
        step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        cls = equal_strings(text, np.repeat(begin, k) + step, length)
        owner = np.repeat(smallest[sort], k)
        best = np.full(int(cls.max()) + 1, _NO_ID)
        np.minimum.at(best, cls, owner)
        gone[np.repeat(first[sort], k) + step] = best[cls] < owner
    step = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    return gone[np.repeat(first[kind], strings) + step] | np.repeat(least > smallest[kind], strings)


# -- the exchanges -------------------------------------------------------------------------------------------------

_ANSWER = "chunk long, bucket long, of_strings boolean, bits binary"
_ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("of_strings", pa.bool_()), ("bits", pa.binary())])
_ASKED = "bucket long, chunk long, hashes binary, twice binary, many binary"
_ASKED_ARROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("twice", pa.binary()), ("many", pa.binary())])
_SENT = "bucket long, chunk long, packed binary, segments long"
_SENT_ARROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("packed", pa.binary()), ("segments", pa.int64())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _spans(covered: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def repeated_strings(docs: DataFrame, length: int = LENGTH, most: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, maximal), kept (the other bytes), one row per input row.

    A byte goes if a string of `length` bytes that covers it also starts in a document of smaller doc_id; matches never
    cross documents and are judged on the input. Null text is empty. A null doc_id counts as larger than any other.
    Rows with one doc_id are one document and take nothing from each other. Empty table: no rows. Other columns
    aren't read, whatever their names. A very long text lies in one chunk, in memory a few times over.
    """
    if length < GRAM:
        raise ValueError(f"strings must have at least {GRAM} bytes")
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(width(spark), -(-total // BUCKET_BYTES))  # buckets; a chunk sends each of them one row at most
    n_chunks = max(2 * width(spark), -(-total // CHUNK_BYTES))
    tie = own.withColumn("tie", F.xxhash64("text"))
    chunks = tie.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks))).repartition(max(width(spark), n_chunks // 2), "chunk")

    def ask(t: pa.Table) -> pa.Table:
        c, rows = Chunk(t, n, length), []
        chunk = t["chunk"][0].as_py()
        for b, s in c.parts():
            short = (c.hashes[s] // np.uint64(n)).view(np.uint8).reshape(-1, 8)[:, :5]
            rows.append((b, chunk, short.tobytes(), _bits(c.twice[s]), c.many[s].tobytes()))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ASKED_ARROW, strict=True)], schema=_ASKED_ARROW) if rows else _ASKED_ARROW.empty_table()

    def tell_shared(t: pa.Table) -> pa.Table:
        parts = t["hashes"].to_pylist()
        sizes = [len(p) // 5 for p in parts]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 5)
        twice = np.concatenate([_flags(b, k) for b, k in zip(t["twice"].to_pylist(), sizes, strict=True)])
        _, number, count = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
        shared = count > 1
        np.logical_or.at(shared, number, twice)
        hot = np.bincount(number, _from_byte(np.frombuffer(b"".join(t["many"].to_pylist()), np.uint8))) > most
        flags, hot = shared[number], (shared & hot)[number]
        rows, at = [], 0
        for chunk, k in zip(t["chunk"].to_pylist(), sizes, strict=True):
            own = slice(at, at + k)
            if flags[own].any():
                rows.append({"chunk": chunk, "bucket": t["bucket"][0].as_py(), "of_strings": False, "bits": _bits(np.concatenate([flags[own], hot[own]]))})
            at += k
        return pa.Table.from_pylist(rows, _ANSWER_ARROW)

    def again(docs_of: pa.Table, answers: pa.Table) -> Chunk:
        c = Chunk(docs_of, n, length)
        rows = zip(answers["bucket"].to_pylist(), answers["of_strings"].to_pylist(), answers["bits"].to_pylist(), strict=True)
        c.shared({b: bits for b, of_strings, bits in rows if not of_strings})
        return c

    def send(docs_of: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard

        if not docs_of.num_rows or not answers.num_rows:
            return _SENT_ARROW.empty_table()
        c, rows, squeeze = again(docs_of, answers), [], zstandard.ZstdCompressor(level=3)
        for b, own in c.by_bucket():
            raw = c.strings[own].astype("<u4").tobytes() + (c.anchor[own] // np.uint64(n)).astype("<u4").tobytes() + c.least[own].tobytes() + b"".join([c.blobs[k] for k in own.tolist()])
            rows.append({"bucket": b, "chunk": docs_of["chunk"][0].as_py(), "packed": squeeze.compress(raw), "segments": len(own)})
        return pa.Table.from_pylist(rows, _SENT_ARROW)

    def tell_strings(t: pa.Table) -> pa.Table:
        import zstandard

        squeeze, parts, blobs = zstandard.ZstdDecompressor(), [], []
        for packed, k in zip(t["packed"].to_pylist(), t["segments"].to_pylist(), strict=True):
            raw = squeeze.decompress(packed)
            strings, at = np.frombuffer(raw, "<u4", k).astype(np.int64), 16 * k
            parts.append((np.frombuffer(raw, "<u4", k, 4 * k), strings, np.frombuffer(raw, np.int64, k, 8 * k)))
            for size in (strings + length - 1).tolist():
                blobs.append(raw[at : at + size])
                at += size
        anchors, strings, least = (np.concatenate([r[k] for r in parts]) for k in range(3))
        gone = answer_block(blobs, anchors, strings, least, length)
        rows, at = [], 0
        for chunk, (_, own, _) in zip(t["chunk"].to_pylist(), parts, strict=True):
            k = int(own.sum())
            rows.append({"chunk": chunk, "bucket": t["bucket"][0].as_py(), "of_strings": True, "bits": _bits(gone[at : at + k])})
            at += k
        return pa.Table.from_pylist(rows, _ANSWER_ARROW)

    def remove(docs_of: pa.Table, answers: pa.Table) -> pa.Table:
        c = again(docs_of, answers)
        first = np.concatenate([[0], np.cumsum(c.strings)]).astype(np.int64)
        gone = np.zeros(int(first[-1]), bool)
        bits = {b: x for b, of_strings, x in zip(answers["bucket"].to_pylist(), answers["of_strings"].to_pylist(), answers["bits"].to_pylist(), strict=True) if of_strings}
        for b, own in c.by_bucket():
            k = c.strings[own]
            to = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k - first[own], k)
            gone[to] = _flags(bits[b], int(k.sum()))
        out: list[tuple] = []
        edges = np.searchsorted(c.members[:, 0], np.arange(len(c.slices) + 1))
        for number, (_, raw, offsets, rows, _) in enumerate(c.slices):
            begins = np.zeros(len(raw) + length, np.int8)
            own = slice(int(edges[number]), int(edges[number + 1]))
            kind, start = c.kind[own], c.members[own, 2]
            k = c.strings[kind]
            step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            # The chunk's smallest owner of a segment asks the others; any later one has it from that owner.
            all_gone = np.repeat(c.owner[own] > c.least[kind], k)
            begins[np.repeat(start, k) + step] = all_gone | gone[np.repeat(first[kind], k) + step]
            change = begins.astype(np.int32)
            change[length:] -= begins[:-length]
            covered = np.cumsum(change)[: len(raw)] > 0
            any_in = np.add.reduceat(np.concatenate([covered, [False]]).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0) if len(rows) else []
            for r, a, b, some in zip(rows.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), any_in, strict=True):
                if some:
                    out.append((r, b - a, _spans(covered[a:b]), raw[a:b][~covered[a:b]].tobytes()))
                else:
                    out.append((r, b - a, [], raw[a:b].tobytes()))
        cols = list(zip(*out, strict=True))
        return pa.Table.from_arrays(
            [docs_of["doc_id"].take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], _SPANS), pa.array(cols[3], pa.binary())],
            ["doc_id", "n_bytes", "spans", "kept"],
        )

    def result(docs_of: pa.Table, answers: pa.Table) -> pa.Table:
        if docs_of.num_rows:
            return remove(docs_of, answers)
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "spans": pa.array([], _SPANS), "kept": pa.array([], pa.binary())})

    by_chunk = chunks.groupBy("chunk")
    shared = by_chunk.applyInArrow(ask, _ASKED).repartition(n, "bucket").groupBy("bucket").applyInArrow(tell_shared, _ANSWER)
    sent = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(send, _SENT)
    strings = sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(tell_strings, _ANSWER)
    return by_chunk.cogroup(shared.unionByName(strings).groupBy("chunk")).applyInArrow(result, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_strings(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
