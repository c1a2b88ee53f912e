"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: lines, cut further behind sentences and at about every sixteenth space, chosen by the
characters before it, so that a cut depends on nothing far away. A digest holds 48 bits of hash (a repeated paragraph
also hashes its number among equals) and 16 bits of length. Each digest is added to three cells of a sketch: a count,
and exclusive ors of digests and of check hashes. Two sketches subtract cell by cell, common paragraphs vanish, and
peeling cells that hold one digest recovers what only one of the two texts has. A sketch of 2**k cells folds into
any smaller one. Where peeling stops short, both sketches are made again, four times as large.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import SLICE_BYTES, slices, table, tidy, width

LEAST_CELLS, MOST_CELLS = 8, 256
LONGEST = 65535  # of a paragraph's length in its digest
_HEAD = struct.Struct("<IQ")  # paragraphs, and their bytes


class Cells(NamedTuple):
    """Cells of one sketch, or of many one behind the other."""

    n: np.ndarray  # int32
    check: np.ndarray  # uint32
    key: np.ndarray  # uint64

    @classmethod
    def empty(cls, size: int) -> "Cells":
        return cls(np.zeros(size, np.int32), np.zeros(size, np.uint32), np.zeros(size, np.uint64))

    def part(self, begin: int, end: int) -> "Cells":
        return Cells(*(x[begin:end] for x in self))

    def put(self, places: np.ndarray, keys: np.ndarray, signs: np.ndarray | int = 1) -> None:
        """Add the digests, or with a sign of -1 take them out again, at the given rows of places."""
        check = _checks(keys)
        for row in places:
            np.add.at(self.n, row, np.int32(signs) if np.isscalar(signs) else signs.astype(np.int32))
            np.bitwise_xor.at(self.key, row, keys)
            np.bitwise_xor.at(self.check, row, check)

    def __sub__(self, other: "Cells") -> "Cells":
        return Cells(self.n - other.n, self.check ^ other.check, self.key ^ other.key)

    def fold(self, into: int) -> "Cells":
        """The same sketch with fewer cells, a power of two."""
        if len(self.n) == into:
            return self
        n, check, key = (x.reshape(-1, into) for x in self)
        return Cells(n.sum(0, dtype=np.int32), np.bitwise_xor.reduce(check, 0), np.bitwise_xor.reduce(key, 0))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(raw: np.ndarray) -> np.ndarray:
    """Ends of the paragraphs of one text's bytes."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    blank, end = raw == 32, raw == 10
    sentence = np.zeros(n, bool)
    sentence[1:] = blank[1:] & ((raw[:-1] == 46) | (raw[:-1] == 33) | (raw[:-1] == 63))
    chosen = np.zeros(n, bool)
    if n > 4:
        before = np.zeros(n - 4, np.uint32)
        for k in range(4):
            before |= raw[3 - k : n - 1 - k].astype(np.uint32) << np.uint32(8 * k)
        chosen[4:] = blank[4:] & (before * np.uint32(0x9E3779B1) >> np.uint32(28) == 0)
    ends = np.flatnonzero(end | sentence | chosen) + 1
    return ends if len(ends) and ends[-1] == n else np.append(ends, n)


def digests(raw: np.ndarray) -> np.ndarray:
    """The distinct digests of one text's paragraphs."""
    import xxhash

    ends = cuts(raw)
    data, out, at = raw.tobytes(), [], 0
    for e in ends.tolist():
        out.append(xxhash.xxh3_64_intdigest(data[at:e]))
        at = e
    key = np.array(out, np.uint64)
    sizes = np.minimum(np.diff(ends, prepend=0), LONGEST).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(key) else np.zeros(0, np.int64)
    number = np.zeros(len(key), np.uint64)
    number[order] = (np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))).astype(np.uint64)
    key = _mixed(key + number * np.uint64(0x9E3779B97F4A7C15))
    return (key & ~np.uint64(LONGEST)) | sizes


def weights(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(LONGEST)).astype(np.int64)


def _checks(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def _places(keys: np.ndarray, cells: np.ndarray | int) -> np.ndarray:
    """The three cells of each digest, a row for each; cells: how many its sketch has, a power of two."""
    cells = np.asarray(cells, np.uint64)
    g, h = _mixed(keys), _mixed(keys ^ np.uint64(0xA0761D6478BD642F))
    return np.stack([g & (cells - np.uint64(1)), (g >> np.uint64(32)) & (cells - np.uint64(1)), h & (cells - np.uint64(1))]).astype(np.int64)


def sketches(keys: np.ndarray, owner: np.ndarray, cells: np.ndarray) -> tuple[Cells, np.ndarray]:
    """(all cells, where each sketch begins): digests of many texts, each with its text's number and each text with its cells."""
    begin = np.concatenate([[0], np.cumsum(cells)])
    flat = Cells.empty(int(begin[-1]))
    flat.put(_places(keys, cells[owner]) + begin[owner], keys)
    return flat, begin


def cells_for(paragraphs: np.ndarray | int) -> np.ndarray:
    """Cells of a stored fingerprint: a power of two, about half as many as paragraphs, within bounds."""
    want = np.maximum(np.asarray(paragraphs) // 2, 1)
    return np.clip(1 << np.ceil(np.log2(want)).astype(np.int64), LEAST_CELLS, MOST_CELLS)


def write(cells: Cells, paragraphs: int, size: int) -> str:
    return base64.b64encode(_HEAD.pack(paragraphs, size) + cells.n.astype("<i4").tobytes() + cells.check.astype("<u4").tobytes() + cells.key.astype("<u8").tobytes()).decode()


def read(fingerprint: str) -> tuple[Cells, int, int]:
    """(cells, paragraphs, their bytes)."""
    raw = base64.b64decode(fingerprint)
    m = (len(raw) - _HEAD.size) // 16
    return Cells(*(np.frombuffer(raw, kind, m, _HEAD.size + at * m) for kind, at in (("<i4", 0), ("<u4", 4), ("<u8", 8)))), *_HEAD.unpack_from(raw)


def subtract(a: Cells, b: Cells) -> Cells:
    """The difference at the smaller of the two sizes."""
    n = min(len(a.n), len(b.n))
    return a.fold(n) - b.fold(n)


def peel(given: Cells, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digests, their pair, 1 if only the first text has it and -1 if only the second, is the pair's difference whole?) of many differences at once."""
    flat, sizes = Cells(*(x.copy() for x in given)), np.diff(begin)
    pair = np.repeat(np.arange(len(sizes)), sizes)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.arange(len(flat.n))
    while len(look):  # each round takes digests out for good, or is the last
        one = look[np.abs(flat.n[look]) == 1]
        one = one[flat.check[one] == _checks(flat.key[one])]
        at = _places(flat.key[one], sizes[pair[one]]) + begin[pair[one]]
        real = (at == one).any(0)
        one, at = one[real], at[:, real]
        key, of = flat.key[one], pair[one]
        order = np.lexsort((key, of))
        again = np.zeros(len(order), bool)
        again[1:] = (key[order[1:]] == key[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        once = order[~again]
        key, of, sign, at = key[once], of[once], flat.n[one[once]].astype(np.int64), at[:, once]
        flat.put(at, key, -sign)
        found.append((key, of, sign))
        look = np.unique(at)
    rest = np.bincount(pair, (flat.n != 0) | (flat.key != 0) | (flat.check != 0), len(sizes))
    key, of, sign = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return key, of, sign, rest == 0


class Texts:
    """Digests and sketches of a bounded number of texts."""

    def __init__(self, texts: list[bytes]):
        each = [digests(np.frombuffer(t, np.uint8)) for t in texts]
        self.n = np.array([len(d) for d in each], np.int64)
        self.keys = np.concatenate(each) if each else np.zeros(0, np.uint64)
        self.begin = np.concatenate([[0], np.cumsum(self.n)])
        self.owner = np.repeat(np.arange(len(each)), self.n)
        self.size = np.array([int(weights(d).sum()) for d in each], np.int64)
        self.cells, self.at = sketches(self.keys, self.owner, cells_for(self.n))

    def sketch(self, k: int) -> Cells:
        return self.cells.part(self.at[k], self.at[k + 1])

    def fingerprint(self, k: int) -> str:
        return write(self.sketch(k), int(self.n[k]), int(self.size[k]))

    def some(self, rows: np.ndarray, cells: np.ndarray) -> tuple[Cells, np.ndarray]:
        """Sketches of these texts, as large as asked for."""
        n = self.n[rows]
        at = np.repeat(self.begin[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return sketches(self.keys[at], np.repeat(np.arange(len(rows)), n), cells)


def differences(a: Texts, rows_a: np.ndarray, b: Texts, rows_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digests, pair, sign, cells used by each pair) of pairs of texts: stored fingerprints first, then ever larger ones.

    A failed pair is tried again with four times the cells: with more than three cells for each digest of both texts
    nearly every difference peels, and each further try deals the digests by more bits of their hashes.
    """
    out, left = [], np.arange(len(rows_a))
    used = np.zeros(len(rows_a), np.int64)
    cells = np.minimum(cells_for(a.n[rows_a]), cells_for(b.n[rows_b]))
    while len(left):
        if not used.any():
            parts = [subtract(a.sketch(i), b.sketch(j)) for i, j in zip(rows_a.tolist(), rows_b.tolist(), strict=True)]
            flat, begin = Cells(*(np.concatenate(x) for x in zip(*parts, strict=True))), np.concatenate([[0], np.cumsum(cells[left])])
        else:
            flat, begin = a.some(rows_a[left], cells[left])
            flat = flat - b.some(rows_b[left], cells[left])[0]
        key, of, sign, whole = peel(flat, begin)
        used[left] = cells[left]
        good = whole[of]
        out.append((key[good], left[of[good]], sign[good]))
        left = left[~whole]
        cells[left] *= 4
    key, of, sign = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), left, left)
    return key, of, sign, used


def likeness(a: Texts, rows_a: np.ndarray, b: Texts, rows_b: np.ndarray) -> np.ndarray:
    """1 less the share of both texts' bytes that lie in differing paragraphs; two texts without bytes are alike."""
    key, of, _, _ = differences(a, rows_a, b, rows_b)
    apart = np.zeros(len(rows_a), np.int64)
    np.add.at(apart, of, weights(key))
    total = a.size[rows_a] + b.size[rows_b]
    return np.where(total > 0, 1 - apart / np.maximum(total, 1), 1.0)


def compare(a: str, b: str) -> tuple[list[int], list[int]] | None:
    """(digests that only the first fingerprint has, only the second) from the fingerprints alone; None if they are too small for it."""
    diff = subtract(read(a)[0], read(b)[0])
    key, _, sign, whole = peel(diff, np.array([0, len(diff.n)]))
    return (sorted(key[sign > 0].tolist()), sorted(key[sign < 0].tolist())) if whole[0] else None


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text is empty. No shuffle; other columns aren't read."""

    def run(batches):
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            for i, j in slices(b, np.array([len(t) for t in texts]), SLICE_BYTES):
                made = Texts(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([made.fingerprint(k) for k in range(j - i)], pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, fingerprint string")


def version_differences(old: DataFrame, new: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, removed, added (paragraph digests), likeness, cells for the ids of both tables: one equi-join, whole texts.

    A repeated id meets each of its versions on the other side; a null id meets none; null texts are empty.
    """
    both = old.select(old[id_col].alias("doc_id"), old[text_col].alias("a")).join(new.select(new[id_col].alias("doc_id"), new[text_col].alias("b")), "doc_id")

    def run(batches):
        for batch in batches:
            left, right = ([(t or "").encode() for t in batch.column(k).to_pylist()] for k in (1, 2))
            for i, j in slices(batch, np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64), SLICE_BYTES):
                a, b, rows = Texts(left[i:j]), Texts(right[i:j]), np.arange(j - i)
                key, of, sign, used = differences(a, rows, b, rows)
                key = key.astype(np.int64)
                lists = [[np.sort(key[(of == k) & (sign == s)]).tolist() for k in rows] for s in (1, -1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x, pa.list_(pa.int64())) for x in lists), pa.array(likeness(a, rows, b, rows)), pa.array(used)], ["doc_id", "removed", "added", "likeness", "cells"])

    kind = old.schema[id_col].dataType.simpleString()
    return both.mapInArrow(tidy(run), f"doc_id {kind}, removed array<long>, added array<long>, likeness double, cells long")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, part, halo), dealt and sorted so that a row's successor is the row behind it in its part.

    Rows are dealt by ranges of ids; each part also gets, marked halo, the first row of the next part that has rows, the
    last part that of the first. Bounds come from a sample of at most 30 ids for each task, the least id of each part
    from all; both are one small row for each part on the driver. Equal ids lie in one part and are ordered by text;
    null ids come first.
    """
    spark, n = docs.sparkSession, width(docs.sparkSession)
    docs = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    sample = sorted(r[0] for r in ids.where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(30 * n).collect())
    bounds = sorted({sample[k * len(sample) // n] for k in range(1, n)} if sample else set())
    kind = docs.schema["doc_id"].dataType
    step = max(1, int(len(bounds) ** 0.5))

    def listed(values) -> F.Column:
        return F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(f"array<{kind.simpleString()}>")

    def below(values: F.Column) -> F.Column:
        return F.size(F.filter(values, lambda b: b <= F.col("doc_id")))

    # The coarse bounds tell which few of the fine ones to look at.
    coarse = below(listed(bounds[step - 1 :: step]))
    part = (coarse * step + below(F.slice(listed(bounds), coarse * step + 1, step))).cast("int")
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(part)
    least = {r["part"]: r["least"][0] for r in ids.select(part.alias("part"), "doc_id").groupBy("part").agg(F.min(F.struct("doc_id")).alias("least")).collect()}
    there = sorted(least)
    to = dict(zip(there, [there[-1], *there[:-1]] if there else [], strict=True))
    firsts, before = listed([least.get(p) for p in range(len(bounds) + 1)]), F.array(*[F.lit(to.get(p, 0)) for p in range(len(bounds) + 1)])
    first = F.element_at(firsts, F.col("part") + 1).eqNullSafe(F.col("doc_id"))
    copies = F.when(first, F.array(F.struct("part", F.lit(False).alias("halo")), F.struct(F.element_at(before, F.col("part") + 1).alias("part"), F.lit(True).alias("halo")))).otherwise(F.array(F.struct("part", F.lit(False).alias("halo"))))
    dealt = docs.withColumn("part", part).select("doc_id", "text", F.explode(copies).alias("to")).select("doc_id", "text", "to.part", "to.halo")
    return dealt.repartitionById(max(1, len(bounds) + 1), F.col("part")).sortWithinPartitions("part", "halo", F.asc_nulls_first("doc_id"), "text")


def edited_text(text: str, following: str) -> str:
    """The last half of the text's code points replaced by as many of the following one's first, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    A null text is empty; a repeated id's rows follow each other by text; a single row is its own successor; an empty
    table gives an empty result; a very long text is taken up by itself. Other columns aren't read. Texts are shuffled
    once.
    """

    def pairs(batches):
        """(id, text, next text), the next row in the part, or its first halo row."""
        held = None
        for b in batches:
            for d, t, p, halo in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None and held[2] == p:
                    yield held[0], held[1], t
                    held = None
                elif held is not None:
                    raise ValueError("a part without its halo row")
                if not halo:
                    held = (d, t, p)
                # further halo rows of a part have no row before them
        if held is not None:
            raise ValueError("a part without its halo row")

    def run(batches):
        rows, size = [], 0
        for d, t, following in pairs(batches):
            rows.append((d, t, following))
            size += len(t)
            if size >= SLICE_BYTES // 2:
                yield finish(rows)
                rows, size = [], 0
        if rows:
            yield finish(rows)

    def finish(rows):
        n, at = len(rows), np.arange(len(rows))
        given, following = [t for _, t, _ in rows], []
        for k, (_, _, f) in enumerate(rows):  # mostly the next row's text, whose sketch is then made once
            following.append(k + 1 if k + 1 < n and rows[k + 1][1] == f else len(given))
            if following[-1] == len(given):
                given.append(f)
        changed = [edited_text(t, f).encode() for _, t, f in rows]
        own, edited = Texts([t.encode() for t in given]), Texts(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _, _ in rows], ids), pa.array([len(t) for t in given[:n]], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
                pa.array([own.fingerprint(k) for k in range(n)]), pa.array([edited.fingerprint(k) for k in range(n)]),
                pa.array(likeness(own, at, edited, at)), pa.array(likeness(own, at, own, np.array(following))),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    ids = to_arrow_type(kind)
    schema = f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(tidy(run), schema)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_versions(table(spark, sf_dir, "documents"))
