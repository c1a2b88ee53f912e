"""Sequence packing by shortest-pack-first over the length histogram.

Documents become pieces of at most one sequence each. Only the histogram of piece lengths (as many rows as a
sequence has tokens) goes to the driver, which places lengths longest first, always into the pack with the
most room, and counts equal packs as one pattern. Pieces then find their pattern slot by their rank among
pieces of their length; ranks are dealt over salted parts, so that one very common length is no hot key.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import SLICE_BYTES, Encoder, materialize, slices, table, text_bytes, tidy, width

SEQUENCE = 2048
END_ID = 1


def cut_pieces(docs: DataFrame, path: str, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """Tokenise whole texts, append end_id, and cut at every multiple of size. No shuffle.

    Returns doc_id, start, length, ids_crc32, doc_tokens. A null or empty text is the end id alone.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc, end = Encoder.of(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            raw, offsets = text_bytes(b.column(1))
            for i, j in slices(b, np.diff(offsets), SLICE_BYTES):
                part = b.slice(i, j - i)
                rows, starts, lengths, crcs, totals = [], [], [], [], []
                for r, ids in enumerate(enc.encode_bytes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
                    ids += end
                    n = len(ids) // 4
                    for s in range(0, n, size):
                        piece = ids[4 * s : 4 * (s + size)]
                        rows.append(r)
                        starts.append(s)
                        lengths.append(len(piece) // 4)
                        crcs.append(zlib.crc32(piece))
                        totals.append(n)
                cols = [part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns as (how many packs, lengths in them). Work depends on size, not on the counts."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max(room, default=0)
            if most < length:
                room.setdefault(size - length, []).append((left, (length,)))
                break
            count, lengths = room[most].pop()
            if not room[most]:
                del room[most]
            take = min(count, left)
            if count > take:
                room.setdefault(most, []).append((count - take, lengths))
            room.setdefault(most - length, []).append((take, (*lengths, length)))
            left -= take
    return [p for r in sorted(room) for p in room[r]]


def slot_table(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Slots sorted by (length, first rank): ranks from there on up to the next slot belong to it."""
    used: dict[int, int] = {}
    keys, seqs, offsets, base = [], [], [], 0
    for count, lengths in patterns:
        at = 0
        for n in lengths:
            rank = used.get(n, 0)
            keys.append((n << 44) + rank)
            seqs.append(base - rank)
            offsets.append(at)
            used[n] = rank + count
            at += n
        base += count
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return {k: np.array(v, np.int64)[order] for k, v in (("key", keys), ("shift", seqs), ("offset", offsets))}


def pack(docs: DataFrame, path: str, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """Pieces with sequence_id and offset. Every id of every document lies in one piece.

    Null text: the end id alone. Null doc_id: kept as null. Repeated rows: packed each. Empty table: no rows.
    Other columns aren't read. Pieces of a document may lie in different sequences. A very long text is tokenised
    window by window; only its ids, four bytes a token, are held whole.
    """
    spark = docs.sparkSession
    salted = cut_pieces(docs, path, end_id, size).withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(4 * width(spark))))
    pieces = materialize(salted, "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    slots = spark.sparkContext.broadcast(slot_table(shortest_pack_first(histogram, size)))

    # The rank within (length, part) and the count of earlier parts meet at one exchange, on (length, part).
    own = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("own", F.row_number().over(own) - 1)
        .join(before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("own") + F.col("before")).cast("long").alias("rank"))
    )

    def place(batches):
        s = slots.value
        for b in batches:
            n, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            at = np.searchsorted(s["key"], (n << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(s["shift"][at] + rank), pa.array(s["offset"][at])], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
