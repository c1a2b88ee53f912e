"""Token ids in binary files: fixed-size blocks transposed into byte (or bit) planes, each plane compressed with zstandard.

One file per range of doc_id:

    magic "IDPLANE1"
    planes of block 0, planes of block 1, ...
    footer, zstandard-compressed JSON: unit, per block [ids, [plane sizes]], and the byte length of the two arrays below
    doc ids (little-endian int64), null flags (uint8), tokens per document (uint32), zstandard-compressed together
    footer length, array length (little-endian uint64 each), magic

A plane that is all zero has size 0 and takes no bytes.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import SLICE_BYTES, Encoder, shared_dir, slices, table, text_bytes, tidy, width

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
END_ID = 2


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a local path or of a URI that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """Planes of one block, from the least significant on; b"" for one that is all zero."""
    ids = ids.astype("<u4", copy=False)
    if unit == "byte":
        planes = np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T)
    else:
        planes = [np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1) for b in range(32)]
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    if unit == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                out[:, k] = np.frombuffer(p, np.uint8)
        return out.reshape(-1).view("<u4")
    ids = np.zeros(n, "<u4")
    for b, p in enumerate(planes):
        if p:
            ids |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype("<u4") << np.uint32(b)
    return ids


class Writer:
    """Writes one file; holds one block of ids, and 13 bytes for each document until it closes."""

    def __init__(self, out, unit: str = "byte", block: int = BLOCK, level: int = 3):
        import zstandard

        self.out, self.unit, self.block, self.pack = out, unit, block, zstandard.ZstdCompressor(level=level)
        self.held: list[bytes] = []
        self.n_held = 0
        self.blocks: list[list] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        full = len(ids) if last else len(ids) - len(ids) % self.block
        for i in range(0, full, self.block):
            part = ids[i : min(i + self.block, full)]
            planes = [self.pack.compress(p) if p else b"" for p in to_planes(part, self.unit)]
            self.blocks.append([len(part), [len(p) for p in planes]])
            self.out.write(b"".join(planes))
        self.held = [ids[full:].tobytes()]
        self.n_held = len(ids) - full

    def close(self) -> int:
        self._flush(True)
        foot = self.pack.compress(json.dumps({"unit": self.unit, "blocks": self.blocks, "docs": len(self.docs)}).encode())
        nulls = np.array([d is None for d in self.docs], np.uint8)
        arrays = self.pack.compress(np.array([d or 0 for d in self.docs], "<i8").tobytes() + nulls.tobytes() + np.array(self.counts, "<u4").tobytes())
        self.out.write(foot + arrays + struct.pack("<QQ", len(foot), len(arrays)) + MAGIC)
        return sum(self.counts)


def read_file(source):
    """Yields (doc_id, ids as little-endian uint32 pieces in order) of a file opened for random access; one block is held at a time."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    source.seek(0, 2)
    end = source.tell()
    source.seek(end - 24)
    n_foot, n_arrays = struct.unpack("<QQ", source.read(16))
    if source.read(8) != MAGIC:
        raise ValueError("not a token id file, or cut short")
    source.seek(end - 24 - n_foot - n_arrays)
    foot = json.loads(unpack.decompress(source.read(n_foot)))
    arrays, n = unpack.decompress(source.read(n_arrays)), foot["docs"]
    docs, nulls, counts = np.frombuffer(arrays, "<i8", n), np.frombuffer(arrays, np.uint8, n, 8 * n), np.frombuffer(arrays, "<u4", n, 9 * n)
    source.seek(len(MAGIC))

    def blocks():
        for size, planes in foot["blocks"]:
            yield from_planes([unpack.decompress(source.read(k)) if k else b"" for k in planes], size, foot["unit"])

    stream, held, at = blocks(), np.zeros(0, "<u4"), 0
    for d, null, left in zip(docs.tolist(), nulls.tolist(), counts.tolist(), strict=True):
        pieces = []
        while left:
            if at == len(held):
                held, at = next(stream), 0
            take = min(left, len(held) - at)
            pieces.append(held[at : at + take])
            at += take
            left -= take
        yield None if null else d, pieces


def write_token_files(docs: DataFrame, tokenizer: str, out_dir: str, end_id: int = END_ID, unit: str = "byte") -> list[tuple[str, int]]:
    """Write all documents in ascending doc_id order, one file per range of it; returns (path, ids in it) in that order.

    A task writes under a name of its own and renames when whole, so a task that runs twice leaves one whole file.
    Null doc_ids come first; null texts are the end id alone; equal doc_ids are ordered by a hash of the text; other
    columns aren't read. A very long text is tokenised window by window; its ids are held whole until they are written.
    The driver gets one row for each file.
    """
    n = width(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(n, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")

    def run(batches):
        from pyspark import TaskContext

        enc, end = Encoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        ctx, fs, root = TaskContext.get(), *filesystem(out_dir)
        final = f"{root}/part-{ctx.partitionId():06d}.ids"
        own, writer, sink = f"{final}.{ctx.taskAttemptId()}", None, None
        for b in batches:
            raw, offsets = text_bytes(b.column(1))
            for i, j in slices(b, np.diff(offsets), SLICE_BYTES):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(own, compression=None)
                    writer = Writer(sink, unit)
                encoded = enc.encode_bytes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for d, ids in zip(b.column(0).slice(i, j - i).to_pylist(), encoded, strict=True):
                    writer.add(d, ids + end)
        if writer is not None:
            total = writer.close()
            sink.close()
            fs.move(own, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([ctx.partitionId()], pa.int64()), "n": pa.array([total], pa.int64())})

    rows = sorted(ordered.select("doc_id", "text").mapInArrow(tidy(run), "part long, n long").collect())
    return [(f"{out_dir}/part-{p:06d}.ids", n) for p, n in rows]


def read_token_files(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32; start counts over the files in the order given."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    bases = np.concatenate([[0], np.cumsum([n for _, n in files])]).tolist()
    listed = spark.createDataFrame([(p, b) for (p, _), b in zip(files, bases, strict=False)], "path string, base long").repartition(len(files))

    def run(batches):
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, local = filesystem(path)
                rows: list[tuple] = []
                with fs.open_input_file(local) as source:
                    for d, pieces in read_file(source):
                        n, crc = 0, 0
                        for p in pieces:
                            n, crc = n + len(p), zlib.crc32(p, crc)
                        rows.append((d, at, n, crc))
                        at += n
                        if len(rows) == 8192:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, schema)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out_dir = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out_dir))
