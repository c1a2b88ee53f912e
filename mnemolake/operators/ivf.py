"""Approximate cosine search by an inverted file of short codes.

Unit vectors fall to cells, as many as the square root of their number (CENTERS at most). Within a cell a vector is kept
as a product-quantised residual: a byte for every few dimensions. A query meets the codes of its nearest cells, decoded
and multiplied block by block; only its best candidates are read as whole vectors and scored exactly. Queries travel to
the cells they probe, in groups of bounded size, so neither they nor candidates pass through the driver; it only holds
the quantiser, which is fitted on a bounded sample.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.columns import cosine
from mnemolake.operators.vectors import CENTERS, _unit, assign, fit_centers
from mnemolake.plans.storage import materialize, shared_dir

CODES = 256
WIDTH = 4  # dimensions of a code
BLOCK = 32_768  # codes that a task decodes at once
QUERIES = 1024  # queries that meet them at once
COPIES = 100  # ids kept of one direction; no search gives more of them


class Quantiser(NamedTuple):
    centers: np.ndarray
    books: list[np.ndarray]  # codewords of each group of dimensions

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        out, at = np.zeros((len(residuals), len(self.books)), np.uint8), 0
        for j, book in enumerate(self.books):
            part = residuals[:, at : at + book.shape[1]]
            out[:, j] = (part @ book.T - (book**2).sum(1) / 2).argmax(1)
            at += book.shape[1]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)


def fit(vectors: DataFrame, cells: int, sample: int = 32_768, steps: int = 6) -> Quantiser | None:
    """Cells' centres, and codewords of the residuals of a bounded sample; None without any usable vector. The most frequent length of vector counts."""
    rows = [u for u in _unit(vectors.select("v").orderBy(F.xxhash64("v"), "id").limit(sample).toArrow()["v"].combine_chunks()) if u is not None]
    if not rows:
        return None
    lengths = np.array([len(u) for u in rows])
    dim = int(np.bincount(lengths).argmax())
    x = np.stack([u for u in rows if len(u) == dim])
    same = vectors.where(F.size("v") == dim)
    c = np.stack(fit_centers(same, cells))
    r = x - c[(x @ c.T).argmax(1)]
    books = []
    for at in range(0, dim, WIDTH):
        part = r[:, at : at + WIDTH]
        book = part[np.linspace(0, len(part) - 1, min(CODES, len(part))).astype(int)].copy()
        for _ in range(steps):
            near = (part @ book.T - (book**2).sum(1) / 2).argmax(1)
            n = np.bincount(near, minlength=len(book))
            total = np.stack([np.bincount(near, part[:, d], len(book)) for d in range(part.shape[1])], 1)
            book[n > 0] = total[n > 0] / n[n > 0, None]
        books.append(book)
    return Quantiser(c, books)


def build(vectors: DataFrame, quantiser: Quantiser) -> tuple[DataFrame, DataFrame]:
    """((cell, block, ids, codes) of all distinct directions of the quantiser's length, written by cell; (first, id): the ids
    of each direction, up to COPIES, with the smallest, which the index names). So copies don't crowd out other candidates."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(quantiser)
    dim = quantiser.centers.shape[1]
    placed = assign(vectors.where(F.size("v") == dim).select("id", F.lit("").alias("g"), "v"), list(quantiser.centers))

    placed = materialize(placed, "directions")
    rank = F.row_number().over(Window.partitionBy(F.sha2("u", 256)).orderBy("id"))
    some = placed.select("id", F.sha2("u", 256).alias("h"), rank.alias("at")).where(F.col("at") <= COPIES)
    first = some.where("at = 1").select("h", F.col("id").alias("first"))
    members = materialize(some.join(first, "h").select("first", "id"), "members")
    placed = placed.join(first.select(F.col("first").alias("id")), "id", "left_semi")

    def encode(batches):
        q = sent.value
        for b in batches:
            cell = b.column(2).to_numpy()
            u = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(len(cell), dim)
            codes = np.ascontiguousarray(q.encode(u - q.centers[cell]))
            packed = pa.Array.from_buffers(pa.binary(codes.shape[1]), len(cell), [None, pa.py_buffer(codes)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), packed], ["id", "cell", "code"])

    coded = materialize(placed.select("id", "u", "cell").mapInArrow(encode, "id string, cell int, code binary"), "codes")
    full = coded.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))

    def stack(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table([[key[0].as_py()], [key[1].as_py()], [t["id"].to_pylist()], [b"".join(t["code"].to_pylist())]], schema=pa.schema([("cell", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(pa.string())), ("codes", pa.binary())]))

    x = coded.join(full, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).select("cell", "block", "id", "code")
    path = f"{shared_dir(spark)}/inverted-{np.random.default_rng().integers(1 << 62):x}"
    made = x.groupBy("cell", "block").applyInArrow(stack, "cell int, block long, ids array<string>, codes binary")
    made.write.partitionBy("cell").parquet(path)
    return spark.read.schema("block long, ids array<string>, codes binary, cell int").parquet(path), members


def search(index: DataFrame, members: DataFrame, quantiser: Quantiser, vectors: DataFrame, queries: DataFrame, k: int, probe: int, best: int, least: float) -> DataFrame:
    """qid, id, s, rk: of every query (qid, qv) the k best of its best candidates by code, scored exactly.

    probe: how many cells a query meets. Queries of another length, or without a direction, find nothing.
    """
    spark, dim = index.sparkSession, quantiser.centers.shape[1]
    sent = spark.sparkContext.broadcast(quantiser)
    many = max(1, min(probe, len(quantiser.centers)))
    asked = materialize(queries.where(F.size("qv") == dim).select("qid", "qv"), "asked")
    turns = max(1, -(-asked.count() // QUERIES))

    def spread(batches):
        c = sent.value.centers
        for b in batches:
            units = _unit(b.column(1))
            keep = [j for j, u in enumerate(units) if u is not None]
            if not keep:
                continue
            u = np.stack([units[j] for j in keep])
            cells = np.argsort(-(u @ c.T), axis=1, kind="stable")[:, :many]
            taken = pa.array(np.repeat(keep, cells.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), pa.array([x for row in u for x in [row.tobytes()] * cells.shape[1]], pa.binary()), pa.array(cells.ravel().astype(np.int32))], ["qid", "u", "cell"])

    sent_to = asked.mapInArrow(spread, "qid string, u binary, cell int").withColumn("turn", F.pmod(F.xxhash64("qid"), F.lit(turns)))
    there = sent_to.select("cell", "turn").distinct().join(index, "cell").select(*[F.col(c).alias(c) for c in ("cell", "turn", "block", "ids", "codes")])
    here = sent_to.join(index.select("cell", "block"), "cell").select(*[F.col(c).alias(c) for c in ("cell", "turn", "block")], "qid", "u")

    def meet(codes: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if codes.num_rows and asking.num_rows:
            q = sent.value
            ids, raw = np.array(codes["ids"][0].as_py(), object), np.frombuffer(codes["codes"][0].as_py(), np.uint8)
            x = q.decode(raw.reshape(len(ids), -1)) + q.centers[codes["cell"][0].as_py()]
            names = asking["qid"].to_pylist()
            s = np.frombuffer(b"".join(asking["u"].to_pylist()), np.float64).reshape(len(names), dim) @ x.T
            top = np.argpartition(-s, best - 1, axis=1)[:, :best] if best < len(ids) else np.tile(np.arange(len(ids)), (len(names), 1))
            for name, at, scores in zip(names, top, s, strict=True):
                out[0] += [name] * len(at)
                out[1] += ids[at].tolist()
                out[2] += scores[at].tolist()
        return pa.table(out, schema=pa.schema([("qid", pa.string()), ("id", pa.string()), ("near", pa.float64())]))

    met = there.groupBy("cell", "turn", "block").cogroup(here.groupBy("cell", "turn", "block")).applyInArrow(meet, "qid string, id string, near double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("near"), "id"))
    candidates = met.withColumn("at", rank).where(F.col("at") <= best).select("qid", "id")
    x = candidates.join(vectors.select("id", "v"), "id").join(asked, "qid").select("qid", F.col("id").alias("first"), F.round(cosine("qv", "v"), 9).alias("s")).where(F.col("s") >= least)
    x = x.join(members, "first").select("qid", "id", "s")
    return x.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "id"))).where(F.col("rk") <= k)


def cells_for(n: int) -> int:
    return max(1, min(CENTERS, round(n**0.5)))
