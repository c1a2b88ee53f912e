"""Exact top-k inner products by a Voronoi join.

Vectors are grouped by their nearest pivot. Queries of a group first meet the data of their own group, which
gives each a k-th score so far; the group's summary is the smallest of these and the radius of its queries
round the pivot. For a vector s no query q of the group can score above pivot.s + radius * |s|, so s is sent to
the group only where that bound reaches the summary. Groups are solved block by block, and a query's best of
each block are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import materialize, table

K = 5
PIVOTS = 16
QUERY_BLOCK = 512
DATA_BLOCK = 2048
#: Vectors that meet a query group in one task, about.
TURN_ROWS = 1 << 16
SLACK = 1e-9
PACK = "cell int, block int, n int, ids binary, data binary"


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(256 * x) of every component as long; vectors that are null or hold null or non-finite parts are left out."""
    x = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda c: c.cast("double")).alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.where(F.col("v").isNotNull() & ~bad).select("vec_id", F.transform("v", lambda c: F.floor(256 * c).cast("long")).alias("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column; a shorter vector counts as zero in the parts it lacks."""
    flat, sizes = col.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(col).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.int64)
    out, at = np.zeros((len(sizes), dim), np.int64), 0
    for i, n in enumerate(sizes.tolist()):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def _scores(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Integer inner products; through floating point where every sum is below 2**53 and so exact."""
    if len(q) and len(s) and float(np.abs(q).max()) * float(np.abs(s).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ s.astype(np.float64).T).astype(np.int64)
    return q @ s.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best, ties to the smaller id."""
    n, m = scores.shape
    if m > k:
        floor = np.partition(scores, m - k, axis=1)[:, m - k]
        row, col = np.nonzero(scores >= floor[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    at = np.arange(len(row)) - np.searchsorted(row, row)
    return row[at < k], col[at < k]


def _pack(ids: np.ndarray, data: np.ndarray) -> tuple[int, bytes, bytes]:
    """Vectors in the narrowest of 2, 4 and 8 bytes that holds all of them."""
    most = max(-int(data.min(initial=0)), int(data.max(initial=0)) + 1)
    kind = "<i2" if most <= 1 << 15 else "<i4" if most <= 1 << 31 else "<i8"
    return len(ids), ids.astype("<i8").tobytes(), data.astype(kind).tobytes()


def _unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids) // 8
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, f"<i{len(data) // (n * dim)}").reshape(n, dim).astype(np.int64)


_NO_ID = np.iinfo(np.int64).max


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, turn_rows: int = TURN_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for each query row, against all rows of vectors but the query's own.

    Both tables hold vec_id and v (array<long>) and queries are rows of vectors. Ties go to the smaller vec_id (null
    last); equal rows are candidates of each other; fewer than k others give fewer rows; an empty table gives none.
    Empty vectors score 0 with every other, also where all are empty. Scores that might pass 64 bits (a squared length
    of 2**63 or more) raise ValueError, since the score column could not hold them.
    The pivots are `pivots` rows of least hash, a bounded sample that decides only which work is spared.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest, widest = vectors.agg(F.max(F.size("v")), F.max(squared)).first()
    if longest is None:
        return spark.createDataFrame([], schema)
    if widest >= 2.0**63 * (1 - 1e-9):
        raise ValueError(f"scores pass 64 bits: a vector has the squared length {widest:.3g}")
    dim = max(1, longest)  # empty vectors count as zero
    chosen = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(pivots).select("v").collect()
    at = np.zeros((len(chosen), dim))
    for i, r in enumerate(chosen):
        at[i, : len(r["v"])] = r["v"]
    pivot = spark.sparkContext.broadcast(at)

    def assign(batches, size):
        p = pivot.value
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                part = b.slice(i, 8192)
                ids = part.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                v = _matrix(part.column(1), dim)
                x = v.astype(np.float64)
                cell = ((p * p).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
                rows = []
                for c in np.unique(cell).tolist():
                    own = np.flatnonzero(cell == c)
                    for j in range(0, len(own), size):
                        pick = own[j : j + size]
                        rows.append((c, int(abs(hash((int(ids[pick[0]]), i, j)))) % (1 << 30), *_pack(ids[pick], v[pick])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["cell", "block", "n", "ids", "data"])

    packs = materialize(vectors.select("vec_id", "v").mapInArrow(lambda b: assign(b, DATA_BLOCK), PACK), "packs")

    # Queries of a cell are one group, or several of about QUERY_BLOCK where it holds more.
    per_cell = materialize(queries.select("vec_id", "v").mapInArrow(lambda b: assign(b, 1), PACK), "queries")
    blocks = {r["cell"]: -(-r["n"] // QUERY_BLOCK) for r in per_cell.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most `pivots` rows
    if not blocks:
        return spark.createDataFrame([], schema)
    per = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    g = F.concat_ws("-", "cell", F.pmod(F.xxhash64("ids", "data"), F.element_at(per, F.col("cell"))))
    groups = materialize(per_cell.select(g.alias("g"), "cell", "n", "ids", "data"), "query-groups")

    solved = "g string, q binary, best array<struct<score: long, id: long>>"

    def solve(queries_of, data_of):
        """Best k + 1 of each query over some packs: one more, since the query itself may be among them."""
        rows = []
        if queries_of.num_rows and data_of.num_rows:
            q_raw = list(zip(queries_of["ids"].to_pylist(), queries_of["data"].to_pylist(), strict=True))
            q = np.concatenate([_unpack(*r, dim)[1] for r in q_raw])
            best_id = np.full((len(q), k + 1), _NO_ID)
            best = np.full((len(q), k + 1), np.iinfo(np.int64).min)
            filled = np.zeros((len(q), k + 1), bool)
            for ids, data in zip(data_of["s_ids"].to_pylist(), data_of["s"].to_pylist(), strict=True):
                s_ids, s = _unpack(ids, data, dim)
                score = _scores(q, s)
                row, col = _best(score, s_ids, k + 1)
                got, got_id, got_full = (np.full((len(q), k + 1), f) for f in (np.iinfo(np.int64).min, _NO_ID, False))
                place = np.arange(len(row)) - np.searchsorted(row, row)
                got[row, place], got_id[row, place], got_full[row, place] = score[row, col], s_ids[col], True
                both, both_id, both_full = (np.concatenate(x, 1) for x in ((best, got), (best_id, got_id), (filled, got_full)))
                order = np.lexsort((both_id, np.where(both_full, -both, 0), ~both_full), axis=1)[:, : k + 1]
                best, best_id, filled = (np.take_along_axis(x, order, 1) for x in (both, both_id, both_full))
            for i, (ids, data) in enumerate(q_raw):
                rows.append({"q": ids + data, "best": [{"score": int(s), "id": int(d)} for s, d, f in zip(best[i], best_id[i], filled[i], strict=True) if f]})
        g = queries_of["g"][0].as_py() if queries_of.num_rows else None
        kind = pa.schema([("g", pa.string()), ("q", pa.binary()), ("best", pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())])))])
        return pa.Table.from_pylist([{"g": g, **r} for r in rows], schema=kind)

    # A group's vectors are dealt over so many turns that each is about turn_rows, from the counted packs.
    held = {r["cell"]: r["n"] for r in packs.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # at most `pivots` rows
    turns_of = lambda n: max(8, -(-n // turn_rows))
    total = sum(held.values())
    own_cells = F.create_map(*[F.lit(x) for c in held for x in (c, turns_of(held[c]))])
    own_turns, rest_turns = (F.create_map(*[F.lit(x) for c in blocks for x in (c, turns_of(n(c)))]) for n in (lambda c: held.get(c, 0), lambda c: total - held.get(c, 0)))

    # The queries' own cell, a few of its packs at a time: scores so far, and from them each group's summary.
    own = packs.withColumn("salt", F.pmod(F.col("block"), F.element_at(own_cells, F.col("cell"))).cast("int")).select("cell", "salt", "ids", "data")
    to = groups.select("g", "cell").distinct().join(own, "cell").select(F.col("g").alias("to"), F.col("salt").alias("turn"), F.col("ids").alias("s_ids"), F.col("data").alias("s"))
    once = groups.dropDuplicates(["g", "ids", "data"])

    def asked(turns):
        return once.select("g", F.explode(F.sequence(F.lit(0), F.element_at(turns, F.col("cell")) - 1)).alias("salt"), "ids", "data")

    first = materialize(asked(own_turns).groupBy("g", "salt").cogroup(to.groupBy("to", "turn")).applyInArrow(solve, solved), "own-cell")

    flat = first.select("g", "q", F.explode("best").alias("b"))
    ranked = flat.withColumn("r", F.row_number().over(Window.partitionBy("g", "q").orderBy(F.desc("b.score"), "b.id")))
    kth = ranked.where(F.col("r") == k + 1).groupBy("g").agg(F.min("b.score").alias("kth"), F.count("*").alias("n"))

    def summarise(t):
        cell = t["cell"][0].as_py()
        q = np.concatenate([_unpack(*r, dim)[1] for r in zip(t["ids"].to_pylist(), t["data"].to_pylist(), strict=True)]).astype(np.float64)
        radius = float(np.sqrt(((q - pivot.value[cell]) ** 2).sum(1)).max())
        return pa.table({"g": [t["g"][0].as_py()], "cell": pa.array([cell], pa.int32()), "radius": [radius], "queries": pa.array([len(set(zip(t["ids"].to_pylist(), t["data"].to_pylist(), strict=True)))], pa.int64())})

    radii = groups.groupBy("g").applyInArrow(summarise, "g string, cell int, radius double, queries long")
    # A group of which some query has fewer than k others so far has no bound yet and gets everything.
    summary = materialize(radii.join(kth, "g", "left").select("g", "cell", "radius", F.when(F.col("n") == F.col("queries"), F.col("kth")).alias("kth")), "summary")

    # Groups follow the number of queries, so summaries reach the data in bounded blocks.
    parts, n_groups = [], summary.count()
    turns = max(1, -(-n_groups // 4096))
    for turn in range(turns):
        rows = summary.where(F.pmod(F.xxhash64("g"), F.lit(turns)) == turn).collect()
        if rows:
            parts.append(_send(packs, spark.sparkContext.broadcast(([r["g"] for r in rows], [r["cell"] for r in rows], np.array([r["radius"] for r in rows]), [r["kth"] for r in rows])), pivot, dim))
    if not parts:
        return spark.createDataFrame([], schema)
    sent = parts[0]
    for x in parts[1:]:
        sent = sent.unionByName(x)
    cell_of = F.substring_index("to", "-", 1).cast("int")  # a group's name begins with its cell
    sent = sent.withColumn("turn", F.pmod(F.col("block"), F.element_at(rest_turns, cell_of)).cast("int")).drop("block")
    rest = asked(rest_turns).groupBy("g", "salt").cogroup(sent.groupBy("to", "turn")).applyInArrow(solve, solved)

    flat = first.unionByName(rest).select("g", "q", F.explode("best").alias("b"))
    merged = flat.groupBy("g", "q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("b.score")).alias("low"), "b.id"))), 1, k + 1).alias("best"))
    counts = groups.groupBy("g", F.concat("ids", "data").alias("q")).agg(F.count("*").alias("times"))

    def unfold(batches):
        for b in batches:
            rows = []
            for q, best, times in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                ids, v = _unpack(q[:8], q[8:], dim)
                own, left, out = int(_scores(v, v)[0, 0]), False, []
                for x in best:
                    if not left and x["id"] == ids[0] and -x["low"] == own:
                        left = True
                        continue
                    out.append(x)
                for _ in range(times):
                    rows += [(int(ids[0]), r + 1, None if x["id"] == _NO_ID else x["id"], -x["low"]) for r, x in enumerate(out[:k])]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["query_id", "rank", "vec_id", "score"])

    return merged.join(counts, ["g", "q"]).select("q", "best", "times").mapInArrow(unfold, schema)


def _send(packs: DataFrame, groups, pivot, dim: int) -> DataFrame:
    """Vectors for each group whose bound they reach, in packs. A group has had its own cell."""

    def run(batches):
        names, cells, radius, kth = groups.value
        p = pivot.value
        for b in batches:
            for cell, block, _, ids, data in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                s_ids, s = _unpack(ids, data, dim)
                x = s.astype(np.float64)
                at_pivot, norm = x @ p.T, np.sqrt((x * x).sum(1))
                rows = []
                for g, name in enumerate(names):
                    if cells[g] == cell:
                        continue
                    if kth[g] is None:
                        near = np.arange(len(s))
                    else:
                        bound = at_pivot[:, cells[g]] + radius[g] * norm
                        near = np.flatnonzero(bound * (1 + np.sign(bound) * SLACK) + 1 >= kth[g])
                    if len(near):
                        rows.append((name, block, *_pack(s_ids[near], s[near])[1:]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["to", "block", "s_ids", "s"])

    return packs.mapInArrow(run, "to string, block int, s_ids binary, s binary")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))
