"""Search over a table of queries: token, lexical, vector and graph channels, fusion, reranking, recommendation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.columns import cosine, count, days_old, estimate_tokens, hours_old, occurrences, r6, tokens, words
from mnemolake.plans.registry import query
from mnemolake.plans.views import AS_OF

QUERIES = [("q1", "thened heention"), ("q2", "inthat anthe"), ("q3", "eronthwh src3"), ("q4", "zzzz nothing")]
_Q = "q(qid, text) AS (VALUES ('q1', 'thened heention'), ('q2', 'inthat anthe'), ('q3', 'eronthwh src3'), ('q4', 'zzzz nothing'))"
_TOK = "list_distinct(regexp_extract_all(lower({0}), '[\\x{{4e00}}-\\x{{9fff}}]+|[a-z0-9_]{{2,}}'))"
_INDEX = "ix AS (SELECT DISTINCT id, tok FROM (SELECT id, unnest(" + _TOK.format("content") + ") AS tok FROM memory UNION ALL SELECT id, lower(unnest(tags)) FROM memory))"
_FTS = f"{_Q}, {_INDEX}, qt AS (SELECT qid, unnest({_TOK.format('text')}) AS tok FROM q), f AS (SELECT qid, id, count(*) AS s FROM qt JOIN ix ON qt.tok = ix.tok GROUP BY 1, 2), fts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM f) WHERE rk <= 10)"


def query_table(like: DataFrame, queries: list[tuple[str, str]]) -> DataFrame:
    return like.sparkSession.createDataFrame(queries, "qid string, text string")


def record_tokens() -> Column:
    """A record's distinct text tokens and lower-cased tags."""
    return F.array_distinct(F.array_union(tokens("content"), F.transform("tags", lambda t: F.lower(t))))


def token_index(memory: DataFrame) -> DataFrame:
    """Distinct (tok, id) of text tokens and lower-cased tags."""
    return memory.select("id", F.explode(record_tokens()).alias("tok"))


@query("d1_build_token_index", "memory", f"WITH {_INDEX} SELECT tok, count(*) AS df FROM ix GROUP BY tok ORDER BY df DESC, tok LIMIT 200")
def hot_words(memory: DataFrame, most: int = 200) -> DataFrame:
    """The index's tokens with the highest document frequency."""
    return token_index(memory).groupBy("tok").agg(count().alias("df")).orderBy(F.desc("df"), "tok").limit(most)


def facets(memory: DataFrame, wing: str | None = None, room: str | None = None, author: str | None = None, least: float = 0.0) -> DataFrame:
    """The records of a wing, room and author, from an importance on: filters that reach the scan."""
    out = memory.where(F.col("importance") >= least) if least > 0 else memory
    for column, value in (("wing", wing), ("room", room), ("author", author)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def top(df: DataFrame, score: str, k: int, *by: str) -> DataFrame:
    rk = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "id"))
    return df.withColumn("rk", rk.cast("long")).where(F.col("rk") <= k)


def matches(memory: DataFrame, queries: DataFrame, *carried: str) -> DataFrame:
    """qid, id, tok and the carried columns: the query tokens that each record holds.

    Tokens that nobody asked for are dropped inside their row, so what is exploded follows the hits and not the texts.
    The query side is the caller's stated list and is broadcast.
    """
    qt = queries.select("qid", F.explode(tokens("text")).alias("tok"))
    asked = qt.agg(F.collect_set("tok").alias("asked"))  # one row
    both = F.array_union(tokens("content"), F.transform("tags", lambda t: F.lower(t)))
    held = memory.select("id", *carried, both.alias("held")).crossJoin(F.broadcast(asked))
    return held.select("id", *carried, F.explode(F.array_intersect("held", "asked")).alias("tok")).join(F.broadcast(qt), "tok")


def fts(memory: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, id, s, rk: number of query tokens that the record holds."""
    return top(matches(memory, queries).groupBy("qid", "id").agg(count().alias("s")), "s", k, "qid")


@query("d2_fts_search", "memory", f"""
WITH {_FTS}, none AS (SELECT * FROM q WHERE qid NOT IN (SELECT qid FROM f)), sub AS (SELECT qid, id, 0.5 * len(list_filter({_TOK.format('text')}, lambda t: contains(lower(content), t))) AS s FROM none, memory),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM sub WHERE s > 0)
SELECT qid, id, s::DOUBLE AS score, rk FROM fts UNION ALL SELECT qid, id, s::DOUBLE, rk FROM r WHERE rk <= 10
""")
def fts_search(memory: DataFrame, queries: list[tuple[str, str]] = QUERIES, k: int = 10) -> DataFrame:
    """Token hits; a query without any gets half a point for each token that occurs as a substring."""
    q = query_table(memory, queries)
    found = fts(memory, q, k)
    none = q.join(found.select("qid").distinct(), "qid", "left_anti").select("qid", tokens("text").alias("toks"))
    texts = memory.select("id", F.lower("content").alias("c"))
    sub = texts.crossJoin(F.broadcast(none))  # a stated query list against all rows
    sub = sub.withColumn("s", 0.5 * F.size(F.filter("toks", lambda t: F.contains(F.col("c"), t)))).where("s > 0").select("qid", "id", "s")
    return found.select("qid", "id", F.col("s").cast("double").alias("score"), "rk").unionByName(top(sub, "s", k, "qid").select("qid", "id", F.col("s").cast("double").alias("score"), "rk"))


@query("d3_keyword_score", "memory", """
WITH s AS (SELECT w, id, ((length(content) - length(replace(content, w, ''))) // length(w)) + CASE WHEN contains(room, w) THEN 2 ELSE 0 END + 0.3 * importance + 2 * len(list_filter(tags, lambda t: contains(w, t))) AS s FROM memory, (VALUES ('then'), ('src1')) AS v(w) WHERE contains(content, w) OR contains(room, w)),
r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY s DESC, id) AS rk FROM s) SELECT w AS qid, id, round(s, 6) AS score, rk FROM r WHERE rk <= 10
""", asked=["then", "src1"])
def keyword_score(memory: DataFrame, asked: list[str], k: int = 10) -> DataFrame:
    """Occurrences, 2 for a hit in the room, .3 of importance, 2 for each tag inside the query."""
    out = None
    for w in asked:  # a stated list
        s = occurrences("content", w) + F.when(F.contains("room", F.lit(w)), 2).otherwise(0) + 0.3 * F.col("importance") + 2 * F.size(F.filter("tags", lambda t: F.contains(F.lit(w), t)))
        one = memory.where(F.contains("content", F.lit(w)) | F.contains("room", F.lit(w))).select(F.lit(w).alias("qid"), "id", s.alias("s")).orderBy(F.desc("s"), "id").limit(k)
        out = one if out is None else out.unionByName(one)
    return top(out, "s", k, "qid").select("qid", "id", r6("s").alias("score"), "rk")


@query("d4_lexical_search", "memory", """
SELECT id, importance, substr(content, greatest(1, CAST(strpos(lower(content), 'thened') AS INT) - 50), 150) AS snippet FROM memory WHERE contains(lower(content), 'thened') ORDER BY importance DESC, id LIMIT 20
""", text="Thened")
def lexical_search(memory: DataFrame, text: str, k: int = 20, around: int = 50) -> DataFrame:
    """Case-blind substring match by importance, with the text round the first hit."""
    low = text.lower()
    start = F.greatest(F.lit(1), F.instr(F.lower("content"), low) - around)
    return memory.where(F.contains(F.lower("content"), F.lit(low))).orderBy(F.desc("importance"), "id").limit(k).select("id", "importance", F.substr("content", start, F.lit(3 * around)).alias("snippet"))


QUERY_BLOCK = 4096


def vector_top(vector: DataFrame, queries: DataFrame, k: int, least: float, probed: dict[str, list[int]] | None = None) -> DataFrame:
    """qid, id, s, rk: exact cosine top-k of a bounded query table (qid, qv) against all vectors.

    Vectors pass by in Arrow batches and meet all queries in one matrix product; each partition keeps its own k best,
    so only partitions times queries times k rows are exchanged. Lengths are cut to the query's. With `probed`
    (cells of each qid) vectors have a cell, and a query meets those of its cells.
    """
    rows = queries.collect()
    if not rows:
        return vector.sparkSession.createDataFrame([], "qid string, id string, s double, rk long")
    dim = min(len(r["qv"]) for r in rows)
    q = np.array([r["qv"][:dim] for r in rows], np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    names = np.array([r["qid"] for r in rows], object)
    wants = {}
    for j, name in enumerate(names):
        for c in probed[name] if probed is not None else [0]:
            wants.setdefault(c, []).append(j)
    shared = vector.sparkSession.sparkContext.broadcast((q, names, {c: np.array(w) for c, w in wants.items()}))

    def cut(of, ids, s):
        order = np.lexsort((ids.astype(str), -s, of))
        of, ids, s = of[order], ids[order], s[order]
        best = np.arange(len(of)) - np.searchsorted(of, of) < k
        return of[best], ids[best], s[best]

    def run(batches):
        q, names, wants = shared.value
        held = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        floor = np.full(len(q), -np.inf)  # the k-th score so far
        for whole in batches:
            whole = whole.filter(pa.compute.greater_equal(pa.compute.list_value_length(whole.column(1)), dim))
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                sizes = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                v = flat.reshape(-1, dim) if (sizes == dim).all() else np.stack([x[:dim] for x in np.split(flat, np.cumsum(sizes)[:-1])])
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                ids, cell = np.array(b.column(0).to_pylist(), object), b.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(cell).tolist():
                    if c not in wants:
                        continue
                    asked, own = wants[c], np.flatnonzero(cell == c)
                    s = np.round(v[own] @ q[asked].T, 9)
                    low = np.maximum(floor[asked], least)
                    if len(own) > k:
                        low = np.maximum(low, np.partition(s, len(own) - k, axis=0)[len(own) - k])
                    i, j = np.nonzero(s >= low)
                    held = cut(*(np.concatenate(x) for x in zip(held, (asked[j], ids[own[i]], s[i, j]), strict=True)))
                    full = np.flatnonzero(np.bincount(held[0], minlength=len(q)) >= k)
                    floor[full] = held[2][np.searchsorted(held[0], full, "right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(names[held[0]], pa.string()), pa.array(held[1], pa.string()), pa.array(held[2], pa.float64())], ["qid", "id", "s"])

    cell = F.col("cell") if probed is not None else F.lit(0)
    return top(vector.select("id", "v", cell.cast("int").alias("cell")).mapInArrow(run, "qid string, id string, s double"), "s", k, "qid")


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> list[DataFrame]:
    """A query table (qid, qv) of any length in parts of about `size` rows, each small enough for every task."""
    parts = max(1, -(-queries.count() // size))
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i) for i in range(parts)]


_VQ = "vq AS (SELECT concat('v', id) AS qid, v AS qv FROM vector WHERE id IN ('0', '7', '42'))"
_VT = f"{_VQ}, vs AS (SELECT qid, id, round(list_cosine_similarity(qv::DOUBLE[], v::DOUBLE[]), 9) AS s FROM vq, vector), vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM vs WHERE s >= 0.2) WHERE rk <= 10)"


def _vector_queries(vector: DataFrame, ids: list[str]) -> DataFrame:
    return vector.where(F.col("id").isin(ids)).select(F.concat(F.lit("v"), "id").alias("qid"), F.col("v").alias("qv"))


def vector_topk(vector: DataFrame, ids: list[str], k: int = 10, least: float = 0.2) -> DataFrame:
    """Exact cosine top-k for the vectors of some records."""
    return vector_top(vector, _vector_queries(vector, ids), k, least).select("qid", "id", r6("s").alias("score"), "rk")


def every_nth(vector: DataFrame, every: int) -> DataFrame:
    """The vectors whose id is divisible by `every`, as queries."""
    return vector.where(F.col("id").cast("long") % every == 0).select(F.concat(F.lit("v"), "id").alias("qid"), F.col("v").alias("qv"))


@query("d5_vector_topk", "vector", """
WITH q AS (SELECT concat('v', id) AS qid, v AS qv FROM vector WHERE CAST(id AS BIGINT) % 50 = 0), s AS (SELECT qid, id, round(list_cosine_similarity(qv::DOUBLE[], v::DOUBLE[]), 9) AS s FROM q, vector)
SELECT qid, id, round(s, 6) AS score, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM s WHERE s >= 0.2) WHERE rk <= 10
""", every=50)
def vector_topk_every(vector: DataFrame, every: int, k: int = 10, least: float = 0.2, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact cosine top-k for every n-th record, block by block of queries."""
    out = None
    for q in query_blocks(every_nth(vector, every), block):
        one = vector_top(vector, q, k, least)
        out = one if out is None else out.unionByName(one)
    return out.select("qid", "id", r6("s").alias("score"), "rk")


def cells(vector: DataFrame, n_cells: int, seed: int = 3, sample: int = 20_000):
    """(vectors with their cell, model): k-means on a bounded sample; every vector is assigned."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vector.select("id", "v", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    fit_on = x.orderBy(F.xxhash64("id")).limit(sample)
    model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(fit_on)
    return model.transform(x).withColumnRenamed("prediction", "cell").drop("features"), model


@query("d6_vector_topk_approx", "vector", every=50)
def vector_topk_approx(vector: DataFrame, ids: list[str] | None = None, k: int = 10, n_cells: int | None = None, probe: float = 0.75, rerank: int = 5, least: float = 0.2, every: int = 50) -> DataFrame:
    """Approximate top-k for the given records, or every n-th, by an inverted file: short codes of the nearest cells (probe: a
    share below 1, or how many), then the exact cosine of rerank * k vectors for each query. An empty table gives an empty result."""
    from mnemolake.operators import ivf

    queries = every_nth(vector, every) if ids is None else _vector_queries(vector, ids)
    n_cells = n_cells or ivf.cells_for(vector.count())
    quantiser = ivf.fit(vector, n_cells)
    if quantiser is None:
        return vector.sparkSession.createDataFrame([], "qid string, id string, score double, rk int")
    many = round(probe * len(quantiser.centers)) if probe < 1 else int(probe)
    found = ivf.search(*ivf.build(vector, quantiser), quantiser, vector, queries, k, many, rerank * k, least)
    return found.select("qid", "id", r6("s").alias("score"), "rk")


def rrf(channels: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """qid, id, score: the sum over channels (qid, id, rk from 1) of weight / (k + rk)."""
    both = None
    for df, weight in channels:
        one = df.select("qid", "id", (F.lit(float(weight)) / (k + F.col("rk"))).alias("w"))
        both = one if both is None else both.unionByName(one)
    return both.groupBy("qid", "id").agg(F.sum("w").alias("score"))


_MIX = "mix AS (SELECT qid, id, rk, 1.0 AS w FROM fts UNION ALL SELECT replace(qid, 'v0', 'q1'), id, rk, 0.5 FROM vt WHERE qid = 'v0'), fused AS (SELECT qid, id, sum(w / (60 + rk))::DOUBLE AS score FROM mix GROUP BY 1, 2)"


def _channels(memory: DataFrame, vector: DataFrame, queries: list[tuple[str, str]], k: int) -> list[tuple[DataFrame, float]]:
    by_text = fts(memory, query_table(memory, queries), k)
    by_vector = vector_top(vector, _vector_queries(vector, ["0"]).withColumn("qid", F.lit(queries[0][0])), k, 0.2)
    return [(by_text, 1.0), (by_vector, 0.5)]


@query("d7_rrf", "memory vector", f"WITH {_FTS}, {_VT}, {_MIX} SELECT qid, id, round(score, 8) AS score FROM fused")
def fuse(memory: DataFrame, vector: DataFrame, queries: list[tuple[str, str]] = QUERIES, k: int = 10) -> DataFrame:
    """Token and vector rankings fused by reciprocal rank."""
    return rrf(_channels(memory, vector, queries, k)).select("qid", "id", r6("score", 8).alias("score"))


@query("d8_kg_channel", "entity relation", """
WITH q(qid, w) AS (VALUES ('k1', 'CHINA'), ('k2', 'ASIA')), e AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS rn FROM q, entity WHERE contains(upper(name), w)),
t AS (SELECT qid, r.object_id AS id, max(r.confidence) AS s FROM e JOIN relation r ON r.subject_id = e.id WHERE rn <= 5 GROUP BY 1, 2 UNION ALL SELECT qid, r.subject_id, max(r.confidence) FROM e JOIN relation r ON r.object_id = e.id WHERE rn <= 5 GROUP BY 1, 2),
u AS (SELECT qid, id, max(s) AS s FROM t GROUP BY 1, 2) SELECT qid, id, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM u) WHERE rk <= 10
""", asked=[("k1", "CHINA"), ("k2", "ASIA")])
def kg_channel(entity: DataFrame, relation: DataFrame, asked: list[tuple[str, str]], k: int = 10, most: int = 5) -> DataFrame:
    """The first entities whose names hold a query word, and what their relations lead to, by confidence."""
    out = None
    for qid, w in asked:  # a stated list
        one = entity.where(F.contains(F.upper("name"), F.lit(w.upper()))).orderBy("id").limit(most).select(F.lit(qid).alias("qid"), F.col("id").alias("e"))
        out = one if out is None else out.unionByName(one)
    forth = relation.select(F.col("subject_id").alias("e"), F.col("object_id").alias("id"), "confidence")
    back = relation.select(F.col("object_id").alias("e"), F.col("subject_id").alias("id"), "confidence")
    hit = forth.unionByName(back).join(F.broadcast(out), "e").groupBy("qid", "id").agg(F.max("confidence").alias("s"))  # most * len(asked) rows
    return top(hit, "s", k, "qid").select("qid", "id", "rk")


_HYBRID = f"{_FTS}, {_VT}, {_MIX}, h AS (SELECT qid, f.id, score, importance, content, tags, created_at, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, f.id) AS rk FROM fused f JOIN memory m ON f.id = m.id)"


@query("d9_hybrid_search", "memory vector", f"WITH {_HYBRID} SELECT qid, id, round(score, 8) AS score, rk FROM h WHERE rk <= 10")
def hybrid_search(memory: DataFrame, vector: DataFrame, queries: list[tuple[str, str]] = QUERIES, k: int = 10) -> DataFrame:
    """Top records per query from fused token and vector rankings."""
    fused = rrf(_channels(memory, vector, queries, k)).join(memory.select("id"), "id").withColumn("s", F.round("score", 9))
    return top(fused, "s", k, "qid").select("qid", "id", r6("score", 8).alias("score"), "rk")


_BOOST = "0.15 * exp(-0.1 * (date_diff('second', created_at, {AS_OF}) / 3600.0) / 24) + 0.05 * importance / 5 + least(0.09, 0.03 * len(tags))"


def boost(as_of: str = AS_OF) -> Column:
    """What retention, importance and tags add to a fused score."""
    return 0.15 * F.exp(-0.1 * hours_old("created_at", as_of) / 24) + 0.05 * F.col("importance") / 5 + F.least(F.lit(0.09), 0.03 * F.size("tags"))


def substring_scores(memory: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, id, wing, importance, s over 0: .8 where the text holds the whole query, and .2 for each tag that does."""
    low = queries.select("qid", F.lower("text").alias("low"))
    x = memory.select("id", "wing", "importance", F.lower("content").alias("c"), "tags").crossJoin(F.broadcast(low))  # a stated query list against all rows
    in_tags = F.size(F.filter("tags", lambda t: F.contains(F.lower(t), F.col("low"))))
    s = F.when(F.contains("c", F.col("low")), 0.8).otherwise(0.0) + 0.2 * F.greatest(in_tags, F.lit(0))
    return x.select("qid", "id", "wing", "importance", F.round(s, 9).alias("s")).where("s > 0")


@query("d10_recall", "memory vector", f"""
WITH {_HYBRID}, b AS (SELECT *, score + {_BOOST} AS boosted FROM h)
SELECT qid, id, round(score, 8) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(boosted::DOUBLE, 9) DESC, id) AS rk FROM b
""")
def recall(memory: DataFrame, vector: DataFrame, queries: list[tuple[str, str]] = QUERIES, k: int = 10, as_of: str = AS_OF) -> DataFrame:
    """Fused ranking reordered by retention, importance and tags; the score returned is the fused one."""
    fused = rrf(_channels(memory, vector, queries, k)).join(memory.select("id", "importance", "tags", "created_at"), "id")
    x = fused.withColumn("b", F.round(F.col("score") + boost(as_of), 9))
    return x.select("qid", "id", r6("score", 8).alias("score"), F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("b"), "id")).cast("long").alias("rk"))


PARTIAL = [("p1", "thened heention"), ("p2", "HENED"), ("p3", "rc1"), ("p4", "zzzz nothing"), ("p5", "en in"), ("p6", "an t")]
_PARTIAL = "q(qid, text) AS (VALUES ('p1', 'thened heention'), ('p2', 'HENED'), ('p3', 'rc1'), ('p4', 'zzzz nothing'), ('p5', 'en in'), ('p6', 'an t'))"


@query("d10_recall_fallback", "memory", f"""
WITH {_FTS.replace(_Q, _PARTIAL)}, h AS (SELECT fts.qid, fts.id, (1.0 / (60 + rk))::DOUBLE AS score, created_at, importance, tags FROM fts JOIN memory m ON m.id = fts.id WHERE importance >= 1.5),
b AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round((score + {_BOOST})::DOUBLE, 9) DESC, id) AS rk FROM h),
s AS (SELECT qid, id, CASE WHEN contains(lower(content), lower(text)) THEN 0.8 ELSE 0 END + 0.2 * len(list_filter(tags, lambda t: contains(lower(t), lower(text)))) AS s FROM (SELECT * FROM q WHERE qid NOT IN (SELECT qid FROM fts)), (SELECT * FROM memory WHERE importance >= 1.5))
SELECT qid, id, round(score, 8) AS score, rk, 'tokens' AS found_by FROM b
UNION ALL SELECT qid, id, round(s::DOUBLE, 8), rk, 'substring' FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM s WHERE s > 0) WHERE rk <= 10
""".replace("FROM memory UNION ALL", "FROM memory WHERE importance >= 1.5 UNION ALL").replace("lower(unnest(tags)) FROM memory)", "lower(unnest(tags)) FROM memory WHERE importance >= 1.5)"), queries=PARTIAL, least=1.5)
def recall_or_substring(memory: DataFrame, queries: list[tuple[str, str]], k: int = 10, wing: str | None = None, room: str | None = None, author: str | None = None, least: float = 0.0, as_of: str = AS_OF) -> DataFrame:
    """Records by tokens in the boosted order of `recall`; a query that no token hits is looked for as a substring of texts and tags.

    Facets are filters below both ways. A query that neither way finds has no rows.
    """
    kept = facets(memory, wing, room, author, least)
    asked = query_table(memory, queries)
    found = fts(kept, asked, k).select("qid", "id", (1.0 / (60 + F.col("rk"))).alias("score"))
    by_token = found.join(kept.select("id", "importance", "tags", "created_at"), "id").withColumn("b", F.round(F.col("score") + boost(as_of), 9))
    by_token = top(by_token, "b", k, "qid").select("qid", "id", r6("score", 8).alias("score"), "rk", F.lit("tokens").alias("found_by"))
    missed = asked.join(F.broadcast(by_token.select("qid").distinct()), "qid", "left_anti")
    by_part = top(substring_scores(kept, missed), "s", k, "qid").select("qid", "id", r6("s", 8).alias("score"), "rk", F.lit("substring").alias("found_by"))
    return by_token.unionByName(by_part)


def recency_step(ts: str, as_of: str) -> Column:
    d = days_old(ts, as_of)
    return F.when(d <= 1, 1.0).when(d <= 7, 0.8).when(d <= 30, 0.5).otherwise(0.2)


def rerank_score(as_of: str = AS_OF) -> Column:
    """Over columns score (fused), text (the query), content, created_at and importance."""
    asked = F.array_distinct(F.split("text", " "))
    ctx = F.size(F.filter(asked, lambda w: F.contains(F.lower("content"), w))) / F.size(asked)
    quality = F.when(F.length("content") > 200, 1.0).when(F.length("content") > 50, 0.7).otherwise(0.4)
    return 0.35 * F.least(F.lit(1.0), F.col("score") * 60) + 0.25 * ctx + 0.15 * recency_step("created_at", as_of) + 0.15 * (F.col("importance") / 5) + 0.1 * quality


@query("d11_rerank", "memory vector", f"""
WITH {_HYBRID}, x AS (SELECT h.qid, id, least(1.0, score * 60) AS rel, len(list_filter(list_distinct(string_split(q.text, ' ')), lambda w: contains(lower(content), w)))::DOUBLE / len(list_distinct(string_split(q.text, ' '))) AS ctx,
  CASE WHEN d <= 1 THEN 1.0 WHEN d <= 7 THEN 0.8 WHEN d <= 30 THEN 0.5 ELSE 0.2 END AS rec, importance / 5 AS imp, CASE WHEN length(content) > 200 THEN 1.0 WHEN length(content) > 50 THEN 0.7 ELSE 0.4 END AS qual FROM (SELECT *, date_diff('second', created_at, {{AS_OF}}) / 86400.0 AS d FROM h) h JOIN q ON q.qid = h.qid)
SELECT qid, id, round((0.35 * rel + 0.25 * ctx + 0.15 * rec + 0.15 * imp + 0.1 * qual)::DOUBLE, 6) AS score FROM x
""")
def rerank(memory: DataFrame, vector: DataFrame, queries: list[tuple[str, str]] = QUERIES, k: int = 10, as_of: str = AS_OF) -> DataFrame:
    """.35 fused rank + .25 query words present + .15 recency + .15 importance + .1 quality."""
    fused = rrf(_channels(memory, vector, queries, k)).join(memory, "id").join(F.broadcast(query_table(memory, queries)), "qid")
    return fused.select("qid", "id", r6(rerank_score(as_of)).alias("score"))


def graph_channel(entity: DataFrame, relation: DataFrame, memory: DataFrame, queries: DataFrame, k: int, most: int = 5) -> DataFrame:
    """qid, id, s, rk: records that relations of the entities named in a query lead to, by confidence.

    An entity counts if its name holds a query word of two characters or more; the first `most` by id are followed, so
    what is broadcast has at most that many rows for each query.
    """
    asked = queries.select("qid", F.explode(F.filter(words("text"), lambda w: F.length(w) >= 2)).alias("w"))
    named = entity.select(F.col("id").alias("e"), F.lower("name").alias("name")).join(F.broadcast(asked), F.contains("name", F.col("w"))).select("qid", "e").distinct()
    first = named.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("e"))).where(F.col("rn") <= most).select("qid", "e")
    led = relation.select(F.col("subject_id").alias("e"), F.col("object_id").alias("id"), "confidence").join(F.broadcast(first), "e")
    return top(led.join(memory.select("id"), "id", "left_semi").groupBy("qid", "id").agg(F.max("confidence").alias("s")), "s", k, "qid")


def tag_relations(memory: DataFrame) -> DataFrame:
    """Each tag leads to the records that carry it, with their importance as confidence."""
    return memory.select("id", "importance", F.explode("tags").alias("tag")).select(F.concat(F.lit("tag:"), "tag").alias("subject_id"), F.lit("tags").alias("predicate"), F.col("id").alias("object_id"), (F.col("importance") / 5).alias("confidence"))


def tag_entities(memory: DataFrame) -> DataFrame:
    tag = memory.select(F.explode("tags").alias("name")).distinct()
    return tag.select(F.concat(F.lit("tag:"), "name").alias("id"), "name", F.lit("tag").alias("type"))


#: Words that no explanation names as a keyword.
STOPWORDS = ["the", "a", "an", "of", "in", "on", "to", "and", "or", "is", "are", "的", "了", "是", "在"]


def reasons(as_of: str = AS_OF) -> tuple[Column, Column, Column]:
    """Match type, reasons and confidence of a result with columns text, keywords, content, tags, created_at and the channel ranks."""
    low = F.lower("content")
    matched = F.filter("keywords", lambda w: F.contains(low, w))
    tags = F.filter("tags", lambda t: F.contains(F.lower("text"), F.lower(t)))
    named = F.array_join(F.slice(matched, 1, 5), ", ")
    ranks = F.array_join(F.filter(F.array(
        F.when(F.col("text_rank") <= 3, F.concat(F.lit("text rank "), F.col("text_rank").cast("string"))),
        F.when(F.col("vector_rank") <= 3, F.concat(F.lit("vector rank "), F.col("vector_rank").cast("string"))),
        F.when(F.col("graph_rank").isNotNull(), "graph"),
    ), lambda x: x.isNotNull()), ", ")
    age = days_old("created_at", as_of)
    why = F.filter(F.array(
        F.when(F.size(matched) > 0, F.concat(F.when(F.size(matched) == F.size("keywords"), "all words: ").otherwise("words: "), named)),
        F.when(F.size(tags) > 0, F.concat(F.lit("tags: "), F.array_join(F.slice(tags, 1, 3), ", "))),
        F.when(ranks != "", ranks),
        F.when(age < 1, "today").when(age < 7, F.concat(F.floor(age).cast("string"), F.lit(" days ago"))).when(age < 30, "this month"),
    ), lambda x: x.isNotNull())
    kind = F.when(F.size(matched) > 0, "keyword").when(F.size(tags) > 0, "tag").otherwise("semantic")
    return kind, F.array_join(why, "; "), F.least(F.lit(1.0), 0.25 * F.size(why))


def keywords_of(text: str) -> Column:
    """Sorted words of a query: two characters or more and no stop word, and runs of CJK or of three word characters."""
    low = F.lower(text)
    plain = F.filter(words(text), lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS))
    runs = F.regexp_extract_all(low, F.lit("[\\u4e00-\\u9fff]{2,}|[a-z0-9_]{3,}"), F.lit(0))
    return F.array_sort(F.array_union(plain, runs))


ASKED = [("h1", "thened heention src3", "0"), ("h2", "inthat anthe", None), ("h3", "src1 the eronthwh", "7"), ("h4", "zzzz nothing", None), ("h5", "zzzz qqqq", "42")]
_ASKED = """q(qid, text, vec) AS (VALUES ('h1', 'thened heention src3', '0'), ('h2', 'inthat anthe', NULL), ('h3', 'src1 the eronthwh', '7'), ('h4', 'zzzz nothing', NULL), ('h5', 'zzzz qqqq', '42'))"""
_WHOLE = (
    "m AS (SELECT * FROM memory WHERE importance >= 1.2), "
    + _FTS.replace(_Q, _ASKED).replace("FROM memory", "FROM m").replace("rk <= 10", "rk <= 50")
    + """, vs AS (SELECT q.qid, v.id, round(list_cosine_similarity(a.v::DOUBLE[], v.v::DOUBLE[]), 9) AS s FROM q JOIN vector a ON a.id = q.vec, (SELECT * FROM vector WHERE id IN (SELECT id FROM m)) v),
vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM vs WHERE s >= 0.2) WHERE rk <= 50),
tg AS (SELECT DISTINCT 'tag:' || t AS e, t FROM (SELECT unnest(tags) AS t FROM m)), qw AS (SELECT qid, unnest(regexp_split_to_array(lower(text), '[ ]+')) AS w FROM q),
te AS (SELECT qid, e FROM (SELECT qid, e, row_number() OVER (PARTITION BY qid ORDER BY e) AS rn FROM (SELECT DISTINCT qid, e FROM tg, qw WHERE length(w) >= 2 AND contains(lower(t), w))) WHERE rn <= 5),
gs AS (SELECT qid, id, max(importance / 5) AS s FROM te JOIN (SELECT id, importance, 'tag:' || unnest(tags) AS e FROM m) USING (e) GROUP BY 1, 2),
gt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM gs) WHERE rk <= 50),
ch AS (SELECT qid, id, rk, 1.0 AS w, 't' AS c FROM fts UNION ALL SELECT qid, id, rk, 1.0, 'v' FROM vt UNION ALL SELECT qid, id, rk, 0.5, 'g' FROM gt),
fu AS (SELECT qid, id, sum(w / (60 + rk))::DOUBLE AS score, max(CASE c WHEN 't' THEN rk END) AS text_rank, max(CASE c WHEN 'v' THEN rk END) AS vector_rank, max(CASE c WHEN 'g' THEN rk END) AS graph_rank FROM ch GROUP BY 1, 2),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rn FROM fu) WHERE rn <= 10),
xx AS (SELECT be.*, q.text, content, tags, importance, date_diff('second', created_at, {AS_OF}) / 86400.0 AS d, lower(content) AS low, string_split(q.text, ' ') AS ws,
  list_sort(list_distinct(list_filter(string_split(lower(q.text), ' '), lambda w: length(w) >= 2 AND w <> 'the') || regexp_extract_all(lower(q.text), '[a-z0-9_]{3,}'))) AS kw FROM be JOIN m ON m.id = be.id JOIN q ON q.qid = be.qid),
yy AS (SELECT *, list_filter(kw, lambda w: contains(low, w)) AS mt, list_filter(tags, lambda t: contains(lower(text), lower(t))) AS tt, 0.35 * least(1.0, score * 60) + 0.25 * len(list_filter(ws, lambda w: contains(low, w)))::DOUBLE / len(ws)
  + 0.15 * CASE WHEN d <= 1 THEN 1.0 WHEN d <= 7 THEN 0.8 WHEN d <= 30 THEN 0.5 ELSE 0.2 END + 0.15 * (importance / 5) + 0.1 * CASE WHEN length(content) > 200 THEN 1.0 WHEN length(content) > 50 THEN 0.7 ELSE 0.4 END AS final FROM xx),
zz AS (SELECT *, list_filter([CASE WHEN len(mt) > 0 THEN CASE WHEN len(mt) = len(kw) THEN 'all words: ' ELSE 'words: ' END || array_to_string(mt[1:5], ', ') END, CASE WHEN len(tt) > 0 THEN 'tags: ' || array_to_string(tt[1:3], ', ') END,
  nullif(array_to_string(list_filter([CASE WHEN text_rank <= 3 THEN 'text rank ' || text_rank END, CASE WHEN vector_rank <= 3 THEN 'vector rank ' || vector_rank END, CASE WHEN graph_rank IS NOT NULL THEN 'graph' END], lambda x: x IS NOT NULL), ', '), ''),
  CASE WHEN d < 1 THEN 'today' WHEN d < 7 THEN floor(d)::BIGINT || ' days ago' WHEN d < 30 THEN 'this month' END], lambda x: x IS NOT NULL) AS why FROM yy)"""
)


@query("d9_hybrid_explained", "memory vector", f"""
WITH {_WHOLE} SELECT qid, id, round(final::DOUBLE, 6) AS score, round(score, 8) AS fused, row_number() OVER (PARTITION BY qid ORDER BY round(final::DOUBLE, 9) DESC, id) AS rk, text_rank, vector_rank, graph_rank,
CASE WHEN len(mt) > 0 THEN 'keyword' WHEN len(tt) > 0 THEN 'tag' ELSE 'semantic' END AS match_type, array_to_string(why, '; ') AS reasons, least(1.0, 0.25 * len(why))::DOUBLE AS confidence FROM zz
""", queries=ASKED, least=1.2)
def hybrid_by_tags(memory: DataFrame, vector: DataFrame, queries=ASKED, **settings) -> DataFrame:
    """`hybrid` with the graph of tags as its third channel; a query may name a stored vector to search with."""
    vectors = {qid: v for qid, _, v in queries if v is not None}
    named = memory.sparkSession.createDataFrame(list(vectors.items()), "qid string, id string")
    qv = vector.join(F.broadcast(named), "id").select("qid", F.col("v").alias("qv"))
    return hybrid(memory, vector, tag_entities(memory), tag_relations(memory), [(q, t) for q, t, _ in queries], qv, **settings)


def hybrid(memory: DataFrame, vector: DataFrame, entity: DataFrame, relation: DataFrame, queries: list[tuple[str, str]], vectors: DataFrame, k: int = 10, depth: int = 50, weights: tuple[float, float, float] = (1.0, 1.0, 0.5), wing: str | None = None, room: str | None = None, author: str | None = None, least: float = 0.0, close: float = 0.2, as_of: str = AS_OF) -> DataFrame:
    """The whole search: token, vector and graph channels below the facets, fused by rank, the best k reranked and explained.

    `vectors` is a bounded table (qid, qv) of the queries that have one. Each channel gives its best `depth`. Columns:
    qid, id, score (reranked), fused, rk, the rank in each channel or null, match_type, reasons and confidence. A query
    that no channel answers has no rows; ties go to the smaller id.
    """
    kept = facets(memory, wing, room, author, least)
    asked = query_table(memory, queries)
    seen = vector if kept is memory else vector.join(kept.select("id"), "id", "left_semi")
    channels = [("text_rank", fts(kept, asked, depth)), ("vector_rank", vector_top(seen, vectors, depth, close)), ("graph_rank", graph_channel(entity, relation, kept, asked, depth))]
    both = None
    for (name, df), weight in zip(channels, weights, strict=True):
        one = df.select("qid", "id", (F.lit(float(weight)) / (60 + F.col("rk"))).alias("w"), *[F.when(F.lit(n == name), F.col("rk")).alias(n) for n, _ in channels])
        both = one if both is None else both.unionByName(one)
    fused = both.groupBy("qid", "id").agg(F.sum("w").alias("score"), *[F.max(n).alias(n) for n, _ in channels])
    best = top(fused.withColumn("s", F.round("score", 9)), "s", k, "qid").drop("rk", "s")
    # k rows a query meet the records, so the texts never move
    x = kept.join(F.broadcast(best), "id").join(F.broadcast(asked.withColumn("keywords", keywords_of("text"))), "qid")
    kind, why, sure = reasons(as_of)
    x = x.select("qid", "id", F.col("score").alias("fused"), F.round(rerank_score(as_of), 9).alias("final"), *[n for n, _ in channels], kind.alias("match_type"), why.alias("reasons"), sure.alias("confidence"))
    return top(x, "final", k, "qid").select("qid", "id", r6("final").alias("score"), r6("fused", 8).alias("fused"), "rk", *[n for n, _ in channels], "match_type", "reasons", "confidence")


@query("d15_rewrite_hints", "memory vector", f"""
WITH {_WHOLE}, un AS (SELECT qid, list_sort(list(w)) AS ws FROM (SELECT DISTINCT q.qid, w FROM (SELECT qid, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM q) q WHERE NOT EXISTS (SELECT 1 FROM zz WHERE zz.qid = q.qid AND contains(low, w))) GROUP BY qid),
ag AS (SELECT qid, count(*) AS n, avg(round(final::DOUBLE, 6)) < 0.3 AS weak, sum((0.1 * importance / 5 > 0.08)::INT) < 0.3 * count(*) AS slight FROM zz GROUP BY qid)
SELECT q.qid, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'broader words; other spelling or synonyms' ELSE array_to_string(list_filter([CASE WHEN ws IS NOT NULL THEN 'synonyms of ' || array_to_string(ws, ', ') END, CASE WHEN weak THEN 'more context' END, CASE WHEN slight THEN 'more important records' END], lambda x: x IS NOT NULL), '; ') END AS hints
FROM q LEFT JOIN ag USING (qid) LEFT JOIN un USING (qid)
""", queries=ASKED, least=1.2)
def rewrite_hints(memory: DataFrame, vector: DataFrame, queries=ASKED, **settings) -> DataFrame:
    """How each query might be put better: its words that no result holds, weak scores, results of little importance."""
    asked = query_table(memory, [(q, t) for q, t, _ in queries]).select("qid", F.array_distinct(words("text")).alias("ws"))
    found = hybrid_by_tags(memory, vector, queries, **settings).select("qid", "id", "score")
    x = memory.select("id", "content", "importance").join(F.broadcast(found), "id").join(F.broadcast(asked), "qid")
    held = F.filter("ws", lambda w: F.contains(F.lower("content"), w))
    per = x.groupBy("qid").agg(count().alias("n"), (F.avg("score") < 0.3).alias("weak"), (F.sum(F.when(0.1 * F.col("importance") / 5 > 0.08, 1).otherwise(0)) < 0.3 * F.count("*")).alias("slight"), F.array_distinct(F.flatten(F.collect_list(held))).alias("held"))  # k rows of a few words for each query
    y = asked.join(per, "qid", "left")
    lost = F.array_sort(F.array_except("ws", "held"))
    hints = F.array_join(F.filter(F.array(F.when(F.size(lost) > 0, F.concat(F.lit("synonyms of "), F.array_join(lost, ", "))), F.when(F.col("weak"), "more context"), F.when(F.col("slight"), "more important records")), lambda h: h.isNotNull()), "; ")
    return y.select("qid", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "broader words; other spelling or synonyms").otherwise(hints).alias("hints"))


SLOTS = 128  # of the source projection


def projections(memory: DataFrame) -> DataFrame:
    """id, temporal, emotional and parts: the parts of the source projection that aren't 0, by slot."""
    h, w, m = (2 * 3.141592653589793 * x for x in (F.hour("created_at") / 24.0, F.weekday("created_at") / 7.0, F.month("created_at") / 12.0))
    e = F.col("emotional_weight")
    slots = F.transform(F.array("wing", "room", "author"), lambda x: F.pmod(F.xxhash64(x), F.lit(SLOTS)).cast("int"))
    x = memory.select("id", F.array(F.sin(h), F.cos(h), F.sin(w), F.cos(w), F.sin(m), F.cos(m)).alias("temporal"), F.array(e, F.abs(e), F.greatest(e, F.lit(0.0)), F.greatest(-e, F.lit(0.0))).alias("emotional"), F.array_sort(slots).alias("slots"))
    held = F.transform(F.array_distinct("slots"), lambda i: F.struct(i.alias("slot"), F.size(F.filter("slots", lambda y: y == i)).cast("double").alias("part")))
    x = x.select("id", "temporal", "emotional", held.alias("parts"))

    # Each norm is a column of its own: inside a lambda it would be taken again for every component.
    def norm(v, part=lambda y: y):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + part(y) * part(y)))

    x = x.select("*", norm("temporal").alias("n_t"), norm("emotional").alias("n_e"), norm("parts", lambda y: y["part"]).alias("n_p"))

    def unit(v, size):
        return F.when(F.col(size) > 0, F.transform(v, lambda y: y / F.col(size))).otherwise(F.col(v)).alias(v)

    return x.select("id", unit("temporal", "n_t"), unit("emotional", "n_e"), F.transform("parts", lambda y: F.struct(y["slot"].alias("slot"), (y["part"] / F.col("n_p")).alias("part"))).alias("parts"))


def dense(parts: str) -> Column:
    """All SLOTS components of the source projection, put together from its few parts and runs of zeros."""
    none = F.array().cast("array<double>")
    return F.aggregate(parts, none, lambda v, x: F.concat(v, F.array_repeat(F.lit(0.0), x["slot"] - F.size(v)), F.array(x["part"])), lambda v: F.concat(v, F.array_repeat(F.lit(0.0), F.lit(SLOTS) - F.size(v))))


@query("d12_hologram_encode", "memory")
def hologram_encode(memory: DataFrame) -> DataFrame:
    """id and normalised projections: temporal (cyclic hour, weekday, month), emotional, source (hashed wing, room, author)."""
    return projections(memory).select("id", "temporal", "emotional", dense("parts").alias("source"))


@query("d13_hologram_search", "memory", ids=["3", "12"])
def hologram_search(memory: DataFrame, ids: list[str], k: int = 10, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """Weighted sum of the cosines of each projection, for a stated list of records against all. Of the source projections only the
    few parts that aren't 0 are multiplied."""
    h = projections(memory).withColumn("squares", F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["part"] * x["part"]))
    q = h.where(F.col("id").isin(ids)).select(F.col("id").alias("qid"), *[F.col(c).alias(f"q_{c}") for c in ("temporal", "emotional", "squares")], dense("parts").alias("q_source"))
    x = h.join(F.broadcast(q), F.col("id") != F.col("qid"))  # len(ids) rows
    both = F.aggregate("parts", F.lit(0.0), lambda a, y: a + y["part"] * F.element_at("q_source", y["slot"] + 1))
    cosines = (cosine("temporal", "q_temporal"), cosine("emotional", "q_emotional"), both / (F.sqrt("squares") * F.sqrt("q_squares")))
    s = sum((w * c for w, c in zip(weights, cosines, strict=True)), F.lit(0.0))
    return top(x.select("qid", "id", F.round(s, 9).alias("s")), "s", k, "qid").select("qid", "id", r6("s").alias("score"), "rk")


@query("d14_context_pack", "memory", """
WITH s AS (SELECT id, content, round(0.5 * CASE WHEN contains(lower(content), 'thened') THEN 1.0 ELSE 0.0 END + 0.3 * importance / 5 + 0.2 * greatest(0.0, 1 - date_diff('second', created_at, {AS_OF}) / 86400.0 / 30), 9) AS s FROM memory),
t AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS rn FROM (SELECT * FROM s WHERE s > 0.2 ORDER BY s DESC, id LIMIT 40)), r AS (SELECT *, CAST(floor(0.25 * length(content)) AS BIGINT) AS tok FROM t), u AS (SELECT *, sum(tok) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run FROM r),
w AS (SELECT *, coalesce(max(CASE WHEN run > 3000 THEN 1 ELSE 0 END) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM u)
SELECT id, rn AS position, CASE WHEN run <= 3000 THEN content ELSE substr(content, 1, CAST((3000 - (run - tok)) * 4 AS INT)) END AS content FROM w WHERE over = 0 AND (run <= 3000 OR (3000 - (run - tok)) * 4 > 20)
""", word="thened", budget=3000)
def context_pack(memory: DataFrame, word: str, budget: int, most: int = 40, as_of: str = AS_OF) -> DataFrame:
    """The best records by relevance, importance and recency until a token budget is full; the last is cut to what is left."""
    s = 0.5 * F.when(F.contains(F.lower("content"), F.lit(word)), 1.0).otherwise(0.0) + 0.3 * F.col("importance") / 5 + 0.2 * F.greatest(F.lit(0.0), 1 - days_old("created_at", as_of) / 30)
    best = memory.select("id", "content", F.round(s, 9).alias("s")).where("s > 0.2").orderBy(F.desc("s"), "id").limit(most)
    w = Window.orderBy(F.desc("s"), "id")  # `most` rows only
    x = best.select("*", F.row_number().over(w).cast("long").alias("position"), estimate_tokens("content").alias("tok"))
    x = x.withColumn("run", F.sum("tok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("over", F.coalesce(F.max(F.when(F.col("run") > budget, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = (budget - (F.col("run") - F.col("tok"))) * 4
    return x.where((F.col("over") == 0) & ((F.col("run") <= budget) | (left > 20))).select("id", "position", F.when(F.col("run") <= budget, F.col("content")).otherwise(F.substr("content", F.lit(1), left.cast("int"))).alias("content"))


@query("d15_explain", "memory vector", f"""
WITH {_HYBRID}, x AS (SELECT h.qid, id, 0.2 * len(list_filter(list_distinct(string_split(q.text, ' ')), lambda w: contains(lower(content), w))) AS kw, 0.15 * len(list_filter(tags, lambda t: contains(q.text, t))) AS tg, 0.1 * importance / 5 AS imp, 0.3 * score AS vec FROM h JOIN q ON q.qid = h.qid)
SELECT qid, id, round(kw::DOUBLE, 6) AS keyword, round(tg::DOUBLE, 6) AS tag, round(imp::DOUBLE, 6) AS importance, round(vec::DOUBLE, 6) AS vector, CASE WHEN kw >= greatest(tg, imp, vec) THEN 'keyword' WHEN tg >= greatest(imp, vec) THEN 'tag' WHEN imp >= vec THEN 'importance' ELSE 'vector' END AS primary_factor FROM x
""")
def explain(memory: DataFrame, vector: DataFrame, queries: list[tuple[str, str]] = QUERIES, k: int = 10) -> DataFrame:
    """What each factor contributes to a fused result, and the largest."""
    x = rrf(_channels(memory, vector, queries, k)).join(memory, "id").join(F.broadcast(query_table(memory, queries)), "qid")
    parts = [
        ("keyword", 0.2 * F.size(F.filter(F.array_distinct(F.split("text", " ")), lambda w: F.contains(F.lower("content"), w)))),
        ("tag", 0.15 * F.size(F.filter("tags", lambda t: F.contains(F.col("text"), t)))),
        ("importance", 0.1 * F.col("importance") / 5),
        ("vector", 0.3 * F.col("score")),
    ]
    first = F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, v) in enumerate(parts)]))
    return x.select("qid", "id", *[r6(v).alias(name) for name, v in parts], first["name"].alias("primary_factor"))


@query("d16_layer_summary", "memory", """
WITH t AS (SELECT id, room, left(content, 200) AS line, row_number() OVER (ORDER BY room, importance DESC, id) AS rn FROM (SELECT * FROM memory ORDER BY importance DESC, id LIMIT 15)),
r AS (SELECT *, sum(length(line)) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run FROM t) SELECT room, id, line, rn AS position FROM r WHERE run <= 2000
""", budget=2000)
def layer_summary(memory: DataFrame, most: int = 15, cut: int = 200, budget: int = 3200) -> DataFrame:
    """The most important records by room, lines cut, within a budget of characters."""
    best = memory.orderBy(F.desc("importance"), "id").limit(most).select("id", "room", "importance", F.left("content", F.lit(cut)).alias("line"))
    w = Window.orderBy("room", F.desc("importance"), "id")  # `most` rows only
    x = best.select("room", "id", "line", F.row_number().over(w).cast("long").alias("position"), F.sum(F.length("line")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return x.where(F.col("run") <= budget).drop("run")


@query("d17_estimate_tokens", "memory", "SELECT id, CAST(floor(0.25 * length(content)) AS BIGINT) AS tokens FROM memory")
def tokens_of(memory: DataFrame) -> DataFrame:
    """Estimated tokens of each text."""
    return memory.select("id", estimate_tokens("content").alias("tokens"))


@query("d18_answer_batch", "memory", f"""
WITH {_Q}, s AS (SELECT qid, id, content, 2.0 * len(list_filter(string_split(q.text, ' '), lambda w: contains(lower(content), w))) + 3.0 * len(list_filter(tags, lambda t: contains(q.text, t))) AS s FROM q, memory), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM s WHERE s > 0), k AS (SELECT * FROM r WHERE rk <= 5)
SELECT qid, count(*) AS n, round(least(0.9, 0.3 + 0.1 * count(*) + 0.05 * max(s))::DOUBLE, 6) AS confidence, array_to_string(list(left(content, 40) ORDER BY rk), ' | ') AS answer FROM k GROUP BY qid
""")
def answer_batch(memory: DataFrame, queries: list[tuple[str, str]] = QUERIES, k: int = 5) -> DataFrame:
    """Per question the best records by words and tags, their beginnings joined, and a confidence. All questions meet a record in one pass."""
    asked = F.array(*[F.struct(F.lit(q).alias("qid"), F.lit(t).alias("text"), F.array(*map(F.lit, t.split())).alias("words")) for q, t in queries])
    x = memory.select("id", "content", F.lower("content").alias("low"), "tags", F.explode(asked).alias("q"))
    s = 2.0 * F.size(F.filter("q.words", lambda w: F.contains(F.col("low"), w))) + 3.0 * F.size(F.filter("tags", lambda t: F.contains(F.col("q.text"), t)))
    best = top(x.select("q.qid", "id", "content", s.alias("s")).where("s > 0"), "s", k, "qid")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rk", F.left("content", F.lit(40)).alias("c")))), lambda y: y["c"])
    return best.groupBy("qid").agg(count().alias("n"), r6(F.least(F.lit(0.9), 0.3 + 0.1 * F.count("*") + 0.05 * F.max("s"))).alias("confidence"), F.array_join(lines, " | ").alias("answer"))


@query("d19_recommend_by_context", "memory", """
WITH s AS (SELECT id, 2 * len(list_filter(['then', 'that'], lambda w: contains(lower(content), w))) + 3 * len(list_filter(['src2', 'then'], lambda w: list_contains(tags, w))) AS s FROM memory) SELECT id, round(least(1.0, s / 10.0)::DOUBLE, 6) AS score FROM s WHERE s > 0 ORDER BY s DESC, id LIMIT 20
""", context=["then", "that"], topics=["src2", "then"])
def recommend_by_context(memory: DataFrame, context: list[str], topics: list[str], k: int = 20) -> DataFrame:
    """2 for each context word in the text, 3 for each tag; a tenth of that, 1 at most."""
    hits_ = sum((F.when(F.contains(F.lower("content"), F.lit(w)), 1).otherwise(0) for w in context), F.lit(0))
    tags_ = sum((F.when(F.array_contains("tags", w), 1).otherwise(0) for w in topics), F.lit(0))
    return memory.select("id", (2 * hits_ + 3 * tags_).alias("s")).where("s > 0").orderBy(F.desc("s"), "id").limit(k).select("id", r6(F.least(F.lit(1.0), F.col("s") / 10.0)).alias("score"))


@query("d20_recommend_similar", "memory", """
WITH t AS (SELECT id, tags, wing FROM memory WHERE id IN ('3', '12')), s AS (SELECT t.id AS qid, m.id, 3 * len(list_intersect(t.tags, m.tags)) + CASE WHEN t.wing = m.wing THEN 2 ELSE 0 END AS s FROM t, memory m WHERE t.id <> m.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM s WHERE s > 0) SELECT qid, id, s::BIGINT AS score, rk FROM r WHERE rk <= 10
""", ids=["3", "12"])
def recommend_similar(memory: DataFrame, ids: list[str], k: int = 10) -> DataFrame:
    """3 for each shared tag and 2 for the same wing, for a stated list of records."""
    t = memory.where(F.col("id").isin(ids)).select(F.col("id").alias("qid"), F.col("tags").alias("qt"), F.col("wing").alias("qw"))
    x = memory.select("id", "tags", "wing").join(F.broadcast(t), F.col("id") != F.col("qid"))  # len(ids) rows
    s = 3 * F.size(F.array_intersect("qt", "tags")) + F.when(F.col("qw") == F.col("wing"), 2).otherwise(0)
    return top(x.select("qid", "id", s.cast("long").alias("score")).where("score > 0"), "score", k, "qid").select("qid", "id", "score", "rk")


@query("d21_recommend_related", "memory", f"""
WITH {_INDEX}, t AS (SELECT id AS qid, tok FROM ix WHERE id IN ('3', '12')), s AS (SELECT qid, ix.id, count(*) AS s FROM t JOIN ix ON t.tok = ix.tok AND t.qid <> ix.id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM s WHERE s >= 2) SELECT qid, id, s AS score, rk FROM r WHERE rk <= 10
""", ids=["3", "12"])
def recommend_related(memory: DataFrame, ids: list[str], k: int = 10, least: int = 2) -> DataFrame:
    """Records that share most tokens with those of a stated list. Only the listed records' tokens are joined."""
    ix = token_index(memory)
    t = ix.where(F.col("id").isin(ids)).select(F.col("id").alias("qid"), "tok")
    s = ix.join(t, "tok").where("id <> qid").groupBy("qid", "id").agg(count().alias("score")).where(F.col("score") >= least)
    return top(s, "score", k, "qid").select("qid", "id", "score", "rk")


@query("d22_recommend_timely", "memory", """
WITH a AS (SELECT id, 0.6 * importance / 5 + 0.4 * greatest(0.0, 1 - date_diff('second', created_at, {AS_OF}) / 86400.0 / 7) AS s FROM memory WHERE date_diff('second', created_at, {AS_OF}) / 86400.0 BETWEEN 1 AND 7),
b AS (SELECT id, 0.7 * importance / 5 + 0.3 AS s FROM memory WHERE wing <> 'en'), u AS (SELECT id, max(round(s, 9)) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id) SELECT id, round(s, 6) AS score FROM u ORDER BY s DESC, id LIMIT 30
""", wing="en")
def recommend_timely(memory: DataFrame, wing: str, k: int = 30, as_of: str = AS_OF) -> DataFrame:
    """Records of the last week, and important ones of other wings, the better score of each."""
    d = days_old("created_at", as_of)
    a = memory.where(d.between(1, 7)).select("id", (0.6 * F.col("importance") / 5 + 0.4 * F.greatest(F.lit(0.0), 1 - d / 7)).alias("s"))
    b = memory.where(F.col("wing") != wing).select("id", (0.7 * F.col("importance") / 5 + 0.3).alias("s"))
    return a.unionByName(b).groupBy("id").agg(F.max(F.round("s", 9)).alias("s")).orderBy(F.desc("s"), "id").limit(k).select("id", r6("s").alias("score"))


@query("d23_recommend_by_vector", "memory vector", f"""
WITH {_VT}, x AS (SELECT qid, vt.id, 0.6 * s + 0.2 * importance / 10 + 0.2 * pow(0.9, greatest(0.0, date_diff('second', created_at, {{AS_OF}}) / 86400.0 - 7)) AS s FROM vt JOIN memory m ON vt.id = m.id) SELECT qid, id, round(s, 6) AS score FROM x
""", ids=["0", "7", "42"])
def recommend_by_vector(memory: DataFrame, vector: DataFrame, ids: list[str], k: int = 10, as_of: str = AS_OF) -> DataFrame:
    """.6 cosine + .2 importance / 10 + .2 of .9 for each day beyond a week."""
    found = vector_top(vector, _vector_queries(vector, ids), k, 0.2).join(memory.select("id", "importance", "created_at"), "id")
    s = 0.6 * F.col("s") + 0.2 * F.col("importance") / 10 + 0.2 * F.pow(F.lit(0.9), F.greatest(F.lit(0.0), days_old("created_at", as_of) - 7))
    return found.select("qid", "id", r6(s).alias("score"))


@query("d24_predict_needed", "memory", """
WITH s AS (SELECT id, 0.3 * len(list_filter(['then', 'thened'], lambda w: contains(lower(content), w))) + 0.2 * len(list_filter(tags, lambda t: contains('then thened t1', t))) + 0.1 * importance / 5 + 0.1 * greatest(0.0, 1 - date_diff('second', created_at, {AS_OF}) / 86400.0 / 30) AS s FROM memory)
SELECT id, round(s::DOUBLE, 6) AS score FROM s WHERE s > 0.1 ORDER BY round(s::DOUBLE, 9) DESC, id LIMIT 25
""", keywords=["then", "thened"], context="then thened t1")
def predict_needed(memory: DataFrame, keywords: list[str], context: str, k: int = 25, as_of: str = AS_OF) -> DataFrame:
    """.3 for each keyword, .2 for each tag in the context, importance and recency."""
    s = 0.3 * sum((F.when(F.contains(F.lower("content"), F.lit(w)), 1).otherwise(0) for w in keywords), F.lit(0)) + 0.2 * F.size(F.filter("tags", lambda t: F.contains(F.lit(context), t)))
    s = s + 0.1 * F.col("importance") / 5 + 0.1 * F.greatest(F.lit(0.0), 1 - days_old("created_at", as_of) / 30)
    return memory.select("id", s.alias("s")).where("s > 0.1").withColumn("o", F.round("s", 9)).orderBy(F.desc("o"), "id").limit(k).select("id", r6("s").alias("score"))


@query("d25_result_dedup", "memory", f"""
WITH {_FTS}, x AS (SELECT qid, m.id, rk, lower(trim(left(content, 100))) AS p FROM fts JOIN memory m ON fts.id = m.id), y AS (SELECT *, row_number() OVER (PARTITION BY qid, p ORDER BY rk) AS rn FROM x) SELECT qid, id, rk FROM y WHERE rn = 1
""")
def result_dedup(memory: DataFrame, queries: list[tuple[str, str]] = QUERIES, k: int = 10) -> DataFrame:
    """Search results without those whose first 100 characters a better one has."""
    x = fts(memory, query_table(memory, queries), k).join(memory.select("id", F.lower(F.trim(F.left("content", F.lit(100)))).alias("p")), "id")
    return x.withColumn("rn", F.row_number().over(Window.partitionBy("qid", "p").orderBy("rk"))).where("rn = 1").select("qid", "id", "rk")


@query("d26_facet_results", "memory", f"""
WITH {_FTS}, x AS (SELECT qid, m.id, tags[1] AS tag, wing, row_number() OVER (PARTITION BY qid ORDER BY created_at, m.id) AS rn, count(*) OVER (PARTITION BY qid) AS n FROM fts JOIN memory m ON fts.id = m.id)
SELECT qid, id, tag, wing, least(2, (rn - 1) // greatest(1, n // 3))::BIGINT AS chunk FROM x
""", chunks=3)
def facet_results(memory: DataFrame, chunks: int, queries: list[tuple[str, str]] = QUERIES, k: int = 10) -> DataFrame:
    """Results with first tag, wing and an equal chunk of time (the remainder in the last)."""
    x = fts(memory, query_table(memory, queries), k).join(memory, "id")
    n_ = F.count("*").over(Window.partitionBy("qid"))
    rn = F.row_number().over(Window.partitionBy("qid").orderBy("created_at", "id"))
    return x.select("qid", "id", F.element_at("tags", 1).alias("tag"), "wing", F.least(F.lit(chunks - 1), F.floor((rn - 1) / F.greatest(F.lit(1), F.floor(n_ / chunks)))).cast("long").alias("chunk"))


@query("d27_cross_project_search", "memory", """
WITH s AS (SELECT room AS project, id, 2 * len(list_filter(['then', 'that'], lambda w: contains(lower(content), w))) + 3 * len(list_filter(['t1'], lambda w: list_contains(tags, w))) AS s FROM memory), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY s DESC, id) AS rk FROM s WHERE s > 0) SELECT project, id, s::BIGINT AS score FROM r WHERE rk <= 3
""", asked=["then", "that"], tagged=["t1"])
def cross_project_search(memory: DataFrame, asked: list[str], tagged: list[str], k: int = 3) -> DataFrame:
    """The best records of every project (room) by words and tags. The ranking stops at k rows before the exchange."""
    s = 2 * sum((F.when(F.contains(F.lower("content"), F.lit(w)), 1).otherwise(0) for w in asked), F.lit(0)) + 3 * sum((F.when(F.array_contains("tags", w), 1).otherwise(0) for w in tagged), F.lit(0))
    return top(memory.select(F.col("room").alias("project"), "id", s.cast("long").alias("score")).where("score > 0"), "score", k, "project").select("project", "id", "score")


def merge_project(source: DataFrame, target: DataFrame) -> DataFrame:
    """The target's rows and those of the source whose id it hasn't, each id of the source once."""
    return target.unionByName(source.join(target.select("id"), "id", "left_anti").dropDuplicates(["id"]).select(*target.columns))


@query("d27_merge_project", "memory", """
SELECT id, md5(content) AS digest, 'target' AS origin FROM memory WHERE CAST(id AS BIGINT) % 2 = 0 UNION ALL SELECT id, md5(content), 'source' FROM memory WHERE CAST(id AS BIGINT) % 3 <> 0 AND CAST(id AS BIGINT) % 2 <> 0
""")
def merged_projects(memory: DataFrame) -> DataFrame:
    """Two overlapping projects made from the table (even ids, and ids that three doesn't divide), the second merged into the first."""
    k = F.col("id").cast("long")
    rows = memory.select("id", F.md5("content").alias("digest"))
    return merge_project(rows.where(k % 3 != 0).withColumn("origin", F.lit("source")), rows.where(k % 2 == 0).withColumn("origin", F.lit("target")))
