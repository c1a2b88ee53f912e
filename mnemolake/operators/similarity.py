"""Similarity joins, duplicate groups and clusters.

Set-similarity joins of high thresholds meet all sets of fitting sizes by their parities (operators/parity.py). Equal sets are
one node before any join, and pairs are reported between such nodes, with membership.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.columns import count, r6
from mnemolake.operators.components import connected_components
from mnemolake.operators.parity import TOKENS, WORDS, hashed_sets, members, parity_pairs, representatives, similarities, trigram_hashes, word_sets, words_of
from mnemolake.operators.sets import classes as set_members
from mnemolake.operators.sets import set_links, trigram_sets
from mnemolake.operators.vectors import classes, vector_pairs
from mnemolake.plans.registry import query
from mnemolake.plans.storage import materialize

STOP = ["the", "and", "that"]
KNOWN = 100_000  # ids that are broadcast, at most
_TOK = "list_distinct(regexp_extract_all(lower({0}), '[\\x{{4e00}}-\\x{{9fff}}]+|[a-z0-9_]{{2,}}'))"


def near_in_parity(pairs: DataFrame, th: float) -> DataFrame:
    """Of pairs (a, b, na, nb, fa, fb) those whose fine parities, folded to one width, leave a Jaccard of th possible."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                most = (b.column(2).to_numpy() + b.column(3).to_numpy()) * (1 - th) / (1 + th) + 1e-6
                keep = np.zeros(b.num_rows, bool)
                (x, wx), (y, wy) = (words_of(b.column(k)) for k in (4, 5))
                for i, j in sorted(set(zip(wx.tolist(), wy.tolist(), strict=True))):
                    rows = np.flatnonzero((wx == i) & (wy == j))
                    u, v = x(rows, i), y(rows, j)
                    while u.shape[1] != v.shape[1]:
                        u, v = (u, v) if u.shape[1] > v.shape[1] else (v, u)
                        half = u.shape[1] // 2
                        u = u[:, :half] ^ u[:, half:]
                    keep[rows] = np.bitwise_count(u ^ v).sum(1) <= most[rows]
                yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    return pairs.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(run, "a string, b string")


def jaccard_pairs(df: DataFrame, tokens_: Column, th: float, gap: int | None = None) -> DataFrame:
    """(a, b, similarity) of classes a < b with Jaccard of at least th, exact; th > 0. With gap, only sets whose sizes differ by no more are paired."""
    sets = hashed_sets(df, tokens_, th)
    return near_sets(sets, representatives(sets), th, gap)


def near_sets(sets: DataFrame, reps: DataFrame, th: float, gap: int | None = None) -> DataFrame:
    """jaccard_pairs() of sets from operators/parity.py.

    All pairs of fitting sizes meet by their parities; the rest is tried by finer parities, and what is left checked once on whole sets.
    """
    pairs = materialize(parity_pairs(reps, th, gap), "near-pairs")
    some = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    whole = materialize(sets.join(some, "key", "left_semi").groupBy("key").agg(F.first("fine").alias("f"), F.first("s").alias("s")), "near-sets")
    fa, fb, sa, sb = (whole.select(F.col("key").alias(k), F.col(c).alias(f"{c}{k}")) for c in "fs" for k in "ab")
    pairs = near_in_parity(pairs.join(fa, "a").join(fb, "b"), th)
    j = similarities(pairs.join(sa, "a").join(sb, "b")).where(F.col("similarity") >= th - 1e-12)
    ids = reps.select("key", "id")
    x = j.join(ids.withColumnsRenamed({"key": "a", "id": "x"}), "a").join(ids.withColumnsRenamed({"key": "b", "id": "y"}), "b").where("x <> y")
    return x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


@query("e1_dup_hash", "memory", """
SELECT min(id) AS first_id, count(*) AS n, round(max(importance), 6) AS importance FROM memory GROUP BY trim(content) HAVING count(*) > 1
""")
def dup_hash(memory: DataFrame) -> DataFrame:
    """Groups of equal texts, outer spaces aside: smallest id, size, highest importance."""
    return memory.groupBy(F.sha2(F.trim("content"), 256)).agg(F.min("id").alias("first_id"), count().alias("n"), r6(F.max("importance")).alias("importance")).where("n > 1").select("first_id", "n", "importance")


_NEAR = "round(list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]), 9)"


@query("e2_dup_vector", "vector", f"WITH c AS (SELECT id, v, min(id) OVER (PARTITION BY v) AS cls FROM vector) SELECT a.id AS a, b.id AS b, round({_NEAR}, 6) AS similarity FROM c a JOIN c b ON a.id < b.id WHERE a.cls = a.id AND b.cls IN (a.id, b.id) AND {_NEAR} >= 0.45", th=0.45)
def dup_vector(vector: DataFrame, th: float = 0.99) -> DataFrame:
    """Pairs of vectors with cosine of at least th. Copies are linked to the first of them, which stands for all in the other pairs."""
    copies = classes(vector).where("id <> cls").select(F.col("cls").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return vector_pairs(vector, th).select("a", "b", r6("s").alias("similarity")).unionByName(copies)


_SETS = "ts AS (SELECT id, list_sort({0}) AS s FROM memory), c AS (SELECT id, s FROM ts WHERE len(s) > 0 QUALIFY row_number() OVER (PARTITION BY s ORDER BY id) = 1)"


def _pairs_sql(toks: str, th: float) -> str:
    return f"WITH {_SETS.format(toks)} SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS similarity FROM c a JOIN c b ON a.id < b.id AND least(len(a.s), len(b.s)) >= {th} * greatest(len(a.s), len(b.s)) WHERE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= {th}"


@query("e3_dup_jaccard", "memory", _pairs_sql(_TOK.format("content"), 0.8), th=0.8)
def dup_jaccard(memory: DataFrame, th: float) -> DataFrame:
    """Pairs of token-set classes with Jaccard of at least th."""
    sets = word_sets(memory, TOKENS, th)
    return near_sets(sets, representatives(sets), th).select("a", "b", r6("similarity").alias("similarity"))


_C3 = """g AS (SELECT DISTINCT id, substr(content, CAST(i AS INT), 3) AS tri FROM (SELECT id, content, unnest(range(1, length(content) - 1)) AS i FROM memory WHERE length(content) > 2)),
w AS (SELECT tri, row_number() OVER () AS x FROM (SELECT DISTINCT tri FROM g)), t AS (SELECT id, list_sort(list(CAST(x AS INT))) AS s FROM g JOIN w USING (tri) GROUP BY id), k AS (SELECT id, s, min(id) OVER (PARTITION BY s) AS cls FROM t),
e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM k WHERE id = cls), p AS (SELECT a.id AS a, b.id AS b, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS s FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND least(a.n, b.n) > {0} * greatest(a.n, b.n) GROUP BY 1, 2)"""


@query("e5_dup_char3", "memory", f"WITH {_C3.format(0.85)} SELECT a, b, round(s, 6) AS similarity FROM p WHERE s > 0.85 UNION ALL SELECT cls, id, 1.0 FROM k WHERE id <> cls", th=0.85)
def dup_char3(memory: DataFrame, th: float = 0.85) -> DataFrame:
    """Pairs of records whose character trigrams have a Jaccard similarity over th, among all records. Equal sets are linked
    to the smallest id, which stands for all in the other pairs. The reference's caps on rows and merges are not kept."""
    sets = trigram_hashes(memory, th)
    reps = representatives(sets)
    copies = members(sets, reps).where("id <> cls").select(F.col("cls").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return near_sets(sets, reps, th).where(F.col("similarity") > th).select("a", "b", r6("similarity").alias("similarity")).unionByName(copies)


@query("e5_link_char3", "memory", f"""
WITH {_C3.format(0.3)}, l AS (SELECT a AS id, s FROM p UNION ALL SELECT b, s FROM p), n AS (SELECT id, count(*) FILTER (s > 0.3 AND s <= 0.85) AS r, count(*) FILTER (s > 0.85) AS d FROM l GROUP BY id)
SELECT k.id, cls, coalesce(r, 0) AS n_related, coalesce(d, 0) AS n_duplicates FROM k LEFT JOIN n ON n.id = k.cls
""")
def link_char3(memory: DataFrame, low: float = 0.3, high: float = 0.85) -> DataFrame:
    """For every record its class of equal trigram sets, and how many other classes are related to it (over low) or
    duplicates of it (over high), of all records. Related pairs are a large part of all, so they are counted and not listed."""
    s = materialize(trigram_sets(memory), "trigrams")
    return set_members(s).join(set_links(s, low, high).withColumnRenamed("id", "cls"), "cls").select("id", "cls", "n_related", "n_duplicates")


def duplicate_groups(memory: DataFrame, th: float = 0.8) -> DataFrame:
    """(id, component): components of records whose token sets are equal or have Jaccard of at least th."""
    return set_components(word_sets(memory, TOKENS, th), th)


def set_components(sets: DataFrame, th: float) -> DataFrame:
    """(id, component) of sets from operators/parity.py. Components are found among distinct sets, and carried to their members."""
    reps = representatives(sets)
    comp = connected_components(near_sets(sets, reps, th), "a", "b")
    return members(sets, reps).join(comp, F.col("cls") == F.col("node"), "left").select("id", F.coalesce("component", "cls").alias("component"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(content), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"


@query("e4_dup_words_greedy", "memory", f"WITH RECURSIVE {_SETS.format(_WORDS)}, p AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.id <> b.id AND least(len(a.s), len(b.s)) >= 0.85 * greatest(len(a.s), len(b.s)) WHERE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.85), w AS (SELECT id AS node, id AS root FROM c UNION SELECT p.b, w.root FROM w JOIN p ON p.a = w.node), k AS (SELECT node, min(root) AS leader FROM w GROUP BY node) SELECT leader, count(*) AS n FROM ts t JOIN c ON c.s = t.s JOIN k ON k.node = c.id GROUP BY leader HAVING count(*) > 1", th=0.85)
def dup_words(memory: DataFrame, th: float) -> DataFrame:
    """Groups by white-space words; the order-bound greedy leader is replaced by connected components."""
    return set_components(word_sets(memory, WORDS, th), th).groupBy(F.col("component").alias("leader")).agg(count().alias("n")).where("n > 1")


@query("e6_dup_prefix_or_tags", "memory", """
SELECT 'prefix' AS kind, min(id) AS leader, count(*) AS n FROM memory GROUP BY left(content, 30) HAVING count(*) > 1 UNION ALL SELECT 'tags', min(id), count(*) FROM memory GROUP BY list_sort(tags), left(lower(content), 10) HAVING count(*) > 1
""")
def dup_prefix_or_tags(memory: DataFrame) -> DataFrame:
    """Groups of equal 30-character prefixes, and of equal tags with an equal beginning."""
    a = memory.groupBy(F.left("content", F.lit(30)).alias("k")).agg(F.min("id").alias("leader"), count().alias("n")).select(F.lit("prefix").alias("kind"), "leader", "n")
    b = memory.groupBy(F.array_sort("tags").alias("k"), F.left(F.lower("content"), F.lit(10)).alias("p")).agg(F.min("id").alias("leader"), count().alias("n")).select(F.lit("tags").alias("kind"), "leader", "n")
    return a.unionByName(b).where("n > 1")


_EDGES = f"{_SETS.format(_TOK.format('content'))}, p AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.id <> b.id AND least(len(a.s), len(b.s)) >= 0.8 * greatest(len(a.s), len(b.s)) WHERE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.8), w AS (SELECT id AS node, id AS root FROM c UNION SELECT p.b, w.root FROM w JOIN p ON p.a = w.node), k AS (SELECT node, min(root) AS component FROM w GROUP BY node), m AS (SELECT t.id, component FROM ts t JOIN c ON c.s = t.s JOIN k ON k.node = c.id)"


@query("e7_group_duplicates", "memory", f"WITH RECURSIVE {_EDGES} SELECT component, count(*) AS n, arg_max(m.id, (importance, length(content), m.id)) AS main FROM m JOIN memory ON memory.id = m.id GROUP BY component HAVING count(*) > 1")
def group_duplicates(memory: DataFrame, th: float = 0.8) -> DataFrame:
    """Duplicate groups and their main record, by importance, then length."""
    g = duplicate_groups(memory, th).join(memory.select("id", "importance", F.length("content").alias("size")), "id")
    return g.groupBy("component").agg(count().alias("n"), F.max_by("id", F.struct("importance", "size", "id")).alias("main")).where("n > 1")


@query("e8_merge_duplicates", "memory", f"WITH RECURSIVE {_EDGES}, g AS (SELECT component, memory.* FROM m JOIN memory ON memory.id = m.id), t AS (SELECT component, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM (SELECT component, unnest(tags) AS tag FROM g) GROUP BY 1) SELECT g.component AS id, arg_max(content, (length(content), id)) AS content, max(importance) AS importance, any_value(t.tags) AS tags, CAST(CAST(min(created_at) AS DATE) AS VARCHAR) AS day FROM g JOIN t ON t.component = g.component GROUP BY g.component")
def merge_duplicates(memory: DataFrame, th: float = 0.8) -> DataFrame:
    """One record per group: longest text, highest importance, all tags, earliest day. Tags are made distinct before they are gathered."""
    g = memory.join(duplicate_groups(memory, th), "id")
    t = g.select("component", F.explode("tags").alias("tag")).groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    m = g.groupBy("component").agg(F.max_by("content", F.struct(F.length("content"), "id")).alias("content"), F.max("importance").alias("importance"), F.to_date(F.min("created_at")).cast("string").alias("day"))
    return m.join(t, "component").select(F.col("component").alias("id"), "content", "importance", "tags", "day")


def keywords(memory: DataFrame, k: int = 8, stop: list[str] = STOP) -> DataFrame:
    """(id, word, n): each text's most frequent words of three letters or more, stop words aside.

    A text's words are counted and cut within its row; only words of an id that several rows have are exchanged. Whether any has
    is counted first: up to KNOWN such ids are broadcast, more are joined.
    """
    several = materialize(memory.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "repeated-ids")
    low, many = memory.select("id", F.lower("content").alias("low")), several.count()
    if not many:
        return top_words(low, k, stop)
    same = low["id"].eqNullSafe(several["id"])
    several = F.broadcast(several) if many <= KNOWN else several
    one = top_words(low.join(several, same, "left_anti"), k, stop)
    c = top_words(low.join(several, same, "left_semi"), None, stop).groupBy("id", "word").agg(F.sum("n").cast("long").alias("n"))
    rn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "word"))
    return one.unionByName(c.withColumn("rn", rn).where(F.col("rn") <= k).drop("rn"))


def top_words(low: DataFrame, k: int | None, stop: list[str]) -> DataFrame:
    """(id, word, n) of every row (id, low): its k most frequent words of three letters or more, ties in order; all with None."""

    def run(batches):
        find, gone = re.compile("[a-z]{3,}").findall, set(stop)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                of, words, counts = [], [], []
                for row, text in enumerate(b.column(1).to_pylist()):
                    if text:
                        found = Counter(find(text))
                        best = sorted(((-n, w) for w, n in found.items() if w not in gone))[:k]
                        of.extend([row] * len(best))
                        words.extend(w for _, w in best)
                        counts.extend(-n for n, _ in best)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["id", "word", "n"])

    return low.select("id", "low").mapInArrow(run, "id string, word string, n long")


def shared_keywords(memory: DataFrame) -> DataFrame:
    """(id, ws): the keywords of each text that some other text has too, for texts with two of them or more."""
    kw = materialize(keywords(memory).select("id", "word"), "keywords")
    shared = kw.groupBy("word").agg(F.count("*").alias("df")).where("df > 1").select("word")
    return kw.join(shared, "word").groupBy("id").agg(F.collect_list("word").alias("ws")).where(F.size("ws") > 1)


def keyword_subsets(kw: DataFrame, *keep: str) -> DataFrame:
    """(*keep, k1, k2, weight): a row for every subset of two words or more of ws (at most 8), named by 128 bits; its weight is (-1)^j (j - 1) for j words."""
    masks = [m for m in range(1, 256) if m.bit_count() > 1]
    bits = np.array([[m >> i & 1 for i in range(8)] for m in masks], np.uint64)
    weights = np.array([(-1) ** m.bit_count() * (m.bit_count() - 1) for m in masks], np.int64)
    reach = np.array([m.bit_length() for m in masks])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                sizes = b.column(len(keep)).value_lengths().to_numpy()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                row, col = np.nonzero(reach[None, :] <= sizes[:, None])
                keys = []
                for k in (0, 1):
                    h = np.zeros((len(sizes), 8), np.uint64)
                    h[owner, place] = b.column(len(keep) + k).flatten().to_numpy().view(np.uint64)
                    keys.append(pa.array((h @ bits.T)[row, col].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(row)) for k in range(len(keep))], *keys, pa.array(weights[col])], [*keep, "k1", "k2", "weight"])

    def hashed(seed: int) -> Column:
        return F.transform("ws", lambda w: F.xxhash64(w, F.lit(seed)))

    hashes = [hashed(k).alias(f"h{k}") for k in (1, 2)]
    kinds = ", ".join(f"{c} {kw.schema[c].dataType.simpleString()}" for c in keep)
    return kw.select(*keep, *hashes).mapInArrow(run, f"{kinds}, k1 long, k2 long, weight long")


_KW = "kw AS (SELECT id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS rn FROM (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z]{3,}')) AS word FROM memory) WHERE word NOT IN ('the', 'and', 'that') GROUP BY 1, 2)) WHERE rn <= 8)"


@query("e9_keyword_extract", "memory", f"WITH {_KW} SELECT id, word, n FROM kw")
def keyword_extract(memory: DataFrame, k: int = 8) -> DataFrame:
    """Top words of every text."""
    return keywords(memory, k)


@query("e10_cluster_vectors", "vector")
def cluster_vectors(vector: DataFrame, n_cells: int = 8) -> DataFrame:
    """k-means cells by cosine: size and mean cosine to the centre."""
    from mnemolake.functions.columns import dot
    from mnemolake.operators.search import cells

    placed, model = cells(vector, n_cells)
    centers = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    c = F.element_at(centers, F.col("cell") + 1)
    s = dot("v", c) / (F.sqrt(dot("v", "v")) * F.sqrt(dot(c, c)))
    return placed.select("cell", s.alias("s")).groupBy("cell").agg(count().alias("n"), r6(F.avg("s")).alias("cohesion"))


@query("e11_cluster_keywords", "memory", f"WITH {_KW}, d AS (SELECT word, count(*) AS df FROM kw GROUP BY 1), a AS (SELECT id, arg_max(kw.word, (df, kw.word)) AS word FROM kw JOIN d ON kw.word = d.word GROUP BY id) SELECT word, count(*) AS n FROM a GROUP BY word HAVING count(*) >= 2 ORDER BY n DESC, word LIMIT 20")
def cluster_keywords(memory: DataFrame, k: int = 20) -> DataFrame:
    """Each text joins the keyword of its own that most texts have; the largest groups."""
    kw = materialize(keywords(memory).select("id", "word"), "keywords")
    d = kw.groupBy("word").agg(F.count("*").alias("df"))
    a = kw.join(d, "word").groupBy("id").agg(F.max_by("word", F.struct("df", "word")).alias("word"))
    return a.groupBy("word").agg(count().alias("n")).where("n >= 2").orderBy(F.desc("n"), "word").limit(k)


@query("e13_cluster_stats", "memory", f"WITH {_KW}, d AS (SELECT word, count(*) AS df FROM kw GROUP BY 1), a AS (SELECT id, arg_max(kw.word, (df, kw.word)) AS word FROM kw JOIN d ON kw.word = d.word GROUP BY id), c AS (SELECT word, count(*) AS n FROM a GROUP BY word HAVING count(*) >= 2 ORDER BY n DESC, word LIMIT 20) SELECT count(*) AS clusters, sum(n)::BIGINT AS records, round(avg(n), 6) AS mean_size, max(n) AS largest, min(n) AS smallest FROM c")
def cluster_stats(memory: DataFrame) -> DataFrame:
    """Sizes of the keyword clusters."""
    return cluster_keywords(memory).agg(count().alias("clusters"), F.sum("n").alias("records"), r6(F.avg("n")).alias("mean_size"), F.max("n").alias("largest"), F.min("n").alias("smallest"))


def _vp(group: str) -> str:
    return f"g AS (SELECT v.id, v, {group} AS g FROM vector v JOIN memory m ON m.id = v.id), c AS (SELECT id, v, g FROM g WHERE g IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g, v ORDER BY id) = 1), vp AS (SELECT a.id AS a, b.id AS b, a.g AS ga, b.g AS gb, {_NEAR} AS s FROM c a JOIN c b ON a.id < b.id WHERE {_NEAR} >= 0.4)"


@query("e14_cross_wing_links", "memory vector", f"WITH {_vp('wing')} SELECT a, b, round(s, 6) AS similarity FROM vp WHERE ga <> gb", th=0.4)
def cross_wing_links(memory: DataFrame, vector: DataFrame, th: float) -> DataFrame:
    """Similar vectors of records in different wings; of a wing's copies the first stands for all."""
    v = vector.select("id", "v").join(memory.select("id", F.col("wing").alias("g")), "id")
    return vector_pairs(v, th, "other").select("a", "b", r6("s").alias("similarity"))


@query("e15_resonance", "memory vector", f"WITH {_vp('nullif(sign(emotional_weight), 0)')} SELECT a, b, round(s, 6) AS similarity FROM vp WHERE ga = gb", th=0.4)
def resonance(memory: DataFrame, vector: DataFrame, th: float) -> DataFrame:
    """Similar vectors of records with the same sign of emotional weight; of copies with one sign the first stands for all."""
    v = vector.select("id", "v").join(memory.select("id", F.nullif(F.signum("emotional_weight"), F.lit(0.0)).alias("g")), "id")
    return vector_pairs(v, th, "same").select("a", "b", r6("s").alias("similarity"))


@query("e16_best_history_link", "memory vector", """
WITH n AS (SELECT v.id, v, created_at, tags FROM vector v JOIN memory m ON m.id = v.id), p AS (SELECT a.id AS id, b.id AS history, round(list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]), 9) AS s, len(list_intersect(a.tags, b.tags)) AS shared FROM n a JOIN n b ON b.created_at < a.created_at AND a.id <> b.id WHERE CAST(a.id AS BIGINT) % 50 = 0)
SELECT id, arg_max(history, (s, history)) AS history, round(max(s), 6) AS similarity, arg_max(shared, (s, history))::BIGINT AS shared_tags FROM p WHERE s >= 0.3 GROUP BY id
""", th=0.3)
def best_history_link(memory: DataFrame, vector: DataFrame, th: float = 0.4, block: int = 1024) -> DataFrame:
    """For each new record (every fiftieth) the most similar older one. The new ones are a stated query set against all: a block of
    them meets Arrow batches of all vectors in matrix products, and each partition keeps its best for each."""
    from mnemolake.operators.search import query_blocks

    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("created_at"))
    n = materialize(vector.join(memory.select("id", at.alias("at"), "tags"), "id").where("at IS NOT NULL AND v IS NOT NULL").select("id", "v", "at", "tags"), "dated-vectors")
    new = n.where(F.col("id").cast("long") % 50 == 0).select(F.col("id").alias("qid"), "v", "at", "tags")
    out = None
    for q in query_blocks(new, block):
        one = best_older(n, q, th)
        out = one if out is None else out.unionByName(one)
    key = F.struct("s", "history")
    shared = F.size(F.array_intersect("q_tags", "tags")).cast("long")
    return out.groupBy("id").agg(F.max_by("history", key).alias("history"), r6(F.max("s")).alias("similarity"), F.max_by(shared, key).alias("shared_tags"))


def best_older(vectors: DataFrame, queries: DataFrame, th: float) -> DataFrame:
    """(id, history, s, q_tags, tags) of each of a bounded block of queries (qid, v, at, tags) and, from every partition of vectors
    (id, v, at, tags), the earlier one of largest cosine (9 digits), from th on; ties to the larger id. Of unequal lengths the shorter
    counts, null components are 0."""
    rows = queries.collect()
    sent = vectors.sparkSession.sparkContext.broadcast(rows)
    tags = vectors.schema["tags"].dataType.simpleString()

    def filled(v) -> np.ndarray:
        return np.array([0.0 if x is None else x for x in v], np.float64)

    def by_length(vs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(v) for v in vs])
        return [(k := np.flatnonzero(sizes == size), np.stack([vs[i] for i in k.tolist()])) for size in np.unique(sizes).tolist()]

    def unit(m: np.ndarray) -> np.ndarray:
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm != 0)

    def run(batches):
        rows = sent.value
        qt, groups, own = np.array([r["at"] for r in rows]), by_length([filled(r["v"]) for r in rows]), {}
        for j, r in enumerate(rows):
            own.setdefault(r["qid"], []).append(j)
        best: dict[int, tuple] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                b = whole.slice(low, 1024)
                ids, at = b.column(0).to_pylist(), b.column(2).to_numpy()
                for i, m in by_length([filled(v) for v in b.column(1).to_pylist()]):
                    for j, q in groups:
                        size = min(m.shape[1], q.shape[1])
                        with np.errstate(all="ignore"):
                            s = np.round(unit(m[:, :size]) @ unit(q[:, :size]).T, 9)
                        s[np.isnan(s)] = np.inf  # larger than any number, as in SQL
                        s[(s < th) | (at[i][:, None] >= qt[j][None, :])] = -np.inf
                        place = {int(x): k for k, x in enumerate(j.tolist())}
                        for k, x in enumerate(i.tolist()):
                            for same in own.get(ids[x], ()):
                                if same in place:
                                    s[k, place[same]] = -np.inf
                        most = s.max(0)
                        for x, y in zip(*np.nonzero((s == most) & (most > -np.inf)), strict=True):
                            one = (float(s[x, y]), ids[i[x]])
                            if int(j[y]) not in best or one > best[int(j[y])][:2]:
                                best[int(j[y])] = (*one, b.column(3)[int(i[x])].as_py())
        found = sorted(best.items())
        s = [float("nan") if x[0] == np.inf else x[0] for _, x in found]
        kinds = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([rows[j]["qid"] for j, _ in found], pa.string()), pa.array([x[1] for _, x in found], pa.string()), pa.array(s, pa.float64()), pa.array([rows[j]["tags"] for j, _ in found], kinds), pa.array([x[2] for _, x in found], kinds)], ["id", "history", "s", "q_tags", "tags"])

    return vectors.select("id", "v", "at", "tags").mapInArrow(run, f"id string, history string, s double, q_tags {tags}, tags {tags}")


@query("e17_wing_cooccurrence", "memory", f"WITH {_KW}, p AS (SELECT a.id AS x, b.id AS y FROM kw a JOIN kw b ON a.word = b.word AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 2) SELECT least(m.wing, n.wing) AS a, greatest(m.wing, n.wing) AS b, count(*) AS n FROM p JOIN memory m ON m.id = x JOIN memory n ON n.id = y WHERE m.wing <> n.wing GROUP BY 1, 2")
def wing_cooccurrence(memory: DataFrame) -> DataFrame:
    """For each pair of wings, how many pairs of records share two keywords or more.

    No records are paired. Records are counted by wing for every subset of two keywords or more; a record pair that shares m
    has m over j subsets of j in common, and weighted by (-1)^j (j - 1) these add up to 1 for every m from 2 on.
    """
    kw = memory.where("wing IS NOT NULL").select("id", "wing").join(shared_keywords(memory), "id")
    c = keyword_subsets(kw, "wing").groupBy("k1", "k2", "weight", "wing").agg(F.count("*").alias("n"))
    c = c.groupBy("k1", "k2", "weight").agg(F.collect_list(F.struct("wing", "n")).alias("w")).where(F.size("w") > 1)
    x = c.select("weight", "w", F.explode("w").alias("x")).select("weight", "x", F.explode("w").alias("y")).where("x.wing < y.wing")
    x = x.groupBy(F.col("x.wing").alias("a"), F.col("y.wing").alias("b")).agg(F.sum(F.col("weight") * F.col("x.n") * F.col("y.n")).alias("n"))
    return x.where("n > 0")
