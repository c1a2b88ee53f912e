"""Causal links between all records, chains along them, root causes, and effects that are lost without a cause.

Records with the same set of tags, cause mark and effect mark are interchangeable here, so links are between such classes,
named by their smallest id, with the number of record pairs they stand for; pairs are never listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.columns import any_of, count, r6
from mnemolake.operators.similarity import jaccard_pairs
from mnemolake.plans.registry import query
from mnemolake.plans.storage import materialize

_LINKS = """m AS (SELECT id, list_sort(list_distinct(tags)) AS s, contains(lower(content), 'ththe') AS c, contains(lower(content), 'onhe') AS e FROM memory),
k AS (SELECT s, min(id) AS id, count(*) FILTER (c) AS nc, count(*) FILTER (e) AS ne, count(*) FILTER (c AND e) AS nb FROM m WHERE c OR e GROUP BY s),
l AS (SELECT a.id AS cause, b.id AS effect, len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) AS o, a.nc * b.ne - CASE WHEN a.id = b.id THEN a.nb ELSE 0 END AS pairs FROM k a JOIN k b ON a.nc > 0 AND b.ne > 0),
links AS (SELECT cause, effect, o, least(0.9, 0.4 + o) AS confidence, pairs FROM l WHERE o > 0.2 AND pairs > 0)"""


@query("i13_cause_effect_pairs", "memory", f"WITH {_LINKS} SELECT cause, effect, round(o, 6) AS similarity, round(confidence, 6) AS confidence, CASE WHEN o > 0.5 THEN 'direct' ELSE 'indirect' END AS relation, pairs FROM links", cause=["ththe"], effect=["onhe"])
def cause_effect_pairs(memory: DataFrame, cause: list[str], effect: list[str], least: float = 0.2) -> DataFrame:
    """Cause-marked with effect-marked records whose tags overlap by more than least (over 0), among all records.

    One row for each pair of tag classes: the smallest ids, the overlap, and how many pairs of different records it stands
    for. Classes meet by the parities of their tags, so a tag that a third of the records have is no join key.
    """
    text = F.lower("content")
    m = memory.select("id", F.array_sort(F.array_distinct("tags")).alias("s"), F.coalesce(any_of(text, cause), F.lit(False)).alias("c"), F.coalesce(any_of(text, effect), F.lit(False)).alias("e")).where((F.col("c") | F.col("e")) & (F.size("s") > 0))
    ones = [F.sum(x.cast("long")).alias(k) for k, x in (("nc", F.col("c")), ("ne", F.col("e")), ("nb", F.col("c") & F.col("e")))]
    k = materialize(m.groupBy("s").agg(F.min("id").alias("id"), *ones), "tag-classes")
    near = jaccard_pairs(k, F.col("s"), least).where(F.col("similarity") > least)
    same = k.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(same)
    x = both.join(k.select(F.col("id").alias("a"), "nc", "nb"), "a").join(k.select(F.col("id").alias("b"), "ne"), "b")
    x = x.withColumn("pairs", F.col("nc") * F.col("ne") - F.when(F.col("a") == F.col("b"), F.col("nb")).otherwise(0)).where("nc > 0 AND ne > 0 AND pairs > 0")
    o = F.col("similarity")
    return x.select(F.col("a").alias("cause"), F.col("b").alias("effect"), r6(o).alias("similarity"), r6(F.least(F.lit(0.9), 0.4 + o)).alias("confidence"), F.when(o > 0.5, "direct").otherwise("indirect").alias("relation"), "pairs")


_FIRST = "f AS (SELECT cause, min(effect) AS effect, arg_min(confidence, effect) AS confidence FROM links WHERE cause <> effect GROUP BY cause)"


@query("i14_cause_chains", "memory", f"""
WITH {_LINKS}, {_FIRST}, x AS (SELECT l.cause, l.effect, l.confidence AS c1, b.effect AS s2, b.confidence AS c2, d.effect AS s3, d.confidence AS c3 FROM links l LEFT JOIN f b ON b.cause = l.effect LEFT JOIN f d ON d.cause = b.effect WHERE l.cause <> l.effect)
SELECT cause, concat_ws('>', cause, effect, s2, s3) AS path, CASE WHEN s2 IS NULL THEN 1 WHEN s3 IS NULL THEN 2 ELSE 3 END::BIGINT AS steps, round(CASE WHEN s2 IS NULL THEN c1 WHEN s3 IS NULL THEN (c1 + c2) / 2 ELSE (c1 + c2 + c3) / 3 END, 6) AS confidence FROM x WHERE s2 IS NOT NULL
""", cause=["ththe"], effect=["onhe"], steps=2)
def cause_chains(memory: DataFrame, cause: list[str], effect: list[str], steps: int = 5) -> DataFrame:
    """From every causal link along the first link of each effect, at most so many further ones; chains of two links and more with their mean confidence."""
    return chains_of(cause_effect_pairs(memory, cause, effect).select("cause", "effect", "confidence"), steps)


def chains_of(links: DataFrame, steps: int) -> DataFrame:
    """cause, path, steps, confidence of chains along links (cause, effect, confidence): the first link of a cause is that to its smallest effect. Loops are left out; a chain may go round a circle until its steps are used up."""
    links = materialize(links.where("cause <> effect"), "links")
    first = links.groupBy("cause").agg(F.min(F.struct("effect", "confidence")).alias("f"))
    x = links.select("cause", F.array("cause", "effect").alias("path"), F.array("confidence").alias("c"), F.col("effect").alias("at"))
    for _ in range(steps):
        x = x.join(first.select(F.col("cause").alias("at"), "f"), "at", "left").select("cause", F.when(F.col("f").isNull(), F.col("path")).otherwise(F.concat("path", F.array("f.effect"))).alias("path"), F.when(F.col("f").isNull(), F.col("c")).otherwise(F.concat("c", F.array("f.confidence"))).alias("c"), F.col("f.effect").alias("at"))
    mean = F.aggregate("c", F.lit(0.0), lambda s, v: s + v) / F.size("c")
    return x.where(F.size("c") >= 2).select("cause", F.array_join("path", ">").alias("path"), F.size("c").cast("long").alias("steps"), r6(mean).alias("confidence"))


@query("i14_root_causes", "memory", f"""
WITH {_LINKS}, r AS (SELECT effect, cause, confidence, row_number() OVER (PARTITION BY effect ORDER BY confidence DESC, cause) AS rank, count(*) OVER (PARTITION BY effect) AS found FROM links WHERE cause <> effect) SELECT effect, cause, round(confidence, 6) AS confidence, rank, found FROM r WHERE rank <= 5
""", cause=["ththe"], effect=["onhe"])
def root_causes(memory: DataFrame, cause: list[str], effect: list[str], most: int = 5) -> DataFrame:
    """The causes believed most of every effect, and how many it has."""
    links = materialize(cause_effect_pairs(memory, cause, effect).where("cause <> effect").select("cause", "effect", "confidence"), "links")
    rank = F.row_number().over(Window.partitionBy("effect").orderBy(F.desc("confidence"), "cause"))
    best = links.withColumn("rank", rank).where(F.col("rank") <= most)
    return best.join(links.groupBy("effect").agg(count().alias("found")), "effect").select("effect", "cause", r6("confidence").alias("confidence"), "rank", "found")


def _growing(start: DataFrame, step, keys: list[str], label: str) -> DataFrame:
    """All rows that start and step lead to: each round takes the last one's new rows on, and is a written table."""
    new = materialize(start.distinct(), label)
    every = new
    while not new.isEmpty():
        new = materialize(step(new).distinct().join(every, keys, "left_anti"), label)
        every = every.unionByName(new)
    return materialize(every, label)


def reachable(links: DataFrame) -> DataFrame:
    """(cause, effect): all that links (cause, effect) lead to, in any number of steps; circles end, and a node in one reaches itself."""
    links = links.select("cause", "effect")
    ahead = links.select(F.col("cause").alias("at"), F.col("effect").alias("to"))
    return _growing(links, lambda new: new.join(ahead, F.col("effect") == F.col("at")).select("cause", F.col("to").alias("effect")), ["cause", "effect"], "reach")


def lost_without(links: DataFrame) -> DataFrame:
    """(cause, effect): effects that no chain from an uncaused event leads to any more once the cause is taken out.

    Uncaused events have no link to them. What only hangs on a circle without such an event is never counted. A cause loses
    what it dominates: what all chains from uncaused events to the effect go through. A node's dominators are itself and
    what its causes' dominators have in common; rounds take those on whose causes changed, until none does. Work follows
    the links and their few common dominators, not the pairs that reach each other.
    """
    links = materialize(links.where("cause <> effect").select("cause", "effect").distinct(), "links")
    uncaused = links.select(F.col("cause").alias("node")).distinct().join(links.select(F.col("effect").alias("node")), "node", "left_anti")
    known = new = materialize(uncaused.select("node", F.col("node").alias("over")), "dominators")
    while not new.isEmpty():
        touched = links.join(new.select(F.col("node").alias("cause")).distinct(), "cause", "left_semi").select("effect").distinct()
        met = links.join(touched, "effect", "left_semi").join(known, F.col("cause") == F.col("node")).select("effect", "cause", "over")
        causes = met.where("over = cause").groupBy("effect").agg(F.count("*").alias("causes"))
        common = met.groupBy("effect", "over").agg(F.count("*").alias("n")).join(causes, "effect").where("n = causes").select(F.col("effect").alias("node"), "over")
        now = materialize(common.unionByName(touched.select(F.col("effect").alias("node"), F.col("effect").alias("over"))).distinct(), "dominators")
        counted = [d.groupBy("node").agg(F.count("*").alias(k)) for d, k in ((now, "n"), (known, "was"))]
        # Dominators of a known node only ever get fewer, so their number tells whether they changed.
        changed = counted[0].join(counted[1], "node", "left").where("was IS NULL OR n <> was").select("node")
        new = materialize(now.join(changed, "node", "left_semi"), "dominators-changed")
        known = materialize(known.join(new.select("node").distinct(), "node", "left_anti").unionByName(new), "dominators")
    return known.where("over <> node").select(F.col("over").alias("cause"), F.col("node").alias("effect"))


@query("i14_what_if", "relation")
def what_if(relation: DataFrame) -> DataFrame:
    """How many entities each one's relations lead to, and how many of these nothing else leads to."""
    links = relation.select(F.col("subject_id").alias("cause"), F.col("object_id").alias("effect"))
    n = reachable(links).where("cause <> effect").groupBy("cause").agg(count().alias("effects"))
    gone = lost_without(links).groupBy("cause").agg(count().alias("lost"))
    return n.join(gone, "cause", "left").select("cause", "effects", F.coalesce("lost", F.lit(0)).cast("long").alias("lost"))
