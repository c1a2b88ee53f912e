"""Summaries and knowledge drawn from groups of records. Groups are cut to their leading rows by ranking before anything is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.columns import any_of, count, days_old, labels, n, r6
from mnemolake.operators.conflict import DATA_OPPOSITES, polarity
from mnemolake.operators.similarity import keywords
from mnemolake.plans.registry import query
from mnemolake.plans.views import AS_OF

_SENT = "string_split(regexp_replace(content, '([.!?。！？])', '\\1' || chr(10), 'g'), chr(10))"
_KW = "kw AS (SELECT id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS rn FROM (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z]{3,}')) AS word FROM memory) WHERE word NOT IN ('the', 'and', 'that') GROUP BY 1, 2)) WHERE rn <= 8)"


def sentences(memory: DataFrame, *keep: str) -> DataFrame:
    parts = F.split(F.regexp_replace("content", "([.!?。！？])", "$1\n"), "\n")
    return memory.select("id", *keep, F.posexplode(F.transform(parts, lambda x: F.trim(x))).alias("pos", "s"))


def leading(df: DataFrame, k: int, by: str, *order) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("rn", rn).where(F.col("rn") <= k)


@query("k1_key_points", "memory", f"""
WITH t AS (SELECT room, id, importance, row_number() OVER (PARTITION BY room ORDER BY importance DESC, id) AS r, content FROM memory), s AS (SELECT room, r, importance, id, trim(u.s) AS s, u.i AS pos FROM (SELECT *, unnest(list_transform({_SENT}, lambda x, i: {{'s': x, 'i': i}})) AS u FROM t WHERE r <= 10)),
d AS (SELECT room, s, min((r, pos)) AS k FROM s WHERE length(s) BETWEEN 11 AND 199 GROUP BY 1, 2), x AS (SELECT room, s, row_number() OVER (PARTITION BY room ORDER BY k) AS rn FROM d) SELECT room AS topic, rn AS rank, s AS point FROM x WHERE rn <= 10
""")
def key_points(memory: DataFrame, rows: int = 10, most: int = 10) -> DataFrame:
    """Per topic (room) the first sentences of 11 to 199 characters of its leading records, repeated ones once."""
    t = leading(memory, rows, "room", F.desc("importance"), "id")
    s = sentences(t, "room", "rn").where(F.length("s").between(11, 199)).groupBy("room", "s").agg(F.min(F.struct("rn", "pos")).alias("k"))
    return leading(s, most, "room", "k").select(F.col("room").alias("topic"), F.col("rn").cast("long").alias("rank"), F.col("s").alias("point"))


@query("k2_fuse_topic", "memory", """
WITH t AS (SELECT topic, memory.* FROM (VALUES ('thened'), ('inth'), ('src7')) AS v(topic), memory WHERE contains(lower(content), topic) OR list_contains(tags, topic)), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY importance DESC, id) AS rn FROM t)
SELECT topic, count(*) AS n, round(least(1.0, 0.3 + 0.05 * count(*)), 6) AS confidence, round(avg(importance), 6) AS importance, array_to_string(list(id ORDER BY created_at, id), ',') AS evolution FROM r WHERE rn <= 20 GROUP BY topic
""", topics=["thened", "inth", "src7"])
def fuse_topic(memory: DataFrame, topics: list[str], most: int = 20) -> DataFrame:
    """Leading records of each stated topic: how many, confidence, importance and their order in time."""
    low = memory.select("id", "importance", "created_at", F.lower("content").alias("c"), "tags", F.explode(F.array(*map(F.lit, topics))).alias("topic"))
    t = low.where(F.contains("c", F.col("topic")) | F.array_contains("tags", F.col("topic"))).drop("c", "tags")
    g = leading(t, most, "topic", F.desc("importance"), "id").groupBy("topic")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id"))), lambda x: x["id"])
    return g.agg(count().alias("n"), r6(F.least(F.lit(1.0), 0.3 + 0.05 * F.count("*"))).alias("confidence"), r6(F.avg("importance")).alias("importance"), F.array_join(ids, ",").alias("evolution"))


def _masks() -> str:
    from mnemolake.operators.conflict import _masks_sql

    return _masks_sql()


_WORD = "[\\x{{4e00}}-\\x{{9fff}}]{{2,}}|[a-z]{{3,}}"


@query("k2_fused_topics", "memory", f"""
WITH {_masks()}, t AS (SELECT topic, m.*, row_number() OVER (PARTITION BY topic ORDER BY importance DESC, id) AS rn FROM (VALUES ('thened'), ('inth'), ('src7'), ('zzzz')) AS v(topic), m WHERE contains(lower(content), topic) OR list_contains(tags, topic)), r AS (SELECT * FROM t WHERE rn <= 20),
w AS (SELECT topic, word, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, word) AS k FROM (SELECT topic, unnest(regexp_extract_all(lower(content), '{_WORD.replace("{{", "{").replace("}}", "}")}')) AS word FROM r) WHERE word <> topic GROUP BY topic, word),
kw AS (SELECT topic, array_to_string(list(word ORDER BY k), ',') AS keywords FROM w WHERE k <= 8 GROUP BY topic),
s AS (SELECT topic, rn, u.i AS pos, trim(u.s) AS s FROM (SELECT topic, rn, unnest(list_transform({_SENT}, lambda x, i: {{'s': x, 'i': i}})) AS u FROM r)),
d AS (SELECT topic, s, row_number() OVER (PARTITION BY topic ORDER BY min((rn, pos))) AS k FROM s WHERE length(s) BETWEEN 11 AND 199 GROUP BY topic, s),
kp AS (SELECT topic, array_to_string(list(s ORDER BY k), ' | ') AS key_points FROM d WHERE k <= 10 GROUP BY topic),
g AS (SELECT topic, count(*) AS n, round(least(1.0, 0.5 + avg(importance) / 10 + count(*) / 50.0), 6) AS confidence, strftime(min(created_at), '%Y-%m-%d') AS earliest, strftime(max(created_at), '%Y-%m-%d') AS latest, array_to_string(list(id ORDER BY rn), ',') AS sources, array_to_string(list(id ORDER BY created_at, id), ',') AS evolution,
  count(*) FILTER (pos <> 0) AS claims, count(*) FILTER (neg <> 0) AS denials FROM r GROUP BY topic)
SELECT topic, n, confidence, earliest, latest, sources, evolution, coalesce(keywords, '') AS keywords, coalesce(key_points, '') AS key_points, claims, denials, claims > 0 AND denials > 0 AS contradictory FROM g LEFT JOIN kw USING (topic) LEFT JOIN kp USING (topic)
""", topics=["thened", "inth", "src7", "zzzz"], opposites=DATA_OPPOSITES)
def fused_topics(memory: DataFrame, topics: list[str], opposites, most: int = 20, words: int = 8, points: int = 10) -> DataFrame:
    """Each stated topic's leading records as one piece of knowledge: sources, order in time, keywords, key points (the first
    distinct sentences of 11 to 199 characters), claims and denials, and confidence. Topics without records have no row.

    Texts are cut to the leading records of a topic before words or sentences are taken, so that is all that moves.
    """
    pos, neg = polarity(opposites)
    m = memory.select("id", "content", "importance", "created_at", "tags", F.lower("content").alias("c"), F.explode(F.array(*map(F.lit, topics))).alias("topic"))
    t = m.where(F.contains("c", F.col("topic")) | F.array_contains("tags", F.col("topic"))).select("topic", "id", "importance", "created_at")
    lead = leading(t, most, "topic", F.desc("importance"), "id")
    r = memory.select("id", "content", pos.alias("pos"), neg.alias("neg")).join(F.broadcast(lead), "id")  # `most` rows a topic
    word = r.select("topic", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[\\u4e00-\\u9fff]{2,}|[a-z]{3,}"), F.lit(0))).alias("word")).where("word <> topic").groupBy("topic", "word").agg(count().alias("n"))
    s = sentences(r, "topic", "rn").where(F.length("s").between(11, 199)).groupBy("topic", "s").agg(F.min(F.struct("rn", "pos")).alias("k"))

    def joined(value: str, sep: str, *order):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]), sep)

    kw = leading(word, words, "topic", F.desc("n"), "word").groupBy("topic").agg(joined("word", ",", "rn").alias("keywords"))
    kp = leading(s, points, "topic", "k").groupBy("topic").agg(joined("s", " | ", "rn").alias("key_points"))
    g = r.groupBy("topic").agg(count().alias("n"), r6(F.least(F.lit(1.0), 0.5 + F.avg("importance") / 10 + F.count("*") / 50.0)).alias("confidence"), F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("earliest"), F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("latest"),
        joined("id", ",", "rn").alias("sources"), joined("id", ",", "created_at").alias("evolution"), n(F.col("pos") != 0).alias("claims"), n(F.col("neg") != 0).alias("denials"))
    out = g.join(kw, "topic", "left").join(kp, "topic", "left")
    return out.select("topic", "n", "confidence", "earliest", "latest", "sources", "evolution", F.coalesce("keywords", F.lit("")).alias("keywords"), F.coalesce("key_points", F.lit("")).alias("key_points"), "claims", "denials", ((F.col("claims") > 0) & (F.col("denials") > 0)).alias("contradictory"))


@query("k3_progressive_summary", "memory", """
WITH w AS (SELECT lower(regexp_extract(content, '[A-Za-z]+')) AS w, importance FROM memory) SELECT 2 AS level, w AS key, count(*) AS n, round(avg(importance), 6) AS importance FROM w GROUP BY w HAVING count(*) >= 2 UNION ALL SELECT 3, NULL, count(*), round(avg(importance), 6) FROM w
""")
def progressive_summary(memory: DataFrame) -> DataFrame:
    """Groups by first word (level 2) and the whole (level 3)."""
    w = memory.select(F.lower(F.regexp_extract("content", "[A-Za-z]+", 0)).alias("key"), "importance")
    a = w.groupBy("key").agg(count().alias("n"), r6(F.avg("importance")).alias("importance")).where("n >= 2")
    b = w.agg(count().alias("n"), r6(F.avg("importance")).alias("importance"))
    return a.select(F.lit(2).alias("level"), "key", "n", "importance").unionByName(b.select(F.lit(3).alias("level"), F.lit(None).cast("string").alias("key"), "n", "importance"))


KINDS = [("fact", ["是", "version", "thened"]), ("lesson", ["教训", "learned", "eronth"]), ("decision", ["决定", "decided", "inthe"]), ("pattern", ["总是", "always", "ndthe"])]


@query("k4_crystallize", "memory", """
SELECT kind, count(*) AS n, min(id) AS first_id FROM (SELECT id, unnest(list_filter([CASE WHEN contains(c, '是') OR contains(c, 'version') OR contains(c, 'thened') THEN 'fact' END, CASE WHEN contains(c, '教训') OR contains(c, 'learned') OR contains(c, 'eronth') THEN 'lesson' END,
CASE WHEN contains(c, '决定') OR contains(c, 'decided') OR contains(c, 'inthe') THEN 'decision' END, CASE WHEN contains(c, '总是') OR contains(c, 'always') OR contains(c, 'ndthe') THEN 'pattern' END], lambda x: x IS NOT NULL)) AS kind FROM (SELECT id, lower(content) AS c FROM memory)) GROUP BY kind
""")
def crystallize(memory: DataFrame, kinds=KINDS) -> DataFrame:
    """Records that state facts, lessons, decisions or patterns (several at once are possible)."""
    k = labels([(any_of(F.lower("content"), ws), name) for name, ws in kinds])
    return memory.select("id", F.explode(k).alias("kind")).groupBy("kind").agg(count().alias("n"), F.min("id").alias("first_id"))


@query("k5_distill_groups", "memory", """
WITH f AS (SELECT tag, count(*) AS k FROM (SELECT unnest(tags) AS tag FROM memory) GROUP BY 1), o AS (SELECT id, importance, any_value(size) AS size, arg_max(x.tag, (k, x.tag)) AS tag FROM (SELECT id, importance, length(content) AS size, unnest(tags) AS tag FROM memory) x JOIN f ON f.tag = x.tag GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY importance DESC, id) AS rn FROM o) SELECT tag, count(*) AS n, round(least(5.0, avg(importance) + 0.3), 6) AS importance, CAST(floor(0.25 * sum(size) * 0.6) AS BIGINT) AS tokens_saved, array_to_string(list(id ORDER BY rn), ',') AS ids FROM r WHERE rn <= 10 GROUP BY tag
""")
def distill_groups(memory: DataFrame, most: int = 10) -> DataFrame:
    """Each record goes to its most frequent tag; the leading ones make a group with raised importance."""
    t = memory.select("id", "importance", F.length("content").alias("size"), F.explode("tags").alias("tag"))
    f = t.groupBy("tag").agg(count().alias("k"))
    o = t.join(f, "tag").groupBy("id", "importance", "size").agg(F.max_by("tag", F.struct("k", "tag")).alias("tag"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"])
    return leading(o, most, "tag", F.desc("importance"), "id").groupBy("tag").agg(count().alias("n"), r6(F.least(F.lit(5.0), F.avg("importance") + 0.3)).alias("importance"), F.floor(0.25 * F.sum("size") * 0.6).cast("long").alias("tokens_saved"), F.array_join(ids, ",").alias("ids"))


@query("k6_knowledge_cards", "memory", f"""
WITH {_KW}, k AS (SELECT id, array_to_string(list(word ORDER BY n DESC, word), ',') AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS rn FROM kw) WHERE rn <= 5 GROUP BY id)
SELECT m.id, left(content, 50) AS title, coalesce(keywords, '') AS keywords, len(list_filter({_SENT}, lambda x: contains(lower(x), 'thened')))::BIGINT AS causal FROM memory m LEFT JOIN k ON k.id = m.id WHERE importance >= 4.5
""", cause="thened")
def knowledge_cards(memory: DataFrame, cause: str = "because", least: float = 4.5, most: int = 5) -> DataFrame:
    """Title, keywords and number of causal sentences of each important record."""
    m = memory.where(F.col("importance") >= least)
    k = keywords(m, most).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "word"))), lambda x: x["word"]), ",").alias("keywords"))
    parts = F.split(F.regexp_replace("content", "([.!?。！？])", "$1\n"), "\n")
    causal = F.size(F.filter(parts, lambda x: F.contains(F.lower(x), F.lit(cause)))).cast("long")
    return m.select("id", F.left("content", F.lit(50)).alias("title"), causal.alias("causal")).join(k, "id", "left").select("id", "title", F.coalesce("keywords", F.lit("")).alias("keywords"), "causal")


@query("k7_synthesize_topics", "memory", """
SELECT tag, count(*) AS n, count(DISTINCT wing) AS wings, round(least(1.0, 0.4 + 0.1 * count(*)), 6) AS confidence, arg_max(id, (importance + 0.1 * len(tags) + CASE WHEN length(content) > 200 THEN 0.5 ELSE 0 END, id)) AS insight FROM (SELECT *, unnest(tags) AS tag FROM memory) GROUP BY tag HAVING count(*) >= 2
""")
def synthesize_topics(memory: DataFrame) -> DataFrame:
    """Tags with their wings, a confidence and the most telling record."""
    score = F.col("importance") + 0.1 * F.size("tags") + F.when(F.length("content") > 200, 0.5).otherwise(0.0)
    t = memory.select("id", "wing", score.alias("score"), F.explode("tags").alias("tag"))
    return t.groupBy("tag").agg(count().alias("n"), F.countDistinct("wing").alias("wings"), r6(F.least(F.lit(1.0), 0.4 + 0.1 * F.count("*"))).alias("confidence"), F.max_by("id", F.struct("score", "id")).alias("insight")).where("n >= 2")


@query("k8_shared_tag_links", "memory", """
WITH t AS (SELECT id, wing, importance, tag, row_number() OVER (PARTITION BY tag, wing ORDER BY importance DESC, id) AS rn FROM (SELECT id, wing, importance, unnest(tags) AS tag FROM memory))
SELECT a.tag, a.id AS a, b.id AS b, round(least(a.importance, b.importance) / 5, 6) AS weight FROM t a JOIN t b ON a.tag = b.tag AND a.wing < b.wing WHERE a.rn <= 2 AND b.rn <= 2
""")
def shared_tag_links(memory: DataFrame, per_wing: int = 2) -> DataFrame:
    """Links between wings by tag, from the leading records of each tag and wing only."""
    t = memory.select("id", "wing", "importance", F.explode("tags").alias("tag"))
    rn = F.row_number().over(Window.partitionBy("tag", "wing").orderBy(F.desc("importance"), "id"))
    t = t.withColumn("rn", rn).where(F.col("rn") <= per_wing)
    a, b = (t.select("tag", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "wing", "importance")]) for k in "ab")
    return a.join(b, "tag").where("wing_a < wing_b").select("tag", F.col("id_a").alias("a"), F.col("id_b").alias("b"), r6(F.least("importance_a", "importance_b") / 5).alias("weight"))


@query("k9_narratives", "memory", """
WITH t AS (SELECT * FROM memory WHERE importance > 3 ORDER BY created_at DESC, id LIMIT 30) SELECT wing, count(*) AS n, round(avg(importance), 6) AS importance, array_to_string(list(left(content, 20) ORDER BY created_at, id), ' | ') AS story FROM t GROUP BY wing HAVING count(*) >= 3
""")
def narratives(memory: DataFrame, most: int = 30, least: int = 3) -> DataFrame:
    """The newest important records as a story for each wing with enough of them."""
    t = memory.where("importance > 3").orderBy(F.desc("created_at"), "id").limit(most)
    story = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", F.left("content", F.lit(20)).alias("p")))), lambda x: x["p"])
    return t.groupBy("wing").agg(count().alias("n"), r6(F.avg("importance")).alias("importance"), F.array_join(story, " | ").alias("story")).where(F.col("n") >= least)


@query("k10_hypotheses", "memory", f"""
WITH {_masks()} SELECT room, count(*) AS n, count(*) FILTER (pos <> 0) AS evidence, count(*) FILTER (neg <> 0) AS against, round(count(*) FILTER (pos <> 0)::DOUBLE / nullif(count(*) FILTER (pos <> 0 OR neg <> 0), 0), 6) AS support, count(*) FILTER (date_diff('second', created_at, {{AS_OF}}) / 86400.0 <= 15) AS recent FROM m GROUP BY room HAVING count(*) >= 3
""", opposites=DATA_OPPOSITES)
def hypotheses(memory: DataFrame, opposites, as_of: str = AS_OF) -> DataFrame:
    """Per room with enough records: evidence for and against, the share in favour, and how much is recent."""
    pos, neg = polarity(opposites)
    m = memory.select("room", pos.alias("pos"), neg.alias("neg"), days_old("created_at", as_of).alias("d"))
    g = m.groupBy("room").agg(count().alias("n"), n(F.col("pos") != 0).alias("evidence"), n(F.col("neg") != 0).alias("against"), n((F.col("pos") != 0) | (F.col("neg") != 0)).alias("either"), n(F.col("d") <= 15).alias("recent"))
    return g.where("n >= 3").select("room", "n", "evidence", "against", r6(F.try_divide("evidence", "either")).alias("support"), "recent")
