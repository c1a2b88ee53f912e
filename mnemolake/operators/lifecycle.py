"""Scores and bulk updates over a record's life: decay, retention, importance, forgetting, compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.columns import any_of, count, days_old, hours_old, n, r6
from mnemolake.plans.registry import query
from mnemolake.plans.views import AS_OF

_HOURS = "date_diff('second', created_at, {AS_OF}) / 3600.0"
_DAYS = "date_diff('second', created_at, {AS_OF}) / 86400.0"


def reads(access_log: DataFrame) -> DataFrame:
    return access_log.groupBy("memory_id").agg(count().alias("accesses"))


def with_reads(memory: DataFrame, access_log: DataFrame) -> DataFrame:
    return memory.join(reads(access_log).withColumnRenamed("memory_id", "id"), "id", "left").withColumn("accesses", F.coalesce("accesses", F.lit(0)))


_READS = "r AS (SELECT memory_id, count(*) AS accesses FROM access_log GROUP BY 1), m AS (SELECT memory.*, coalesce(accesses, 0) AS accesses FROM memory LEFT JOIN r ON id = memory_id)"


@query("j1_decay", "memory", f"""
WITH x AS (SELECT id, {_HOURS} AS h, importance / 5 AS imp FROM memory),
y AS (SELECT id, h, CASE WHEN h < 0.5 THEN 1.0 ELSE greatest(0.15, least(1.0, pow(0.95, h / 168) * (1 - 0.4 * imp * 0.1) * (CASE WHEN (hour({{AS_OF}}) < 6) THEN 1 / 1.2 ELSE 1.0 END) * (CASE WHEN h <= 24 THEN 1.35 WHEN h >= 720 THEN 1.06 ELSE 1.0 END))) END AS s FROM x)
SELECT id, round(s, 6) AS decay_score, CASE WHEN s > 1.001 THEN 'strengthened' WHEN s < 0.999 THEN 'decayed' ELSE 'unchanged' END AS action FROM y
""")
def decay(memory: DataFrame, as_of: str = AS_OF, base: float = 0.95, floor: float = 0.15, night: float = 1.2, short: float = 1.35, long: float = 1.06) -> DataFrame:
    """Weekly decay of a score of 1, weaker for important records, stronger at night, with a boost for the fresh and the old; clamped to [floor, 1]."""
    h = hours_old("created_at", as_of)
    at_night = 1 / night if int(as_of[11:13]) < 6 else 1.0
    touch = F.when(h <= 24, short).when(h >= 720, long).otherwise(1.0)
    s = F.pow(F.lit(base), h / 168) * (1 - 0.4 * (F.col("importance") / 5) * 0.1) * at_night * touch
    x = memory.select("id", F.when(h < 0.5, 1.0).otherwise(F.greatest(F.lit(floor), F.least(F.lit(1.0), s))).alias("s"))
    return x.select("id", r6("s").alias("decay_score"), F.when(F.col("s") > 1.001, "strengthened").when(F.col("s") < 0.999, "decayed").otherwise("unchanged").alias("action"))


@query("j2_decay_stats", "memory", f"""
WITH x AS (SELECT greatest(0.15, pow(0.95, {_HOURS} / 168) * importance / 5) AS s FROM memory) SELECT count(*) AS n, round(avg(s), 6) AS mean_score, count(*) FILTER (s <= 0.15) AS at_floor, count(*) FILTER (s < 0.3) AS archived, count(*) FILTER (s > 0.7) AS healthy FROM x
""")
def decay_stats(memory: DataFrame, as_of: str = AS_OF, floor: float = 0.15, purge_under: float = 0.3) -> DataFrame:
    """Of importance-weighted decay scores: mean, how many at the floor, to archive, and healthy."""
    s = F.greatest(F.lit(floor), F.pow(F.lit(0.95), hours_old("created_at", as_of) / 168) * F.col("importance") / 5)
    return memory.select(s.alias("s")).agg(count().alias("n"), r6(F.avg("s")).alias("mean_score"), n(F.col("s") <= floor).alias("at_floor"), n(F.col("s") < purge_under).alias("archived"), n(F.col("s") > 0.7).alias("healthy"))


def retention(rate: float, as_of: str):
    return F.exp(-rate * hours_old("created_at", as_of) / 24) * F.col("importance") * (1 + 0.05 * F.col("accesses"))


@query("j3_retention_curve", "memory access_log", f"WITH {_READS} SELECT id, round(exp(-0.1 * ({_HOURS}) / 24) * importance * (1 + 0.05 * accesses), 6) AS retention FROM m")
def retention_curve(memory: DataFrame, access_log: DataFrame, rate: float = 0.1, as_of: str = AS_OF) -> DataFrame:
    """Forgetting curve weighted by importance and accesses."""
    return with_reads(memory, access_log).select("id", r6(retention(rate, as_of)).alias("retention"))


_EFFECTIVE = f"importance * exp(-0.1 * ({_HOURS}) / 24) * least(2.0, 1 + 0.1 * accesses) * least(1.3, 1 + 0.1 * len(tags)) * (CASE WHEN length(content) > 500 THEN 1.1 WHEN length(content) < 50 THEN 0.8 ELSE 1.0 END)"


def effective(as_of: str = AS_OF, rate: float = 0.1):
    length = F.length("content")
    return F.col("importance") * F.exp(-rate * hours_old("created_at", as_of) / 24) * F.least(F.lit(2.0), 1 + 0.1 * F.col("accesses")) * F.least(F.lit(1.3), 1 + 0.1 * F.size("tags")) * F.when(length > 500, 1.1).when(length < 50, 0.8).otherwise(1.0)


@query("j4_effective_importance", "memory access_log", f"WITH {_READS} SELECT id, round(({_EFFECTIVE})::DOUBLE, 6) AS effective FROM m")
def effective_importance(memory: DataFrame, access_log: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Importance times retention, access (2 at most), tag (1.3 at most) and length factors."""
    return with_reads(memory, access_log).select("id", r6(effective(as_of)).alias("effective"))


def lowest(df: DataFrame, score, share: int) -> DataFrame:
    """The lowest 1/share by (score, id): the cut is found as an exact percentile rank by counting, then applied as a filter, so rows are never ranked in one task."""
    x = df.withColumn("_s", F.round(score, 9))
    total = x.count()
    want = max(1, total // share) if total else 0
    return x.orderBy("_s", "id").limit(want).drop("_s")


@query("j5_find_forgotten", "memory access_log", f"""
WITH {_READS}, e AS (SELECT id, ({_EFFECTIVE})::DOUBLE AS e, {_HOURS} AS h, accesses FROM m), k AS (SELECT id FROM e ORDER BY round(e, 9), id LIMIT (SELECT greatest(1, count(*) // 3) FROM memory))
SELECT id, e < 0.5 AS forgotten, id IN (SELECT id FROM k) AS compressible, h > CASE WHEN accesses < 6 THEN ([24, 6, 24, 72, 168, 720])[accesses + 1] ELSE 720 * pow(1.5, accesses - 5) END AS due FROM e
""")
def find_forgotten(memory: DataFrame, access_log: DataFrame, under: float = 0.5, as_of: str = AS_OF) -> DataFrame:
    """Per record: under the threshold, in the lowest third by effective importance, due for review by its access count."""
    x = with_reads(memory, access_log).select("id", effective(as_of).alias("e"), hours_old("created_at", as_of).alias("h"), "accesses")
    low = lowest(x, F.col("e"), 3).select("id", F.lit(True).alias("low"))
    steps = F.array(*map(F.lit, [24.0, 6.0, 24.0, 72.0, 168.0, 720.0]))
    interval = F.when(F.col("accesses") < 6, F.element_at(steps, F.least(F.col("accesses") + 1, F.lit(6)).cast("int"))).otherwise(720.0 * F.pow(F.lit(1.5), F.col("accesses") - 5))
    return x.join(low, "id", "left").select("id", (F.col("e") < under).alias("forgotten"), F.coalesce("low", F.lit(False)).alias("compressible"), (F.col("h") > interval).alias("due"))


RATES = {"hall_facts": 0.02, "hall_events": 0.1, "hall_discoveries": 0.05, "hall_preferences": 0.03, "hall_advice": 0.04, "hall_concepts": 0.02, "hall_relations": 0.05}


@query("j6_typed_retention", "memory access_log", f"""
WITH {_READS}, x AS (SELECT id, hall, (CASE hall WHEN 'hall_facts' THEN 0.02 WHEN 'hall_events' THEN 0.1 WHEN 'hall_discoveries' THEN 0.05 WHEN 'hall_preferences' THEN 0.03 WHEN 'hall_advice' THEN 0.04 WHEN 'hall_concepts' THEN 0.02 ELSE 0.05 END)
  * (1 - 0.3 * abs(emotional_weight)) / (1 + 0.2 * ln(1 + accesses)) AS rate, {_HOURS} AS h FROM m)
SELECT id, round(exp(-rate * h / 24), 6) AS retention FROM x
""")
def typed_retention(memory: DataFrame, access_log: DataFrame, rates: dict[str, float] = RATES, as_of: str = AS_OF) -> DataFrame:
    """Retention with a rate by record type, slowed by emotion and by accesses."""
    rate = F.try_element_at(F.create_map(*[F.lit(x) for p in rates.items() for x in p]), F.col("hall"))
    rate = F.coalesce(rate, F.lit(0.05)) * (1 - 0.3 * F.abs("emotional_weight")) / (1 + 0.2 * F.log1p(F.col("accesses").cast("double")))
    return with_reads(memory, access_log).select("id", r6(F.exp(-rate * hours_old("created_at", as_of) / 24)).alias("retention"))


@query("j7_consolidation_candidates", "memory access_log", f"""
WITH {_READS}, x AS (SELECT id, importance / 5 AS s, abs(emotional_weight) AS a, accesses, {_HOURS} AS h FROM m)
SELECT id, round(CASE WHEN a > 0.7 THEN s * 0.7 WHEN a > 0.4 THEN s * 0.8 ELSE s END, 6) AS strength, a > 0.4 AS aroused FROM x WHERE s >= 0.3 AND (a > 0.4 OR accesses > 3 OR h > 1)
""")
def consolidation_candidates(memory: DataFrame, access_log: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Records strong enough and aroused, often read or over an hour old; emotional ones are damped."""
    x = with_reads(memory, access_log).select("id", (F.col("importance") / 5).alias("s"), F.abs("emotional_weight").alias("a"), "accesses", hours_old("created_at", as_of).alias("h"))
    x = x.where((F.col("s") >= 0.3) & ((F.col("a") > 0.4) | (F.col("accesses") > 3) | (F.col("h") > 1)))
    return x.select("id", r6(F.when(F.col("a") > 0.7, F.col("s") * 0.7).when(F.col("a") > 0.4, F.col("s") * 0.8).otherwise(F.col("s"))).alias("strength"), (F.col("a") > 0.4).alias("aroused"))


@query("j8_emotion_modulate", "memory", """
SELECT id, round(importance / 5 * (1 + 0.5 * emotional_weight), 6) AS on_write, round(importance / 5 * (1 + 0.3 * emotional_weight), 6) AS on_read, round(importance / 5 * pow(CASE WHEN emotional_weight < 0 THEN 0.9 ELSE 0.95 END, 3), 6) AS devalued FROM memory
""")
def emotion_modulate(memory: DataFrame, cycles: int = 3) -> DataFrame:
    """Strength on write and on read by emotional weight, and after so many cycles of devaluation."""
    s, w = F.col("importance") / 5, F.col("emotional_weight")
    return memory.select("id", r6(s * (1 + 0.5 * w)).alias("on_write"), r6(s * (1 + 0.3 * w)).alias("on_read"), r6(s * F.pow(F.when(w < 0, 0.9).otherwise(0.95), F.lit(cycles))).alias("devalued"))


@query("j9_importance_score", "memory access_log", f"""
WITH {_READS}, x AS (SELECT id, content, 0.25 * (CASE WHEN length(content) > 200 THEN 1.0 WHEN length(content) > 100 THEN 0.8 WHEN length(content) > 50 THEN 0.6 ELSE 0.4 END) + 0.2 * greatest(0.0, 1 - ({_DAYS}) / 30)
  + 0.2 * least(accesses / 10.0, 1.0) + 0.15 * importance / 5 + 0.1 * least(len(tags) / 5.0, 1.0) + 0.1 * abs(emotional_weight) AS s FROM m)
SELECT id, round(least(1.0, CASE WHEN contains(lower(content), 'ththe') THEN s * 1.2 ELSE s END)::DOUBLE, 3) AS score FROM x
""", context="ththe")
def importance_score(memory: DataFrame, access_log: DataFrame, context: str = "", as_of: str = AS_OF) -> DataFrame:
    """Six weighted factors, 1.2 times that if a context word (two characters or more) occurs."""
    length = F.length("content")
    s = 0.25 * F.when(length > 200, 1.0).when(length > 100, 0.8).when(length > 50, 0.6).otherwise(0.4) + 0.2 * F.greatest(F.lit(0.0), 1 - days_old("created_at", as_of) / 30)
    s = s + 0.2 * F.least(F.col("accesses") / 10.0, F.lit(1.0)) + 0.15 * F.col("importance") / 5 + 0.1 * F.least(F.size("tags") / 5.0, F.lit(1.0)) + 0.1 * F.abs("emotional_weight")
    told = any_of(F.lower("content"), [w for w in context.lower().split() if len(w) >= 2])
    return with_reads(memory, access_log).select("id", F.round(F.least(F.lit(1.0), F.when(told, s * 1.2).otherwise(s)), 3).alias("score"))


@query("j10_apply_feedback", "memory access_log", """
WITH s AS (SELECT memory_id, list(CASE operation WHEN 'click' THEN 1.2 WHEN 'purchase' THEN 1.5 WHEN 'error' THEN 0.7 ELSE 1.0 END ORDER BY ts, event_id) AS f FROM access_log WHERE operation IN ('click', 'purchase', 'error') GROUP BY 1)
SELECT id, round((list_reduce(list_prepend(importance, f::DOUBLE[]), lambda a, x: greatest(0.5, least(5.0, a * x))))::DOUBLE, 6) AS importance FROM memory JOIN s ON id = memory_id
""")
def apply_feedback(memory: DataFrame, access_log: DataFrame) -> DataFrame:
    """Importance times a multiplier for each signal, clamped to [.5, 5] at every step, so the order counts: a fold over each record's own signals."""
    m = F.when(F.col("operation") == "click", 1.2).when(F.col("operation") == "purchase", 1.5).when(F.col("operation") == "error", 0.7)
    s = access_log.select("memory_id", "ts", "event_id", m.alias("m")).where("m IS NOT NULL").groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "m"))).alias("f"))
    fold = F.aggregate("f", F.col("importance"), lambda a, x: F.greatest(F.lit(0.5), F.least(F.lit(5.0), a * x["m"])))
    return memory.join(s, F.col("id") == F.col("memory_id")).select("id", r6(fold).alias("importance"))


@query("j11_forget_decision", "memory access_log", f"""
WITH {_READS}, x AS (SELECT id, 0.4 * (1 - importance / 5) + 0.3 * (1 - least(1.0, accesses / 10.0)) + 0.3 * (1 - greatest(0.0, 1 - ({_DAYS}) / 30)) AS s, content FROM m)
SELECT id, round(s::DOUBLE, 8) AS score, CASE WHEN s >= 0.7 THEN 'forget' WHEN s >= 0.55 THEN 'archive' WHEN s >= 0.4 THEN 'compress' ELSE 'keep' END AS decision, CAST(floor(0.25 * length(content)) AS BIGINT) AS tokens FROM x
""")
def forget_decision(memory: DataFrame, access_log: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """A score of unimportance, disuse and age, its band, and the tokens at stake."""
    s = 0.4 * (1 - F.col("importance") / 5) + 0.3 * (1 - F.least(F.lit(1.0), F.col("accesses") / 10.0)) + 0.3 * (1 - F.greatest(F.lit(0.0), 1 - days_old("created_at", as_of) / 30))
    x = with_reads(memory, access_log).select("id", s.alias("s"), F.floor(0.25 * F.length("content")).cast("long").alias("tokens"))
    return x.select("id", r6("s", 8).alias("score"), F.when(F.col("s") >= 0.7, "forget").when(F.col("s") >= 0.55, "archive").when(F.col("s") >= 0.4, "compress").otherwise("keep").alias("decision"), "tokens")


@query("j12_reconsolidate", "memory", """
WITH c AS (SELECT id, importance FROM memory WHERE importance BETWEEN 1.5 AND 3.5 AND created_at < {AS_OF} - INTERVAL 1 DAY ORDER BY importance, id LIMIT 50)
SELECT memory.id, round(CASE WHEN c.id IS NULL THEN memory.importance ELSE least(5.0, memory.importance * 1.2 + 0.05) END, 6) AS importance, c.id IS NOT NULL AS changed FROM memory LEFT JOIN c ON memory.id = c.id
""")
def reconsolidate(memory: DataFrame, low: float = 1.5, high: float = 3.5, most: int = 50, as_of: str = AS_OF) -> DataFrame:
    """The lowest of the middle-importance records over a day old gain a fifth and .05."""
    c = memory.where(F.col("importance").between(low, high) & (days_old("created_at", as_of) > 1)).orderBy("importance", "id").limit(most).select("id", F.lit(True).alias("changed"))
    return memory.join(c, "id", "left").select("id", r6(F.when(F.col("changed"), F.least(F.lit(5.0), F.col("importance") * 1.2 + 0.05)).otherwise(F.col("importance"))).alias("importance"), F.coalesce("changed", F.lit(False)).alias("changed"))


@query("j13_network_importance", "memory", """
WITH t AS (SELECT tag, avg(importance) AS a FROM (SELECT importance, unnest(tags) AS tag FROM memory) GROUP BY 1), x AS (SELECT id, importance, avg(a) AS a FROM (SELECT id, importance, unnest(tags) AS tag FROM memory) m JOIN t ON m.tag = t.tag GROUP BY 1, 2)
SELECT id, round(0.6 * importance + 0.4 * a, 6) AS importance FROM x WHERE abs(0.4 * (a - importance)) > 0.3
""")
def network_importance(memory: DataFrame, change: float = 0.3) -> DataFrame:
    """.6 of a record's importance and .4 of the mean of its tags' means, where that moves it enough."""
    t = memory.select("importance", F.explode("tags").alias("tag")).groupBy("tag").agg(F.avg("importance").alias("a"))
    x = memory.select("id", "importance", F.explode("tags").alias("tag")).join(t, "tag").groupBy("id", "importance").agg(F.avg("a").alias("a"))
    return x.where(F.abs(0.4 * (F.col("a") - F.col("importance"))) > change).select("id", r6(0.6 * F.col("importance") + 0.4 * F.col("a")).alias("importance"))


def key_sentences(text, most: int = 3, longest: int = 200):
    """The first sentences of over five characters, at most so many, joined and cut."""
    parts = F.filter(F.split(F.regexp_replace(text, "([.!?。！？])", "$1\n"), "\n"), lambda x: F.length(F.trim(x)) > 5)
    return F.left(F.array_join(F.transform(F.slice(parts, 1, most), lambda x: F.trim(x)), " "), F.lit(longest))


_KEY = "left(array_to_string(list_transform(list_slice(list_filter(string_split(regexp_replace(content, '([.!?。！？])', '\\1' || chr(10), 'g'), chr(10)), lambda x: length(trim(x)) > 5), 1, 3), lambda x: trim(x)), ' '), 200)"


@query("j14_compress_text", "memory", f"""
SELECT id, {_KEY} AS summary, round(length({_KEY})::DOUBLE / length(content), 6) AS ratio FROM memory WHERE length(content) >= 100 AND {_DAYS} >= 10 AND importance <= 2
""", age=10, most_important=2.0)
def compress_text(memory: DataFrame, age: float = 30, most_important: float = 1.5, as_of: str = AS_OF) -> DataFrame:
    """Key points of long, old, unimportant texts and the ratio of lengths."""
    c = memory.where((F.length("content") >= 100) & (days_old("created_at", as_of) >= age) & (F.col("importance") <= most_important))
    x = c.select("id", "content", key_sentences(F.col("content")).alias("summary"))
    return x.select("id", "summary", r6(F.length("summary") / F.length("content")).alias("ratio"))


@query("j15_compress_by_tag", "memory", """
SELECT tag, count(*) AS n, round(avg(importance), 6) AS mean_importance, CAST(floor(0.25 * sum(length(content)) * 0.7) AS BIGINT) AS tokens_saved, arg_max(id, (importance, id)) AS leader FROM (SELECT *, unnest(tags) AS tag FROM memory) GROUP BY tag HAVING count(*) >= 3
""")
def compress_by_tag(memory: DataFrame, least: int = 3) -> DataFrame:
    """Tags with enough records: mean importance, tokens a summary would save, and the leading record."""
    t = memory.select("id", "importance", F.length("content").alias("size"), F.explode("tags").alias("tag"))
    return t.groupBy("tag").agg(count().alias("n"), r6(F.avg("importance")).alias("mean_importance"), F.floor(0.25 * F.sum("size") * 0.7).cast("long").alias("tokens_saved"), F.max_by("id", F.struct("importance", "id")).alias("leader")).where(F.col("n") >= least)


@query("j16_merge_candidates", "memory access_log", f"""
WITH {_READS}, f AS (SELECT tag, count(*) AS k FROM (SELECT unnest(tags) AS tag FROM memory) GROUP BY 1), t AS (SELECT id, arg_max(tag, (k, tag)) AS tag FROM (SELECT id, unnest(tags) AS tag FROM memory) x JOIN f USING (tag) GROUP BY id),
g AS (SELECT t.tag, t.id, row_number() OVER (PARTITION BY t.tag ORDER BY m.importance DESC, t.id) AS rn FROM t JOIN m ON t.id = m.id)
SELECT 'merge' AS kind, tag AS key, array_to_string(list_sort(list(id)), ',') AS ids FROM g WHERE rn <= 5 GROUP BY tag HAVING count(*) >= 3
UNION ALL SELECT 'promote', id, id FROM m WHERE accesses >= 5 AND importance < 3 UNION ALL SELECT 'old', id, id FROM m WHERE {_DAYS} > 25 AND length(content) > 200
""", old_days=25)
def merge_candidates(memory: DataFrame, access_log: DataFrame, most: int = 5, old_days: float = 60, as_of: str = AS_OF) -> DataFrame:
    """Per tag the leading records (each record belongs to its most frequent tag), often-read minor ones, and old long ones."""
    t = memory.select("id", "importance", F.explode("tags").alias("tag"))
    used = t.groupBy("tag").agg(count().alias("k"))
    own = t.join(used, "tag").groupBy("id", "importance").agg(F.max_by("tag", F.struct("k", "tag")).alias("tag"))
    rn = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("importance"), "id"))
    groups = own.withColumn("rn", rn).where(F.col("rn") <= most).groupBy("tag").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") >= 3)
    m = with_reads(memory, access_log)
    promote = m.where((F.col("accesses") >= 5) & (F.col("importance") < 3))
    old = memory.where((days_old("created_at", as_of) > old_days) & (F.length("content") > 200))
    return groups.select(F.lit("merge").alias("kind"), F.col("tag").alias("key"), F.array_join("ids", ",").alias("ids")).unionByName(promote.select(F.lit("promote").alias("kind"), F.col("id").alias("key"), F.col("id").alias("ids"))).unionByName(old.select(F.lit("old").alias("kind"), F.col("id").alias("key"), F.col("id").alias("ids")))


@query("j17_consolidate_run", "memory access_log", f"""
WITH {_READS}, e AS (SELECT id, importance, ({_EFFECTIVE})::DOUBLE AS e, {_HOURS} AS h, accesses FROM m),
f AS (SELECT *, e < 0.5 AS forgotten, h > CASE WHEN accesses < 6 THEN ([24, 6, 24, 72, 168, 720])[accesses + 1] ELSE 720 * pow(1.5, accesses - 5) END AS due FROM e)
SELECT id, round(CASE WHEN forgotten THEN greatest(0.1, importance * 0.5) WHEN due THEN least(5.0, importance * 1.1) ELSE importance END, 6) AS importance, CASE WHEN forgotten THEN 'forgotten' WHEN due THEN 'reviewed' ELSE 'kept' END AS action FROM f
""")
def consolidate_run(memory: DataFrame, access_log: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Forgotten records lose half, due ones gain a tenth: the next version of importance and what was done."""
    flags = find_forgotten(memory, access_log, as_of=as_of)
    x = memory.select("id", "importance").join(flags, "id")
    return x.select("id", r6(F.when(F.col("forgotten"), F.greatest(F.lit(0.1), F.col("importance") * 0.5)).when(F.col("due"), F.least(F.lit(5.0), F.col("importance") * 1.1)).otherwise(F.col("importance"))).alias("importance"), F.when(F.col("forgotten"), "forgotten").when(F.col("due"), "reviewed").otherwise("kept").alias("action"))


@query("j18_auto_fuse", "memory", f"""
WITH t AS (SELECT wing, unnest(tags) AS tag, id, importance, {_KEY} AS k FROM memory), r AS (SELECT *, row_number() OVER (PARTITION BY wing, tag ORDER BY importance DESC, id) AS rn, count(*) OVER (PARTITION BY wing, tag) AS n FROM t)
SELECT concat('fused-', left(sha256(concat(wing, '|', tag)), 16)) AS id, wing, tag, any_value(n) AS n, array_to_string(list(k ORDER BY importance DESC, id), ' / ') AS content FROM r WHERE n >= 3 AND rn <= 3 GROUP BY wing, tag
""")
def auto_fuse(memory: DataFrame, least: int = 3, points: int = 3) -> DataFrame:
    """One fused record per wing and tag with enough records, from its leading ones; the id depends on wing and tag only."""
    t = memory.select("wing", F.explode("tags").alias("tag"), "id", "importance", key_sentences(F.col("content")).alias("k"))
    size = t.groupBy("wing", "tag").agg(count().alias("n")).where(F.col("n") >= least)
    rn = F.row_number().over(Window.partitionBy("wing", "tag").orderBy(F.desc("importance"), "id"))
    best = t.withColumn("rn", rn).where(F.col("rn") <= points).groupBy("wing", "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "k"))), lambda x: x["k"]), " / ").alias("content"))
    return best.join(size, ["wing", "tag"]).select(F.concat(F.lit("fused-"), F.left(F.sha2(F.concat_ws("|", "wing", "tag"), 256), F.lit(16))).alias("id"), "wing", "tag", "n", "content")


@query("j19_compress_run", "memory access_log", f"""
WITH {_READS}, e AS (SELECT id, content, ({_EFFECTIVE})::DOUBLE AS e FROM m), k AS (SELECT id FROM e ORDER BY round(e, 9), id LIMIT (SELECT greatest(1, count(*) // 3) FROM memory))
SELECT id, CASE WHEN id IN (SELECT id FROM k) AND length(content) > 100 THEN {_KEY} ELSE content END AS content, id IN (SELECT id FROM k) AND length(content) > 100 AS compressed, length(content) AS old_length FROM e
""")
def compress_run(memory: DataFrame, access_log: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """The lowest third by effective importance is reduced to key points; the old length is kept."""
    x = with_reads(memory, access_log).withColumn("e", effective(as_of))
    low = lowest(x.select("id", "e"), F.col("e"), 3).select("id", F.lit(True).alias("low"))
    y = x.join(low, "id", "left").withColumn("compressed", F.coalesce("low", F.lit(False)) & (F.length("content") > 100))
    return y.select("id", F.when(F.col("compressed"), key_sentences(F.col("content"))).otherwise(F.col("content")).alias("content"), "compressed", F.length("content").cast("long").alias("old_length"))
