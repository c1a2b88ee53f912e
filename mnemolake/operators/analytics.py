"""Reports over the record table: distributions, health, anomalies, patterns, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.columns import count, hours_old, labels, moment, n, r6, words
from mnemolake.operators.ordered import within_key
from mnemolake.plans.registry import query
from mnemolake.plans.views import AS_OF


def _tagged(memory: DataFrame, *keep: str) -> DataFrame:
    return memory.select(*keep, F.explode("tags").alias("tag"))


@query("h1_corpus_report", "memory", """
SELECT 'wing' AS facet, wing AS value, count(*) AS n, round(avg(importance), 6) AS mean_importance FROM memory GROUP BY wing
UNION ALL SELECT 'room', room, count(*), round(avg(importance), 6) FROM memory GROUP BY room
UNION ALL SELECT 'hall', hall, count(*), round(avg(importance), 6) FROM memory GROUP BY hall
UNION ALL SELECT 'band', CASE WHEN importance >= 4 THEN 'high' WHEN importance >= 2 THEN 'medium' ELSE 'low' END, count(*), round(avg(importance), 6) FROM memory GROUP BY 2
UNION ALL SELECT 'age', CASE WHEN date_diff('second', created_at, {AS_OF}) <= 86400 THEN '24h' WHEN date_diff('second', created_at, {AS_OF}) <= 604800 THEN '7d' WHEN date_diff('second', created_at, {AS_OF}) <= 2592000 THEN '30d' ELSE 'older' END, count(*), round(avg(importance), 6) FROM memory GROUP BY 2
UNION ALL SELECT 'tag', tag, count(*), round(avg(importance), 6) FROM (SELECT importance, unnest(tags) AS tag FROM memory) GROUP BY tag
UNION ALL SELECT 'all', NULL, count(*), round(avg(importance), 6) FROM memory
""")
def corpus_report(memory: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Counts and mean importance by wing, room, hall, importance band, age and tag, and in all: one grouping-sets pass and one for tags."""
    age = hours_old("created_at", as_of)
    facets = memory.select(
        "wing", "room", "hall", "importance",
        F.when(F.col("importance") >= 4, "high").when(F.col("importance") >= 2, "medium").otherwise("low").alias("band"),
        F.when(age <= 24, "24h").when(age <= 168, "7d").when(age <= 720, "30d").otherwise("older").alias("age"),
    )
    names = ["wing", "room", "hall", "band", "age"]
    sets = facets.groupingSets([[F.col(k)] for k in names] + [[]], *names).agg(count().alias("n"), r6(F.avg("importance")).alias("mean_importance"), F.grouping_id().alias("g"))
    which = F.lit("all")
    for i, k in enumerate(names):
        which = F.when(F.col("g") == (2 ** len(names) - 1 - 2 ** (len(names) - 1 - i)), k).otherwise(which)
    report = sets.select(which.alias("facet"), F.coalesce(*names).alias("value"), "n", "mean_importance")
    tags = _tagged(memory, "importance").groupBy("tag").agg(count().alias("n"), r6(F.avg("importance")).alias("mean_importance"))
    return report.unionByName(tags.select(F.lit("tag").alias("facet"), F.col("tag").alias("value"), "n", "mean_importance"))


@query("h2_health_score", "memory", """
WITH s AS (SELECT count(*) AS total, avg(importance) AS imp, avg(CASE WHEN len(tags) = 0 THEN 1.0 ELSE 0.0 END) AS untagged,
  avg(CASE WHEN length(content) < 20 THEN 1.0 ELSE 0.0 END) AS short, count(DISTINCT wing) AS wings,
  avg(CASE WHEN importance < 1.5 THEN 1.0 ELSE 0.0 END) AS low, count(*) - count(DISTINCT content) AS repeats,
  avg(CASE WHEN date_diff('second', created_at, {AS_OF}) > 604800 THEN 1.0 ELSE 0.0 END) AS stale FROM memory),
i AS (SELECT *, list_filter([CASE WHEN total < 10 THEN 'few records' END, CASE WHEN imp < 2 THEN 'low importance' END, CASE WHEN untagged > 0.3 THEN 'untagged' END,
  CASE WHEN short > 0.2 THEN 'short' END, CASE WHEN wings < 2 THEN 'one wing' END, CASE WHEN low > 0.5 THEN 'mostly minor' END,
  CASE WHEN repeats > 0.05 * total THEN 'repeats' END, CASE WHEN stale > 0.9 THEN 'stale' END], lambda x: x IS NOT NULL) AS issues FROM s)
SELECT total, greatest(0, 100 - 10 * len(issues))::BIGINT AS score, array_to_string(issues, ',') AS issues FROM i
""")
def health_score(memory: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """100 minus 10 for each of eight checks that fails, and the list of these."""
    def share(cond):
        return F.avg(F.when(cond, 1.0).otherwise(0.0))

    s = memory.agg(
        count().alias("total"), F.avg("importance").alias("imp"), share(F.size("tags") == 0).alias("untagged"), share(F.length("content") < 20).alias("short"),
        F.countDistinct("wing").alias("wings"), share(F.col("importance") < 1.5).alias("low"), (F.count("*") - F.countDistinct("content")).alias("repeats"),
        share(hours_old("created_at", as_of) > 168).alias("stale"),
    )
    checks = [(F.col("total") < 10, "few records"), (F.col("imp") < 2, "low importance"), (F.col("untagged") > 0.3, "untagged"), (F.col("short") > 0.2, "short"), (F.col("wings") < 2, "one wing"), (F.col("low") > 0.5, "mostly minor"), (F.col("repeats") > 0.05 * F.col("total"), "repeats"), (F.col("stale") > 0.9, "stale")]
    issues = labels(checks)
    return s.select("total", F.greatest(F.lit(0), 100 - 10 * F.size(issues)).cast("long").alias("score"), F.array_join(issues, ",").alias("issues"))


@query("h3_growth_trend", "memory", """
SELECT CAST(d AS VARCHAR) AS day, count(m.id) AS n FROM (SELECT CAST(unnest(generate_series({AS_OF} - INTERVAL 29 DAY, {AS_OF}, INTERVAL 1 DAY)) AS DATE) AS d) s
LEFT JOIN memory m ON CAST(m.created_at AS DATE) = d GROUP BY d
""")
def growth_trend(memory: DataFrame, as_of: str = AS_OF, days: int = 30) -> DataFrame:
    """Records for each of the last days, empty days included."""
    end = F.to_date(moment(as_of))
    every = memory.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    per_day = memory.groupBy(F.to_date("created_at").alias("day")).agg(count().alias("n"))
    return every.join(per_day, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("h4_activity_heatmap", "memory access_log", """
WITH a AS (SELECT memory_id, count(*) AS k FROM access_log GROUP BY 1),
m AS (SELECT hour(created_at) AS h, isodow(created_at) - 1 AS w, coalesce(k, 0) AS k FROM memory LEFT JOIN a ON id = memory_id)
SELECT 'hour' AS kind, s AS slot, coalesce(sum(k), 0)::BIGINT AS n FROM (SELECT unnest(range(24)) AS s) LEFT JOIN m ON h = s GROUP BY s
UNION ALL SELECT 'weekday', s, coalesce(sum(k), 0)::BIGINT FROM (SELECT unnest(range(7)) AS s) LEFT JOIN m ON w = s GROUP BY s
""")
def activity_heatmap(memory: DataFrame, access_log: DataFrame) -> DataFrame:
    """Accesses by the hour and weekday (Monday 0) at which the record was made; every slot is there."""
    hits = access_log.groupBy("memory_id").agg(count().alias("k"))
    m = memory.join(hits, F.col("id") == F.col("memory_id"), "left").select(F.hour("created_at").cast("long").alias("hour"), F.weekday("created_at").cast("long").alias("weekday"), F.coalesce("k", F.lit(0)).alias("k"))
    out = None
    for kind, slots in (("hour", 24), ("weekday", 7)):
        every = m.sparkSession.range(slots).withColumnRenamed("id", "slot")
        one = every.join(m.groupBy(F.col(kind).alias("slot")).agg(F.sum("k").alias("n")), "slot", "left").select(F.lit(kind).alias("kind"), "slot", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("h5_corpus_anomalies", "memory", """
WITH s AS (SELECT count(*) AS total, count(*) FILTER (date_diff('second', created_at, {AS_OF}) <= 86400) AS recent, count(*) FILTER (importance > 9) AS extreme,
  count(*) FILTER (trim(content) = '') AS empty FROM memory),
d AS (SELECT count(*) AS groups FROM (SELECT 1 FROM memory GROUP BY content HAVING count(*) > 1))
SELECT 'surge' AS kind, recent AS n, recent > 0.5 * total AS flagged FROM s UNION ALL SELECT 'extreme_importance', extreme, extreme > 0 FROM s
UNION ALL SELECT 'empty', empty, empty > 0 FROM s UNION ALL SELECT 'repeated_text', groups, groups > 0 FROM d
""")
def corpus_anomalies(memory: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Records of the last day, importance over 9, empty texts and groups of equal texts, each with a flag."""
    s = memory.agg(count().alias("total"), n(hours_old("created_at", as_of) <= 24).alias("recent"), n(F.col("importance") > 9).alias("extreme"), n(F.trim("content") == "").alias("empty"))
    rows = s.select(F.explode(F.array(
        F.struct(F.lit("surge").alias("kind"), F.col("recent").alias("n"), (F.col("recent") > 0.5 * F.col("total")).alias("flagged")),
        F.struct(F.lit("extreme_importance").alias("kind"), F.col("extreme").alias("n"), (F.col("extreme") > 0).alias("flagged")),
        F.struct(F.lit("empty").alias("kind"), F.col("empty").alias("n"), (F.col("empty") > 0).alias("flagged")),
    )).alias("r")).select("r.*")
    repeated = memory.groupBy(F.sha2("content", 256)).agg(F.count("*").alias("k")).where("k > 1").agg(count().alias("n"))
    return rows.unionByName(repeated.select(F.lit("repeated_text").alias("kind"), "n", (F.col("n") > 0).alias("flagged")))


@query("h6_health_checks", "memory", """
WITH p AS (SELECT left(content, 30) AS p, count(*) AS k FROM memory GROUP BY 1), w AS (SELECT wing, count(*) AS k FROM memory GROUP BY 1),
s AS (SELECT count(*) AS total, avg(importance) AS mean, stddev_samp(importance) AS sd, avg(CASE WHEN len(tags) > 0 THEN 1.0 ELSE 0.0 END) AS tagged,
  avg(CASE WHEN length(content) >= 20 THEN 1.0 ELSE 0.0 END) AS long FROM memory),
c AS (SELECT unnest(['volume', 'importance', 'tags', 'balance', 'content', 'repeats']) AS name,
  unnest([least(1.0, total / 100.0), CASE WHEN mean BETWEEN 2 AND 4 AND sd > 0.5 THEN 1.0 ELSE 0.5 END, tagged,
  1 - (SELECT max(k) FROM w)::DOUBLE / total, long, (SELECT count(*) FROM p)::DOUBLE / total]) AS score FROM s)
SELECT name, round(score, 6) AS score, CASE WHEN score >= 0.8 THEN 'good' WHEN score >= 0.5 THEN 'fair' ELSE 'poor' END AS status FROM c
""")
def health_checks(memory: DataFrame) -> DataFrame:
    """Six checks in [0, 1] with a status: volume, importance spread, tag coverage, balance of wings, text length, repeated prefixes."""
    s = memory.agg(count().alias("total"), F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("sd"), F.avg(F.when(F.size("tags") > 0, 1.0).otherwise(0.0)).alias("tagged"), F.avg(F.when(F.length("content") >= 20, 1.0).otherwise(0.0)).alias("long"))
    top = memory.groupBy("wing").agg(count().alias("k")).agg(F.max("k").alias("top"))
    prefixes = memory.select(F.left("content", F.lit(30)).alias("p")).distinct().agg(count().alias("prefixes"))
    one = s.crossJoin(top).crossJoin(prefixes)  # one row each
    scores = [
        ("volume", F.least(F.lit(1.0), F.col("total") / 100.0)),
        ("importance", F.when(F.col("mean").between(2, 4) & (F.col("sd") > 0.5), 1.0).otherwise(0.5)),
        ("tags", F.col("tagged")),
        ("balance", 1 - F.col("top") / F.col("total")),
        ("content", F.col("long")),
        ("repeats", F.col("prefixes") / F.col("total")),
    ]
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("score")) for k, v in scores])).alias("r"))
    status = F.when(F.col("r.score") >= 0.8, "good").when(F.col("r.score") >= 0.5, "fair").otherwise("poor")
    return rows.select("r.name", r6("r.score").alias("score"), status.alias("status"))


@query("h7_vitality", "memory", """
WITH s AS (SELECT avg(CASE WHEN len(tags) > 0 THEN 1.0 ELSE 0.0 END) AS tagged, avg(importance) / 5 AS imp, count(*) AS total,
  avg(CASE WHEN date_diff('second', created_at, {AS_OF}) <= 604800 THEN 1.0 ELSE 0.0 END) AS fresh FROM memory),
t AS (SELECT count(DISTINCT tag) AS tags FROM (SELECT unnest(tags) AS tag FROM memory)),
v AS (SELECT 0.15 * tagged + 0.35 * imp + 0.25 * least(1.0, tags::DOUBLE / total) + 0.25 * fresh AS v FROM s, t)
SELECT round(v, 6) AS vitality, CASE WHEN v >= 0.7 THEN 'thriving' WHEN v >= 0.4 THEN 'stable' ELSE 'dormant' END AS label FROM v
""")
def vitality(memory: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """.15 tag coverage + .35 importance + .25 distinct tags a record + .25 share of the last week."""
    s = memory.agg(F.avg(F.when(F.size("tags") > 0, 1.0).otherwise(0.0)).alias("tagged"), (F.avg("importance") / 5).alias("imp"), count().alias("total"), F.avg(F.when(hours_old("created_at", as_of) <= 168, 1.0).otherwise(0.0)).alias("fresh"))
    t = _tagged(memory).agg(F.countDistinct("tag").alias("tags"))
    v = s.crossJoin(t).select((0.15 * F.col("tagged") + 0.35 * F.col("imp") + 0.25 * F.least(F.lit(1.0), F.col("tags") / F.col("total")) + 0.25 * F.col("fresh")).alias("v"))
    return v.select(r6("v").alias("vitality"), F.when(F.col("v") >= 0.7, "thriving").when(F.col("v") >= 0.4, "stable").otherwise("dormant").alias("label"))


@query("h8_space_analysis", "memory", """
WITH w AS (SELECT wing, count(*) AS k, avg(importance) AS imp FROM memory GROUP BY wing),
t AS (SELECT wing, count(DISTINCT tag) AS tags FROM (SELECT wing, unnest(tags) AS tag FROM memory) GROUP BY wing)
SELECT w.wing, k AS n, round(imp, 6) AS mean_importance, tags AS n_tags, round(k::DOUBLE / (SELECT sum(k) FROM w), 6) AS share,
  CASE WHEN k < 2 THEN 'merge' WHEN k > 0.4 * (SELECT sum(k) FROM w) THEN 'split' ELSE 'keep' END AS advice,
  CASE WHEN imp >= 3.5 THEN 'hot' WHEN imp >= 2 THEN 'warm' ELSE 'cold' END AS band FROM w JOIN t ON w.wing = t.wing
""")
def space_analysis(memory: DataFrame) -> DataFrame:
    """Per wing: size, share, mean importance, distinct tags, and whether to merge, split or keep it."""
    w = memory.groupBy("wing").agg(count().alias("n"), F.avg("importance").alias("imp"))
    tags = _tagged(memory, "wing").groupBy("wing").agg(F.countDistinct("tag").alias("n_tags"))
    total = memory.agg(count().alias("total"))
    x = w.join(tags, "wing").crossJoin(F.broadcast(total))  # one row
    return x.select("wing", "n", r6("imp").alias("mean_importance"), "n_tags", r6(F.col("n") / F.col("total")).alias("share"), F.when(F.col("n") < 2, "merge").when(F.col("n") > 0.4 * F.col("total"), "split").otherwise("keep").alias("advice"), F.when(F.col("imp") >= 3.5, "hot").when(F.col("imp") >= 2, "warm").otherwise("cold").alias("band"))


@query("h9_diagnose", "memory access_log", """
WITH m AS (SELECT count(*) AS total, avg(importance) AS imp, count(DISTINCT content) AS texts FROM memory),
w AS (SELECT max(k)::DOUBLE / min(k) AS skew FROM (SELECT count(*) AS k FROM memory GROUP BY wing)),
t AS (SELECT count(DISTINCT tag)::DOUBLE / (SELECT total FROM m) AS ratio FROM (SELECT unnest(tags) AS tag FROM memory)),
a AS (SELECT avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS rate FROM access_log)
SELECT * FROM (SELECT 'few_records' AS finding, total < 10 AS found, round(total::DOUBLE, 6) AS value FROM m
UNION ALL SELECT 'importance_off', imp < 2 OR imp > 4.5, round(imp, 6) FROM m UNION ALL SELECT 'wing_skew', skew > 10, round(skew, 6) FROM w
UNION ALL SELECT 'few_tags', ratio < 0.3, round(ratio, 6) FROM t UNION ALL SELECT 'low_hit_rate', rate < 0.3, round(rate, 6) FROM a
UNION ALL SELECT 'repeats', 1 - texts::DOUBLE / total > 0.15, round(1 - texts::DOUBLE / total, 6) FROM m)
""")
def diagnose(memory: DataFrame, access_log: DataFrame) -> DataFrame:
    """Findings about the corpus and its use, each with its value."""
    m = memory.agg(count().alias("total"), F.avg("importance").alias("imp"), F.countDistinct("content").alias("texts"))
    w = memory.groupBy("wing").agg(F.count("*").alias("k")).agg((F.max("k") / F.min("k")).alias("skew"))
    t = _tagged(memory).agg(F.countDistinct("tag").alias("tags"))
    a = access_log.agg(F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)).alias("rate"))
    one = m.crossJoin(w).crossJoin(t).crossJoin(a)  # one row each
    ratio, repeats = F.col("tags") / F.col("total"), 1 - F.col("texts") / F.col("total")
    rows = [("few_records", F.col("total") < 10, F.col("total").cast("double")), ("importance_off", (F.col("imp") < 2) | (F.col("imp") > 4.5), F.col("imp")), ("wing_skew", F.col("skew") > 10, F.col("skew")), ("few_tags", ratio < 0.3, ratio), ("low_hit_rate", F.col("rate") < 0.3, F.col("rate")), ("repeats", repeats > 0.15, repeats)]
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("finding"), f.alias("found"), r6(v).alias("value")) for k, f, v in rows])).alias("r")).select("r.*")


@query("h10_frequent_tags", "memory", """
SELECT 'tag' AS kind, tag AS value, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM memory), 6) AS share, array_to_string(list_slice(list_sort(list(id)), 1, 5), ',') AS first_ids
FROM (SELECT id, unnest(tags) AS tag FROM memory) GROUP BY tag HAVING count(*) >= 3
UNION ALL SELECT 'room', room, count(*), round(count(*)::DOUBLE / (SELECT count(*) FROM memory), 6), array_to_string(list_slice(list_sort(list(id)), 1, 5), ',') FROM memory GROUP BY room HAVING count(*) >= 3
""")
def frequent_tags(memory: DataFrame, least: int = 3, show: int = 5) -> DataFrame:
    """Tags and rooms of at least `least` records, their share, and the first few ids.

    The ids come from a ranking window that stops at `show` rows, so a frequent tag is never gathered whole.
    """
    both = _tagged(memory, "id").select(F.lit("tag").alias("kind"), F.col("tag").alias("value"), "id").unionByName(memory.select(F.lit("room").alias("kind"), F.col("room").alias("value"), "id"))
    counted = both.groupBy("kind", "value").agg(count().alias("n")).where(F.col("n") >= least)
    first = both.withColumn("rn", F.row_number().over(Window.partitionBy("kind", "value").orderBy("id"))).where(F.col("rn") <= show)
    ids = first.groupBy("kind", "value").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("first_ids"))
    total = memory.agg(count().alias("total"))
    return counted.join(ids, ["kind", "value"]).crossJoin(F.broadcast(total)).select("kind", "value", "n", r6(F.col("n") / F.col("total")).alias("share"), "first_ids")


def tag_pairs(memory: DataFrame) -> DataFrame:
    """a, b, n: how many records hold both tags, a before b."""
    tags = F.array_sort(F.array_distinct("tags"))
    one = memory.select(F.posexplode(tags).alias("i", "a"), tags.alias("all"))
    return one.select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b")).groupBy("a", "b").agg(count().alias("n"))


@query("h11_tag_associations", "memory", """
WITH p AS (SELECT x.tag AS a, y.tag AS b, count(*) AS n FROM (SELECT id, unnest(tags) AS tag FROM memory) x JOIN (SELECT id, unnest(tags) AS tag FROM memory) y ON x.id = y.id AND x.tag < y.tag GROUP BY 1, 2)
SELECT a, b, n, round(n::DOUBLE / (SELECT count(*) FROM memory), 6) AS support, round(least(1.0, 5.0 * n / (SELECT count(*) FROM memory)), 6) AS confidence
FROM p WHERE least(1.0, 5.0 * n / (SELECT count(*) FROM memory)) >= 0.3 ORDER BY n DESC, a, b LIMIT 10
""")
def tag_associations(memory: DataFrame, top: int = 10, least: float = 0.3) -> DataFrame:
    """The most frequent tag pairs; confidence is five times the support, 1 at most."""
    total = memory.agg(count().alias("total"))
    x = tag_pairs(memory).crossJoin(F.broadcast(total)).withColumn("confidence", F.least(F.lit(1.0), 5.0 * F.col("n") / F.col("total")))
    return x.where(F.col("confidence") >= least).orderBy(F.desc("n"), "a", "b").limit(top).select("a", "b", "n", r6(F.col("n") / F.col("total")).alias("support"), r6("confidence").alias("confidence"))


@query("h12_tag_sequences", "memory", """
WITH o AS (SELECT author, tags, room, lead(tags) OVER w AS nt, lead(room) OVER w AS nr FROM memory WINDOW w AS (PARTITION BY author ORDER BY created_at, id)),
x AS (SELECT unnest(tags) AS a, nt FROM o WHERE nt IS NOT NULL), y AS (SELECT a, unnest(nt) AS b FROM x)
SELECT 'tag' AS kind, a, b, count(*) AS n FROM y WHERE a <> b GROUP BY a, b HAVING count(*) >= 2
UNION ALL SELECT 'room', room, nr, count(*) FROM o WHERE nr IS NOT NULL AND nr <> room GROUP BY room, nr HAVING count(*) >= 2
""")
def tag_sequences(memory: DataFrame, least: int = 2) -> DataFrame:
    """Ordered pairs of tags and of rooms in an author's consecutive records."""
    o = within_key(memory.select("id", "author", "created_at", "tags", "room"), ["author"], ["created_at", "id"], {"nt": ("tags", 1), "nr": ("room", 1)})
    t = o.where("nt IS NOT NULL").select(F.explode("tags").alias("a"), "nt").select("a", F.explode("nt").alias("b"))
    both = t.select(F.lit("tag").alias("kind"), "a", "b").unionByName(o.where("nr IS NOT NULL").select(F.lit("room").alias("kind"), F.col("room").alias("a"), F.col("nr").alias("b")))
    return both.where("a <> b").groupBy("kind", "a", "b").agg(count().alias("n")).where(F.col("n") >= least)


@query("h13_outliers", "memory", """
WITH s AS (SELECT avg(length(content)) AS m, stddev_pop(length(content)) AS d, avg(importance) AS mi, stddev_pop(importance) AS di FROM memory),
t AS (SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS k FROM memory GROUP BY 1)
SELECT 'length' AS kind, id AS key, round((length(content) - m) / d, 4) AS score FROM memory, s WHERE abs(length(content) - m) > 3 * d
UNION ALL SELECT 'importance', id, round((importance - mi) / di, 4) FROM memory, s WHERE abs((importance - mi) / di) > 2.5
UNION ALL SELECT 'burst', day, round(k / (SELECT avg(k) FROM t), 4) FROM t WHERE k >= 3 AND k >= 3 * (SELECT avg(k) FROM t)
""")
def outliers(memory: DataFrame, sigma: float = 3.0, z: float = 2.5, burst: float = 3.0) -> DataFrame:
    """Text lengths beyond sigma deviations, importance beyond z, and days of burst times the mean count."""
    length = F.length("content")
    s = memory.agg(F.avg(length).alias("m"), F.stddev_pop(length).alias("d"), F.avg("importance").alias("mi"), F.stddev_pop("importance").alias("di"))
    x = memory.select("id", length.alias("n"), "importance").crossJoin(F.broadcast(s))
    by_length = x.where(F.abs(F.col("n") - F.col("m")) > sigma * F.col("d")).select(F.lit("length").alias("kind"), F.col("id").alias("key"), r6((F.col("n") - F.col("m")) / F.col("d"), 4).alias("score"))
    score = (F.col("importance") - F.col("mi")) / F.col("di")
    by_importance = x.where(F.abs(score) > z).select(F.lit("importance").alias("kind"), F.col("id").alias("key"), r6(score, 4).alias("score"))
    days = memory.groupBy(F.to_date("created_at").cast("string").alias("key")).agg(F.count("*").alias("k"))
    mean = days.agg(F.avg("k").alias("mean"))
    bursts = days.crossJoin(F.broadcast(mean)).where((F.col("k") >= 3) & (F.col("k") >= burst * F.col("mean"))).select(F.lit("burst").alias("kind"), "key", r6(F.col("k") / F.col("mean"), 4).alias("score"))
    return by_length.unionByName(by_importance).unionByName(bursts)


@query("h14_pattern_summary", "memory", """
WITH f AS (SELECT 'tag' AS kind, tag AS value, count(*)::DOUBLE / (SELECT count(*) FROM memory) AS c FROM (SELECT unnest(tags) AS tag FROM memory) GROUP BY tag HAVING count(*) >= 3
UNION ALL SELECT 'room', room, count(*)::DOUBLE / (SELECT count(*) FROM memory) FROM memory GROUP BY room HAVING count(*) >= 3)
SELECT kind, count(*) AS n, count(*) FILTER (c >= 0.5) AS high, count(*) FILTER (c < 0.5 AND c >= 0.1) AS medium, count(*) FILTER (c < 0.1) AS low, arg_max(value, (c, value)) AS top FROM f GROUP BY kind
""")
def pattern_summary(memory: DataFrame) -> DataFrame:
    """Frequent tags and rooms: how many of each kind and confidence band, and the top one."""
    f = frequent_tags(memory)
    return f.groupBy("kind").agg(count().alias("n"), n(F.col("share") >= 0.5).alias("high"), n((F.col("share") < 0.5) & (F.col("share") >= 0.1)).alias("medium"), n(F.col("share") < 0.1).alias("low"), F.max_by("value", F.struct("share", "value")).alias("top"))


@query("h15_content_anomalies", "memory access_log", """
WITH l AS (SELECT operation, count(*) AS k FROM (SELECT operation FROM access_log ORDER BY ts DESC, event_id DESC LIMIT 100) GROUP BY 1)
SELECT 'empty' AS kind, NULL AS value, count(*) FILTER (trim(content) = '') AS n FROM memory UNION ALL SELECT 'long', NULL, count(*) FILTER (length(content) > 10000) FROM memory
UNION ALL SELECT 'untagged', NULL, count(*) FILTER (len(tags) = 0) FROM memory UNION ALL SELECT 'repeated', NULL, count(*) - count(DISTINCT trim(content)) FROM memory
UNION ALL SELECT 'repeated_query', operation, k FROM l WHERE k > 20
""")
def content_anomalies(memory: DataFrame, access_log: DataFrame, longest: int = 10_000, last: int = 100, often: int = 20) -> DataFrame:
    """Empty, very long, untagged and repeated texts, and queries asked more than `often` times in the last 100."""
    s = memory.agg(n(F.trim("content") == "").alias("empty"), n(F.length("content") > longest).alias("long"), n(F.size("tags") == 0).alias("untagged"), (F.count("*") - F.countDistinct(F.trim("content"))).alias("repeated"))
    rows = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("value"), F.col(k).alias("n")) for k in ("empty", "long", "untagged", "repeated")])).alias("r")).select("r.*")
    recent = access_log.orderBy(F.desc("ts"), F.desc("event_id")).limit(last).groupBy("operation").agg(count().alias("n")).where(F.col("n") > often)
    return rows.unionByName(recent.select(F.lit("repeated_query").alias("kind"), F.col("operation").alias("value"), "n"))


@query("h16_query_forecast", "access_log", """
SELECT operation AS word, count(*) AS n, round(least(0.8, count(*) / 50.0), 6) AS confidence FROM (SELECT operation FROM access_log ORDER BY ts DESC, event_id DESC LIMIT 50) GROUP BY operation
""")
def query_forecast(access_log: DataFrame, last: int = 50) -> DataFrame:
    """Words of the last queries by frequency; confidence is their share, .8 at most."""
    recent = access_log.orderBy(F.desc("ts"), F.desc("event_id")).limit(last)
    return recent.select(F.explode(words("operation")).alias("word")).groupBy("word").agg(count().alias("n")).select("word", "n", r6(F.least(F.lit(0.8), F.col("n") / float(last))).alias("confidence"))


@query("h17_forget_forecast", "memory access_log", """
WITH a AS (SELECT memory_id, max(ts) AS last FROM access_log GROUP BY 1)
SELECT id, importance, CAST(date_diff('day', CAST(coalesce(last, created_at) AS DATE), CAST({AS_OF} AS DATE)) AS BIGINT) AS idle_days FROM memory LEFT JOIN a ON id = memory_id
WHERE importance < 1.5 AND date_diff('day', CAST(coalesce(last, created_at) AS DATE), CAST({AS_OF} AS DATE)) > 5
""", idle=5)
def forget_forecast(memory: DataFrame, access_log: DataFrame, idle: int = 30, as_of: str = AS_OF) -> DataFrame:
    """Records of importance under 1.5 that nobody has read for more than `idle` days."""
    last = access_log.groupBy("memory_id").agg(F.max("ts").alias("last"))
    days = F.datediff(F.to_date(moment(as_of)), F.to_date(F.coalesce("last", "created_at"))).cast("long")
    return memory.where("importance < 1.5").join(last, F.col("id") == F.col("memory_id"), "left").select("id", "importance", days.alias("idle_days")).where(F.col("idle_days") > idle)


@query("h18_hot_topics", "memory", """
SELECT tag, count(*) AS n, count(*) FILTER (importance >= 4) AS strong, round(count(*) FILTER (importance >= 4)::DOUBLE / count(*), 6) AS momentum FROM (SELECT importance, unnest(tags) AS tag FROM memory) GROUP BY tag
""")
def hot_topics(memory: DataFrame) -> DataFrame:
    """Per tag the share of important records."""
    t = _tagged(memory, "importance").groupBy("tag").agg(count().alias("n"), n(F.col("importance") >= 4).alias("strong"))
    return t.select("tag", "n", "strong", r6(F.col("strong") / F.col("n")).alias("momentum"))


@query("h34_metadata_coverage", "memory vector relation", """
SELECT (SELECT count(*) FROM memory) AS n, (SELECT count(*) FROM memory WHERE id IN (SELECT id FROM vector)) AS with_vector, (SELECT count(*) FROM relation) AS edges
""")
def metadata_coverage(memory: DataFrame, vector: DataFrame, relation: DataFrame) -> DataFrame:
    """Records, those with a vector, and edges."""
    has = memory.join(vector.select("id").distinct().withColumn("has", F.lit(1)), "id", "left").agg(count().alias("n"), n(F.col("has").isNotNull()).alias("with_vector"))
    return has.crossJoin(relation.agg(count().alias("edges")))


@query("h35_quality_score", "memory", """
WITH q AS (SELECT id, greatest(0, least(100, 50 + CASE WHEN length(content) > 100 THEN 15 WHEN length(content) < 20 THEN -20 ELSE 0 END
  + CASE WHEN len(tags) >= 2 THEN 10 WHEN len(tags) = 0 THEN -10 ELSE 0 END + CASE WHEN importance >= 3 THEN 10 ELSE 0 END + CASE WHEN regexp_matches(content, '[0-9]') THEN 5 ELSE 0 END
  + CASE WHEN room <> '' THEN 5 ELSE 0 END)) AS score FROM memory)
SELECT CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n, round(avg(score), 6) AS mean_score FROM q GROUP BY 1
""")
def quality_bands(memory: DataFrame) -> DataFrame:
    """How many records are in each band of quality_score, and its mean there."""
    band = F.when(F.col("score") >= 80, "excellent").when(F.col("score") >= 60, "good").when(F.col("score") >= 40, "fair").otherwise("poor")
    return memory.select(quality_score().alias("score")).groupBy(band.alias("band")).agg(count().alias("n"), r6(F.avg("score")).alias("mean_score"))


def quality_score():
    """50 plus and minus points for length, tags, importance, digits and a room, within 0 and 100."""
    length, tags = F.length("content"), F.size("tags")
    points = F.when(length > 100, 15).when(length < 20, -20).otherwise(0) + F.when(tags >= 2, 10).when(tags == 0, -10).otherwise(0)
    points = points + F.when(F.col("importance") >= 3, 10).otherwise(0) + F.when(F.col("content").rlike("[0-9]"), 5).otherwise(0) + F.when(F.col("room") != "", 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), 50 + points))


@query("h36_quality_assess", "memory", """
WITH p AS (SELECT left(content, 50) AS p, count(*) - 1 AS others FROM memory GROUP BY 1),
x AS (SELECT id, (CASE WHEN length(content) >= 50 THEN 1.0 ELSE length(content) / 50.0 END) AS complete, 1.0 / (1 + others) AS own, least(1.0, len(tags) / 3.0) AS tagged,
  least(1.0, length(content) / 200.0) AS density, importance / 5 AS imp FROM memory m JOIN p ON left(m.content, 50) = p.p),
y AS (SELECT id, 0.25 * complete + 0.25 * own + 0.2 * tagged + 0.15 * density + 0.15 * imp AS s FROM x)
SELECT id, round(s, 6) AS score, CASE WHEN s >= 0.9 THEN 'A' WHEN s >= 0.8 THEN 'B' WHEN s >= 0.7 THEN 'C' WHEN s >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM y
""")
def quality_assess(memory: DataFrame) -> DataFrame:
    """Five weighted dimensions and a grade; a prefix that others share lowers uniqueness. Prefixes are counted by aggregation, not by a window over a hot one."""
    prefix = F.left("content", F.lit(50))
    shared = memory.groupBy(prefix.alias("p")).agg((F.count("*") - 1).alias("others"))
    x = memory.withColumn("p", prefix).join(shared, "p")
    length = F.length("content")
    s = 0.25 * F.when(length >= 50, 1.0).otherwise(length / 50.0) + 0.25 * (1.0 / (1 + F.col("others"))) + 0.2 * F.least(F.lit(1.0), F.size("tags") / 3.0) + 0.15 * F.least(F.lit(1.0), length / 200.0) + 0.15 * (F.col("importance") / 5)
    y = x.select("id", s.alias("s"))
    return y.select("id", r6("s").alias("score"), F.when(F.col("s") >= 0.9, "A").when(F.col("s") >= 0.8, "B").when(F.col("s") >= 0.7, "C").when(F.col("s") >= 0.6, "D").otherwise("F").alias("grade"))


@query("h37_tune_params", "memory access_log", """
WITH s AS (SELECT count(*) AS total, avg(importance) AS imp, avg(length(content)) AS len FROM memory), a AS (SELECT avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS rate FROM access_log)
SELECT round(greatest(0.5, least(0.99, 0.95 + CASE WHEN total > 500 THEN 0.01 ELSE -0.01 END)), 6) AS decay_base, round(greatest(0.1, least(0.9, 0.65 + CASE WHEN rate < 0.5 THEN -0.05 ELSE 0.0 END)), 6) AS min_similarity,
  (10 + CASE WHEN len > 1000 THEN -2 ELSE 2 END)::BIGINT AS top_k, round(greatest(0.1, least(0.5, 0.3 + CASE WHEN imp > 3.5 THEN 0.05 ELSE 0.0 END)), 6) AS forget_threshold FROM s, a
""")
def tune_params(memory: DataFrame, access_log: DataFrame) -> DataFrame:
    """Parameters moved by thresholds on corpus statistics, kept within bounds."""
    s = memory.agg(count().alias("total"), F.avg("importance").alias("imp"), F.avg(F.length("content")).alias("len")).crossJoin(access_log.agg(F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)).alias("rate")))

    def within(low, base, move, high):
        return r6(F.greatest(F.lit(low), F.least(F.lit(high), base + move)))

    return s.select(
        within(0.5, 0.95, F.when(F.col("total") > 500, 0.01).otherwise(-0.01), 0.99).alias("decay_base"),
        within(0.1, 0.65, F.when(F.col("rate") < 0.5, -0.05).otherwise(0.0), 0.9).alias("min_similarity"),
        (10 + F.when(F.col("len") > 1000, -2).otherwise(2)).cast("long").alias("top_k"),
        within(0.1, 0.3, F.when(F.col("imp") > 3.5, 0.05).otherwise(0.0), 0.5).alias("forget_threshold"),
    )


@query("h38_coverage_gaps", "memory", """
WITH t AS (SELECT tag, count(*) AS k FROM (SELECT unnest(tags) AS tag FROM memory) GROUP BY 1),
p AS (SELECT DISTINCT x.tag AS a, y.tag AS b FROM (SELECT id, unnest(tags) AS tag FROM memory) x JOIN (SELECT id, unnest(tags) AS tag FROM memory) y ON x.id = y.id AND x.tag <> y.tag),
d AS (SELECT a AS tag, count(*) AS degree FROM p GROUP BY a)
SELECT t.tag, k AS n, coalesce(degree, 0) AS degree, CASE WHEN k = 1 THEN 'thin' WHEN k >= 3 AND coalesce(degree, 0) <= 1 THEN 'orphan' ELSE 'connected' END AS gap FROM t LEFT JOIN d ON t.tag = d.tag
""")
def coverage_gaps(memory: DataFrame) -> DataFrame:
    """Tags used once (thin), or often but with one neighbour at most (orphan)."""
    pairs = tag_pairs(memory).select("a", "b")
    degree = pairs.select(F.col("a").alias("tag")).unionByName(pairs.select(F.col("b").alias("tag"))).groupBy("tag").agg(count().alias("degree"))
    used = _tagged(memory).groupBy("tag").agg(count().alias("n")).join(degree, "tag", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return used.select("tag", "n", "degree", F.when(F.col("n") == 1, "thin").when((F.col("n") >= 3) & (F.col("degree") <= 1), "orphan").otherwise("connected").alias("gap"))


@query("h40_topic_insights", "memory", """
WITH r AS (SELECT * FROM memory WHERE contains(lower(content), 'the ') AND created_at >= {AS_OF} - INTERVAL 20 DAY)
SELECT 'wing' AS facet, wing AS value, count(*) AS n, round(avg(importance), 6) AS mean_importance FROM r GROUP BY wing
UNION ALL SELECT 'room', room, count(*), round(avg(importance), 6) FROM r GROUP BY room
UNION ALL SELECT 'top', id, 1, round(importance, 6) FROM (SELECT id, importance FROM r ORDER BY importance DESC, id LIMIT 5)
""", topic="the ", days=20)
def topic_insights(memory: DataFrame, topic: str, days: int, as_of: str = AS_OF, top: int = 5) -> DataFrame:
    """Records on a topic in a period: counts by wing and room, and the most important."""
    r = memory.where(F.contains(F.lower("content"), F.lit(topic.lower())) & (F.col("created_at") >= moment(as_of) - F.make_dt_interval(days=F.lit(days))))
    facets = [r.groupBy(F.col(k).alias("value")).agg(count().alias("n"), r6(F.avg("importance")).alias("mean_importance")).select(F.lit(k).alias("facet"), "value", "n", "mean_importance") for k in ("wing", "room")]
    best = r.orderBy(F.desc("importance"), "id").limit(top).select(F.lit("top").alias("facet"), F.col("id").alias("value"), F.lit(1).cast("long").alias("n"), r6("importance").alias("mean_importance"))
    return facets[0].unionByName(facets[1]).unionByName(best)


