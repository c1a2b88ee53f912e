"""Reports over search, audit, error, usage, vote and session logs."""

from __future__ import annotations

import secrets
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.columns import count, moment, n, r6, seconds_between
from mnemolake.operators.privacy import PrivacyLedger, geometric
from mnemolake.plans.registry import query
from mnemolake.plans.storage import materialize, shared_dir
from mnemolake.plans.views import AS_OF


@query("h19_search_log_report", "access_log", """
SELECT operation, count(*) AS n, round(avg(CASE WHEN success THEN 0.0 ELSE 1.0 END), 6) AS empty_rate, count(*) FILTER (duration_ms > 500) AS slow, round(avg(duration_ms), 4) AS mean_ms, count(DISTINCT user_id) AS users, arg_max(h, (k, -h))::BIGINT AS peak_hour
FROM (SELECT *, hour(ts) AS h, count(*) OVER (PARTITION BY operation, hour(ts)) AS k FROM access_log) GROUP BY operation
""", slow_ms=500.0)
def search_log_report(access_log: DataFrame, slow_ms: float) -> DataFrame:
    """Per query: how often, how often empty, how many slow, mean time, users and the busiest hour. Hours are counted before they are compared, so a frequent query isn't gathered."""
    hours = access_log.groupBy("operation", F.hour("ts").alias("h")).agg(count().alias("k"))
    peak = hours.groupBy("operation").agg(F.max_by(F.col("h"), F.struct("k", -F.col("h"))).cast("long").alias("peak_hour"))
    s = access_log.groupBy("operation").agg(count().alias("n"), r6(F.avg(F.when(F.col("success"), 0.0).otherwise(1.0))).alias("empty_rate"), n(F.col("duration_ms") > slow_ms).alias("slow"), r6(F.avg("duration_ms"), 4).alias("mean_ms"), F.countDistinct("user_id").alias("users"))
    return s.join(peak, "operation")


@query("h20_audit_report", "access_log", """
SELECT 'operation' AS facet, operation AS value, count(*) AS n, round(avg(duration_ms), 4) AS mean_ms, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM access_log GROUP BY operation
UNION ALL SELECT 'user', user_id, count(*), round(avg(duration_ms), 4), round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) FROM access_log GROUP BY user_id
UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), count(*), round(avg(duration_ms), 4), round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) FROM access_log GROUP BY hour(ts)
""")
def audit_report(access_log: DataFrame) -> DataFrame:
    """Count, mean time and success rate by operation, user and hour, in one grouping-sets pass."""
    x = access_log.select(F.col("operation"), "user_id", F.hour("ts").cast("string").alias("hour"), "duration_ms", F.when(F.col("success"), 1.0).otherwise(0.0).alias("ok"))
    g = x.groupingSets([[F.col("operation")], [F.col("user_id")], [F.col("hour")]], "operation", "user_id", "hour").agg(count().alias("n"), r6(F.avg("duration_ms"), 4).alias("mean_ms"), r6(F.avg("ok")).alias("success_rate"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 3, "operation").when(F.col("g") == 5, "user").otherwise("hour").alias("facet"), F.coalesce("operation", "user_id", "hour").alias("value"), "n", "mean_ms", "success_rate")


@query("h21_audit_anomalies", "access_log", """
WITH u AS (SELECT user_id, count(*) AS k, avg(CASE WHEN success THEN 0.0 ELSE 1.0 END) AS f FROM access_log GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM access_log),
l AS (SELECT user_id, count(*) FILTER (operation = 'purchase') AS p, count(*) FILTER (duration_ms > 500) AS s FROM r WHERE rn <= 20 GROUP BY 1)
SELECT u.user_id, k AS n, round(f, 6) AS failure_rate, p AS risky, s AS slow, CASE WHEN k >= 5 AND f > 0.25 AND p > 5 THEN 'high' WHEN k >= 5 AND f > 0.25 OR p > 5 OR s > 3 THEN 'medium' ELSE 'low' END AS risk FROM u JOIN l ON u.user_id = l.user_id
""", risky="purchase", failing=0.25, slow_ms=500.0)
def audit_anomalies(access_log: DataFrame, risky: str = "delete", failing: float = 0.5, slow_ms: float = 1000.0, last: int = 20) -> DataFrame:
    """Per user: failure rate of all operations, risky and slow ones among the last, and a risk level. The ranking stops at `last` rows before it is exchanged."""
    users = access_log.groupBy("user_id").agg(count().alias("n"), F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("f"))
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    recent = access_log.withColumn("rn", rn).where(F.col("rn") <= last).groupBy("user_id").agg(n(F.col("operation") == risky).alias("risky"), n(F.col("duration_ms") > slow_ms).alias("slow"))
    bad = (F.col("n") >= 5) & (F.col("f") > failing)
    risk = F.when(bad & (F.col("risky") > 5), "high").when(bad | (F.col("risky") > 5) | (F.col("slow") > 3), "medium").otherwise("low")
    return users.join(recent, "user_id").select("user_id", "n", r6("f").alias("failure_rate"), "risky", "slow", risk.alias("risk"))


@query("h22_error_report", "access_log", """
WITH s AS (SELECT count(*) AS n, count(*) FILTER (NOT success) AS errors, count(*) FILTER (NOT success AND date_diff('second', ts, {AS_OF}) BETWEEN 0 AND 200000) AS recent FROM access_log),
t AS (SELECT array_to_string(list(user_id ORDER BY k DESC, user_id), ',') AS top FROM (SELECT user_id, count(*) AS k FROM access_log WHERE NOT success GROUP BY 1 ORDER BY k DESC, user_id LIMIT 5))
SELECT n, errors, round(errors::DOUBLE / n, 6) AS error_rate, recent, top, greatest(0, 100 - errors * 100.0 / n * 2)::DOUBLE >= 60 AS healthy FROM s, t
""", window_s=200_000)
def error_report(access_log: DataFrame, as_of: str = AS_OF, window_s: int = 3600, top: int = 5) -> DataFrame:
    """Error rate, errors in the last window, users with most errors, and whether the score is at least 60."""
    bad = ~F.col("success")
    age = seconds_between(moment(as_of), F.col("ts"))
    s = access_log.agg(count().alias("n"), n(bad).alias("errors"), n(bad & age.between(0, window_s)).alias("recent"))
    worst = access_log.where(bad).groupBy("user_id").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "user_id").limit(top)
    named = worst.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "user_id"))), lambda x: x["user_id"]), ",").alias("top"))
    return s.crossJoin(named).select("n", "errors", r6(F.col("errors") / F.col("n")).alias("error_rate"), "recent", "top", (F.greatest(F.lit(0.0), 100 - F.col("errors") * 100.0 / F.col("n") * 2) >= 60).alias("healthy"))


# A price for each thousand units, by prefix of the operation; the longest prefix counts.
PRICES = [("c", 0.01), ("cl", 0.02), ("v", 0.005), ("pur", 0.05)]


@query("h23_usage_report", "access_log", """
WITH p(prefix, price) AS (VALUES ('c', 0.01::DOUBLE), ('cl', 0.02), ('v', 0.005), ('pur', 0.05)),
b AS (SELECT operation, arg_max(price, length(prefix)) AS price FROM (SELECT DISTINCT operation FROM access_log) JOIN p ON starts_with(operation, prefix) GROUP BY 1)
SELECT a.operation, count(*) AS n, round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.95), 4) AS p95, round(quantile_cont(duration_ms, 0.99), 4) AS p99, round(sum(duration_ms), 2) AS units, round(sum(duration_ms) / 1000 * coalesce(any_value(price), 0), 4) AS cost
FROM access_log a LEFT JOIN b ON a.operation = b.operation GROUP BY a.operation
""")
def usage_report(access_log: DataFrame, prices: list[tuple[str, float]] = PRICES) -> DataFrame:
    """Per operation: exact percentiles (linear), units used and their cost by the price of the longest matching prefix."""
    price = F.lit(0.0)
    for prefix, p in sorted(prices, key=lambda x: len(x[0])):
        price = F.when(F.startswith("operation", F.lit(prefix)), p).otherwise(price)
    s = access_log.groupBy("operation").agg(count().alias("n"), *[r6(F.percentile("duration_ms", q), 4).alias(k) for k, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.sum("duration_ms").alias("u"))
    return s.select("operation", "n", "p50", "p95", "p99", r6("u", 2).alias("units"), r6(F.col("u") / 1000 * price, 4).alias("cost"))


@query("h24_vote_report", "vote", """
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id, user_id ORDER BY ts DESC) AS rn FROM vote) WHERE rn = 1)
SELECT memory_id, count(*) FILTER (vote_type = 'up') AS up, count(*) FILTER (vote_type = 'down') AS down, count(*) FILTER (vote_type = 'bookmark') AS bookmarks,
  round(sum(CASE vote_type WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END * CASE WHEN user_id IN ('u1', 'u2', 'u3') THEN 1.5 ELSE 1.0 END)::DOUBLE, 4) AS weight FROM l GROUP BY memory_id ORDER BY weight DESC, memory_id LIMIT 20
""", experts=["u1", "u2", "u3"])
def vote_report(vote: DataFrame, experts: list[str], top: int = 20) -> DataFrame:
    """Each user's latest vote on a record counts, 1.5 times for experts; the records with the highest weight."""
    latest = vote.groupBy("memory_id", "user_id").agg(F.max_by("vote_type", "ts").alias("vote_type"))
    worth = F.when(F.col("vote_type") == "up", 1).when(F.col("vote_type") == "down", -1).otherwise(0) * F.when(F.col("user_id").isin(*experts), 1.5).otherwise(1.0)
    s = latest.groupBy("memory_id").agg(n(F.col("vote_type") == "up").alias("up"), n(F.col("vote_type") == "down").alias("down"), n(F.col("vote_type") == "bookmark").alias("bookmarks"), r6(F.sum(worth), 4).alias("weight"))
    return s.orderBy(F.desc("weight"), "memory_id").limit(top)


def comments(message: DataFrame) -> DataFrame:
    """Turns as comments: each answers the turn before it."""
    key = F.concat_ws("-", "session_id", "turn")
    return message.select(key.alias("id"), F.when(F.col("turn") > 0, F.concat_ws("-", "session_id", F.col("turn") - 1)).alias("parent_id"), "session_id", F.length("text").alias("size"))


@query("h25_comment_threads", "message", """
WITH RECURSIVE c AS (SELECT concat_ws('-', session_id, turn) AS id, CASE WHEN turn > 0 THEN concat_ws('-', session_id, turn - 1) END AS parent_id FROM message),
t AS (SELECT id, id AS root, 0 AS depth FROM c WHERE parent_id IS NULL UNION ALL SELECT c.id, t.root, t.depth + 1 FROM c JOIN t ON c.parent_id = t.id)
SELECT root, count(*) AS n, max(depth)::BIGINT AS depth FROM t GROUP BY root
""")
def comment_threads(message: DataFrame) -> DataFrame:
    """Per top-level comment, how many it has below (itself included) and how deep they go.

    Pointers double: after k rounds each comment knows its ancestor 2**k levels up, so rounds follow the logarithm of the
    depth, and each is a written table. Comments whose parent is missing, or in a circle, belong to no thread."""
    c = materialize(comments(message).select("id", "parent_id"), "comments")
    # up: the ancestor looked at last, null beyond the top; depth: levels from the comment to top, the last one known.
    now = c.select("id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), F.col("id")).alias("root"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    before = -1
    while True:
        left = now.where("root IS NULL").count()
        if left in (0, before):
            break
        before = left
        ahead = now.select(F.col("id").alias("at"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        far = now.where("root IS NULL").join(ahead, F.col("up") == F.col("at")).select("id", F.col("up2").alias("up"), F.col("root2").alias("root"), (F.col("depth") + F.col("depth2")).alias("depth"))
        now = materialize(now.where("root IS NOT NULL").unionByName(far), "threads")
    levels = now.where("root IS NOT NULL")
    return levels.groupBy("root").agg(count().alias("n"), F.max("depth").cast("long").alias("depth"))


@query("h26_merge_tags", "memory", """
WITH m(source, target) AS (VALUES ('t0', 't-low'), ('t1', 't-low'), ('t4', 't-high')),
t AS (SELECT DISTINCT id, coalesce(target, tag) AS tag FROM (SELECT id, unnest(tags) AS tag FROM memory) x LEFT JOIN m ON tag = source)
SELECT tag, count(*) AS usage_count, (row_number() OVER (ORDER BY count(*) DESC, tag))::BIGINT AS rank FROM t GROUP BY tag ORDER BY usage_count DESC, tag LIMIT 25
""", folds={"t0": "t-low", "t1": "t-low", "t4": "t-high"})
def merge_tags(memory: DataFrame, folds: dict[str, str], top: int = 25) -> DataFrame:
    """The tag catalogue after folding source tags into their targets, most used first."""
    to = F.create_map(*[F.lit(x) for pair in folds.items() for x in pair])
    t = memory.select(F.explode(F.array_distinct(F.transform("tags", lambda x: F.coalesce(F.try_element_at(to, x), x)))).alias("tag"))
    best = t.groupBy("tag").agg(count().alias("usage_count")).orderBy(F.desc("usage_count"), "tag").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("usage_count"), "tag")).cast("long"))  # top rows only


@query("h26b_suggest_tags", "memory", """
WITH u AS (SELECT tag, count(*) AS k FROM (SELECT unnest(tags) AS tag FROM memory) GROUP BY 1), q AS (SELECT * FROM (VALUES ('src1'), ('en'), ('zzz')) AS v(q)),
c AS (SELECT q, tag, CASE WHEN contains(tag, q) THEN 2 ELSE 1 END AS s, k FROM q, u),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, k DESC, tag) AS rn FROM c) SELECT q, tag, s::BIGINT AS score, rn AS rank FROM r WHERE rn <= 5
""", asked=["src1", "en", "zzz"])
def suggest_tags(memory: DataFrame, asked: list[str], k: int = 5) -> DataFrame:
    """Tags that contain the words asked for, then the most used ones. The vocabulary is aggregated first; the words are a stated list."""
    used = memory.select(F.explode("tags").alias("tag")).groupBy("tag").agg(count().alias("n"))
    both = used.select(F.explode(F.array(*map(F.lit, asked))).alias("q"), "tag", "n")
    scored = both.withColumn("score", F.when(F.expr("contains(tag, q)"), 2).otherwise(1).cast("long"))
    rn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("n"), "tag"))
    return scored.withColumn("rank", rn).where(F.col("rank") <= k).select("q", "tag", "score", F.col("rank").cast("long").alias("rank"))


@query("h27_knowledge_stats", "memory", """
SELECT 'domain' AS facet, wing AS value, count(*) AS n, round(avg(importance), 6) AS mean FROM memory GROUP BY wing UNION ALL SELECT 'category', hall, count(*), round(avg(importance), 6) FROM memory GROUP BY hall
UNION ALL SELECT 'status', CASE WHEN importance >= 3 THEN 'active' ELSE 'draft' END, count(*), round(avg(importance), 6) FROM memory GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*), round(avg(importance), 6) FROM memory
""")
def knowledge_stats(memory: DataFrame) -> DataFrame:
    """Counts and mean importance by domain, category, status and in all: GROUPING SETS."""
    x = memory.select(F.col("wing").alias("domain"), F.col("hall").alias("category"), F.when(F.col("importance") >= 3, "active").otherwise("draft").alias("status"), "importance")
    g = x.groupingSets([[F.col("domain")], [F.col("category")], [F.col("status")], []], "domain", "category", "status").agg(count().alias("n"), r6(F.avg("importance")).alias("mean"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 3, "domain").when(F.col("g") == 5, "category").when(F.col("g") == 6, "status").otherwise("all")
    return g.select(facet.alias("facet"), F.coalesce("domain", "category", "status").alias("value"), "n", "mean")


@query("h28_agent_map", "memory", """
WITH a AS (SELECT DISTINCT author FROM memory), v AS (SELECT count(*) AS k FROM memory WHERE importance >= 3)
SELECT a.author, count(*) FILTER (m.author = a.author) AS owned, (count(*) FILTER (m.author = a.author AND m.importance < 3) + any_value(v.k))::BIGINT AS visible,
  round(avg(m.importance) FILTER (m.author = a.author), 6) AS mean_importance, (SELECT arg_max(wing, (c, wing)) FROM (SELECT author, wing, count(*) AS c FROM memory GROUP BY 1, 2) w WHERE w.author = a.author) AS top_wing
FROM a, memory m, v GROUP BY a.author
""")
def agent_map(memory: DataFrame, public_from: float = 3.0) -> DataFrame:
    """Per agent: records owned and visible (own, or public by importance), mean importance and main wing. Public rows are counted once, not for each agent."""
    own = memory.groupBy("author").agg(count().alias("owned"), n(F.col("importance") < public_from).alias("private"), r6(F.avg("importance")).alias("mean_importance"))
    wings = memory.groupBy("author", "wing").agg(F.count("*").alias("c")).groupBy("author").agg(F.max_by("wing", F.struct("c", "wing")).alias("top_wing"))
    public = memory.where(F.col("importance") >= public_from).agg(count().alias("k"))
    return own.join(wings, "author").crossJoin(F.broadcast(public)).select("author", "owned", (F.col("private") + F.col("k")).alias("visible"), "mean_importance", "top_wing")


@query("h29_click_learning", "access_log", """
WITH p AS (SELECT operation, memory_id, sum(CASE WHEN operation = 'click' THEN 1.0 ELSE 0.5 END) AS accesses, count(*) AS k FROM access_log GROUP BY 1, 2), q AS (SELECT operation, count(*) AS uses FROM access_log GROUP BY 1)
SELECT p.operation, memory_id, round(accesses::DOUBLE, 4) AS accesses, round(least(1.0, 0.5 + least(0.3, 0.05 * accesses) + least(0.2, 1.0 * k / uses))::DOUBLE, 6) AS relevance FROM p JOIN q ON p.operation = q.operation
""")
def click_learning(access_log: DataFrame) -> DataFrame:
    """Relevance of a record for a query: .5, plus capped terms for its accesses (a click 1, else .5) and its share of the query's uses."""
    p = access_log.groupBy("operation", "memory_id").agg(F.sum(F.when(F.col("operation") == "click", 1.0).otherwise(0.5)).alias("accesses"), count().alias("k"))
    q = p.groupBy("operation").agg(F.sum("k").alias("uses"))
    score = 0.5 + F.least(F.lit(0.3), 0.05 * F.col("accesses")) + F.least(F.lit(0.2), F.col("k") / F.col("uses"))
    return p.join(q, "operation").select("operation", "memory_id", r6("accesses", 4).alias("accesses"), r6(F.least(F.lit(1.0), score)).alias("relevance"))


@query("h30_strategy_report", "access_log", """
WITH s AS (SELECT operation, count(*) AS n, avg(CASE WHEN duration_ms < 200 THEN 1.0 ELSE 0.0 END) AS rate FROM access_log GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY ts DESC, event_id DESC) AS rn FROM access_log), l AS (SELECT operation, count(*) FILTER (duration_ms > 400) AS low FROM r WHERE rn <= 20 GROUP BY 1)
SELECT s.operation AS strategy, n, round(rate, 6) AS success_rate, low, n >= 5 AND rate < 0.5 AS weak, low >= 3 AS troubled, operation_best = s.operation AS best FROM s JOIN l ON s.operation = l.operation, (SELECT arg_max(operation, (rate, operation)) AS operation_best FROM s)
""")
def strategy_report(access_log: DataFrame, quick_ms: float = 200.0, poor_ms: float = 400.0, last: int = 20) -> DataFrame:
    """Per strategy: success rate, poor values among the last, and which is best. The plain mean, since a running one depends on order."""
    s = access_log.groupBy("operation").agg(count().alias("n"), F.avg(F.when(F.col("duration_ms") < quick_ms, 1.0).otherwise(0.0)).alias("rate"))
    rn = F.row_number().over(Window.partitionBy("operation").orderBy(F.desc("ts"), F.desc("event_id")))
    low = access_log.withColumn("rn", rn).where(F.col("rn") <= last).groupBy("operation").agg(n(F.col("duration_ms") > poor_ms).alias("low"))
    best = s.agg(F.max_by("operation", F.struct("rate", "operation")).alias("top"))
    x = s.join(low, "operation").crossJoin(F.broadcast(best))
    return x.select(F.col("operation").alias("strategy"), "n", r6("rate").alias("success_rate"), "low", ((F.col("n") >= 5) & (F.col("rate") < 0.5)).alias("weak"), (F.col("low") >= 3).alias("troubled"), (F.col("operation") == F.col("top")).alias("best"))


@query("h31_metric_trend", "access_log", """
WITH m AS (SELECT operation, min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 AS mid FROM access_log GROUP BY 1),
h AS (SELECT a.operation, avg(duration_ms) FILTER (epoch_us(ts) <= mid) AS a, avg(duration_ms) FILTER (epoch_us(ts) > mid) AS b FROM access_log a JOIN m ON a.operation = m.operation GROUP BY 1)
SELECT operation, round(a, 4) AS first_half, round(b, 4) AS second_half, CASE WHEN b > a * 1.1 THEN 'degrading' WHEN b < a * 0.9 THEN 'improving' ELSE 'stable' END AS trend FROM h
""")
def metric_trend(access_log: DataFrame, band: float = 0.1) -> DataFrame:
    """Mean of the first and second half of each operation's time span. The split is by time: a count-based one would rank all rows in one task."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    x = access_log.withColumn("us", us)
    m = x.groupBy("operation").agg((F.min("us") + F.floor((F.max("us") - F.min("us")) / 2)).alias("mid"))
    h = x.join(m, "operation").groupBy("operation").agg(F.avg(F.when(F.col("us") <= F.col("mid"), F.col("duration_ms"))).alias("a"), F.avg(F.when(F.col("us") > F.col("mid"), F.col("duration_ms"))).alias("b"))
    return h.select("operation", r6("a", 4).alias("first_half"), r6("b", 4).alias("second_half"), F.when(F.col("b") > F.col("a") * (1 + band), "degrading").when(F.col("b") < F.col("a") * (1 - band), "improving").otherwise("stable").alias("trend"))


@query("h32_ab_test", "access_log", """
WITH a AS (SELECT avg(duration_ms) FILTER (event_id % 2 = 0) AS a, avg(duration_ms) FILTER (event_id % 2 = 1) AS b, least(count(*) FILTER (event_id % 2 = 0), count(*) FILTER (event_id % 2 = 1)) AS n FROM access_log)
SELECT round(a, 4) AS mean_a, round(b, 4) AS mean_b, n AS least_n, CASE WHEN n < 30 THEN 'undecided' WHEN a < b THEN 'a' ELSE 'b' END AS winner, round(abs(a - b) / ((a + b) / 2), 6) AS confidence FROM a
""")
def ab_test(access_log: DataFrame, least: int = 30) -> DataFrame:
    """Two arms by parity of the event: means, the better (lower), and the difference relative to the pooled mean."""
    even = F.col("event_id") % 2 == 0
    s = access_log.agg(F.avg(F.when(even, F.col("duration_ms"))).alias("a"), F.avg(F.when(~even, F.col("duration_ms"))).alias("b"), F.least(n(even), n(~even)).alias("n"))
    return s.select(r6("a", 4).alias("mean_a"), r6("b", 4).alias("mean_b"), F.col("n").alias("least_n"), F.when(F.col("n") < least, "undecided").when(F.col("a") < F.col("b"), "a").otherwise("b").alias("winner"), r6(F.abs(F.col("a") - F.col("b")) / ((F.col("a") + F.col("b")) / 2)).alias("confidence"))


def laplace(scale: float, seed: int | None = None):
    """A Laplace deviate by the inverse of its distribution. Without a seed a secret one is drawn, so that nobody can take the noise off."""
    u = F.rand(secrets.randbits(63) if seed is None else seed) - 0.5
    return -scale * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(2.0**-53)))  # u may be -0.5


class PrivacyBudget:
    """Spent by each noisy answer; refuses an answer that would exceed it."""

    def __init__(self, epsilon: float):
        self.left = epsilon

    def spend(self, epsilon: float) -> float:
        if epsilon > self.left + 1e-12:
            raise ValueError(f"privacy budget exhausted: {self.left} left, {epsilon} asked")
        self.left -= epsilon
        return epsilon


def _within(column: str, low: float, high: float):
    return F.greatest(F.lit(low), F.least(F.lit(high), F.col(column)))


def _noisy_mean(x: DataFrame, *keep: str) -> DataFrame:
    """keep, n, mean_importance from a noisy count and sum; the mean divides by the noisy count, never by the true one."""
    return x.select(*keep, F.greatest(F.lit(0.0), F.round("noisy_k")).alias("n"), (F.col("noisy_s") / F.greatest(F.lit(1.0), F.col("noisy_k"))).alias("mean_importance"))


@query("h33_dp_histogram", "memory")
def dp_histogram(memory: DataFrame, budget: PrivacyBudget | PrivacyLedger | None = None, epsilon: float = 0.5, seed: int | None = None) -> DataFrame:
    """Counts by wing with geometric noise and the mean importance with Laplace noise; a record changes one count by one and the
    clamped sum by five. Answers are refused once the budget is spent; callers who share one pass a PrivacyLedger of a common
    path, without any a new one is made for this answer. A seed is for tests only."""
    ledger = budget or PrivacyLedger(memory.sparkSession, f"{shared_dir(memory.sparkSession)}/ledger-{uuid.uuid4().hex}", 2 * epsilon)
    e = ledger.spend(epsilon)
    counts = memory.groupBy("wing").agg(count().alias("k"), F.coalesce(F.sum(_within("importance", 0.0, 5.0)), F.lit(0.0)).alias("s"))
    noisy = counts.select("wing", (F.col("k") + geometric(e / 2, seed)).cast("double").alias("noisy_k"), (F.col("s") + laplace(5 / (e / 2), None if seed is None else seed + 2)).alias("noisy_s"))
    return _noisy_mean(noisy, "wing")


def dp_count(rows: DataFrame, budget: PrivacyBudget | PrivacyLedger, epsilon: float, seed: int | None = None) -> DataFrame:
    """One row, n: the number of rows with geometric noise, not below 0."""
    e = budget.spend(epsilon)
    return rows.agg(count().alias("k")).select(F.greatest(F.lit(0.0), (F.col("k") + geometric(e, seed)).cast("double")).alias("n"))


def dp_mean(rows: DataFrame, column: str, low: float, high: float, budget: PrivacyBudget | PrivacyLedger, epsilon: float, seed: int | None = None) -> DataFrame:
    """One row, mean: of the values clamped to low and high, from a noisy sum of their distances from low and a noisy count. Nulls take no part."""
    e = budget.spend(epsilon) / 2
    x = rows.agg(F.count(column).alias("k"), F.coalesce(F.sum(_within(column, low, high) - low), F.lit(0.0)).alias("s"))
    x = x.select((F.col("k") + laplace(1 / e, seed)).alias("k"), (F.col("s") + laplace((high - low) / e, None if seed is None else seed + 1)).alias("s"))
    return x.select((low + F.greatest(F.lit(0.0), F.least(F.lit(high - low), F.col("s") / F.greatest(F.lit(1.0), F.col("k"))))).alias("mean"))


@query("h33_dp_count_mean", "memory")
def dp_count_mean(memory: DataFrame, epsilon: float = 0.5) -> DataFrame:
    """The noisy number of records and their noisy mean importance under one budget."""
    budget = PrivacyBudget(2 * epsilon)
    return dp_count(memory, budget, epsilon).crossJoin(dp_mean(memory, "importance", 0.0, 5.0, budget, epsilon))  # one row each


@query("h39_regression_check", "access_log", """
WITH d AS (SELECT operation, avg(duration_ms) FILTER (ts < TIMESTAMP '2024-01-15 00:00:00') AS base, avg(duration_ms) FILTER (ts >= TIMESTAMP '2024-01-15 00:00:00') AS now FROM access_log GROUP BY 1)
SELECT operation AS metric, round(base, 4) AS baseline, round(now, 4) AS current, round(now / base - 1, 6) AS change, CASE WHEN now / base - 1 > 0.02 THEN 'worse' WHEN now / base - 1 < -0.02 THEN 'better' ELSE 'same' END AS verdict FROM d
""", threshold=0.02)
def regression_check(access_log: DataFrame, threshold: float = 0.2, split: str = "2024-01-15 00:00:00") -> DataFrame:
    """Mean times before and after a moment, and whether the change exceeds the threshold either way."""
    late = F.col("ts") >= moment(split)
    d = access_log.groupBy("operation").agg(F.avg(F.when(~late, F.col("duration_ms"))).alias("base"), F.avg(F.when(late, F.col("duration_ms"))).alias("now"))
    change = F.col("now") / F.col("base") - 1
    return d.select(F.col("operation").alias("metric"), r6("base", 4).alias("baseline"), r6("now", 4).alias("current"), r6(change).alias("change"), F.when(change > threshold, "worse").when(change < -threshold, "better").otherwise("same").alias("verdict"))
