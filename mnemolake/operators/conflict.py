"""Conflicting records, resolution policies, status, change logs and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.columns import any_of, count, days_old, jaccard, moment, n, r6
from mnemolake.operators.similarity import keyword_subsets, keywords, shared_keywords
from mnemolake.operators.ordered import within_key
from mnemolake.plans.registry import query
from mnemolake.plans.storage import materialize
from mnemolake.plans.views import AS_OF

# Words that claim and words that deny, pair by pair.
OPPOSITES = [
    (["是", "正确", "对的", "✓"], ["不是", "错误", "不对", "✗", "否"]),
    (["成功", "通过", "完成"], ["失败", "未通过", "中断"]),
    (["支持", "启用", "开启"], ["不支持", "禁用", "关闭"]),
    (["增加", "上升", "提升"], ["减少", "下降", "降低"]),
    (["推荐", "建议", "应该"], ["不推荐", "避免", "不应该"]),
    (["存在", "有"], ["不存在", "没有", "无"]),
    (["简单", "容易", "方便"], ["复杂", "困难", "麻烦"]),
    (["快", "迅速", "高效"], ["慢", "缓慢", "低效"]),
    (["安全", "可靠"], ["不安全", "危险", "不可靠"]),
    (["yes", "true", "correct"], ["no", "false", "incorrect"]),
    (["success", "pass", "work"], ["fail", "error", "broken"]),
    (["support", "enable"], ["not support", "disable"]),
    (["increase", "up"], ["decrease", "down"]),
    (["good", "great", "excellent"], ["bad", "poor", "terrible"]),
    (["fast", "quick"], ["slow"]),
    (["safe", "secure"], ["unsafe", "dangerous", "insecure"]),
]
# Lists that the driver's invented words can hit.
DATA_OPPOSITES = [(["thened", "inth "], ["eronth", "lyha"]), (["hathe"], ["ndthe"])]


def polarity(opposites):
    """Bit masks of the pairs whose claiming and denying words the text holds."""
    c = F.lower("content")
    return tuple(sum((F.when(any_of(c, pair[side]), 1 << i).otherwise(0) for i, pair in enumerate(opposites)), F.lit(0)) for side in (0, 1))


def _masks_sql(name: str = "m") -> str:
    def has(ws):
        return "(" + " OR ".join(f"contains(c, '{w}')" for w in ws) + ")"

    pos = " + ".join(f"CASE WHEN {has(p)} THEN {1 << i} ELSE 0 END" for i, (p, _) in enumerate(DATA_OPPOSITES))
    neg = " + ".join(f"CASE WHEN {has(q)} THEN {1 << i} ELSE 0 END" for i, (_, q) in enumerate(DATA_OPPOSITES))
    return f"{name} AS (SELECT *, ({pos})::INT AS pos, ({neg})::INT AS neg FROM (SELECT *, lower(content) AS c FROM memory))"


_KW = "kw AS (SELECT id, word FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS rn FROM (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z]{3,}')) AS word FROM memory) WHERE word NOT IN ('the', 'and', 'that') GROUP BY 1, 2)) WHERE rn <= 8)"


@query("f1_conflict_pairs", "memory", f"""
WITH {_masks_sql()}, {_KW}, p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM kw x JOIN kw y ON x.word = y.word AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a, b, shared, round(least(1.0, 0.8 * CASE WHEN shared >= 4 THEN 1.5 ELSE 1.0 END)::DOUBLE, 6) AS confidence, CASE WHEN shared >= 4 THEN 'high' ELSE 'medium' END AS severity FROM p JOIN m s ON s.id = a JOIN m t ON t.id = b WHERE ((s.pos & t.neg) | (s.neg & t.pos)) <> 0
""", opposites=DATA_OPPOSITES)
def conflict_pairs(memory: DataFrame, opposites=OPPOSITES) -> DataFrame:
    """Pairs that share two keywords or more and claim opposite things. Only records with a claim are joined, on keyword pairs, so that each pair meets once."""
    pos, neg = polarity(opposites)
    m = memory.select("id", pos.alias("pos"), neg.alias("neg")).where("pos <> 0 OR neg <> 0")
    kw = keywords(memory).groupBy("id").agg(F.array_sort(F.collect_list("word")).alias("ws")).join(m, "id")
    # A pair meets once for every two keywords it shares, and counts where these are the first two: no keyword ahead of the
    # second, but the first, is shared. So only pairs that count have their shared keywords counted.
    two = kw.select("*", F.posexplode("ws").alias("i", "w1")).select("*", F.posexplode(F.slice("ws", F.col("i") + 2, F.size("ws"))).alias("k", "w2"))
    two = two.withColumn("ahead", F.array_remove(F.slice("ws", F.lit(1), F.col("i") + F.col("k") + 1), F.col("w1")))
    a, b = (two.select("w1", "w2", F.col("id").alias(k), F.col("pos").alias(f"pos{k}"), F.col("neg").alias(f"neg{k}"), F.col("ws").alias(f"ws{k}"), F.col("ahead").alias(f"ahead{k}")) for k in "ab")
    j = a.join(b, ["w1", "w2"]).where((F.col("a") < F.col("b")) & (F.col("posa").bitwiseAND(F.col("negb")).bitwiseOR(F.col("nega").bitwiseAND(F.col("posb"))) != 0))
    j = j.where(~F.arrays_overlap("aheada", "aheadb")).select("a", "b", F.size(F.array_intersect("wsa", "wsb")).cast("long").alias("shared"))
    strong = F.col("shared") >= 4
    return j.select("a", "b", "shared", r6(F.least(F.lit(1.0), 0.8 * F.when(strong, 1.5).otherwise(1.0))).alias("confidence"), F.when(strong, "high").otherwise("medium").alias("severity"))


def conflict_counts(memory: DataFrame, opposites=OPPOSITES) -> DataFrame:
    """(id, conflicts): how many pairs of conflict_pairs() each record is in, without listing them.

    Claims are counted for every subset of shared keywords, as in keyword_subsets(); a record's subsets add up the opposite ones.
    """
    pos, neg = polarity(opposites)
    m = memory.select("id", pos.alias("pos"), neg.alias("neg")).where("pos <> 0 OR neg <> 0")
    kw = memory.join(m.select("id"), "id", "left_semi")
    each = materialize(keyword_subsets(m.join(shared_keywords(kw), "id"), "id", "pos", "neg"), "keyword-subsets")
    claims = each.groupBy("k1", "k2", "pos", "neg").agg(F.count("*").alias("n"))
    mine, theirs = claims.select("k1", "k2", "pos", "neg"), claims.select("k1", "k2", F.col("pos").alias("p"), F.col("neg").alias("q"), "n")
    opposite = F.col("pos").bitwiseAND(F.col("q")).bitwiseOR(F.col("neg").bitwiseAND(F.col("p"))) != 0
    against = mine.join(theirs, ["k1", "k2"]).where(opposite).groupBy("k1", "k2", "pos", "neg").agg(F.sum("n").alias("n"))
    x = each.join(against, ["k1", "k2", "pos", "neg"])
    # A record that claims and denies one thing would count itself.
    own = F.when(F.first("pos").bitwiseAND(F.first("neg")) != 0, 1).otherwise(0)
    return x.groupBy("id").agg((F.sum(F.col("weight") * F.col("n")) - own).alias("conflicts")).where("conflicts > 0")


@query("f2_agent_conflicts", "memory", f"""
WITH {_masks_sql()}, k AS (SELECT author, list_sort(list_distinct(tags)) AS s, pos, neg, min(id) AS id, count(*) AS n, list(id) AS ids FROM m WHERE pos <> 0 OR neg <> 0 GROUP BY 1, 2, 3, 4)
SELECT 'pair' AS kind, a.id AS a, b.id AS b, round(least(1.0, 0.4 * (bit_count(a.pos & b.neg) + bit_count(a.neg & b.pos)) + 0.2 * len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s)))), 6) AS confidence, a.n * b.n AS pairs
FROM k a JOIN k b ON a.id < b.id AND a.author <> b.author WHERE ((a.pos & b.neg) | (a.neg & b.pos)) <> 0
UNION ALL SELECT 'member', id, unnest(ids), NULL, NULL FROM k WHERE author IS NOT NULL
""", opposites=DATA_OPPOSITES)
def agent_conflicts(memory: DataFrame, opposites=OPPOSITES) -> DataFrame:
    """Opposite claims of different authors among all records; .4 for each pair of lists hit and .2 of tag overlap.

    Records of one author with equal tags and claims are one class, named by its smallest id; a row stands for so many pairs
    of records. Classes meet by the list that one claims and the other denies. Records without an author take no part.
    Rows of kind "member" give for every record b with a claim its class a, so all pairs of records can be had from both kinds.
    """
    pos, neg = polarity(opposites)
    m = materialize(memory.where("author IS NOT NULL").select("id", "author", F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))).alias("s"), pos.alias("pos"), neg.alias("neg")).where("pos <> 0 OR neg <> 0"), "claiming")
    k = materialize(m.groupBy("author", "s", "pos", "neg").agg(F.min("id").alias("id"), count().alias("n")), "claims")
    lists = F.sequence(F.lit(0), F.lit(len(opposites) - 1))

    def hit(mask: str):
        return F.explode(F.filter(lists, lambda i: F.col(mask).cast("long").bitwiseAND(F.pow(F.lit(2), i).cast("long")) != 0)).alias("list")

    claims, denials = k.select(F.col("id").alias("x"), "author", hit("pos")), k.select(F.col("id").alias("y"), F.col("author").alias("other"), hit("neg"))
    met = claims.join(denials, "list").where("author <> other").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    one, two = (k.select(*[F.col(c).alias(f"{c}_{side}") for c in ("id", "s", "pos", "neg", "n")]) for side in "ab")
    j = met.join(one, F.col("a") == F.col("id_a")).join(two, F.col("b") == F.col("id_b"))
    x, y = F.col("pos_a").bitwiseAND(F.col("neg_b")), F.col("neg_a").bitwiseAND(F.col("pos_b"))
    overlap = F.when((F.size("s_a") > 0) | (F.size("s_b") > 0), jaccard("s_a", "s_b")).otherwise(0.0)
    pairs = j.select(F.lit("pair").alias("kind"), "a", "b", r6(F.least(F.lit(1.0), 0.4 * (F.bit_count(x) + F.bit_count(y)) + 0.2 * overlap)).alias("confidence"), (F.col("n_a") * F.col("n_b")).alias("pairs"))
    same = ["author", "s", "pos", "neg"]
    members = m.select(F.col("id").alias("b"), *same).join(k.select(F.col("id").alias("a"), *same), same)
    return pairs.unionByName(members.select(F.lit("member").alias("kind"), "a", "b", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("long").alias("pairs")))


@query("f3_resolve", "memory", """
SELECT left(content, 20) AS topic, arg_max(id, (created_at, id)) AS last_write, arg_max(id, (importance, id)) AS highest_priority, count(*) AS n FROM memory GROUP BY left(content, 20) HAVING count(*) > 1
""")
def resolve(memory: DataFrame) -> DataFrame:
    """Of records on one topic (equal beginning): the winner by last write and by priority."""
    return memory.groupBy(F.left("content", F.lit(20)).alias("topic")).agg(F.max_by("id", F.struct("created_at", "id")).alias("last_write"), F.max_by("id", F.struct("importance", "id")).alias("highest_priority"), count().alias("n")).where("n > 1")


@query("f3_resolve_pairs", "memory", """
WITH t AS (SELECT left(content, 20) AS topic, arg_max(id, (created_at, id)) AS a, arg_max(id, (importance, id)) AS b FROM memory GROUP BY 1 HAVING count(*) > 1), j AS (SELECT topic, a, b, x.content AS ca, y.content AS cb, x.tags AS ta, y.tags AS tb FROM t JOIN memory x ON x.id = a JOIN memory y ON y.id = b)
SELECT topic, a || ',' || b AS sources, unnest(['last_write', 'priority', 'merge', 'manual']) AS policy, unnest([a, b, CASE WHEN a = b THEN a END, CASE WHEN a = b THEN a END]) AS kept, unnest([ca, cb, CASE WHEN a = b THEN ca ELSE '[merged] ' || ca || chr(10) || '---' || chr(10) || cb END, NULL]) AS content,
unnest([array_to_string(list_sort(ta), ','), array_to_string(list_sort(tb), ','), array_to_string(list_sort(list_distinct(ta || tb)), ','), NULL]) AS tags, unnest([false, false, false, a <> b]) AS review FROM j
""")
def resolve_pairs(memory: DataFrame) -> DataFrame:
    """The latest and the most important record of each topic that has several, resolved by every policy.

    last_write and priority keep one of the two. merge joins both texts and the union of their tags to a new record (kept
    is null, unless both are one record). manual keeps neither and marks the pair for review. Texts of two records a topic
    are read, however many it has; ids are joined to records behind that cut.
    """
    t = memory.groupBy(F.left("content", F.lit(20)).alias("topic")).agg(F.max_by("id", F.struct("created_at", "id")).alias("a"), F.max_by("id", F.struct("importance", "id")).alias("b"), count().alias("n")).where("n > 1").drop("n")
    one, two = (memory.select(F.col("id").alias(k), F.col("content").alias(f"c{k}"), F.coalesce("tags", F.array().cast("array<string>")).alias(f"t{k}")) for k in "ab")
    j = t.join(one, "a").join(two, "b")
    same = F.col("a") == F.col("b")

    def tags(c):
        return F.array_join(F.array_sort(c), ",")

    merged = F.when(same, F.col("ca")).otherwise(F.concat(F.lit("[merged] "), "ca", F.lit("\n---\n"), "cb"))
    none = F.lit(None).cast("string")
    kept = F.when(same, F.col("a"))
    rows = [("last_write", F.col("a"), F.col("ca"), tags("ta"), F.lit(False)), ("priority", F.col("b"), F.col("cb"), tags("tb"), F.lit(False)), ("merge", kept, merged, tags(F.array_union("ta", "tb")), F.lit(False)), ("manual", kept, none, none, ~same)]
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), k.alias("kept"), c.alias("content"), g.alias("tags"), r.alias("review")) for p, k, c, g, r in rows]))
    return j.select("topic", F.concat_ws(",", "a", "b").alias("sources"), each.alias("x")).select("topic", "sources", "x.*")


@query("f4_topic_contradictions", "memory", f"""
WITH {_masks_sql()} SELECT tag, count(*) FILTER (pos <> 0) AS claims, count(*) FILTER (neg <> 0) AS denials, arg_max(id, (importance, id)) AS keeper FROM (SELECT id, importance, pos, neg, unnest(tags) AS tag FROM m) GROUP BY tag HAVING bool_or(pos <> 0) AND bool_or(neg <> 0)
""", opposites=DATA_OPPOSITES)
def topic_contradictions(memory: DataFrame, opposites=OPPOSITES) -> DataFrame:
    """Tags with claiming and denying records, and the most important of each."""
    pos, neg = polarity(opposites)
    t = memory.select("id", "importance", pos.alias("pos"), neg.alias("neg"), F.explode("tags").alias("tag"))
    return t.groupBy("tag").agg(n(F.col("pos") != 0).alias("claims"), n(F.col("neg") != 0).alias("denials"), F.max_by("id", F.struct("importance", "id")).alias("keeper")).where("claims > 0 AND denials > 0")


@query("f5_graph_contradictions", "relation", """
WITH o(p, q) AS (VALUES ('depends_on', 'enables'), ('related_to', 'causes')), d AS (SELECT DISTINCT subject_id, predicate FROM relation), e AS (SELECT DISTINCT object_id, predicate FROM relation)
SELECT 'subject' AS side, a.subject_id AS node, p, q FROM o JOIN d a ON a.predicate = p JOIN d b ON b.predicate = q AND a.subject_id = b.subject_id UNION ALL SELECT 'object', a.object_id, p, q FROM o JOIN e a ON a.predicate = p JOIN e b ON b.predicate = q AND a.object_id = b.object_id
""", opposed=[("depends_on", "enables"), ("related_to", "causes")])
def graph_contradictions(relation: DataFrame, opposed: list[tuple[str, str]]) -> DataFrame:
    """Nodes with opposed predicates on the same side: distinct (node, predicate) first, so a hub counts once."""
    out = None
    for side in ("subject", "object"):
        d = relation.groupBy(F.col(f"{side}_id").alias("node")).agg(F.collect_set("predicate").alias("ps"))
        pairs = F.filter(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in opposed]), lambda x: F.array_contains("ps", x["p"]) & F.array_contains("ps", x["q"]))
        one = d.select(F.lit(side).alias("side"), "node", F.explode(pairs).alias("x")).select("side", "node", "x.p", "x.q")
        out = one if out is None else out.unionByName(one)
    return out


@query("f6_pair_verdict", "memory", """
WITH t AS (SELECT id, lower(content) AS c, row_number() OVER (ORDER BY importance DESC, id) AS rn FROM (SELECT * FROM memory ORDER BY importance DESC, id LIMIT 50)),
v AS (SELECT CASE WHEN contains(a.c, 'thened') AND contains(b.c, 'eronth') THEN 'regression' WHEN contains(b.c, 'inth') THEN 'evolution' WHEN contains(b.c, 'ndthe') THEN 'supersession' ELSE 'none' END AS verdict FROM t a JOIN t b ON a.rn <= 10 AND b.rn > a.rn AND b.rn <= 15) SELECT verdict, count(*) AS n FROM v GROUP BY 1
""")
def pair_verdict(memory: DataFrame, first: int = 10, upto: int = 15) -> DataFrame:
    """Ordered keyword verdicts over pairs of the most important records; `upto` rows are paired."""
    t = memory.orderBy(F.desc("importance"), "id").limit(upto).select("id", F.lower("content").alias("c"), "importance")
    t = t.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("importance"), "id")))
    a, b = (t.select(F.col("rn").alias(f"r{k}"), F.col("c").alias(k)) for k in "ab")
    j = a.join(F.broadcast(b), (F.col("ra") <= first) & (F.col("rb") > F.col("ra")))

    def has(c, w):
        return F.contains(c, F.lit(w))

    return j.groupBy(F.when(has("a", "thened") & has("b", "eronth"), "regression").when(has("b", "inth"), "evolution").when(has("b", "ndthe"), "supersession").otherwise("none").alias("verdict")).agg(count().alias("n"))


@query("f7_memory_status", "memory", f"""
WITH {_masks_sql()} SELECT CASE WHEN pos <> 0 AND neg <> 0 THEN 'conflicted' WHEN date_diff('second', created_at, {{AS_OF}}) / 86400.0 >= 20 AND (contains(c, 'version') OR contains(c, 'that ')) AND length(content) < 400 THEN 'stale' WHEN importance >= 4 THEN 'verified' ELSE 'active' END AS status, count(*) AS n FROM m GROUP BY 1
""", opposites=DATA_OPPOSITES, facts=["version", "that "], days=20, shorter=400)
def memory_status(memory: DataFrame, opposites=OPPOSITES, facts=("version",), days: float = 90, shorter: int = 200, as_of: str = AS_OF) -> DataFrame:
    """Conflicted before stale before verified before active."""
    pos, neg = polarity(opposites)
    stale = (days_old("created_at", as_of) >= days) & any_of(F.lower("content"), list(facts)) & (F.length("content") < shorter)
    return memory.groupBy(F.when((pos != 0) & (neg != 0), "conflicted").when(stale, "stale").when(F.col("importance") >= 4, "verified").otherwise("active").alias("status")).agg(count().alias("n"))


@query("f8_change_log", "access_log", """
SELECT memory_id, count(*) AS changes, count(*) FILTER (ts >= TIMESTAMP '2024-01-20 00:00:00') AS pending, arg_max(operation, (ts, event_id)) AS last_operation, md5(arg_max(operation || '|' || memory_id, (ts, event_id))) AS last_hash FROM access_log GROUP BY memory_id
""", since="2024-01-20 00:00:00")
def change_log(access_log: DataFrame, since: str) -> DataFrame:
    """Per record: changes, those since a moment, the last operation and its hash."""
    key = F.struct("ts", "event_id")
    return access_log.groupBy("memory_id").agg(count().alias("changes"), n(F.col("ts") >= moment(since)).alias("pending"), F.max_by("operation", key).alias("last_operation"), F.md5(F.max_by(F.concat_ws("|", "operation", "memory_id"), key)).alias("last_hash"))


def _side(access_log: DataFrame, parity: int) -> DataFrame:
    return access_log.where((F.col("event_id") % 2 == parity) & F.col("operation").isin("click", "purchase"))


@query("f9_sync_conflicts", "access_log", """
WITH l AS (SELECT * FROM access_log WHERE event_id % 2 = 0 AND operation IN ('click', 'purchase')), r AS (SELECT * FROM access_log WHERE event_id % 2 = 1 AND operation IN ('click', 'purchase')),
f AS (SELECT memory_id, min(CASE WHEN operation = 'click' THEN event_id END) AS c, min(CASE WHEN operation = 'purchase' THEN event_id END) AS p FROM l GROUP BY 1)
SELECT r.event_id AS remote, CASE WHEN r.operation = 'click' THEN p ELSE c END AS local FROM r JOIN f ON r.memory_id = f.memory_id WHERE CASE WHEN r.operation = 'click' THEN p ELSE c END IS NOT NULL
""")
def sync_conflicts(access_log: DataFrame) -> DataFrame:
    """Remote changes with a different local one on the same record; the first local one. Local changes are first reduced to one per record and content."""
    local = _side(access_log, 0).groupBy("memory_id", F.col("operation").alias("own")).agg(F.min("event_id").alias("event_id"))
    j = _side(access_log, 1).select(F.col("event_id").alias("remote"), "memory_id", "operation").join(local, "memory_id").where("own <> operation")
    return j.groupBy("remote").agg(F.min("event_id").alias("local"))


@query("f10_apply_remote", "access_log", """
WITH l AS (SELECT memory_id, arg_max(operation, (ts, event_id)) AS own FROM access_log WHERE event_id % 2 = 0 AND operation IN ('click', 'purchase') GROUP BY 1)
SELECT CASE WHEN own IS NULL OR own = r.operation THEN 'applied' ELSE 'conflict' END AS outcome, count(*) AS n FROM access_log r LEFT JOIN l ON l.memory_id = r.memory_id WHERE event_id % 2 = 1 AND operation IN ('click', 'purchase') GROUP BY 1
""")
def apply_remote(access_log: DataFrame) -> DataFrame:
    """Remote changes that apply, or conflict with the latest local content."""
    l = _side(access_log, 0).groupBy("memory_id").agg(F.max_by("operation", F.struct("ts", "event_id")).alias("own"))  # noqa: E741
    return _side(access_log, 1).join(l, "memory_id", "left").groupBy(F.when(F.col("own").isNull() | (F.col("own") == F.col("operation")), "applied").otherwise("conflict").alias("outcome")).agg(count().alias("n"))


@query("f11_record_versions", "access_log", """
SELECT memory_id, event_id, version FROM (SELECT memory_id, event_id, row_number() OVER (PARTITION BY memory_id ORDER BY ts, event_id) AS version, row_number() OVER (PARTITION BY memory_id ORDER BY ts DESC, event_id DESC) AS back FROM access_log) WHERE back <= 10
""", keep=10)
def record_versions(access_log: DataFrame, keep: int) -> DataFrame:
    """Changes numbered per record, the last `keep` of them; numbers never repeat."""
    w = Window.partitionBy("memory_id")
    x = access_log.select("memory_id", "event_id", F.row_number().over(w.orderBy("ts", "event_id")).cast("long").alias("version"), F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).alias("back"))
    return x.where(F.col("back") <= keep).drop("back")


def rollback(versions: DataFrame, to: int) -> DataFrame:
    """memory_id, version, restores: the row that going back to version `to` appends to each record that still keeps it."""
    x = versions.groupBy("memory_id").agg(F.max("version").alias("last"), F.max(F.when(F.col("version") == to, F.col("event_id"))).alias("restores"))
    return x.where("restores IS NOT NULL").select("memory_id", (F.col("last") + 1).alias("version"), "restores")


@query("f12_rollback", "access_log", """
WITH v AS (SELECT memory_id, event_id, row_number() OVER (PARTITION BY memory_id ORDER BY ts, event_id) AS version, count(*) OVER (PARTITION BY memory_id) AS n FROM access_log)
SELECT memory_id, n + 1 AS version, event_id AS restores FROM v WHERE version = 2 AND version > n - 10
""", to=2)
def rolled_back(access_log: DataFrame, to: int, keep: int = 10) -> DataFrame:
    """Every record that still keeps version `to` rolled back to it."""
    return rollback(record_versions(access_log, keep), to)


@query("f12_compare_versions", "memory", """
WITH v AS (SELECT id, content, importance, lag(content) OVER w AS pc, lag(importance) OVER w AS pi, lag(created_at) OVER w AS pt, created_at FROM memory WINDOW w AS (PARTITION BY author, room ORDER BY created_at, id))
SELECT id, content <> pc AS text_changed, importance <> pi AS importance_changed, round(len(list_intersect(list_distinct(string_split(content, '')), list_distinct(string_split(pc, ''))))::DOUBLE / len(list_distinct(list_concat(string_split(content, ''), string_split(pc, '')))), 6) AS similarity, round(date_diff('second', pt, created_at) / 3600.0, 4) AS hours FROM v WHERE pc IS NOT NULL
""")
def compare_versions(memory: DataFrame) -> DataFrame:
    """A record against the one before it in author and room: what changed, overlap of characters, hours between."""
    chars = F.filter(F.array_distinct(F.split("content", "")), lambda x: x != "")
    v = memory.select("id", F.sha2("content", 256).alias("h"), "importance", "created_at", chars.alias("c"), "author", "room")
    v = within_key(v, ["author", "room"], ["created_at", "id"], {f"p{c}": (c, -1) for c in ("h", "importance", "created_at", "c")}).where("ph IS NOT NULL")
    return v.select("id", (F.col("h") != F.col("ph")).alias("text_changed"), (F.col("importance") != F.col("pimportance")).alias("importance_changed"), r6(jaccard("c", "pc")).alias("similarity"), r6(F.timestamp_diff("SECOND", F.col("pcreated_at"), F.col("created_at")) / 3600.0, 4).alias("hours"))


def line_diff(a: str, b: str):
    """Struct of position-wise counts of two texts' lines."""
    return lines_differ(F.split(a, "\n"), F.split(b, "\n"))


def lines_differ(x, y):
    """The same of two arrays of lines, or of their hashes."""
    z = F.arrays_zip(x.alias("x"), y.alias("y"))
    zero = F.struct(*[F.lit(0).cast("long").alias(k) for k in ("added", "removed", "modified", "unchanged")])

    def step(s, p):
        def more(k, cond):
            return (s[k] + F.when(cond, 1).otherwise(0)).cast("long").alias(k)

        p, q = p["x"], p["y"]
        return F.struct(more("added", p.isNull()), more("removed", q.isNull()), more("modified", F.coalesce(p != q, F.lit(False))), more("unchanged", F.coalesce(p == q, F.lit(False))))

    return F.aggregate(z, zero, step)


@query("f13_line_diff", "memory", """
WITH p AS (SELECT id, string_split(lag(content) OVER (PARTITION BY author, wing ORDER BY created_at, id), chr(10)) AS a, string_split(content, chr(10)) AS b FROM memory), q AS (SELECT id, a, b FROM p WHERE a IS NOT NULL),
c AS (SELECT id, greatest(0, len(b) - len(a)) AS added, greatest(0, len(a) - len(b)) AS removed, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) AS unchanged, least(len(a), len(b)) AS bt FROM q)
SELECT id, added::BIGINT AS added, removed::BIGINT AS removed, (bt - unchanged)::BIGINT AS modified, unchanged::BIGINT AS unchanged, round(unchanged::DOUBLE / (bt + added + removed), 6) AS similarity FROM c
""")
def line_diffs(memory: DataFrame) -> DataFrame:
    """Each record's lines against those of the one before it in author and wing."""
    lines = F.transform(F.split("content", "\n"), lambda t: F.xxhash64(t))  # enough to tell lines apart
    p = within_key(memory.select("id", "author", "wing", "created_at", lines.alias("lines")), ["author", "wing"], ["created_at", "id"], {"before": ("lines", -1)}).where("before IS NOT NULL").select("id", lines_differ(F.col("before"), F.col("lines")).alias("d"))
    every = F.col("d.added") + F.col("d.removed") + F.col("d.modified") + F.col("d.unchanged")
    return p.select("id", "d.*", r6(F.col("d.unchanged") / every).alias("similarity"))


@query("f14_diff_matrix", "memory", """
WITH t AS (SELECT id, string_split(content, chr(10)) AS l FROM memory ORDER BY importance DESC, id LIMIT 12)
SELECT x.id AS a, y.id AS b, round(len(list_filter(range(1, least(len(x.l), len(y.l)) + 1), lambda i: x.l[i] = y.l[i]))::DOUBLE / greatest(len(x.l), len(y.l)), 6) AS similarity FROM t x JOIN t y ON x.id < y.id
""", most=12)
def diff_matrix(memory: DataFrame, most: int) -> DataFrame:
    """Line similarity of all pairs of a small set: the `most` most important records."""
    t = memory.orderBy(F.desc("importance"), "id").limit(most)
    a, b = (t.select(F.col("id").alias(k), F.col("content").alias(f"{k}t")) for k in "ab")
    d = a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", line_diff("at", "bt").alias("d"))
    return d.select("a", "b", r6(F.col("d.unchanged") / (F.col("d.added") + F.col("d.removed") + F.col("d.modified") + F.col("d.unchanged"))).alias("similarity"))
