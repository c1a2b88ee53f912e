"""Filters, visibility and understanding of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.columns import best_of, count, hits, moment, n, r6, words
from mnemolake.plans.registry import query
from mnemolake.plans.views import AS_OF


@query("c1_recall_filter", "memory", "SELECT id, wing, room, importance FROM memory WHERE wing = 'en' AND importance >= 3 ORDER BY importance DESC, id LIMIT 25 OFFSET 10", wing="en", least=3.0, limit=25, offset=10)
def recall_filter(memory: DataFrame, wing: str | None = None, room: str | None = None, author: str | None = None, least: float = 0.0, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of records by facets, most important first, ids breaking ties."""
    out = memory.where(F.col("importance") >= least)
    for column, value in (("wing", wing), ("room", room), ("author", author)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy(F.desc("importance"), "id").offset(offset).limit(limit).select("id", "wing", "room", "importance")


@query("c2_recall_by_ids", "memory access_log", "SELECT id, wing, importance FROM memory WHERE id IN (SELECT memory_id FROM access_log WHERE operation = 'purchase')")
def recall_by_ids(memory: DataFrame, access_log: DataFrame) -> DataFrame:
    """Records whose id is in a set: a semi-join, so the set may be large."""
    ids = access_log.where("operation = 'purchase'").select(F.col("memory_id").alias("id"))
    return memory.join(ids, "id", "left_semi").select("id", "wing", "importance")


_SCOPE = "CASE WHEN importance >= 4 THEN 'public' WHEN importance >= 2 THEN 'shared' ELSE 'private' END"


def scope():
    return F.when(F.col("importance") >= 4, "public").when(F.col("importance") >= 2, "shared").otherwise("private")


@query("c3_visible_to", "memory", f"SELECT id, {_SCOPE} AS scope FROM memory WHERE {_SCOPE} = 'public' OR author = 'a1' OR ({_SCOPE} = 'shared' AND list_contains(tags, 't2'))", agent="a1", through="t2")
def visible_to(memory: DataFrame, agent: str, through: str) -> DataFrame:
    """Public records, one's own, and shared ones whose share list (tags) names the group."""
    m = memory.withColumn("scope", scope())
    return m.where((F.col("scope") == "public") | (F.col("author") == agent) | ((F.col("scope") == "shared") & F.array_contains("tags", through))).select("id", "scope")


@query("c4_access_rights", "memory", f"""
WITH u(user_id) AS (VALUES ('a0'), ('a3'), ('x')) SELECT user_id, count(*) AS n, count(*) FILTER (author = user_id OR {_SCOPE} <> 'private') AS can_read, count(*) FILTER (author = user_id OR {_SCOPE} = 'public') AS can_comment, count(*) FILTER (author <> user_id AND {_SCOPE} = 'public') AS can_vote FROM u, memory GROUP BY user_id
""", users=["a0", "a3", "x"])
def access_rights(memory: DataFrame, users: list[str]) -> DataFrame:
    """How many records each stated user may read, comment on and vote for, in one pass."""
    m = memory.select("author", scope().alias("scope"), F.explode(F.array(*map(F.lit, users))).alias("user_id"))
    own = F.col("author") == F.col("user_id")
    return m.groupBy("user_id").agg(count().alias("n"), n(own | (F.col("scope") != "private")).alias("can_read"), n(own | (F.col("scope") == "public")).alias("can_comment"), n(~own & (F.col("scope") == "public")).alias("can_vote"))


@query("c5_knowledge_filter", "memory", "SELECT id, importance FROM memory WHERE wing = 'en' AND list_has_all(tags, ['en', 't1']) AND contains(lower(content), 'the') ORDER BY importance DESC, created_at DESC, id LIMIT 40", wing="en", tags=["en", "t1"], text="the")
def knowledge_filter(memory: DataFrame, wing: str, tags: list[str], text: str, limit: int = 40) -> DataFrame:
    """All facets and all tags, before the limit."""
    has = F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0
    return memory.where((F.col("wing") == wing) & has & F.contains(F.lower("content"), F.lit(text))).orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(limit).select("id", "importance")


@query("c6_time_slice", "memory", "SELECT id, room FROM memory WHERE created_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' AND list_has_any(tags, ['t1', 't3'])", start="2024-01-10 00:00:00", end="2024-01-15 00:00:00", tags=["t1", "t3"])
def time_slice(memory: DataFrame, start: str, end: str, tags: list[str]) -> DataFrame:
    """An inclusive time range and any of the tags."""
    return memory.where(F.col("created_at").between(moment(start), moment(end)) & F.arrays_overlap("tags", F.array(*map(F.lit, tags)))).select("id", "room")


_ASKED = "q(qid, text) AS (SELECT concat(session_id, '-', turn), text || CASE turn % 4 WHEN 0 THEN ' 3 days ago' WHEN 1 THEN ' 2024-01-05 summary' WHEN 2 THEN ' yesterday' ELSE '' END FROM message WHERE role = 'user')"


def questions(message: DataFrame) -> DataFrame:
    """User turns as queries, some with a time added."""
    tail = F.when(F.col("turn") % 4 == 0, " 3 days ago").when(F.col("turn") % 4 == 1, " 2024-01-05 summary").when(F.col("turn") % 4 == 2, " yesterday").otherwise("")
    return message.where("role = 'user'").select(F.concat_ws("-", "session_id", "turn").alias("qid"), F.concat("text", tail).alias("text"))


def mentioned(text, as_of: str = AS_OF):
    """Date a text names: so many days ago, yesterday or today, or year-month-day; null if none is valid."""
    today = F.to_date(moment(as_of))
    ago = F.try_to_number(F.nullif(F.regexp_extract(text, "([0-9]+) days? ago", 1), F.lit("")), F.lit("999999")).cast("int")
    named = F.regexp_extract(text, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.when(ago.isNotNull(), F.date_sub(today, ago)).when(F.contains(text, F.lit("yesterday")), F.date_sub(today, 1)).when(F.contains(text, F.lit("today")), today).otherwise(F.try_to_date(F.nullif(named, F.lit("")), "yyyy-MM-dd"))


@query("c7_mentioned_time", "message", f"""
WITH {_ASKED} SELECT qid, CAST(CASE WHEN regexp_matches(text, '[0-9]+ days? ago') THEN CAST({{AS_OF}} AS DATE) - CAST(regexp_extract(text, '([0-9]+) days? ago', 1) AS INT) WHEN contains(text, 'yesterday') THEN CAST({{AS_OF}} AS DATE) - 1 WHEN contains(text, 'today') THEN CAST({{AS_OF}} AS DATE) ELSE TRY_CAST(nullif(regexp_extract(text, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS DATE) END AS VARCHAR) AS day FROM q
""")
def mentioned_time(message: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """The date that each question names."""
    return questions(message).select("qid", mentioned(F.col("text"), as_of).cast("string").alias("day"))


@query("c8_parse_queries", "message", f"""
WITH {_ASKED} SELECT qid, CASE WHEN contains(text, 'summary') THEN 'summary' WHEN contains(text, 'ago') OR contains(text, 'yesterday') THEN 'timeline' ELSE 'search' END AS intent, len(list_filter(list_distinct(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+')), lambda x: length(x) >= 4))::BIGINT AS n_keywords FROM q
""")
def parse_queries(message: DataFrame) -> DataFrame:
    """Intent and number of keywords of each question."""
    q = questions(message)
    intent = F.when(F.contains("text", F.lit("summary")), "summary").when(F.contains("text", F.lit("ago")) | F.contains("text", F.lit("yesterday")), "timeline").otherwise("search")
    return q.select("qid", intent.alias("intent"), F.size(F.filter(F.array_distinct(words("text")), lambda x: F.length(x) >= 4)).cast("long").alias("n_keywords"))


@query("c9_run_parsed", "memory message", f"""
WITH {_ASKED}, p AS (SELECT qid, CASE WHEN contains(text, 'summary') THEN 'summary' WHEN contains(text, 'ago') OR contains(text, 'yesterday') THEN 'timeline' ELSE 'search' END AS intent,
  CAST(CASE WHEN regexp_matches(text, '[0-9]+ days? ago') THEN CAST({{AS_OF}} AS DATE) - CAST(regexp_extract(text, '([0-9]+) days? ago', 1) AS INT) WHEN contains(text, 'yesterday') THEN CAST({{AS_OF}} AS DATE) - 1 WHEN contains(text, 'today') THEN CAST({{AS_OF}} AS DATE) ELSE TRY_CAST(nullif(regexp_extract(text, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS DATE) END AS VARCHAR) AS day,
  len(list_filter(list_distinct(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+')), lambda x: length(x) >= 4))::BIGINT AS k FROM q), d AS (SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM memory GROUP BY 1)
SELECT qid, intent, p.day, CASE intent WHEN 'timeline' THEN coalesce(n, 0) WHEN 'summary' THEN (SELECT count(*) FROM memory) ELSE k END AS n FROM p LEFT JOIN d ON d.day = p.day
""")
def run_parsed(memory: DataFrame, message: DataFrame) -> DataFrame:
    """What each intent returns: counts for summaries, a day's records for timelines, nothing to rank for the rest."""
    parsed = parse_queries(message).join(mentioned_time(message), "qid")
    per_day = memory.groupBy(F.to_date("created_at").cast("string").alias("day")).agg(count().alias("n"))
    timeline = parsed.where("intent = 'timeline'").join(per_day, "day", "left").select("qid", "intent", "day", F.coalesce("n", F.lit(0)).alias("n"))
    total = memory.agg(count().alias("n"))
    summary = parsed.where("intent = 'summary'").crossJoin(F.broadcast(total)).select("qid", "intent", "day", "n")
    return timeline.unionByName(summary).unionByName(parsed.where("intent = 'search'").select("qid", "intent", "day", F.col("n_keywords").alias("n")))


SYNONYMS = [("then", "thus", 1), ("then", "after", 2), ("the", "this", 1), ("que", "what", 1)]


@query("c10_expand_terms", "message", f"""
WITH {_ASKED}, s(term, syn, ord) AS (VALUES ('then', 'thus', 1), ('then', 'after', 2), ('the', 'this', 1), ('que', 'what', 1)), w AS (SELECT DISTINCT qid, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+')) AS term FROM q) SELECT qid, w.term, syn FROM w JOIN s ON w.term = s.term WHERE ord <= 3
""")
def expand_terms(message: DataFrame, synonyms=SYNONYMS, most: int = 3) -> DataFrame:
    """Synonyms of each question's terms, so many for each; the rules are a fixed small table."""
    s = message.sparkSession.createDataFrame([x for x in synonyms if x[2] <= most], "term string, syn string, ord int")
    return questions(message).select("qid", F.explode(F.array_distinct(words("text"))).alias("term")).join(F.broadcast(s), "term").select("qid", "term", "syn")


@query("c11_decompose_query", "message", f"""
WITH {_ASKED}, p AS (SELECT qid, list_slice(CASE WHEN contains(text, '. ') THEN string_split(text, '. ') WHEN contains(text, ', ') THEN string_split(text, ', ') ELSE [text] END, 1, 5) AS parts FROM q) SELECT qid, i::BIGINT AS position, parts[i] AS part FROM (SELECT qid, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)
""", connectives=[". ", ", "])
def decompose_query(message: DataFrame, connectives: list[str], most: int = 5) -> DataFrame:
    """Questions cut at the first connective found."""
    parts = F.array("text")
    for c in reversed(connectives):
        parts = F.when(F.contains("text", F.lit(c)), F.split("text", "\\Q" + c + "\\E")).otherwise(parts)
    return questions(message).select("qid", F.posexplode(F.slice(parts, 1, most)).alias("i", "part")).select("qid", (F.col("i") + 1).cast("long").alias("position"), "part")


@query("c12_suggest_terms", "memory", """
WITH v AS (SELECT DISTINCT unnest(tags) AS tag FROM memory), q(q) AS (VALUES ('src1'), ('fre')), s AS (SELECT q, tag, CASE WHEN contains(tag, q) OR contains(q, tag) THEN 1.0 ELSE len(list_intersect(list_distinct(string_split(q, '')), list_distinct(string_split(tag, ''))))::DOUBLE / len(list_distinct(string_split(q, ''))) END AS s FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, tag) AS rn FROM s WHERE s > 0.5) SELECT q, tag, round(s, 6) AS score FROM r WHERE rn <= 3
""", asked=["src1", "fre"])
def suggest_terms(memory: DataFrame, asked: list[str], k: int = 3) -> DataFrame:
    """Tags that contain a word, lie in it or share over half its characters."""
    v = memory.select(F.explode("tags").alias("tag")).distinct().select("tag", F.explode(F.array(*map(F.lit, asked))).alias("q"))
    chars = [F.filter(F.array_distinct(F.split(c, "")), lambda x: x != "") for c in ("q", "tag")]
    s = F.when(F.contains("tag", F.col("q")) | F.contains("q", F.col("tag")), 1.0).otherwise(F.size(F.array_intersect(*chars)) / F.size(chars[0]))
    rn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "tag"))
    return v.withColumn("s", s).where("s > 0.5").withColumn("rn", rn).where(F.col("rn") <= k).select("q", "tag", r6("s").alias("score"))


@query("c13_snippet", "memory", """
SELECT id, (CASE WHEN p > 51 THEN '...' ELSE '' END) || replace(substr(content, greatest(1, p - 50)::INT, 156), 'thened', '**thened**') || (CASE WHEN p + 106 <= length(content) THEN '...' ELSE '' END) AS snippet FROM (SELECT id, content, strpos(content, 'thened') AS p FROM memory) WHERE p > 0
""", word="thened")
def snippet(memory: DataFrame, word: str, around: int = 50) -> DataFrame:
    """Text round the first hit with the word in bold and ellipses where it is cut."""
    p = F.instr("content", word)
    m = memory.select("id", "content", p.alias("p")).where("p > 0")
    size = 3 * around + len(word)
    cut = F.replace(F.substr("content", F.greatest(F.lit(1), F.col("p") - around), F.lit(size)), F.lit(word), F.lit(f"**{word}**"))
    return m.select("id", F.concat(F.when(F.col("p") > around + 1, "...").otherwise(""), cut, F.when(F.col("p") - around + size <= F.length("content"), "...").otherwise("")).alias("snippet"))


INTENTS = [("learn", ["learn", "学习", "thened"]), ("plan", ["plan", "计划", "inth"]), ("fix", ["fix", "修复", "eron"])]


@query("c14_intent_of_activity", "memory", """
WITH r AS (SELECT author, lower(content) AS c FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created_at DESC, id) AS rn FROM memory) WHERE rn <= 20),
h AS (SELECT author, sum(contains(c, 'learn')::INT + contains(c, '学习')::INT + contains(c, 'thened')::INT) AS a, sum(contains(c, 'plan')::INT + contains(c, '计划')::INT + contains(c, 'inth')::INT) AS b, sum(contains(c, 'fix')::INT + contains(c, '修复')::INT + contains(c, 'eron')::INT) AS d FROM r GROUP BY author)
SELECT author, CASE WHEN greatest(a, b, d) = 0 THEN 'none' WHEN a = greatest(a, b, d) THEN 'learn' WHEN b = greatest(a, b, d) THEN 'plan' ELSE 'fix' END AS intent, round(least(0.9, 0.3 + 0.1 * greatest(a, b, d))::DOUBLE, 6) AS confidence FROM h
""")
def intent_of_activity(memory: DataFrame, intents=INTENTS, last: int = 20) -> DataFrame:
    """Per author the intent with most keyword hits in the last records."""
    rn = F.row_number().over(Window.partitionBy("author").orderBy(F.desc("created_at"), "id"))
    r = memory.withColumn("rn", rn).where(F.col("rn") <= last)
    h = r.groupBy("author").agg(*[F.sum(hits(F.lower("content"), ws)).alias(name) for name, ws in intents])
    return h.select("author", best_of([(F.col(name), name) for name, _ in intents], "none").alias("intent"), r6(F.least(F.lit(0.9), 0.3 + 0.1 * F.greatest(*[name for name, _ in intents]))).alias("confidence"))
