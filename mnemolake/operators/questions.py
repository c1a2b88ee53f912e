"""Questions in plain language: what time, wing, importance and intent they name, and what each intent returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.columns import any_of, count, moment, r6, words
from mnemolake.operators.search import _BOOST, _INDEX, _TOK, boost, matches, query_table, substring_scores, top
from mnemolake.plans.registry import query
from mnemolake.plans.storage import materialize
from mnemolake.plans.views import AS_OF

# The first word of a list that a question holds decides.
TIMES = [("今天", 0), ("昨天", 1), ("前天", 2), ("上周", 7), ("本周", 0), ("最近", 7), ("today", 0), ("yesterday", 1), ("last week", 7), ("this week", 0), ("recently", 7)]
SPANS = [("天|days?", 1), ("周|weeks?", 7), ("个月|months?", 30)]
WINGS = [("技术", "tech"), ("代码", "tech"), ("开发", "tech"), ("工作", "work"), ("项目", "work"), ("个人", "personal"), ("生活", "personal"), ("学习", "learning"), ("知识", "learning")]
WEIGHTS = [("重要", 0.8), ("关键", 0.9), ("紧急", 0.9), ("必须", 0.8), ("决策", 0.7), ("决定", 0.7), ("important", 0.8), ("critical", 0.9), ("urgent", 0.9), ("decision", 0.7)]
INTENTS = [
    ("search", ["查找", "搜索", "找", "回忆", "记得", "看看", "find", "search", "recall"]),
    ("summary", ["总结", "概括", "归纳", "概述", "summar", "overview"]),
    ("analysis", ["分析", "统计", "多少条", "how many", "statistic"]),
    ("recommend", ["推荐", "建议", "应该", "需要", "recommend", "suggest"]),
    ("timeline", ["时间线", "什么时候", "何时", "哪天", "timeline", "which day"]),
    ("relation", ["关联", "相关", "联系", "关系", "related", "connection"]),
]
UNITS = [("天|days?", 1), ("周|weeks?", 7), ("个?月|months?", 30), ("年|years?", 365)]
DAYS = [("前天", -2), ("昨天", -1), ("今天", 0), ("明天", 1), ("day before yesterday", -2), ("yesterday", -1), ("today", 0), ("tomorrow", 1)]


def first_of(text: Column, rules: list[tuple[str, object]], default: Column) -> Column:
    """Value of the first rule whose word the text holds."""
    out = default
    for word, value in reversed(rules):
        out = F.when(F.contains(text, F.lit(word)), F.lit(value)).otherwise(out)
    return out


def _number(text: Column, pattern: str) -> Column:
    """The number before a unit; null if there is none or it has more than four digits."""
    return F.nullif(F.regexp_extract(text, f"(?:^|[^0-9])([0-9]{{1,4}}) ?(?:{pattern})", 1), F.lit("")).cast("int")


def named_day(text: Column, as_of: str = AS_OF) -> Column:
    """The date a text names, in this order: so many days, weeks (7), months (30) or years (365) ago or ahead; a day word; year-month-day with - or / or as in Chinese. Null if there is none, or no such day."""
    today, low = F.to_date(moment(as_of)), F.lower(text)
    pattern = "(?:^|[^0-9])([0-9]{1,4}) ?(天|周|个?月|年|days?|weeks?|months?|years?) ?(前|后|ago|ahead|later)"
    said = F.regexp_extract(low, pattern, 0)  # a text is searched once, its groups are taken from what was found
    many = F.nullif(F.regexp_extract(said, pattern, 1), F.lit("")).cast("int")
    unit, way = F.regexp_extract(said, pattern, 2), F.regexp_extract(said, pattern, 3)
    length = F.when(unit.rlike("^(天|day)"), 1).when(unit.rlike("^(周|week)"), 7).when(unit.rlike("(月|month)"), 30).otherwise(365)
    moved = F.date_add(today, F.when(way.isin("前", "ago"), -many * length).otherwise(many * length))
    word = first_of(low, DAYS, F.lit(None).cast("int"))
    ymd = "([0-9]{4})[年/-]([0-9]{1,2})[月/-]([0-9]{1,2})"
    written = F.regexp_extract(low, ymd, 0)
    parts = [F.lpad(F.regexp_extract(written, ymd, i), 4 if i == 1 else 2, "0") for i in (1, 2, 3)]
    day = F.when(written != "", F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))
    return F.when(many.isNotNull(), moved).when(word.isNotNull(), F.date_add(today, word)).otherwise(day)


def _case(column: str, rules, default: str) -> str:
    said = " ".join(f"WHEN contains({column}, '{w}') THEN {v!r}" for w, v in rules)
    return f"CASE {said} ELSE {default} END"


_YMD = "([0-9]{4})[年/-]([0-9]{1,2})[月/-]([0-9]{1,2})"
_MOVED = "(?:^|[^0-9])([0-9]{1,4}) ?(天|周|个?月|年|days?|weeks?|months?|years?) ?(前|后|ago|ahead|later)"


def _day_sql(low: str) -> str:
    u = f"regexp_extract({low}, '{_MOVED}', 2)"
    size = f"CASE WHEN regexp_matches({u}, '^(天|day)') THEN 1 WHEN regexp_matches({u}, '^(周|week)') THEN 7 WHEN regexp_matches({u}, '(月|month)') THEN 30 ELSE 365 END"
    way = f"CASE WHEN regexp_extract({low}, '{_MOVED}', 3) IN ('前', 'ago') THEN -1 ELSE 1 END"
    day = "try_cast(" + " || '-' || ".join(f"lpad(regexp_extract({low}, '{_YMD}', {i}), {4 if i == 1 else 2}, '0')" for i in (1, 2, 3)) + " AS DATE)"
    word = _case(low, DAYS, "NULL")
    return f"CASE WHEN regexp_matches({low}, '{_MOVED}') THEN CAST({{AS_OF}} AS DATE) + CAST(regexp_extract({low}, '{_MOVED}', 1) AS INT) * {way} * {size} WHEN ({word}) IS NOT NULL THEN CAST({{AS_OF}} AS DATE) + ({word}) WHEN regexp_matches({low}, '{_YMD}') THEN {day} END"


#: Ends put to user turns and records, whose invented words name no times: by number of characters.
TAILS = [" 3 weeks ago", " 2024/1/9", " 2 个月前 important", " tomorrow", " 2023-02-30 summary", " how many in english 最近", " 10 days ahead", "", " 1年后", " 12345 days ago", " critical french 5天", " 昨天 推荐", " which day last 2 weeks", " 2024年1月15"]
_TAIL = "[" + ", ".join(f"'{t}'" for t in TAILS) + f"][CAST(length(text) % {len(TAILS)} AS INT) + 1]"
_TURNS = f"q(qid, text) AS (SELECT concat(session_id, '-', turn), text || {_TAIL} FROM message WHERE role = 'user')"
_OWN_WINGS = [("english", "en"), ("french", "fr"), ("german", "de"), ("spanish", "es")]


def tailed(text: Column) -> Column:
    return F.concat(text, F.element_at(F.array(*map(F.lit, TAILS)), (F.length(text) % len(TAILS) + 1).cast("int")))


def turns(message: DataFrame) -> DataFrame:
    return message.where("role = 'user'").select(F.concat_ws("-", "session_id", "turn").alias("qid"), tailed(F.col("text")).alias("text"))


@query("c7_named_days", "message", f"WITH {_TURNS} SELECT qid, CAST({_day_sql('lower(text)')} AS VARCHAR) AS day FROM q")
def named_days(message: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """The date that each user turn names, in every form."""
    return turns(message).select("qid", named_day(F.col("text"), as_of).cast("string").alias("day"))


@query("c7_records_about", "memory", f"""
SELECT id, CAST(day AS VARCHAR) AS day FROM (SELECT id, {_day_sql('lower(text)')} AS day FROM (SELECT id, content || ' ' || {_TAIL.replace('text', 'content')} AS text FROM memory)) WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-31'
""", start="2024-01-05", end="2024-01-31")
def records_about(memory: DataFrame, start: str, end: str, as_of: str = AS_OF) -> DataFrame:
    """Records whose text names a day of a range, ends included."""
    text = F.concat("content", F.lit(" "), F.element_at(F.array(*map(F.lit, TAILS)), (F.length("content") % len(TAILS) + 1).cast("int")))
    # Written before the filter, which would search every text again for each of its ends.
    days = materialize(memory.select("id", named_day(text, as_of).alias("day")), "named-days")
    return days.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("id", F.col("day").cast("string").alias("day"))


def _without(column: str, gone: list[str]) -> str:
    for w in gone:
        column = f"replace({column}, '{w}', '')"
    return column


def _parsed_sql(wings) -> str:
    """Columns low, intent, days, wing, least and keywords over q(qid, text)."""
    spans = " ".join(f"WHEN regexp_matches(low, '(?:^|[^0-9])[0-9]{{1,4}} ?(?:{p})') THEN {n} * CAST(regexp_extract(low, '(?:^|[^0-9])([0-9]{{1,4}}) ?(?:{p})', 1) AS INT)" for p, n in SPANS)
    intents = " ".join("WHEN " + " OR ".join(f"contains(low, '{w}')" for w in ws) + f" THEN '{name}'" for name, ws in INTENTS)
    left = _without("low", [w for w, _ in TIMES] + [w for w, _ in wings])
    return f"""p AS (SELECT qid, text, CASE {intents} ELSE 'search' END AS intent, {_case('low', TIMES, f'CASE {spans} END')} AS days, {_case('low', wings, 'NULL')} AS wing, CAST({_case('low', WEIGHTS, '0.0')} AS DOUBLE) AS least,
  array_to_string(list_filter(regexp_split_to_array({left}, '[ \\t\\n\\r\\f]+'), lambda x: length(x) > 1), ' ') AS keywords FROM (SELECT *, lower(text) AS low FROM q))"""


def parsed(questions: DataFrame, wings: list[tuple[str, str]] = WINGS) -> DataFrame:
    """qid, text and what the text names: intent, days back (or null), wing (or null), least importance as a share of the highest, and keywords.

    Keywords are what is left without the words of times and wings, one-character words dropped, lower-cased, in order.
    A null text has no keywords and the intent search.
    """
    low = F.lower("text")
    back = F.coalesce(*[_number(low, pattern) * length for pattern, length in SPANS])
    intent = F.lit("search")
    for name, said in reversed(INTENTS):
        intent = F.when(any_of(low, said), name).otherwise(intent)
    left = low
    for w in [w for w, _ in TIMES] + [w for w, _ in wings]:
        left = F.replace(left, F.lit(w), F.lit(""))
    keywords = F.array_join(F.filter(words(left), lambda x: F.length(x) > 1), " ")
    wing = first_of(low, wings, F.lit(None).cast("string"))
    return questions.select("qid", "text", intent.alias("intent"), first_of(low, TIMES, back).alias("days"), wing.alias("wing"), first_of(low, WEIGHTS, F.lit(0.0)).alias("least"), keywords.alias("keywords"))


@query("c8_parsed_questions", "message", f"WITH {_TURNS}, {_parsed_sql(_OWN_WINGS)} SELECT qid, intent, days, wing, least, keywords FROM p", wings=_OWN_WINGS)
def parse_turns(message: DataFrame, wings: list[tuple[str, str]] = WINGS) -> DataFrame:
    """Every user turn with its time window, wing, importance, keywords and intent."""
    return parsed(turns(message), wings).drop("text")


ASKED = [
    ("a1", "find thened heention important"),
    ("a2", "summarize english"),
    ("a3", "how many french"),
    ("a4", "timeline of the last 3 days"),
    ("a5", "recommend inthat anthe english"),
    ("a6", "search zzzz nothing"),
    ("a7", "hened"),
    ("a8", "when was eronthwh decision german"),
    ("a9", "which day"),
]
_ASKED = "q(qid, text) AS (VALUES " + ", ".join(f"('{q}', '{t}')" for q, t in ASKED) + ")"


@query("c9_answers", "memory", f"""
WITH {_ASKED}, {_parsed_sql(_OWN_WINGS)}, {_INDEX}, s AS (SELECT qid, coalesce(nullif(keywords, ''), text) AS text, wing, least FROM p WHERE intent NOT IN ('summary', 'analysis', 'timeline')),
qt AS (SELECT qid, wing, least, unnest({_TOK.format('text')}) AS tok FROM s),
f AS (SELECT qid, m.id, count(*) AS n FROM qt JOIN ix USING (tok) JOIN memory m ON m.id = ix.id WHERE (qt.wing IS NULL OR qt.wing = m.wing) AND m.importance >= 5 * qt.least GROUP BY 1, 2),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, id) AS rk FROM f) WHERE rk <= 10),
b AS (SELECT qid, t.id, (1.0 / (60 + rk))::DOUBLE AS score, (1.0 / (60 + rk) + {_BOOST})::DOUBLE AS o FROM t JOIN memory m ON m.id = t.id),
u AS (SELECT qid, id, CASE WHEN contains(lower(content), text) THEN 0.8 ELSE 0 END + 0.2 * len(list_filter(tags, lambda x: contains(lower(x), text))) AS s, m.wing, importance, s.wing AS w, least FROM (SELECT * FROM s WHERE qid NOT IN (SELECT qid FROM f)) s, memory m),
o AS (SELECT qid, 'record' AS kind, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(o, 9) DESC, id) AS rk FROM b
  UNION ALL SELECT qid, 'record', id, s::DOUBLE, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) FROM u WHERE s > 0 AND (w IS NULL OR w = wing) AND importance >= 5 * least
  UNION ALL SELECT qid, 'record', id, importance, row_number() OVER (PARTITION BY qid ORDER BY importance DESC, id) FROM p JOIN memory m ON intent = 'summary' AND (p.wing IS NULL OR p.wing = m.wing)
  UNION ALL SELECT qid, 'record', id, importance, row_number() OVER (PARTITION BY qid ORDER BY created_at DESC, id) FROM p JOIN memory m ON intent = 'timeline' AND (days IS NULL OR created_at >= {{AS_OF}} - to_days(days)))
SELECT qid, kind, id, round(score, 8) AS score, rk FROM o WHERE rk <= 10
UNION ALL SELECT qid, k, v, n, NULL FROM p, (SELECT 'wing' AS k, wing AS v, count(*)::DOUBLE AS n FROM memory GROUP BY wing UNION ALL SELECT 'room', room, count(*)::DOUBLE FROM memory GROUP BY room UNION ALL SELECT 'records', NULL, count(*)::DOUBLE FROM memory UNION ALL SELECT 'mean importance', NULL, round(coalesce(avg(importance), 0), 6) FROM memory) WHERE intent = 'analysis'
""", wings=_OWN_WINGS)
def answers(memory: DataFrame, asked: list[tuple[str, str]] = ASKED, wings: list[tuple[str, str]] = WINGS, k: int = 10, highest: float = 5.0, as_of: str = AS_OF) -> DataFrame:
    """What each of a stated list of questions returns, by its intent: qid, kind, id, score and rk.

    summary: the k most important records of the wing. timeline: the k latest of the window. analysis: numbers of
    records, by wing and room, and mean importance (kind names which, id the value). All else: the k best by tokens
    within wing and importance, in recall's order, or by the keywords as a substring where no token hits.
    Ties go to the smaller id. The parsed list is broadcast; each branch is one pass over the records.
    """
    p = parsed(query_table(memory, asked), wings)
    s = p.where(~F.col("intent").isin("summary", "analysis", "timeline")).select("qid", F.coalesce(F.nullif("keywords", F.lit("")), "text").alias("text"), F.col("wing").alias("in_wing"), "least")
    within = (F.col("in_wing").isNull() | (F.col("in_wing") == F.col("wing"))) & (F.col("importance") >= highest * F.col("least"))
    terms = F.broadcast(s.select("qid", "in_wing", "least"))
    hit = matches(memory, s.select("qid", "text"), "wing", "importance").join(terms, "qid").where(within)
    found = top(hit.groupBy("qid", "id").agg(count().alias("n")), "n", k, "qid").select("qid", "id", (1.0 / (60 + F.col("rk"))).alias("score"))
    by_token = found.join(memory.select("id", "importance", "tags", "created_at"), "id").withColumn("o", F.round(F.col("score") + boost(as_of), 9))
    by_token = top(by_token, "o", k, "qid").select("qid", "id", "score", "rk")
    missed = s.join(F.broadcast(by_token.select("qid").distinct()), "qid", "left_anti")
    facts = F.broadcast(missed.select("qid", "in_wing", "least"))
    by_part = top(substring_scores(memory, missed).join(facts, "qid").where(within), "s", k, "qid").select("qid", "id", F.col("s").alias("score"), "rk")
    other = F.broadcast(p.select("qid", "intent", "days", F.col("wing").alias("in_wing")))
    m = memory.select("id", "wing", "importance", "created_at")
    summary = m.join(other, (F.col("intent") == "summary") & (F.col("in_wing").isNull() | (F.col("in_wing") == F.col("wing"))))
    summary = top(summary, "importance", k, "qid").select("qid", "id", F.col("importance").alias("score"), "rk")
    since = moment(as_of) - F.make_dt_interval(days=F.col("days"))
    timeline = m.join(other, (F.col("intent") == "timeline") & (F.col("days").isNull() | (F.col("created_at") >= since)))
    timeline = top(timeline, "created_at", k, "qid").select("qid", "id", F.col("importance").alias("score"), "rk")
    records = by_token.unionByName(by_part).unionByName(summary).unionByName(timeline).select("qid", F.lit("record").alias("kind"), "id", r6("score", 8).alias("score"), "rk")
    return records.unionByName(_numbers(memory, p))


def _numbers(memory: DataFrame, p: DataFrame) -> DataFrame:
    """Rows of the analysis intent: counts by wing and room come from one grouping, since there are few pairs of them."""
    pairs = memory.groupBy("wing", "room").agg(count().alias("n"), F.sum("importance").alias("i"))
    by = pairs.select("n", F.explode(F.array(F.struct(F.lit("wing").alias("kind"), F.col("wing").alias("id")), F.struct(F.lit("room").alias("kind"), F.col("room").alias("id")))).alias("x"))
    by = by.groupBy("x.kind", "x.id").agg(F.sum("n").cast("double").alias("score"))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("i"), F.lit(0.0)).alias("i"))
    mean = F.when(F.col("n") > 0, r6(F.col("i") / F.col("n"))).otherwise(0.0)
    one = total.select(F.explode(F.array(F.struct(F.lit("records").alias("kind"), F.col("n").alias("score")), F.struct(F.lit("mean importance").alias("kind"), mean.alias("score")))).alias("x")).select("x.kind", F.lit(None).cast("string").alias("id"), "x.score")
    asked = F.broadcast(p.where("intent = 'analysis'").select("qid"))  # of a stated list
    return by.unionByName(one).crossJoin(asked).select("qid", "kind", "id", "score", F.lit(None).cast("long").alias("rk"))
