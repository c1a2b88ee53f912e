"""Questions in plain language, and the composed search, on small tables with awkward rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import questions, search

MEMORY = "id string, content string, wing string, room string, importance double, tags array<string>, author string, created_at timestamp_ntz"
AT = datetime(2024, 1, 31)
AS_OF = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def memory(spark):
    rows = [
        ("1", "Alpha beta", "tech", "r", 5.0, ["x"], "a", AT),
        ("2", "alpha", "work", "r", 1.0, ["alpha"], "a", AT),
        ("3", None, "tech", None, 4.0, None, None, None),
        ("4", "", "tech", "s", 4.5, [], "b", datetime(2024, 1, 1)),
        ("5", "gamma " * 50000 + "omega-point", "tech", "s", 4.5, ["x"], "b", AT),
    ]
    return spark.createDataFrame(rows, MEMORY)


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("3 days ago", date(2024, 1, 29)),
        ("2 Weeks later", date(2024, 2, 15)),
        ("1 month ago, and today", date(2024, 1, 2)),
        ("2年前", date(2022, 2, 1)),
        ("3个月后", date(2024, 5, 1)),
        ("前天", date(2024, 1, 30)),
        ("the day before yesterday", date(2024, 1, 30)),
        ("on 2024/1/9 or 2024-01-10", date(2024, 1, 9)),
        ("2024年2月29日", date(2024, 2, 29)),
        ("2023-02-29", None),
        ("123456 days ago", None),
        ("", None),
        (None, None),
    ],
)
def test_named_day(spark, text, day):
    row = spark.createDataFrame([(text,)], "text string").select(questions.named_day(F.col("text"), AS_OF).alias("d")).first()
    assert row["d"] == day


@pytest.mark.parametrize(
    ("text", "intent", "days", "wing", "least", "keywords"),
    [
        ("总结 最近 技术 决定", "summary", 7, "tech", 0.7, "总结 决定"),
        ("什么时候 3个月 x 工作", "timeline", 90, "work", 0.0, "什么时候 3个月"),
        ("Find URGENT notes last week", "search", 7, None, 0.9, "find urgent notes"),
        ("how many 2 weeks", "analysis", 14, None, 0.0, "how many weeks"),
        ("", "search", None, None, 0.0, ""),
    ],
)
def test_parsed(spark, text, intent, days, wing, least, keywords):
    row = questions.parsed(search.query_table(spark.range(1), [("q", text)])).first()
    assert (row["intent"], row["days"], row["wing"], row["least"], row["keywords"]) == (intent, days, wing, least, keywords)


def found(df):
    return {(r["qid"], r["kind"], r["id"]): r["rk"] for r in df.collect()}


def test_answers_by_intent(memory):
    asked = [("s", "总结 技术"), ("t", "timeline last 3 days"), ("n", "how many"), ("f", "find alpha important"), ("p", "mega-poin"), ("none", "zz 找")]
    rows = found(questions.answers(memory, asked, k=3, as_of=AS_OF))
    assert {i: k for (q, _, i), k in rows.items() if q == "s"} == {"1": 1, "4": 2, "5": 3}
    assert {i for q, _, i in rows if q == "t"} == {"1", "2", "5"}
    assert {(kind, i) for q, kind, i in rows if q == "n"} == {("wing", "tech"), ("wing", "work"), ("room", "r"), ("room", "s"), ("room", None), ("records", None), ("mean importance", None)}
    assert {i for q, _, i in rows if q == "f"} == {"1"}  # the other record is below .8 of 5
    assert {i for q, _, i in rows if q == "p"} == {"5"}  # the end of a long text
    assert not [1 for q, _, _ in rows if q == "none"]


def test_answers_of_no_records(memory):
    rows = questions.answers(memory.limit(0), [("s", "总结"), ("n", "统计"), ("f", "alpha")], as_of=AS_OF).collect()
    assert {(r["qid"], r["kind"], r["score"]) for r in rows} == {("n", "records", 0.0), ("n", "mean importance", 0.0)}


def test_substrings_only_where_no_token_hits(memory):
    rows = search.recall_or_substring(memory, [("q", "ALPHA"), ("p", "LPH"), ("n", "zzz")], as_of=AS_OF).collect()
    assert {(r["qid"], r["id"], r["rk"], r["found_by"]) for r in rows} == {("q", "1", 1, "tokens"), ("q", "2", 2, "tokens"), ("p", "2", 1, "substring"), ("p", "1", 2, "substring")}
    assert [r["id"] for r in search.recall_or_substring(memory, [("q", "alpha")], wing="work", as_of=AS_OF).collect()] == ["2"]


def test_hybrid_channels_and_facets(spark, memory):
    vector = spark.createDataFrame([("1", [1.0, 0.0]), ("4", [0.9, 0.1]), ("5", [0.0, 1.0]), ("3", None), ("2", [1.0, 0.0])], "id string, v array<float>")
    rows = {r["id"]: r for r in search.hybrid_by_tags(memory, vector, [("q", "alpha x1 x", "1"), ("n", "nothing here", None)], least=2.0).collect()}
    assert set(rows) == {"1", "4"}  # 2 is of too little importance, 5 is orthogonal, one-character words name no entity
    assert (rows["1"]["text_rank"], rows["1"]["vector_rank"], rows["1"]["graph_rank"]) == (1, 1, None)
    assert (rows["1"]["match_type"], rows["4"]["match_type"], rows["4"]["text_rank"]) == ("keyword", "semantic", None)
    assert rows["1"]["reasons"].startswith("words: alpha; tags: x; text rank 1, vector rank 1; ")
    assert search.hybrid_by_tags(memory.limit(0), vector, [("q", "alpha", "1")]).count() == 0


def test_hints(spark, memory):
    vector = spark.createDataFrame([("1", [1.0, 0.0])], "id string, v array<float>")
    rows = {r["qid"]: (r["n"], r["hints"]) for r in search.rewrite_hints(memory, vector, [("a", "alpha delta", None), ("b", "nothing", None)]).collect()}
    assert rows["a"][0] == 2 and rows["a"][1].startswith("synonyms of delta")
    assert rows["b"] == (0, "broader words; other spelling or synonyms")
