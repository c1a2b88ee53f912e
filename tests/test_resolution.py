"""Resolution by all policies and fused topics on small tables with awkward rows."""

from datetime import datetime

from mnemolake.operators import conflict, knowledge

MEMORY = "id string, content string, importance double, tags array<string>, created_at timestamp_ntz"
SAME = "the same twenty characters"


def memory(spark, rows):
    return spark.createDataFrame([(i, c, w, t, datetime(2024, 1, d)) for i, c, w, t, d in rows], MEMORY)


def test_policies(spark):
    m = memory(spark, [("1", SAME + " old", 5.0, ["b", "a"], 1), ("2", SAME + " new", 1.0, ["c", "a"], 9), ("3", SAME + " mid", 2.0, None, 5), ("4", "alone", 1.0, [], 1), ("5", None, 1.0, [], 1)])
    rows = {r["policy"]: r for r in conflict.resolve_pairs(m).collect()}
    assert {p: (r["kept"], r["review"]) for p, r in rows.items()} == {"last_write": ("2", False), "priority": ("1", False), "merge": (None, False), "manual": (None, True)}
    assert rows["merge"]["content"] == f"[merged] {SAME} new\n---\n{SAME} old" and rows["merge"]["tags"] == "a,b,c" and rows["merge"]["sources"] == "2,1"


def test_one_record_wins_both(spark):
    m = memory(spark, [("1", SAME, 5.0, None, 9), ("2", SAME, 1.0, ["x"], 1)])
    rows = {r["policy"]: (r["kept"], r["content"], r["review"]) for r in conflict.resolve_pairs(m).collect()}
    assert rows == {"last_write": ("1", SAME, False), "priority": ("1", SAME, False), "merge": ("1", SAME, False), "manual": ("1", None, False)}
    assert conflict.resolve_pairs(m.limit(0)).count() == 0


def test_fused_topics(spark):
    m = memory(spark, [("1", "Spark is good for joins. Short. Spark is good for joins.", 4.0, ["x"], 2), ("2", "spark was bad at this yesterday", 5.0, None, 1), ("3", None, 1.0, ["spark"], 3), ("4", "", 1.0, [], 3)])
    row, = knowledge.fused_topics(m, ["spark", "none"], [(["good"], ["bad"])]).collect()
    assert (row["topic"], row["n"], row["sources"], row["evolution"], row["earliest"], row["latest"]) == ("spark", 3, "2,1,3", "2,1,3", "2024-01-01", "2024-01-03")
    assert row["key_points"] == "spark was bad at this yesterday | Spark is good for joins."
    assert row["keywords"].split(",")[:3] == ["for", "good", "joins"] and "spark" not in row["keywords"].split(",")
    assert row["contradictory"] and (row["claims"], row["denials"]) == (1, 1)
