"""Positional overlap over texts of any length, and noisy answers."""

import pytest

from mnemolake.operators import ingest, logs
from mnemolake.plans import views


def overlaps_by_hand(rows, least=0.85, gap=5):
    first, out = {}, set()
    for i, wing, text in sorted(rows):
        if wing is not None and text:
            if (wing, text) in first:
                out.add((first[wing, text], i, 1.0))
            else:
                first[wing, text] = i
    reps = sorted((i, w, t) for (w, t), i in first.items())
    for k, (a, wa, x) in enumerate(reps):
        for b, wb, y in reps[k + 1 :]:
            if wa == wb and abs(len(x) - len(y)) <= gap:
                o = sum(p == q for p, q in zip(x, y, strict=False)) / max(len(x), len(y))
                if o > least:
                    out.add((a, b, round(o, 6)))
    return out


def test_positional_overlap_of_whole_texts(spark, sf):
    view = views.view(spark, sf, "memory").select("id", "wing", "content")
    rows = [tuple(r) for r in view.collect()]
    long = max(t for _, _, t in rows if len(t) > 500)
    rows += [("x1", "w", long), ("x2", "w", long), ("x3", "w", "#" + long[1:] + "end"), ("x4", "w", long[1:]), ("x5", "v", long), ("x6", None, long), ("x7", "w", None), ("x8", "w", ""), ("x9", "w", "\n" * 9 + "\U0001f600"), ("y1", "w", "\n" * 9 + "\U0001f601")]
    for i, cut in enumerate((0.1, 0.14, 0.16)):
        n = int(len(long) * cut)
        rows.append((f"z{i}", "w", "\x00" * n + long[n:]))
    df = spark.createDataFrame(rows, "id string, wing string, content string")
    got = {tuple(r) for r in ingest.positional_overlap_dup(df).collect()}
    wanted = overlaps_by_hand(rows)
    assert got == wanted and {("x1", "x2", 1.0), ("x9", "y1", 0.9)} <= wanted and any(a == "x1" and b == "z1" for a, b, _ in wanted)
    assert ingest.positional_overlap_dup(df.limit(0)).count() == 0


def test_noisy_answers(spark, sf):
    memory = views.view(spark, sf, "memory")
    true = memory.selectExpr("count(*) AS n", "avg(importance) AS m").first()
    budget = logs.PrivacyBudget(4e6)
    assert logs.dp_count(memory, budget, 1e6).first()["n"] == true["n"]
    assert abs(logs.dp_mean(memory, "importance", 0.0, 5.0, budget, 2e6).first()["mean"] - true["m"]) < 1e-3
    with pytest.raises(ValueError):
        logs.dp_count(memory, budget, 2e6)
    rough = [logs.dp_mean(memory, "importance", 0.0, 5.0, logs.PrivacyBudget(1), 0.1).first()["mean"] for _ in range(3)]
    assert len(set(rough)) > 1 and all(0 <= x <= 5 for x in rough)
    assert logs.dp_mean(memory.limit(0), "importance", 0.0, 5.0, logs.PrivacyBudget(1), 1).first()["mean"] >= 0
