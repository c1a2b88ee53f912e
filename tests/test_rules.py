"""Values worked out by hand, and edge cases, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.operators import conflict, graph, ingest, logs, similarity
from mnemolake.operators.components import connected_components
from mnemolake.operators.search import vector_top
from mnemolake.plans import views
from mnemolake.sources import files

MEMORY = "id string, content string, wing string, room string, hall string, importance double, emotional_weight double, tags array<string>, author string, created_at string"


def memory(spark, texts):
    rows = [(str(i), t, "w", "r", "hall_facts", 3.0, 0.0, ["a", "b"], "x", "2024-01-0%d 00:00:00" % (i % 9 + 1)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, MEMORY).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@pytest.mark.parametrize(
    ("text", "level", "wanted"),
    [
        ("mail a.b@c.org now", "standard", "mail [EMAIL] now"),
        ("<script>x\ny</script>ok", "standard", "[SCRIPT_REMOVED]ok"),
        ("at 10.0.0.1", "standard", "at 10.0.0.1"),
        ("at 10.0.0.1", "strict", "at [IP]"),
        ("call 13800138000", "standard", "call [PHONE]"),
        ("https://x.y/?token=abc", "minimal", "[URL_WITH_CREDENTIAL]"),
        ("a@b.cd", "minimal", "a@b.cd"),
        ("12345678901234567X", "standard", "[ID_CARD]"),
        (None, "strict", None),
        ("", "strict", ""),
    ],
)
def test_redaction(spark, text, level, wanted):
    df = spark.createDataFrame([(text,)], "content string")
    assert ingest.redacted(df, "content", level).first()["content"] == wanted


def test_components_join_chains_and_cycles(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("y", "x"), ("z", "z"), (None, "a")]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "p string, q string"), "p", "q").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    assert connected_components(spark.createDataFrame([], "p string, q string"), "p", "q").count() == 0


def test_long_chain_is_one_component(spark):
    n = 60
    got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(n)], "p long, q long"), "p", "q")
    assert {(r["node"], r["component"]) for r in got.collect()} == {(i, 0) for i in range(n + 1)}


def test_jaccard_pairs_match_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.choice(12, rng.integers(0, 9), replace=False)) for _ in range(60)]
    m = memory(spark, texts)
    sets = {str(i): frozenset(t.split()) for i, t in enumerate(texts) if t}
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i], i)
    names = sorted(reps.values())
    wanted = {(a, b) for a in names for b in names if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    got = similarity.jaccard_pairs(m, F.filter(F.split("content", " "), lambda x: x != ""), 0.5)
    assert {(r["a"], r["b"]) for r in got.collect()} == wanted and wanted


def test_char3_duplicates(spark):
    m = memory(spark, ["abcdefghij" * 4, "abcdefghij" * 4 + "k", "zzz", "", None, "ab"])
    assert [(r["a"], r["b"]) for r in similarity.dup_char3(m, 0.8).collect()] == [("0", "1")]


def test_vector_pairs_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(8, 12))
    v = np.repeat(base, 5, 0) + 0.2 * rng.normal(size=(40, 12))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    names = [f"{i:02d}" for i in range(40)]
    wanted = {(names[i], names[j]) for i in range(40) for j in range(i + 1, 40) if s[i, j] >= 0.9}
    df = spark.createDataFrame([(n, [float(x) for x in r]) for n, r in zip(names, v, strict=True)], "id string, v array<double>")
    assert {(r["a"], r["b"]) for r in similarity.vector_pairs(df, 0.9).collect()} == wanted and wanted


def test_approximate_search_recall(spark, sf):
    from mnemolake.operators.search import vector_topk, vector_topk_approx

    v = views.view(spark, sf, "vector")
    ids = [str(i) for i in range(0, 500, 50)]
    exact = {(r["qid"], r["id"]) for r in vector_topk(v, ids).collect()}
    found = {(r["qid"], r["id"]) for r in vector_topk_approx(v, ids, n_cells=8, probe=7).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_vector_top_ignores_short_vectors_and_empty_queries(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0]), ("c", [0.0, 0.0])], "id string, v array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, qv array<double>")
    assert [r["id"] for r in vector_top(v, q, 5, 0.1).collect()] == ["a"]
    assert vector_top(v, q.limit(0), 5, 0.1).count() == 0


def test_conflicts_with_default_words(spark):
    m = memory(spark, ["deploy service success today", "deploy service fail today", "other words here"])
    got = conflict.conflict_pairs(m).collect()
    assert [(r["a"], r["b"], r["shared"]) for r in got] == [("0", "1", 3)]


def test_shortest_path_and_cycle(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c")]
    rel = spark.createDataFrame([(f"{s}{o}", s, "p", o, 0.5) for s, o in e], "id string, subject_id string, predicate string, object_id string, confidence double")
    got = graph.shortest_path(rel, ["a"], ["c"]).collect()
    assert [(r["steps"], r["path"]) for r in got] == [(2, "a>b>c")]


def test_privacy_budget_refuses(spark):
    budget = logs.PrivacyBudget(0.5)
    logs.dp_histogram(memory(spark, ["x"]), budget, 0.5)
    with pytest.raises(ValueError, match="exhausted"):
        logs.dp_histogram(memory(spark, ["x"]), budget, 0.1)


def test_laplace_noise_is_centred(spark):
    x = spark.range(20000).select(logs.laplace(2.0, 3).alias("x")).agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    assert abs(x["m"]) < 0.1 and abs(x["s"] - 2.0 * 2**0.5) < 0.15


def test_markdown_and_chat_shapes(spark):
    text = "intro\n## one\n### first\nbody\n\nmore\n## two\n### second"
    got = files.markdown_records(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("position").collect()
    assert [(r["wing"], r["title"], r["body"]) for r in got] == [("one", "first", "body\nmore"), ("two", "second", "")]
    lines = ['{"role": "user", "content": "hi"}', '{"messages": [{"role": "assistant", "content": "yes"}]}', '{"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "toolCall", "name": "t"}]}}', "{broken", ""]
    got = files.read_chat_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((r["role"], r["text"]) for r in got) == [("assistant", "yes"), ("user", "a t"), ("user", "hi")]


def test_json_array_with_missing_fields(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"id": "1", "content": "x"}, {"id": "2", "content": null, "importance": 4, "created_at": "never"}]')
    got = {r["id"]: r for r in files.read_memories(spark, str(tmp_path)).collect()}
    assert got["1"]["importance"] == 3.0 and got["1"]["tags"] == [] and got["2"]["created_at"] is None


def test_scan_files_skips_hidden(spark, tmp_path):
    for name in ("a.md", "b.PNG", ".git/c.md", "node_modules/d.js", "e"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text("x")
    got = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "text", "b.PNG": "image", "e": "other"}


def test_line_diff_counts(spark):
    df = spark.createDataFrame([("a\nb\nc", "a\nx"), ("", "")], "a string, b string")
    got = [tuple(r["d"]) for r in df.select(conflict.line_diff("a", "b").alias("d")).collect()]
    assert got == [(0, 1, 1, 1), (0, 0, 0, 1)]
