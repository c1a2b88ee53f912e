"""L6, A4 and B9: rows as before, and no text or token is dealt to a few tasks."""

import re
from collections import Counter

from pyspark.sql import functions as F

from mnemolake.operators import ingest
from mnemolake.plans import registry, views
from mnemolake.sources import files
from mnemolake.streaming import streams


def test_thresholds_count_the_same_batches_from_ids_only(spark, sf, monkeypatch):
    seen, as_stream = [], streams.as_stream
    monkeypatch.setattr(streams, "as_stream", lambda df, n: seen.append(df.columns) or as_stream(df, n))
    m = views.view(spark, sf, "memory")
    got = Counter(r["records"] for r in streams.stream_thresholds(m).collect())
    assert got == Counter(r["n"] for r in m.groupBy(F.pmod(F.hash("id"), F.lit(4))).agg(F.count("*").alias("n")).collect())
    assert seen == [["id"]]


def test_markdown_files_are_dealt_by_a_broadcast(spark, sf):
    plan = files.markdown_round_trip(views.view(spark, sf, "memory"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_first_other_record_with_the_word(spark):
    rows = [("1", "Longword one here"), ("2", "longword two"), ("3", "LONGWORD"), ("4", "another thing"), ("5", "nothing"), ("6", None), ("10", "the another longword x"), ("7", "x_longword1 longword")]
    m = spark.createDataFrame(rows, "id string, content string").withColumn("tags", F.array().cast("array<string>"))
    words = {i: set(re.findall("[a-z0-9_]{2,}", (t or "").lower())) for i, t in rows}
    wanted = set()
    for i, t in rows:
        found = re.search("([A-Za-z]{6,}) ([a-z]+)", t or "")
        others = [j for j in words if found and j != i and found[1].lower() in words[j]]
        if others:
            wanted.add((i, found[1].lower(), min(others)))
    df = ingest.resolve_wikilinks(m)
    assert {tuple(r) for r in df.collect()} == wanted and len(wanted) > 3
    plan = registry.QUERIES["b9_resolve_wikilinks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan


def test_document_counts_make_only_repeated_ids_distinct(spark):
    rows = [("1", ["a", "b"]), ("2", ["a"]), ("1", ["b", "c"]), (None, ["a"]), (None, ["a", "d"]), ("3", None), ("4", [])]
    index = spark.createDataFrame(rows, "id string, toks array<string>")
    held = {(i, t) for i, toks in rows for t in toks or []}
    assert {tuple(r) for r in streams.document_counts(index).collect()} == set(Counter(t for _, t in held).items())
    plan = streams.document_counts(index.where("id = '2' OR id = '4'"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_stream_index_is_counted_from_one_row_a_record(spark, sf, monkeypatch):
    seen, inner = [], streams.document_counts
    monkeypatch.setattr(streams, "document_counts", lambda index: seen.append(index.count()) or inner(index))
    m = views.view(spark, sf, "memory")
    streams.stream_index(m)
    assert seen == [m.count()]


def test_conflict_pairs_intersect_keywords_of_results_only(spark, sf):
    plan = registry.QUERIES["f1_conflict_pairs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" in plan and all("array_intersect" not in x for x in plan.splitlines() if "Join" in x or "Filter" in x)
