"""Language ID, line dedup, licence scan and the pipeline: SQL, held-out accuracy and edge cases."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemolake.llm import language_id, license_scan, line_dedup
from mnemolake.llm.queries import ORACLES, QUERIES
from tests.harness import differences
from tests.llm.test_exact import components_by_hand, contaminated_by_hand, rows_of


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), ORACLES[name], sf) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_or_more_for_each_document(spark, sf, name):
    df = QUERIES[name](spark, sf)
    ids = {r[0] for r in df.select(df.columns[0]).collect()}
    if "doc_id" in df.columns:
        assert ids == {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}


def test_lines_by_site(spark):
    rows = [(i, "s", f"head\n own {i} \n\nhead") for i in range(10)] + [(20, "t", "head\nx"), (21, None, None), (22, "s", ""), (23, "s", " own 3 ")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, row int")
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(docs, 0.5, 5, counts=("n", "gone")).collect()}
    assert got[3]["text"] == " own 3 \n" and (got[3]["n"], got[3]["gone"]) == (4, 2)
    assert got[20]["text"] == "head\nx" and got[21]["text"] is None and got[22]["text"] == "" and got[23]["text"] == " own 3 " and got[3]["row"] == 1
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = [mit, "x. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", "LICENSED UNDER CC BY-NC 4.0!", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "software", "", None]
    got = [(r["licenses"], r["classes"], r["unmatched"]) for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[:4] == [(["MIT"], ["permissive"], []), (["Apache-2.0"], ["permissive"], []), (["CC-BY-NC-4.0"], ["noncommercial"], []), ([], [], ["mit-notice"])]
    assert got[4:] == [([], [], [])] * 3


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    got = language_id.identify(test.select("doc_id", "text", "lang"), language_id.fit(train))
    right = got.agg(F.avg((F.col("found.language") == F.col("lang")).cast("int")), F.avg(F.col("found.accepted").cast("int"))).first()
    assert right[0] >= 0.98 and right[1] >= 0.99


def test_language_evidence_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    rows = [(1, None, "fr", "a.fr"), (2, "123 456", "fr", None), (3, "", None, None), (4, "de la", "fr", "a.fr"), (5, "xqzj kvwq zzxj qqkw vvxz jjqk" * 20, None, None)]
    many = [(100 + i, "Que le de la et un éaux tion", "fr-FR", "a.fr") for i in range(20)]
    df = spark.createDataFrame([(*r, "keep") for r in rows + many], "doc_id long, text string, d string, h string, row string")
    got = {r["doc_id"]: r for r in language_id.identify(df, model, declared=F.col("d"), host=F.col("h")).collect()}
    assert [got[i]["found"]["language"] for i in (1, 2, 3)] == ["und"] * 3 and not got[1]["found"]["accepted"]
    assert got[4]["found"]["language"] == "fr" and got[100]["found"]["accepted"] and got[4]["row"] == "keep"
    assert got[5]["found"]["language"] == "und"
    assert language_id.identify(df.limit(0), model).count() == 0


def test_pipeline_against_brute_force(spark, sf):
    """Each stage on its own input, as plainly as can be."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = corpus_pipeline.language_id(spark, docs, sf)
    assert one.columns == docs.columns and one.count() >= 0.98 * docs.count()
    rows = one.collect()
    pages, holds = {}, {}
    for r in rows:
        pages[r["source"]] = pages.get(r["source"], 0) + 1
        for x in {x.strip(" ") for x in r["text"].split("\n")} - {""}:
            holds[r["source"], x] = holds.get((r["source"], x), 0) + 1
    gone = {k for k, n in holds.items() if n >= line_dedup.LEAST_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    want = [(r["doc_id"], "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" ")) not in gone)) for r in rows]
    two = corpus_pipeline.line_dedup(spark, one, sf)
    assert two.columns == docs.columns and rows_of(two, "doc_id", "text") == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())
    kept = {d for d, _, _, k in components_by_hand(want, 80) if k}  # the stage has no contract of its own, so it joins from 0.8 on
    three = corpus_pipeline.near_dedup(spark, two, sf)
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == kept
    left = [(d, t) for d, t in want if d in kept]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {d for d, n, hit, _ in contaminated_by_hand(left, items) if not (hit and 20 * hit >= n)}
    four = corpus_pipeline.decontamination(spark, three, sf)
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} == clean and clean
    five = corpus_pipeline.packing(spark, four, sf)
    assert {r["doc_id"] for r in five.collect()} == clean
    assert re.fullmatch("[a-z_]+", corpus_pipeline.STAGES[0][0])
