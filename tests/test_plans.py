"""Whole runs around recorded providers: extraction to a graph, an evaluation over the whole corpus."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from passagework.operators import chunking, evaluation, graph
from passagework.plans import answer, extraction, provider
from passagework.settings import shared_folder, text_setting


def test_extraction_to_a_graph(spark):
    texts = spark.createDataFrame([("a", "u", "Ann works at Acme"), ("b", "u", "busy"), ("c", "v", "Bob")], "document_id string, user_id string, text string")
    reply = {"entities": [{"name": "Ann", "type": "Person"}, {"name": "Acme", "type": "Organization"}], "relationships": [{"source": "Ann", "target": "Acme", "type": "WORKS_AT"}, {"source": "Ann", "target": "Who", "type": "WORKS_AT"}]}

    def call(prompt, text, seconds):
        if text == "busy":
            return provider.Reply(429)
        return provider.Reply(200, json.dumps(reply if text.startswith("Ann") else {"entities": [{"name": "Bob", "type": "Person"}], "relationships": []}))

    found = extraction.extracted(texts, call, sleep=lambda s: None).persist()
    assert {r.document_id: (r.stage, r.message) for r in found.collect()} == {"a": (None, None), "b": ("extraction", "status 429"), "c": (None, None)}
    nodes, edges = extraction.graph_rows(found)
    assert {(r.user_id, r.type, r.name) for r in nodes.collect()} == {("u", "Person", "Ann"), ("u", "Organization", "Acme"), ("v", "Person", "Bob")}
    assert [(r.src_name, r.rel_type, r.dst_name) for r in edges.collect()] == [("Ann", "WORKS_AT", "Acme")]
    assert graph.upsert(nodes, nodes, graph.NODE).count() == nodes.count()
    documents = spark.createDataFrame([("a", "u", "Ready", "one two"), ("b", "u", "Failed", "x"), ("c", "v", "Ready", "three")], "id string, user_id string, status string, text string")
    passages = chunking.chunks(documents, "id", chunking.whole_chapter(F.col("text")))
    assert {tuple(r) for r in extraction.rebuild_texts(documents, passages).select("document_id", "user_id", "text").collect()} == {("a", "u", "one two"), ("c", "v", "three")}


def test_evaluation_over_the_whole_corpus(spark):
    passages = spark.createDataFrame([(1, "d1", "C", 0, "blue sky", [1.0, 0.0], "u"), (2, "d2", "C", 0, "green grass", [0.0, 1.0], "u")], "passage_id int, document_id string, chapter string, chunk_index int, text string, embedding array<float>, user_id string")
    documents = spark.createDataFrame([("d1", "a.md", "u"), ("d2", "b.md", "u")], "document_id string, filename string, user_id string")
    asked = spark.createDataFrame(
        [(1, "factual", "sky?", ["blue"], "all", [1.0, 0.0], "u"), (2, "factual", "grass?", ["red"], "all", [0.0, 1.0], "u"), (3, "factual", "down?", ["x"], "all", [1.0, 0.0], "u"), (4, "unanswerable", "mars?", [], "all", [-1.0, -1.0], "u")],
        "query_id int, category string, question string, must_contain array<string>, match string, embedding array<float>, user_id string",
    )
    scoped, lists = evaluation.over_whole_corpus(asked, documents)
    assert sorted(map(tuple, lists.collect())) == [(q, d) for q in (1, 2, 3, 4) for d in ("d1", "d2")]

    def call(prompt, question, seconds):
        if question == "down?":
            return provider.Reply(401)
        text = "Blue." if question == "sky?" else "Green."
        return provider.Reply(200, json.dumps({"segments": [{"text": text, "passage_numbers": [1]}]}))

    done = answer.answered(scoped, passages, documents.select("document_id", "filename"), call, ["user_id"], lists=lists)
    row = evaluation.metrics(evaluation.classified(evaluation.results(asked, done))).first()
    assert (row.answerable, row.correct, row.errors, row.unanswerable, row.refused, row.accuracy) == (2, 1, 1, 1, 1, "50.0%")


def test_fixtures(spark):
    rows = spark.createDataFrame([("created", "Uploaded"), ("reingested", "Uploaded"), ("duplicate", "Ready"), ("duplicate", "Graphing")], "outcome string, status string")
    act = evaluation.fixture_action(F.col("outcome"), F.col("status"))
    assert [r[0] for r in rows.select(act).collect()] == ["ingest", "ingest", "reuse", "poll_or_abort"]
    with pytest.raises(Exception, match="no such outcome"):
        rows.select(evaluation.fixture_action(F.lit("odd"), F.col("status"))).collect()
    status = spark.createDataFrame([("d1", 0, "Uploaded"), ("d1", 3, "Ready"), ("d2", 1, "Failed")], "document_id string, seq int, status string")
    fixtures = spark.createDataFrame([("a.md", "d1"), ("b.md", "d2"), ("c.md", "d3")], "filename string, document_id string")
    assert {r.filename for r in evaluation.not_ready(fixtures, status).collect()} == {"b.md", "c.md"}


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("PASSAGEWORK_X", "  value ")
    assert text_setting("PASSAGEWORK_X", "d") == "value"
    monkeypatch.setenv("PASSAGEWORK_X", "   ")
    assert text_setting("PASSAGEWORK_X", "d") == "d" and text_setting("PASSAGEWORK_NONE") is None
    assert shared_folder(spark)
