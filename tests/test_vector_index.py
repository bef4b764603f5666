"""The index against exact search: recall, exact mode, narrow scopes, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.operators import retrieval, vector_index


def rows(df):
    return sorted((r.query_id, r["rank"], r.passage_id, r.distance) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    made = [(i, [float(x) for x in centres[i % 12] + 0.4 * rng.normal(size=16)], "ab"[i % 2], f"d{i % 30}") for i in range(1500)]
    made += [(2000, None, "a", "d0"), (2001, [0.0] * 16, "a", "d0"), (2002, [1.0, 2.0], "a", "d0"), (2003, [float("nan")] * 16, "b", "d0"), (2004, made[0][1], "a", "d0"), (2005, made[0][1], None, "d0")]
    return spark.createDataFrame(made, "passage_id int, embedding array<float>, user_id string, document_id string").persist()


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return vector_index.build(vectors, str(tmp_path_factory.mktemp("index") / "lists"), lists=12)


def questions(vectors, which="passage_id % 40 = 0"):
    return vectors.where(which).select(F.col("passage_id").alias("query_id"), "embedding", "user_id")


def test_recall_of_clustered_vectors_needs_few_lists(vectors, index):
    exact = retrieval.nearest(questions(vectors), vectors, ["user_id"]).persist()
    assert index.probes <= 4 and len(index.centroids) == 12
    assert vector_index.recall(vector_index.search(index, questions(vectors), ["user_id"]), exact) >= 0.9


def test_recall_of_the_given_vectors(spark, sf_dir, tmp_path):
    given = spark.read.parquet(f"{sf_dir}/../sf0.01/embeddings.parquet").select(F.col("vec_id").alias("passage_id"), "embedding", "label")
    asked = given.where("passage_id % 10 = 0").select(F.col("passage_id").alias("query_id"), "embedding", "label")
    built = vector_index.build(given, str(tmp_path / "lists"))
    assert vector_index.recall(vector_index.search(built, asked, []), retrieval.nearest(asked, given, [])) >= 0.9


def test_exact_mode_gives_the_exact_rows(vectors, index):
    asked = questions(vectors, "passage_id % 25 = 0 or passage_id > 1999")
    assert rows(vector_index.search(index, asked, ["user_id"], probes=1, exact=True)) == rows(retrieval.nearest(asked, vectors, ["user_id"]))


def test_a_narrow_scope_is_searched_whole(vectors, index):
    asked = questions(vectors).withColumn("document_ids", F.array(F.lit("d3"), F.lit("none")))
    got = vector_index.search(index, asked, ["user_id"], k=40, probes=1)
    assert rows(got) == rows(retrieval.nearest(asked, vectors, ["user_id"], k=40))


def test_every_row_is_in_one_list(vectors, index):
    assert index.rows.count() == vectors.count()
    odd = {r.passage_id for r in index.rows.where("_list = -1").collect()}
    assert odd == {2000, 2001, 2002, 2003}


def test_empty_tables(spark, vectors, tmp_path):
    none = vector_index.build(vectors.where("false"), str(tmp_path / "lists"))
    assert none.rows.count() == 0 and vector_index.search(none, questions(vectors), ["user_id"]).count() == 0
    assert retrieval.nearest(questions(vectors, "false"), vectors, ["user_id"]).count() == 0


def test_slices_do_not_change_the_rows(vectors, monkeypatch):
    want = rows(retrieval.nearest(questions(vectors), vectors, ["user_id"]))
    monkeypatch.setattr(retrieval, "SLICE_PASSAGES", 90)
    monkeypatch.setattr(retrieval, "SLICE_QUERIES", 7)
    assert rows(retrieval.nearest(questions(vectors), vectors, ["user_id"])) == want
    assert len({(q, p) for q, _, p, _ in want}) == len(want)


def test_a_question_moves_once_for_each_bundle_of_lists(vectors, index, monkeypatch):
    """An exact search of most lists makes a row for each bundle; slices hold no more cells than the bound."""
    rows_made, probed = [], vector_index._probed
    asked = questions(vectors, "passage_id % 25 = 0")
    monkeypatch.setattr(vector_index, "_probed", lambda *a: rows_made.append(probed(*a)) or rows_made[-1])
    found = vector_index.search(index, asked, [], probes=1, exact=True)
    assert rows(found) == rows(retrieval.nearest(asked, vectors, []))
    assert rows_made[-1].count() <= asked.count()
    monkeypatch.setattr(retrieval, "SLICE_PASSAGES", 300)
    assert rows(vector_index.search(index, asked, [], probes=1, exact=True)) == rows(found)
    assert rows_made[-1].agg(F.count_distinct("_bundle")).first()[0] > 1
    monkeypatch.setattr(vector_index, "CELLS", 50)
    assert vector_index._closest(np.eye(16), np.eye(16))[0].tolist() == list(range(16))
    assert max(len(range(1000)[x]) * 12 for x in vector_index._slices(1000, 12)) <= 50


def test_own_places_hold_only_what_is_asked():
    import pyarrow as pa

    found = retrieval._own_places(pa.chunked_array([pa.array([3, None, 9])]), pa.chunked_array([pa.array([1, 3, None, 3, 5])]))
    assert {k: v.tolist() for k, v in found.items()} == {"3": [1, 3]}


def test_distances_are_worked_out_in_blocks(vectors, monkeypatch):
    want = rows(retrieval.nearest(questions(vectors), vectors, ["user_id"]))
    monkeypatch.setattr(retrieval, "_CELLS", 2000)
    monkeypatch.setattr(retrieval, "_VECTORS", 7)
    assert rows(retrieval.nearest(questions(vectors), vectors, ["user_id"])) == want
