"""Scoped nearest passages with the relevance gate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import RELEVANT_DISTANCE, TOP_PASSAGES

#: Passages, and questions, of a scope that meet in one task.
SLICE_PASSAGES, SLICE_QUERIES = 100_000, 20_000
#: Distances that a task works out at a time, and vectors that it makes unit rows of at a time.
_CELLS, _VECTORS = 1 << 21, 1 << 13


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Vectors as unit rows; a row of NaN for a vector that is null, zero, of another size, or holds null or non-finite numbers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    out = np.full((len(vectors), size), np.nan)
    for at in range(0, len(vectors), _VECTORS):
        _unit_rows(vectors.slice(at, _VECTORS), size, out[at : at + _VECTORS])
    return out


def _unit_rows(vectors: pa.Array, size: int, out: np.ndarray) -> None:
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False).to_numpy(zero_copy_only=False))
    if size and len(fits):
        flat = vectors.take(pa.array(fits)).flatten()
        out[fits] = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(len(fits), size)
    with np.errstate(invalid="ignore", divide="ignore"):
        out /= np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    out[~np.isfinite(out).all(axis=1)] = np.nan


def _sizes(vectors: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()


def _own_places(questions: pa.ChunkedArray, passages: pa.ChunkedArray) -> dict[str, np.ndarray]:
    """Where the passages are that have a question's id, by that id as text; only ids of questions are held."""
    asked = questions.cast(pa.string()).combine_chunks().drop_null().unique()
    codes = pc.fill_null(pc.index_in(passages.cast(pa.string()).combine_chunks(), value_set=asked), -1).to_numpy()
    places = np.flatnonzero(codes >= 0)
    places = places[np.argsort(codes[places], kind="stable")]
    found, starts = np.unique(codes[places], return_index=True)
    return dict(zip(asked.take(pa.array(found)).to_pylist(), np.split(places, starts[1:]))) if len(found) else {}


def _best_of(k: int, exclude_self: bool, within: bool):
    """A group's questions with its passages: (query_id, passage_id, distance) of the ``k`` nearest of each."""

    def run(key: tuple, questions: pa.Table, passages: pa.Table) -> pa.Table:
        found_q, found_p, found_d = [], [], []
        if questions.num_rows and passages.num_rows:
            order = np.empty(passages.num_rows, np.int64)
            order[pc.sort_indices(passages.column("passage_id").combine_chunks()).to_numpy()] = np.arange(passages.num_rows)
            own = _own_places(questions.column("query_id"), passages.column("passage_id")) if exclude_self else {}
            if within:
                coded = passages.column("document_id").cast(pa.string()).combine_chunks().dictionary_encode()
                code_of = {d: i for i, d in enumerate(coded.dictionary.to_pylist())}
                codes = pc.fill_null(coded.indices, len(code_of)).to_numpy()
            sizes = _sizes(questions.column("_v"))
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                rows = matrix(passages.column("_v"), max(size, 0))
                asked = matrix(questions.column("_v").take(pa.array(mine)), max(size, 0))
                ids = questions.column("query_id").take(pa.array(mine)).cast(pa.string()).to_pylist()
                scopes = questions.column("document_ids").take(pa.array(mine)).to_pylist() if within else [None] * len(mine)
                step = max(1, _CELLS // len(rows))
                for at in range(0, len(mine), step):
                    with np.errstate(invalid="ignore"):
                        distance = asked[at : at + step] @ rows.T
                        np.subtract(1, distance, out=distance)
                        np.round(distance, 6, out=distance)
                        distance += 0.0  # no negative zero
                    distance[np.isnan(distance)] = np.inf  # no distance comes last
                    for j, d in enumerate(distance):
                        self_ = own.get(ids[at + j])
                        if scopes[at + j]:
                            allowed = np.zeros(len(code_of) + 1, bool)
                            allowed[[code_of[x] for x in map(str, scopes[at + j]) if x in code_of]] = True
                            may = np.flatnonzero(allowed[codes])
                            may = may if self_ is None else np.setdiff1d(may, self_)
                            if len(may) > k:
                                may = may[d[may] <= np.partition(d[may], k - 1)[k - 1]]
                        else:
                            if self_ is not None:
                                d[self_] = np.inf
                            may = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                            may = may if self_ is None else np.setdiff1d(may, self_)
                        best = may[np.lexsort((order[may], d[may]))[:k]]
                        found_q.extend([int(mine[at + j])] * len(best))
                        found_p.extend(best.tolist())
                        found_d.extend(d[best].tolist())
        d = np.array(found_d, float)
        return pa.table(
            {
                "query_id": questions.column("query_id").take(pa.array(found_q, pa.int64())),
                "passage_id": passages.column("passage_id").take(pa.array(found_p, pa.int64())),
                "distance": pa.array(d, mask=np.isinf(d)),
            }
        )

    return run


def _sliced(queries: DataFrame, passages: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_slice``: a group's passages and questions are dealt so that no slice has more than its bound of either, about."""

    def slices(rows: DataFrame, most: int, name: str) -> DataFrame:
        return rows.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name)).where(F.col(name) > 0)

    # one row a group that both sides have
    both = slices(queries, SLICE_QUERIES, "_nq").join(slices(passages, SLICE_PASSAGES, "_np"), groups) if groups else slices(queries, SLICE_QUERIES, "_nq").join(F.broadcast(slices(passages, SLICE_PASSAGES, "_np")))

    def dealt(rows: DataFrame, key: str, own: str, other: str, first: bool) -> DataFrame:
        joined = rows.join(both, groups) if groups else rows.join(F.broadcast(both))
        mine, theirs = F.pmod(F.xxhash64(key), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other).cast("long") - 1))
        joined = joined.withColumn("_a", mine).withColumn("_b", theirs)
        a, b = ("_a", "_b") if first else ("_b", "_a")
        group = F.to_json(F.struct(*groups)) if groups else F.lit("")
        return joined.withColumn("_slice", F.concat_ws("-", F.col(a).cast("string"), F.col(b).cast("string"), group)).drop("_a", "_b", "_nq", "_np", *groups)

    return dealt(queries, "query_id", "_nq", "_np", True), dealt(passages, "passage_id", "_np", "_nq", False)


def best(rows: DataFrame, k: int, *key: str) -> DataFrame:
    """The ``k`` rows of least distance of each key, with ``rank``; ties go to the lesser id, no distance comes last."""
    order = Window.partitionBy(*key).orderBy(F.col("distance").asc_nulls_last(), "passage_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def compared(queries: DataFrame, passages: DataFrame, groups: list[str], k: int, exclude_self: bool) -> DataFrame:
    """(query_id, passage_id, distance): at most ``k`` of each question and slice, for questions and passages of equal ``groups``.

    Both have ``_v``; a question is compared with the passages of its groups alone, in blocks of a matrix product.
    Null groups meet nothing.
    """
    within = "document_ids" in queries.columns
    for c in groups:
        queries, passages = queries.where(F.col(c).isNotNull()), passages.where(F.col(c).isNotNull())
    q, p = _sliced(queries, passages, groups)
    kinds = queries.schema["query_id"].dataType.simpleString(), passages.schema["passage_id"].dataType.simpleString()
    both = q.groupBy("_slice").cogroup(p.groupBy("_slice"))
    return both.applyInArrow(_best_of(k, exclude_self, within), f"query_id {kinds[0]}, passage_id {kinds[1]}, distance double")


def nearest(queries: DataFrame, passages: DataFrame, scope: list[str], k: int = TOP_PASSAGES, exclude_self: bool = True) -> DataFrame:
    """(query_id, passage_id, distance, rank) of each query's ``k`` nearest passages in its scope.

    ``queries`` has (query_id, embedding, *scope), ``passages`` (passage_id,
    embedding, *scope).  Scope columns (owner, document) are group keys, so that
    nothing outside a query's scope is compared.  Queries that have ``document_ids``
    (and passages a ``document_id``) are compared with those documents alone; null or
    an empty list is no restriction.  An owner's passages, and questions, are dealt into as many
    slices as their counts ask for, and each slice gives ``k`` at most.
    """
    within = "document_ids" in queries.columns
    q = queries.select("query_id", F.col("embedding").alias("_v"), *scope, *([F.col("document_ids").cast("array<string>").alias("document_ids")] if within else []))
    p = passages.select("passage_id", F.col("embedding").alias("_v"), *scope, *(["document_id"] if within else []))
    return best(compared(q, p, scope, k, exclude_self), k, "query_id")


def relevant(distance: Column, threshold: float = RELEVANT_DISTANCE) -> Column:
    """Whether any distance of a group clears the bar; null never does, the bar itself does."""
    return F.bool_or(F.coalesce(distance <= threshold, F.lit(False)))


def gated(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with the query's outcome; a gate, no filter: all hits of a passing query go on."""
    decided = hits.groupBy("query_id").agg(F.when(relevant(F.col("distance")), "answer").otherwise("refusal").alias("outcome"))
    return queries.select("query_id").join(decided, "query_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("no_documents"))).join(hits, "query_id", "left")


def query_text(history: Column, question: Column) -> Column:
    """Earlier questions, oldest first, and the question, a line each."""
    return F.array_join(F.concat(F.coalesce(F.transform(history, lambda t: t["question"]), F.array().cast("array<string>")), F.array(question)), "\n")
