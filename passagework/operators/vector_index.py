"""An index of vectors in inverted lists: trained centroids, probes in order, exact distances, exact fallback.

The centroids are fit on a bounded sample; every row is in the list of its nearest centroid, and each list
knows its radius and its size.  How many lists a question probes is measured on the sample, for the recall that is asked for:
vectors in clusters need few, vectors without any need most.  A search compares a question with its nearest lists alone.  A question that finds fewer
than ``k`` there, as a narrow scope may leave it, is compared with all passages of its scope.  An exact
search goes on to all lists whose nearest possible vector is no farther than the ``k``-th found; these may be
most lists, so it goes to bundles of lists, and a question and its vector move once for each bundle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TOP_PASSAGES
from ..settings import settled
from . import retrieval
from .retrieval import best, compared, matrix, nearest

#: Vectors that the centroids are fit on, about, and rounds of the fit; lists at most.
SAMPLE, ROUNDS, MOST_LISTS = 20_000, 12, 4_096
#: The list of vectors that have no direction; no question probes it.
NOWHERE = -1
#: Share of the nearest that the probed lists are to hold.
TARGET = 0.96
#: What distances are rounded to, and more: bounds give way by it.
SLACK = 1e-5
#: Angles that are worked out at a time.
CELLS = 1 << 20


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` are the passages with ``_list``; ``centroids`` unit rows; ``radii`` the widest angle in each list (negative: empty), ``sizes`` its rows; ``probes`` what a question needs."""

    rows: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    probes: int


def sampled(vectors: DataFrame, key: str, column: str, most: int = SAMPLE) -> np.ndarray:
    """About ``most`` vectors at most, by a hash of their key, as unit rows."""
    usable = vectors.where(F.col(column).isNotNull())
    n = usable.count()
    share = 1 << 30
    part = usable if n <= most else usable.where(F.pmod(F.xxhash64(F.col(key)), F.lit(share)) < int(share * most / n))
    found = part.select(column, F.xxhash64(key).alias("_h")).orderBy("_h").limit(2 * most).toPandas()[column]
    if not len(found):
        return np.zeros((0, 0))
    # the size that most of the sample has
    size = int(found.map(len).mode().iloc[0])
    rows = matrix(pa.array(found.tolist(), pa.list_(pa.float64())), size)
    return rows[~np.isnan(rows).any(axis=1)]


def _slices(n: int, width: int) -> Iterator[slice]:
    """Slices of ``n`` rows whose comparison with ``width`` others is ``CELLS`` numbers at most, or one row."""
    step = max(1, CELLS // max(1, width))
    return (slice(at, at + step) for at in range(0, n, step))


def _closest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid and the cosine."""
    mine, closeness = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for x in _slices(len(rows), len(centroids)):
        near = rows[x] @ centroids.T
        mine[x], closeness[x] = near.argmax(axis=1), near.max(axis=1)
    return mine, closeness


def trained(rows: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids on the unit sphere: distinct rows to begin with, then means; a list without a row gets the row farthest from its own."""
    rows = np.unique(rows, axis=0)
    if len(rows) <= lists:
        return rows
    centroids = rows[np.random.default_rng(len(rows)).choice(len(rows), lists, replace=False)]
    for _ in range(rounds):
        mine, closeness = _closest(rows, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, mine, rows)
        empty = np.flatnonzero(np.bincount(mine, minlength=lists) == 0)
        sums[empty] = rows[np.argsort(closeness, kind="stable")[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(length > 0, sums / np.maximum(length, 1e-300), centroids)
        if np.allclose(moved, centroids, atol=1e-12):
            break
        centroids = moved
    return centroids


def probes_for(rows: np.ndarray, centroids: np.ndarray, target: float, k: int = TOP_PASSAGES, asked: int = 400) -> int:
    """The fewest lists, in order of nearness, that hold ``target`` of the ``k`` nearest of ``asked`` rows of the sample, on average.

    Neighbours in a sample are farther off than those in all rows, so the number is rather too large.
    """
    if len(rows) < 2 or not len(centroids):
        return max(1, len(centroids))
    some = np.random.default_rng(len(rows)).permutation(len(rows))[:asked]
    near = rows[some] @ rows.T
    near[np.arange(len(some)), some] = -np.inf
    k = min(k, len(rows) - 1)
    best_rows = np.argpartition(-near, k - 1, axis=1)[:, :k]
    lists = _closest(rows, centroids)[0]
    places = np.argsort(np.argsort(-(rows[some] @ centroids.T), axis=1), axis=1)
    found = np.sort(places[np.arange(len(some))[:, None], lists[best_rows]].ravel())
    return int(found[min(len(found) - 1, int(np.ceil(target * len(found))) - 1)]) + 1


def _angles(vectors: pa.Array, centroids: np.ndarray) -> np.ndarray:
    rows = matrix(vectors, centroids.shape[1] if centroids.size else 0)
    return np.arccos(np.clip(rows @ centroids.T, -1, 1)) if centroids.size else np.full((len(rows), 0), np.nan)


def _placed(vectors: DataFrame, column: str, centroids: np.ndarray) -> DataFrame:
    """``vectors`` with ``_list`` and ``_angle`` from the centroid: numbers go through, vectors do not come back from Python."""

    def place(v: pa.Array) -> pa.Array:
        mine, least = np.full(len(v), NOWHERE, np.int32), np.full(len(v), np.nan)
        for x in _slices(len(v), len(centroids)):
            angles = _angles(v[x], centroids)
            somewhere = np.flatnonzero(~np.isnan(angles).any(axis=1)) if angles.shape[1] else []
            if len(somewhere):
                found = angles[somewhere].argmin(axis=1)
                mine[x.start + somewhere], least[x.start + somewhere] = found, angles[somewhere, found]
        return pa.StructArray.from_arrays([pa.array(mine), pa.array(least)], names=["l", "a"])

    place = F.arrow_udf(place, "struct<l:int,a:double>", F.ArrowUDFType.SCALAR)
    return vectors.withColumn("_p", place(F.col(column))).withColumns({"_list": F.col("_p.l"), "_angle": F.col("_p.a")}).drop("_p")


def build(passages: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, target: float = TARGET) -> VectorIndex:
    """Index (passage_id, embedding, ...) below ``path``, a folder a list; by default as many lists as the root of the rows, ``MOST_LISTS`` at most.

    Vectors that are null or zero, hold null or non-finite numbers, or are not of the size that most have, are kept in
    a list of their own.  Null and repeated ids are rows like any other.
    """
    lists = min(MOST_LISTS, lists or max(1, int(passages.count() ** 0.5)))
    fit = sampled(passages, "passage_id", "embedding", sample)
    centroids = trained(fit, lists)
    placed = _placed(passages, "embedding", centroids)
    # rows of one list may be in several files, so that no list is one task's
    placed.repartition("_list", F.pmod(F.xxhash64("passage_id"), F.lit(8))).write.partitionBy("_list").parquet(path)
    return opened(passages, path, centroids, probes_for(fit, centroids, target))


def opened(passages: DataFrame, path: str, centroids: np.ndarray, probes: int) -> VectorIndex:
    """An index that was built; ``passages`` gives the columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passages.schema)
    rows = passages.sparkSession.read.schema(f"{schema}, _angle double, _list int").parquet(path)
    radii, sizes = np.full(len(centroids), -1.0), np.zeros(len(centroids), np.int64)
    for r in rows.where(F.col("_list") >= 0).groupBy("_list").agg(F.max("_angle").alias("a"), F.count(F.lit(1)).alias("n")).collect():  # a row a list
        radii[r["_list"]], sizes[r["_list"]] = r["a"], r["n"]
    return VectorIndex(rows, centroids, radii, sizes, probes)


def _probed(queries: DataFrame, centroids: np.ndarray, chosen, name: str) -> DataFrame:
    """A row for each question and number of ``chosen(angles of its lists, the farthest distance it has to beat)``, called ``name``.

    Python gives a question's numbers as an array; the rows for each are made outside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _slices(batch.num_rows, len(centroids)):
                part = batch.slice(x.start, x.stop - x.start)
                angles = _angles(part["_v"], centroids)
                found = [chosen(a, d) if len(a) and not np.isnan(a).any() else np.zeros(0, np.int32) for a, d in zip(angles, part["_most"].to_pylist())]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                numbers = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, numbers], names=[*part.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{schema}, `{name}` array<int>").withColumn(name, F.explode(name))


def _bundles(sizes: np.ndarray, most: int) -> np.ndarray:
    """The bundle of each list: lists in turn, about ``most`` rows each."""
    return ((np.cumsum(sizes) - sizes) // most).astype(np.int32)


def search(index: VectorIndex, queries: DataFrame, scope: list[str], k: int = TOP_PASSAGES, probes: int | None = None, exclude_self: bool = True, exact: bool = False) -> DataFrame:
    """(query_id, passage_id, distance, rank) as ``retrieval.nearest`` gives it, from ``probes`` lists a question (by default as many as the index needs).

    ``exact`` makes it the same rows; without it a question whose ``k`` are found may miss one in a list that it did not probe.
    """
    radii, probes = index.radii, probes or index.probes
    within = "document_ids" in queries.columns
    asked = queries.select("query_id", F.col("embedding").alias("_v"), *scope, *([F.col("document_ids").cast("array<string>").alias("document_ids")] if within else []))
    rows = index.rows.select("passage_id", F.col("embedding").alias("_v"), "_list", *scope, *(["document_id"] if within else []))
    filled = np.flatnonzero(radii >= 0)

    def first(angles: np.ndarray, _) -> np.ndarray:
        return filled[np.argsort(angles[filled], kind="stable")[:probes]]

    bundles = _bundles(index.sizes, retrieval.SLICE_PASSAGES)

    def rest(angles: np.ndarray, most: float) -> np.ndarray:
        """Bundles of the lists whose nearest possible vector is as near as the farthest found."""
        bound = 1 - np.cos(np.maximum(0, angles[filled] - radii[filled]))
        return np.unique(bundles[filled[bound <= most + SLACK]])

    near = best(compared(_probed(asked.withColumn("_most", F.lit(None).cast("double")), index.centroids, first, "_list"), rows, ["_list", *scope], k, exclude_self), k, "query_id")
    near = settled(near, "probed")
    counts = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_most"))
    short = F.coalesce(F.col("_n"), F.lit(0)) < k
    judged = queries.join(counts, "query_id", "left")
    all_of = nearest(judged.where(short).drop("_n", "_most"), index.rows, scope, k, exclude_self)
    if exact:
        again = asked.join(counts.where(F.col("_n") >= k).select("query_id", "_most"), "query_id")
        # the lists that were probed are among these as far as they matter
        in_bundles = rows.where(F.col("_list") >= 0).withColumn("_bundle", F.get(F.array(*map(F.lit, bundles.tolist())), F.col("_list"))) if len(bundles) else rows.withColumn("_bundle", F.lit(0))
        kept = best(compared(_probed(again, index.centroids, rest, "_bundle"), in_bundles.drop("_list"), ["_bundle", *scope], k, exclude_self), k, "query_id")
    else:
        kept = near.join(judged.where(~short).select("query_id"), "query_id", "left_semi")
    return kept.unionByName(all_of)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact rows that were found."""
    row = exact.join(found.select("query_id", "passage_id", F.lit(1).alias("_hit")), ["query_id", "passage_id"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hit")).first()
    return row["hit"] / row["n"] if row["n"] else 1.0
