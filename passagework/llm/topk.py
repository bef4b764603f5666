"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are dealt into blocks by a hash of the id, queries into groups; each
(block, group) is one task's unit with bounded rows on both sides.  A block has
one list for each dimension, sorted by component; a query reads each list from
the end that its own component favours.  All lists are read to the same depth,
round by round.  After a round every candidate has

- an upper bound: components that were read count as they are, others as the
  last value read from their list (none can be better), and
- a lower bound: the others as the worst value of their list.

Both are inner products of clipped vectors, so a round is four matrix products
for all queries of a unit at once.  A query stops when candidates that no list
has shown cannot reach its k-th lower bound, and few enough candidates have an upper bound
at or above it (or all lists are read); those are resolved with their final scores.
Scores are integers below 2^53, so doubles hold them exactly.

Defined cases: vectors that are null or hold a null or non-finite component take
no part, nor do empty ones; vectors of different lengths are never compared (the
length is part of the unit); equal vectors tie and go by the smaller id; a query's
own row alone is not its candidate, other rows of the same id are, and repeated ids among
the queries are queries of their own; null ids take no part; an empty table
gives an empty result; extra columns are ignored.  Rows are numbered by partition
and order: the input must read the same when it is read again, as tables do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, GROUP = 2048, 4096
SCALE = 256
DEPTHS = (0.35, 0.5, 0.65, 0.8, 1.0)
#: A query resolves its survivors once they are at most one in so many of the block.
FEW = 16


def rounded_vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, row, v): floor(SCALE * x) of the vectors that take part; ``row`` tells rows of one id apart."""
    v = F.col(vector_column)
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col(id_column).isNotNull()
    numbered = df.select(F.col(id_column), v, F.monotonically_increasing_id().alias("row"))
    return numbered.where(sound).select(F.col(id_column).cast("long").alias("id"), "row", F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def block_top(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, query_rows: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position of the query, ids, scores) of the at most ``k`` best of a block of candidates."""
    n = len(ids)
    ranked = np.sort(x, axis=0)  # a sorted list for each dimension
    up, down = np.maximum(q, 0).T, np.minimum(q, 0).T
    waiting = np.arange(len(q))
    for depth in DEPTHS:
        read = min(n, max(1, int(np.ceil(n * depth))))
        high, low = ranked[n - read], ranked[read - 1]  # the last values read from the top and from the bottom
        u, d = up[:, waiting], down[:, waiting]
        upper = np.maximum(x, high) @ u + np.minimum(x, low) @ d
        lower = np.where(x >= high, x, ranked[0]) @ u + np.where(x <= low, x, ranked[-1]) @ d
        own = rows[:, None] == query_rows[waiting][None, :]
        upper[own] = lower[own] = -np.inf
        kth = min(k, n)
        bar = np.partition(lower, n - kth, axis=0)[n - kth]
        unseen = high @ u + low @ d
        survivors = (upper >= bar).sum(axis=0)
        done = ((unseen < bar) & (survivors <= max(k, n // FEW))) if read < n else np.ones(len(waiting), bool)
        for at in np.flatnonzero(done).tolist():
            some = np.flatnonzero((upper[:, at] >= bar[at]) & ~own[:, at])
            score = x[some] @ q[waiting[at]]
            best = np.lexsort((ids[some], -score))[:k]
            yield int(waiting[at]), ids[some][best], score[best]
        waiting = waiting[~done]
        if not len(waiting):
            return


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.chunked_array([c.flatten() for c in column.chunks]).to_numpy().astype(float)
    return flat.reshape(len(column), -1)


def _unit(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 4]
        if left.num_rows and right.num_rows:
            ids, rows, query_ids, query_rows = (t.column(c).to_numpy() for t in (left, right) for c in ("id", "row"))
            for at, found, score in block_top(ids, rows, _matrix(left.column("v")), query_rows, _matrix(right.column("v")), k):
                out.append((np.full(len(found), query_rows[at]), np.full(len(found), query_ids[at]), found, score.astype(np.int64)))
        return pa.table(dict(zip(("query_row", "query", "id", "score"), map(np.concatenate, zip(*out)))))

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query, rank, id, score) for (id, row, v) candidates, and queries that are some of their rows."""
    n, m = candidates.count(), queries.count()
    blocks, groups = max(1, -(-n // block)), max(1, -(-m // group))
    width = F.size("v").alias("width")
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = candidates.select("id", "row", "v", width, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), every_group)
    right = queries.select("id", "row", "v", width, F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int").alias("group"), every_block)
    key = ["width", "block", "group"]
    # the best of each unit: at most k rows for a query and block
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_unit(k), "query_row long, query long, id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")
