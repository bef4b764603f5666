"""Importance resampling towards a target: hashed word features, gains of buckets, Gumbel top-k.

1. Each block of texts becomes one row: its rows' ids, the offsets of their features, and
   the buckets of all features as a packed stream of 16-bit numbers (written table).
2. Each task sorts the streams that it reads and run-length encodes them; what leaves it is a
   count for each bucket.  From the sums over the corpus and over the target come the gains.
3. The streams are read again: the gains of the buckets are gathered and summed between the
   offsets.  The score of a row is the floored mean and a seeded Gumbel number.
4. Scores are whole numbers of a bounded range, so the lowest score that is drawn comes from
   their counts; the rows from there on get their places range by range.

Features are runs of 1 to 2 words; the checksum of a run of two goes on from that of its
first word.  The number of buckets is at most 65,536, so gains are a bounded table.

Defined cases: null and empty text have no feature and weight 0; a null id is drawn with the
text ``7:`` and comes last in ties; equal ids are rows of their own, and of equal scores and ids
the one with fewer features, then less weight comes first; an empty corpus gives no row, an empty target gains from
no count; columns of any other name are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, shuffle_width
from .word_bytes import SPACE, CRC, Words, blocks, crc_states, words_of

BUCKETS = 10_000
#: Rows with fewer words are never drawn.
LEAST_WORDS = 20
PERCENT, SEED = 25, 7
STREAMS = "ids array<long>, words binary, offsets binary, stream binary"


def features(words: Words, n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, offsets of the texts): a text's words first, then its runs of two."""
    n = np.diff(words.bounds)
    ones = crc_states(words.data, words.starts, words.lengths, np.full(len(words.starts), 0xFFFFFFFF, np.uint32))
    # a word with a word before it in its text
    second = np.ones(len(words.starts), bool)
    second[words.bounds[:-1][n > 0]] = False
    second = np.flatnonzero(second)
    before = ones[second - 1]
    before = CRC[(before ^ np.uint32(SPACE)) & 0xFF] ^ (before >> 8)
    twos = crc_states(words.data, words.starts[second], words.lengths[second], before)
    text = np.repeat(np.arange(len(n)), n)
    order = np.argsort(np.concatenate([text, text[second]]), kind="stable")
    buckets = (np.concatenate([ones, twos])[order] ^ np.uint32(0xFFFFFFFF)) % np.uint32(n_buckets)
    return buckets.astype("<u2"), np.concatenate([[0], np.cumsum(np.where(n > 0, 2 * n - 1, 0))])


def _streams(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, texts in blocks(batch.column(1)):
                words = words_of(texts)
                buckets, offsets = features(words, n_buckets)
                ids = pa.array([batch.column(0).slice(at, n).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((np.diff(words.bounds), "<i8"), (offsets, "<i8"), (buckets, "<u2")))], names=["ids", "words", "offsets", "stream"])

    return run


def _runs(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                ordered = np.sort(np.frombuffer(stream.as_py(), "<u2"))
                heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
                total[ordered[heads]] += np.diff(np.append(heads, len(ordered)))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    return run


def bucket_counts(streams: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all streams: at most ``n_buckets`` rows from a task and to the driver."""
    counts = np.zeros(n_buckets, np.int64)
    for r in streams.select("stream").mapInArrow(_runs(n_buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths of a nat, with one count more everywhere."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_corpus + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, offsets, stream in zip(*batch.columns):
                at = np.frombuffer(offsets.as_py(), "<i8")
                n = np.diff(at)
                sums = np.zeros(len(n), np.int64)
                held = np.flatnonzero(n)
                if len(held):
                    sums[held] = np.add.reduceat(gain[np.frombuffer(stream.as_py(), "<u2")], at[:-1][held])
                columns = [ids.values, pa.array(np.frombuffer(words.as_py(), "<i8")), pa.array(n), pa.array(sums // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_features", "weight"])

    return run


def gumbel(id_column, seed: int = SEED):
    """A seeded Gumbel number of each id, in thousandths, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` with ``rank``; each row once."""
    may = F.col("n_words") >= least_words
    # as many rows as there are scores, whose range the gains bound
    counts = scored.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score")))
    total = counts.agg(F.floor(percent * F.sum("n") / 100)).first()[0] or 0
    last = counts.withColumn("above", above).where(F.col("above") >= total).agg(F.max("score")).first()[0] if total else None
    chosen = may & (F.col("score") >= last) if last is not None else F.lit(False)
    rest = scored.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    if last is None:
        return rest.drop("_row")
    order = [F.desc("score"), F.asc_nulls_last("id"), "n_features", "weight", "_row"]
    parts = settle(scored.where(chosen).repartitionByRange(shuffle_width(scored.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "resampling-ranges")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = parts.join(F.broadcast(before), "_part").withColumn("rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before"))
    return placed.withColumn("rank", F.when(F.col("rank") <= total, F.col("rank").cast("long"))).drop("_part", "_before").unionByName(rest).drop("_row")


def resampled(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text", percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, n_buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of each row; ``rank`` is null for what is not drawn."""
    if not 0 < n_buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")

    def packed(rows: DataFrame, id_, text: str) -> DataFrame:
        return rows.select(id_.cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_streams(n_buckets), STREAMS)

    streams = settle(packed(docs, F.col(id_column), text_column), "resampling-streams")
    gain = gains(bucket_counts(streams, n_buckets), bucket_counts(packed(target, F.lit(None), target_text), n_buckets))
    weighed = streams.mapInArrow(_weights(gain), "id long, n_words long, n_features long, weight long")
    scored = settle(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("_row", F.monotonically_increasing_id()), "resampling-scores")
    return _drawn(scored, percent, least_words)
