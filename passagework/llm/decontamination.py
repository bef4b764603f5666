"""Benchmark decontamination by Wu-Manber search for windows of words.

A window is ``width`` consecutive words of an item, or all words of a shorter item; a
document word inside any occurrence of a window is hit.  Windows of equal numbers of words
share tables: of the first ``m`` bytes of each (the shortest has ``m``), every block
of up to eight bytes has the least distance to the end, by which a scan may go on from that
block (``shift``; blocks of no window let it go on by all of ``m``).  Where the shift is zero,
the window's first, last and middle bytes, its length and that block choose a bucket
of windows, and these are compared byte for byte.

A task scans a block of texts in many stretches at once; the windows come with the task.
Items are cut into slices of ``SLICE_BYTES``, and what is sent to tasks is one slice.  With
one slice, as most benchmarks have, no row is shuffled; more slices are scanned one after
another over a written copy of the texts, and the spans of rows with hits come together.

Defined cases: null and empty text and items without a word hit nothing; equal or null
ids of documents keep one row each; of items, rows with equal ids are one item, and a null id
hits words but is in no list; repeated windows are one; an empty table on either side
gives no hit; columns of any other name are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .word_bytes import SPACE, Words, blocks, words_of

WIDTH = 10
#: Bytes of items whose windows are in a task at one time.
SLICE_BYTES = 16 << 20
#: Bytes of a stretch of text; each is scanned by a position of its own.
STRETCH = 512
TABLE_BITS = 22
RUNS = "array<struct<first:bigint,behind:bigint>>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; ``data`` has eight bytes more than its places."""
    return np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))


def _mixed(*parts: np.ndarray) -> np.ndarray:
    state = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        state = (state ^ p.astype(np.uint64)) * _MIX
        state ^= state >> np.uint64(29)
    return state


@dataclass
class Table:
    """Windows of ``k`` words: their places in ``data`` in order of ``keys``, and the shifts of blocks of ``block`` bytes."""

    k: int
    least: int
    block: int
    shift: np.ndarray
    data: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    item_at: np.ndarray
    items: np.ndarray


def _slot(eights: np.ndarray, block: int) -> np.ndarray:
    """Place in the table of shifts of the last ``block`` of eight bytes."""
    return ((eights >> np.uint64(64 - 8 * block)) * _MIX) >> np.uint64(64 - TABLE_BITS)


def _inside(eights: np.ndarray, starts: np.ndarray, offset) -> np.ndarray:
    """The up to eight bytes of windows that end ``offset`` bytes behind their start; none from before it."""
    spare = 64 - 8 * np.minimum(8, np.asarray(offset) + 1)
    return eights[starts + offset] >> np.broadcast_to(spare, starts.shape).astype(np.uint64)


def _keys(eights: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int) -> np.ndarray:
    """What windows are told apart by before they are compared: four pieces of them and their length."""
    return _mixed(*(_inside(eights, starts, offset) for offset in (least - 1, min(7, least - 1), lengths - 1, lengths // 2)), lengths)


def _padded(data: np.ndarray) -> np.ndarray:
    """Seven bytes before and eight behind, so that eight bytes end at every place."""
    return np.concatenate([np.full(7, SPACE, np.uint8), data, np.full(8, SPACE, np.uint8)])


def _same(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the bytes at both places are the same, eight at a time, the last eight at the end."""
    alive = np.arange(len(at_a))
    fine = np.ones(len(at_a), bool)
    k = 0
    while len(alive):
        step = np.minimum(k + 7, lengths[alive] - 1)
        short = lengths[alive] < 8
        drop = np.where(short, 64 - 8 * np.minimum(lengths[alive], 8), 0).astype(np.uint64)
        differ = (a[at_a[alive] + step] >> drop) != (b[at_b[alive] + step] >> drop)
        fine[alive[differ]] = False
        alive = alive[~differ & (lengths[alive] > k + 8)]
        k += 8
    return fine


def tables(items: list[bytes], width: int = WIDTH) -> list[Table]:
    """A table for each number of words that windows of the items have."""
    words = words_of(items)
    counts = np.diff(words.bounds)
    padded = _padded(words.data)
    eights = _eight(padded)
    out = []
    for k in sorted({min(int(n), width) for n in counts if n}):
        mine = np.flatnonzero(counts >= width if k == width else counts == k)
        per = counts[mine] - k + 1
        item = np.repeat(mine, per)
        first = np.repeat(words.bounds[mine] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
        last = first + k - 1
        starts = words.starts[first] - 1
        lengths = words.starts[last] + words.lengths[last] + 1 - starts
        least = int(lengths.min())
        block = min(8, max(2, least // 2))
        keys = _keys(eights, starts, lengths, least)
        shift = np.full(1 << TABLE_BITS, min(255, least - block + 1), np.uint8)
        for j in range(max(0, least - block - 254), least - block + 1):  # nearer blocks overwrite farther ones
            shift[_slot(eights[starts + block - 1 + j], block)] = least - block - j
        order = np.lexsort((item, keys))
        keys, item, starts, lengths = keys[order], item[order], starts[order], lengths[order]
        # windows of equal keys are one window if all their bytes are the same; else each stays
        again = np.zeros(len(keys), bool)
        pair = np.flatnonzero(keys[1:] == keys[:-1])
        again[pair + 1] = (lengths[pair] == lengths[pair + 1]) & _same(eights, starts[pair], eights, starts[pair + 1], np.minimum(lengths[pair], lengths[pair + 1]))
        heads = np.flatnonzero(~again)
        out.append(Table(k, least, block, shift, eights, keys[heads], starts[heads], lengths[heads], np.append(heads, len(keys)), item))
    return out


def _zero_shifts(eights: np.ndarray, n: int, t: Table) -> np.ndarray:
    """Places where the first ``least`` bytes of a window may end, in all stretches at once."""
    found = []
    at = np.arange(t.least - 1, n, STRETCH)
    end = np.minimum(at + STRETCH, n)
    while len(at):
        step = t.shift[_slot(eights[at], t.block)].astype(np.int64)
        zero = step == 0
        if zero.any():
            found.append(at[zero])
            step[zero] = 1
        at = at + step
        live = at < end
        if not live.all():
            at, end = at[live], end[live]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def occurrences(words: Words, t: Table) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of all occurrences in a block of texts."""
    eights = _eight(_padded(words.data))
    ends = _zero_shifts(eights, len(words.data), t)
    starts = ends - t.least + 1
    starts = starts[(starts >= 0) & (words.data[np.maximum(starts, 0)] == SPACE)]
    first = np.searchsorted(words.starts, starts + 1)
    fits = first + t.k <= len(words.starts)
    first, starts = first[fits], starts[fits]
    # the space before a line feed starts no word, and the words of a window are those of one text
    last = first + t.k - 1
    fits = (words.starts[first] == starts + 1) & (np.searchsorted(words.bounds, first, "right") == np.searchsorted(words.bounds, last, "right"))
    first, last, starts = first[fits], last[fits], starts[fits]
    lengths = words.starts[last] + words.lengths[last] + 1 - starts
    fits = lengths >= t.least
    first, starts, lengths = first[fits], starts[fits], lengths[fits]
    keys = _keys(eights, starts, lengths, t.least)
    low, high = np.searchsorted(t.keys, keys), np.searchsorted(t.keys, keys, "right")
    n = high - low
    row = np.repeat(np.arange(len(keys)), n)
    window = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else low, n) + np.arange(n.sum())
    fine = t.lengths[window] == lengths[row]
    row, window = row[fine], window[fine]
    fine = _same(eights, starts[row], t.data, t.starts[window], lengths[row])
    return first[row[fine]], window[fine]


def hits(texts: list[bytes], found: list[Table]) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """(words of each text, [(text, runs of hit words as pairs, items)]) of a block."""
    words = words_of(texts)
    edges = np.zeros(len(words.starts) + 1, np.int64)
    texts_hit, items_hit = [], []
    for t in found:
        first, window = occurrences(words, t)
        np.add.at(edges, first, 1)
        np.add.at(edges, first + t.k, -1)
        text = np.searchsorted(words.bounds, first, "right") - 1
        # a text and a window count once, however often they meet
        pairs = np.unique(text * len(t.keys) + window)
        text, window = np.divmod(pairs, max(1, len(t.keys)))
        n = t.item_at[window + 1] - t.item_at[window]
        texts_hit.append(np.repeat(text, n))
        items_hit.append(t.items[np.repeat(t.item_at[window] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(n) else window)
    hit = np.cumsum(edges[:-1]) > 0
    counts = np.diff(words.bounds)
    text = np.concatenate(texts_hit) if texts_hit else np.zeros(0, np.int64)
    item = np.concatenate(items_hit) if items_hit else np.zeros(0, np.int64)
    order = np.lexsort((item, text))
    text, item = text[order], item[order]
    out = []
    for k in np.unique(text).tolist():
        own = hit[words.bounds[k] : words.bounds[k + 1]]
        change = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        a, b = np.searchsorted(text, k), np.searchsorted(text, k, "right")
        out.append((k, change, np.unique(item[a:b])))
    return counts, out


def _slices(items: DataFrame, id_column: str, text_column: str, most: int) -> Iterator[tuple[list[str | None], list[bytes]]]:
    """Items in slices of at most ``most`` bytes (a longer item is alone), one at a time at the driver."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(id_column).cast("string"), F.col(text_column).cast("string")).toLocalIterator():
        text = (row[1] or "").encode()
        if texts and size + len(text) > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


def _scan(slice_, width: int, columns: int, schema: pa.Schema):
    """A task's work: the carried columns, the number of words, the runs of hit words and the ids of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items = slice_.value
        found = tables(items, width)
        for batch in batches:
            for at, n, texts in blocks(batch.column(columns)):
                counts, met = hits(texts, found)
                spans: list = [[]] * n
                named: list = [[]] * n
                for k, runs, own in met:
                    spans[k] = [{"first": a, "behind": b} for a, b in runs.reshape(-1, 2).tolist()]
                    named[k] = sorted({ids[i] for i in own.tolist()} - {None})
                kept = [batch.column(c).slice(at, n) for c in range(columns)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts), pa.array(spans, schema.field("spans").type), pa.array(named, schema.field("items").type)], schema=schema)

    return run


def contaminated_words(docs: DataFrame, items: DataFrame, carry: list[str], text_column: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(*carry, n_words, spans, items): ``spans`` are the maximal runs of hit words, ``items`` the ids of the items met, sorted."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    more = f"n_words long, spans {RUNS}, items array<string>"
    slices = _slices(items, item_id, item_text, slice_bytes)
    first = next(slices, ([], []))
    second = next(slices, None)

    def scanned(rows: DataFrame, carried: list[str], text: str, slice_) -> DataFrame:
        given = rows.select(*carried, F.col(text).cast("string").alias("_text"))
        schema = StructType(given.drop("_text").schema.fields + StructType.fromDDL(more).fields)
        return given.mapInArrow(_scan(spark.sparkContext.broadcast(slice_), width, len(carried), to_arrow_schema(schema)), schema)

    if second is None:
        return scanned(docs, carry, text_column, first)
    # more than one slice: rows get a number in a written copy, and each slice leaves rows with hits alone
    numbered = settle(docs.select(*carry, F.col(text_column).cast("string").alias("_text"), F.monotonically_increasing_id().alias("_row")), "decontamination-texts")
    counted = settle(scanned(numbered, ["_row"], "_text", first), "decontamination-hits")
    met = counted.where("size(spans) > 0").select("_row", "spans", "items")
    while second is not None:
        part = settle(scanned(numbered, ["_row"], "_text", second).where("size(spans) > 0").select("_row", "spans", "items"), "decontamination-hits")
        met = met.unionByName(part)
        second = next(slices, None)
    # what is gathered is a row's own: no more than its words, and the items
    gathered = met.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = gathered.withColumn("spans", _joined(F.col("spans")))
    rows = numbered.drop("_text").join(counted.select("_row", "n_words"), "_row").join(found, "_row", "left")
    return rows.select(*carry, "n_words", *(F.coalesce(F.col(c), F.array().cast(t)).alias(c) for c, t in (("spans", RUNS), ("items", "array<string>"))))


def _joined(runs: Column) -> Column:
    """Sorted runs to maximal ones: a run that starts inside the last, or at its end, makes it longer."""

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["behind"], r["behind"]).alias("behind"))))
        return F.when(r["first"] <= last["behind"], longer).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(runs, F.array().cast(RUNS), step)


def n_hit(spans: Column) -> Column:
    """Words in the runs."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, r: s + r["behind"] - r["first"])
