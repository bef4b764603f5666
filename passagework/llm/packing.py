"""Packing token pieces into sequences by a configuration linear program.

1. ``encode``: each whole text to ids; the piece table has no ids, only lengths
   and checksums.  Longer documents are cut into full pieces and a rest.
2. The histogram of piece lengths (at most ``capacity`` rows) goes to the driver.
3. ``fractional``: the covering program over configurations (multisets of
   lengths that fit a sequence) by multiplicative weights.  A length's weight
   falls exponentially with the share of its demand that is covered; a knapsack
   dynamic program over the capacity prices, for each length, the best
   configuration that holds it; those within ``SLACK`` of the best price grow.
4. ``rounded``: the fractional counts are rounded systematically (floors of
   running sums), as far as demand lasts; the rest is solved again.  So it goes at
   every size, from one piece on.  What the passes leave (at most about one piece
   of each length a pass, whatever the input) goes best-fit by decreasing length.
5. Every piece gets a rank among those of its length, counted in buckets, and
   ranks map to places by a table whose size ``MOST_CONFIGS``, ``PASSES`` and
   ``SMALL_REST`` bound.  The table is cut into ranges of ranks, so that a piece meets
   one or two slots, not all of its length.

Defined cases: null or empty text is one piece, the closing id alone; repeated
rows are packed as often as they come; null ids are packed like others; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

CAPACITY = 2048
CLOSING_ID = 0
SLACK = 0.02
RATE = 4.0
ROUNDS, PASSES = 60, 6
#: Configurations of one pass at most: with ``PASSES`` and ``SMALL_REST`` this bounds the table of places, whatever the input.
MOST_CONFIGS = 8192
#: Pieces of one length that share a counting bucket, on average.
BUCKET = 500
#: Rest below which single pieces are placed best-fit.
SMALL_REST = 50_000
#: Pieces up to which best-fit places all of them one by one, for comparison.
MOST_SINGLE = 200_000

_MEMO_ENTRIES, _MEMO_LENGTH, _BATCH_CHARS, _JOINED = 500_000, 48, 3_000_000, 512


def _latin(word: str) -> bool:
    """Letters below U+0250 only, whose lower case is one letter each and whose NFC is themselves."""
    return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word))


class _Encoder:
    """Ids of texts, each space- or newline-delimited chunk encoded once while it is remembered.

    The tokenizer drops white space between pre-tokens and normalises within
    them, so a text's ids are those of its chunks in turn.  Arrow splits the
    texts and numbers the chunks; ids are then gathered by chunk.
    """

    def __init__(self, path: str):
        # a task has one core; threads of the library would only hold memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for lower-case Latin words, set apart by single spaces: there is nothing to normalise or to look for in them
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {"": b""}

    @staticmethod
    def _parts(chunk: str) -> tuple[str, str]:
        """A Latin word and the one comma or stop after it are two pre-tokens; case does not matter."""
        word, end = (chunk[:-1], chunk[-1]) if chunk[-1] in ".," and len(chunk) > 1 else (chunk, "")
        return (word.lower(), end) if _latin(word) else (chunk, "")

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Latin words are one pre-token each, so many are encoded as one text and divided at the ids that end a word."""
        out: dict[str, bytes] = {}
        words = [c for c in chunks if _latin(c)]
        joined = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        for part, e in zip(joined, self.plain.encode_batch_fast([" ".join(w) for w in joined], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) == len(part):
                data, at = ids.tobytes(), 0
                for w, cut in zip(part, cuts.tolist()):
                    out[w] = data[at:cut]
                    at = cut
        rest = [c for c in chunks if c not in out]
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[c] = np.array(e.ids, "<u4").tobytes()
        return [out[c] for c in chunks]

    def _found(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; what is remembered is words without the comma or stop after them, in lower case."""
        parts = [self._parts(c) if c else ("", "") for c in chunks]
        memo = self.memo
        new = {x for pair in parts for x in pair}.difference(memo)
        if len(memo) + len(new) > _MEMO_ENTRIES:
            memo = self.memo = {"": b""}
            new = {x for pair in parts for x in pair if x}
        words = list(new)
        memo.update(zip(words, self._ids(words)))
        found = [memo[word] + memo[end] if end else memo[word] for word, end in parts]
        for c in words:
            if len(c) > _MEMO_LENGTH:
                del memo[c]
        return found

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of an array without nulls."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        found = self._found(coded.dictionary.to_pylist())
        taken = pa.array(found, pa.binary()).take(coded.indices)
        offsets = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, 4 * taken.offset) // 4
        every = np.frombuffer(taken.buffers()[2] or b"", "<u4")
        bounds = offsets[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield every[a:b]


_encoders: dict[str, _Encoder] = {}


def _encode_batches(path: str, capacity: int, closing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, _Encoder(path))
        end = np.array([closing], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            chars = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                upto = int(np.searchsorted(chars, (chars[at - 1] if at else 0) + _BATCH_CHARS)) + 1
                part = texts.slice(at, max(1, upto - at))
                rows: list[tuple] = []
                for k, found in enumerate(encoder.encode(part)):
                    n = len(found) + 1
                    for p, start in enumerate(range(0, n, capacity)):
                        crc = zlib.crc32(found[start : start + capacity].tobytes())
                        last = start + capacity >= n
                        rows.append((at + k, p, start, n - start if last else capacity, zlib.crc32(end, crc) if last else crc))
                where, *rest = zip(*rows)
                columns = [ids.take(pa.array(where)), pa.array(rest[0], pa.int32()), *(pa.array(c, pa.int64()) for c in rest[1:])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "crc"])
                at += len(part)
            pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, closing: int = CLOSING_ID) -> DataFrame:
    """(id, piece, start, length, crc) for each piece of each document."""
    given = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return given.mapInArrow(_encode_batches(tokenizer_path, capacity, closing), "id long, piece int, start long, length long, crc long")


def _knapsack(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best total weight for each capacity, the index of an item that attains it (-1: none), and the capacity left after it."""
    best, item, left = np.zeros(capacity + 1), np.full(capacity + 1, -1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], item[c], left[c] = best[c - 1], item[c - 1], left[c - 1]
        if n := upto[c]:
            total = best[c - lengths[:n]] + weights[:n]
            k = total.argmax()
            if total[k] > best[c] + 1e-12:
                best[c], item[c], left[c] = total[k], k, c - lengths[k]
    return best, item, left


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Configurations (ascending indexes of lengths) and fractional counts that cover about the demand."""
    share = demand.astype(float)
    covered = np.zeros(len(lengths))
    found: dict[tuple[int, ...], float] = {}
    natural = lengths / capacity
    for _ in range(rounds):
        ahead = covered / share
        weights = natural * np.exp(-RATE * (ahead - np.average(ahead, weights=natural * share)))
        best, item, left = _knapsack(lengths, weights, capacity)
        value = weights + best[capacity - lengths]
        chosen = np.flatnonzero(value >= (1 - SLACK) * value.max())
        parts = [chosen]
        room = capacity - lengths[chosen]
        while (item[room] >= 0).any():
            parts.append(item[room])
            room = np.where(item[room] >= 0, left[room], 0)
        rows = np.sort(np.stack(parts, axis=1), axis=1)
        step = share[chosen] / rounds
        # no length may gain more than its share of a round by a factor: large gains overshoot
        gain = np.zeros(len(lengths) + 1)
        for column in rows.T:
            np.add.at(gain, column, step)
        over = np.maximum(1.0, gain[:-1] / (2 * share / rounds))
        scale = np.ones(len(chosen))
        for column in rows.T:
            scale = np.minimum(scale, np.where(column >= 0, 1 / over[column], 1.0))
        step *= scale
        for column in rows.T:
            held = column >= 0
            np.add.at(covered, column[held], step[held])
        for row, x in zip(rows.tolist(), step.tolist()):
            key = tuple(k for k in row if k >= 0)
            found[key] = found.get(key, 0.0) + x
    # scaled so that the demand, by length, is covered once on average
    factor = (natural * share).sum() / (natural * np.minimum(covered, share)).sum() if covered.any() else 0.0
    return {k: x * factor for k, x in found.items()}


def rounded(found: dict[tuple[int, ...], float], rest: np.ndarray, most: int = MOST_CONFIGS) -> list[tuple[tuple[int, ...], int]]:
    """Counts in whole steps by floors of running sums; ``rest``, the demand, is lowered by what they take.

    A step is one sequence, or as many as leave at most ``most`` configurations.
    """
    out, total, taken = [], 0.0, 0
    unit = max(1, -(-int(sum(found.values())) // most))
    for config, x in sorted(found.items(), key=lambda c: (-c[1], c[0])):
        total += x
        want = int(total / unit) * unit - taken
        if want <= 0:
            continue
        kinds, times = np.unique(config, return_counts=True)
        count = min(want, int((rest[kinds] // times).min()))
        taken += want
        if count > 0:
            rest[kinds] -= count * times
            out.append((config, count))
    return out


def best_fit(lengths: np.ndarray, rest: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Single pieces by decreasing length, each to the fullest sequence that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for k in np.argsort(-lengths).tolist():
        size = int(lengths[k])
        for _ in range(int(rest[k])):
            fits = open_rooms >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    open_rooms &= ~(1 << room)
            else:
                b, room = len(bins), capacity
                bins.append([])
            bins[b].append(k)
            left = room - size
            if left:
                by_room[left].append(b)
                open_rooms |= 1 << left
    counts: dict[tuple[int, ...], int] = {}
    for b in bins:
        key = tuple(sorted(b))
        counts[key] = counts.get(key, 0) + 1
    return list(counts.items())


def greedy(lengths: np.ndarray, rest: np.ndarray, capacity: int, until: int) -> list[tuple[tuple[int, ...], int]]:
    """First-fit-decreasing configurations, each as often as demand lasts, until few pieces are left."""
    out = []
    order = np.argsort(-lengths)
    while rest.sum() > until:
        room, config = capacity, []
        for k in order[rest[order] > 0].tolist():
            times = min(int(rest[k]), room // int(lengths[k]))
            if times:
                config += [k] * times
                room -= times * int(lengths[k])
        kinds, times = np.unique(config, return_counts=True)
        count = int((rest[kinds] // times).min())
        rest[kinds] -= count * times
        out.append((tuple(sorted(config)), count))
    return out


def filled(lengths: np.ndarray, rest: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """What is left, by decreasing length: like sequences at once until few pieces are left, these best-fit."""
    return greedy(lengths, rest, capacity, SMALL_REST) + best_fit(lengths, rest, capacity)


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(piece lengths of a sequence, number of such sequences) that hold the histogram exactly."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    rest = np.array([histogram[int(x)] for x in lengths], np.int64)
    made: list[tuple[tuple[int, ...], int]] = []
    for _ in range(PASSES):
        live = np.flatnonzero(rest)
        if not len(live):
            break
        part = rest[live]
        took = rounded(fractional(lengths[live], part, capacity), part)
        made += [(tuple(int(live[k]) for k in config), n) for config, n in took]
        rest[live] = part
        if not took:
            break
    made += filled(lengths, rest, capacity)
    # of lengths that fit no better than in pairs, filling one sequence after another may need fewer
    every = np.array([histogram[int(x)] for x in lengths], np.int64)
    plain = best_fit(lengths, every, capacity) if every.sum() <= MOST_SINGLE else filled(lengths, every, capacity)
    made = min(made, plain, key=lambda configs: sum(n for _, n in configs))
    total: dict[tuple[int, ...], int] = {}
    for config, n in made:
        total[config] = total.get(config, 0) + n
    return [([int(lengths[k]) for k in config], n) for config, n in total.items()]


def places(configs: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Ranks [low, high) of a length go to sequences from ``base``, ``times`` to each, from ``shift`` on."""
    rows, base, used = [], 0, {}
    for config, n in configs:
        shift = 0
        for size in sorted(set(config)):
            times = config.count(size)
            low = used.get(size, 0)
            used[size] = low + times * n
            rows.append((size, low, low + times * n, base, times, shift))
            shift += times * size
        base += n
    return pd.DataFrame(rows, columns=["p_length", "low", "high", "base", "times", "shift"]).astype("int64")


def by_range(slots: pd.DataFrame) -> pd.DataFrame:
    """Slots with ``wide`` and ``nth``: ranks rank // wide == nth of the length meet these rows; fewer than twice the slots."""
    most = slots.groupby("p_length")["high"].transform("max")
    number = slots.groupby("p_length")["high"].transform("size")
    wide = -(-most // number)
    first, last = slots["low"] // wide, (slots["high"] - 1) // wide
    again = (last - first + 1).to_numpy()
    out = slots.assign(wide=wide, nth=first).loc[slots.index.repeat(again)]
    out["nth"] += np.arange(len(out)) - np.repeat(np.cumsum(again) - again, again)
    return out.astype("int64")


def ranks(pieces: DataFrame) -> DataFrame:
    """Add ``rank`` (from 0) among the pieces of a length: buckets of each length are numbered in themselves, then after each other."""
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.max("n").alias("n")).first()["n"] or 0
    width = max(1, -(-total // BUCKET))
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64("id", "piece", "crc", "start"), F.lit(width)) if width > 1 else F.lit(0).cast("long"))
    # rows that are equal in all columns share a bucket: a third of all rows may be such, so they are spread as well
    rows = rows.withColumn("_bucket", F.pmod(F.col("_bucket") + F.monotonically_increasing_id(), F.lit(width)))
    rows = settle(rows, "packing-buckets")
    sizes = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).drop("n")
    inside = Window.partitionBy("length", "_bucket").orderBy("id", "piece")
    return rows.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["length", "_bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("_bucket", "before")


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, closing: int = CLOSING_ID) -> DataFrame:
    """(id, piece, start, length, crc, sequence, offset): every piece with its place in a sequence."""
    spark = docs.sparkSession
    pieces = settle(encode(docs, tokenizer_path, id_column, text_column, capacity, closing), "packing-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = by_range(places(configurations(histogram, capacity)))
    if len(table):
        slots = spark.createDataFrame(pa.Table.from_pandas(table, preserve_index=False))
    else:
        slots = spark.createDataFrame([], ", ".join(f"{c} long" for c in table.columns))
    wide = slots.select(F.col("p_length").alias("length"), "wide").distinct()
    ranked = ranks(pieces).join(F.broadcast(wide), "length").withColumn("_nth", F.floor(F.col("rank") / F.col("wide"))).drop("wide")
    here = ranked.join(F.broadcast(slots), (F.col("length") == F.col("p_length")) & (F.col("_nth") == F.col("nth")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    sequence = F.col("base") + F.floor(nth / F.col("times"))
    return here.select("id", "piece", "start", "length", "crc", sequence.cast("long").alias("sequence"), (F.col("shift") + F.pmod(nth, F.col("times")) * F.col("length")).alias("offset"))
