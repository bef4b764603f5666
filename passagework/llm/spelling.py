"""Spelling variants: words one edit apart, found in positional q-gram indexes with a count filter.

Words of ``n`` letters and those of ``n`` or ``n + 1`` letters that are one edit away from them agree in
their first or in their last half, so words are dealt into groups by both halves, once as
the shorter and once as the longer of a pair.  A group with more than ``GROUP_WORDS`` words is dealt
again by the halves of what its words may still differ in, until no group is larger or one letter is left.

In a group, postings list the words that have a gram at a place.  Words of ``n`` letters have ``n + Q - 1``
grams with their margins, and one edit leaves all but ``Q`` of the longer word's, at the same
place or one place on.  So a word's shortest lists, one more than it may miss, are merged through
a heap; what they name is looked up in the longer ones until too many miss, and what is above the
bound is compared letter by letter.

Defined cases: null and empty text have no word; a null id counts as an empty one where a word loses a letter;
repeated rows count each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LETTERS, LEAST_TIMES = 5, 3
#: One run of so many loses a letter.
ODD = 97
Q = 2
GROUP_WORDS = 1_000


def counted_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): runs of letters, one of ``ODD`` without one of its letters, and how often they occur."""
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.col(text_column).cast("string"), F.lit(RUN), F.lit(0))).alias("_run"))
    runs = runs.select("_id", F.translate("_run", UPPER, UPPER.lower()).alias("_run"))
    h = F.crc32(F.concat_ws(":", "_id", "_run"))
    at = (h % F.char_length("_run")).cast("int")
    without = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.char_length("_run")))
    words = runs.select(F.when(h % ODD == 0, without).otherwise(F.col("_run")).alias("word")).where(F.char_length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_times)


def _halved(rows: DataFrame) -> DataFrame:
    """Rows (word, n, size, head, tail) of what is known to agree, each by the first and by the last half of the rest."""
    half = F.floor((F.col("size") - F.col("head") - F.col("tail")) / 2).cast("int")
    both = F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail")), F.struct(F.col("head"), (F.col("tail") + half).alias("tail")))
    return rows.select("word", "n", "size", F.explode(both).alias("k")).select("word", "n", "size", "k.head", "k.tail").withColumn("key", _key())


def _key() -> Column:
    tail = F.substring(F.col("word"), F.char_length("word") - F.col("tail") + 1, F.col("tail"))
    return F.concat_ws(":", "size", "head", "tail", F.concat(F.substring(F.col("word"), F.lit(1), F.col("head")), tail))


def grouped(words: DataFrame, most: int = GROUP_WORDS) -> DataFrame:
    """(key, size, word, n): words in groups such that any two that are one edit apart meet."""
    size = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)).alias("size")
    rows = _halved(words.select("word", "n", size).withColumns({"head": F.lit(0), "tail": F.lit(0)}))
    done = None
    while True:
        # groups of one letter's difference cannot be parted, and are no larger than the alphabet allows
        crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.first(F.col("size") - F.col("head") - F.col("tail")).alias("_left")).where((F.col("_n") > most) & (F.col("_left") > 1))
        crowded = settle(crowded.select("key"), "spelling-crowded")
        last = crowded.isEmpty()
        small = (rows if last else rows.join(crowded, "key", "left_anti")).select("key", "size", "word", "n")
        done = small if done is None else done.unionByName(small)
        if last:
            return done
        rows = _halved(rows.join(crowded, "key", "left_semi"))


def _grams(word: str) -> list[str]:
    padded = "\x00" * (Q - 1) + word + "\x01" * (Q - 1)
    return [padded[i : i + Q] for i in range(len(word) + Q - 1)]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter is replaced, or left out of the longer ``b``."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :]


def near_in_group(size: int, words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places in ``words``, a list of distinct words of ``size`` and ``size + 1`` letters: the first is a word of ``size``."""
    grams = [_grams(w) for w in words]
    same, longer = defaultdict(list), defaultdict(list)
    for k, w in enumerate(words):
        lists = same if len(w) == size else longer
        for at, g in enumerate(grams[k]):
            lists[at, g].append(k)
    none: list[int] = []
    for k, w in enumerate(words):
        if len(w) != size:
            continue
        own = grams[k]
        for lists, shifts, may_miss in ((same, (0,), Q), (longer, (0, 1), Q - 1)):
            if not lists:
                continue
            # a gram's postings under the limits: words of one length, at its place, or one place on in longer words
            postings = [[lists.get((at + shift, g), none) for shift in shifts] for at, g in enumerate(own)]
            order = sorted(range(len(own)), key=lambda at: sum(map(len, postings[at])))
            short, long = order[: may_miss + 1], order[may_miss + 1 :]
            for other, met in groupby(heapq.merge(*(p for at in short for p in postings[at])), key=None):
                if lists is same and other <= k:
                    continue
                theirs = grams[other]
                times = sum(any(theirs[at + shift] == own[at] for shift in shifts) for at in short)
                missed = may_miss + 1 - times
                for at in long:
                    if missed > may_miss:
                        break
                    missed += all(theirs[at + shift] != own[at] for shift in shifts)
                if missed <= may_miss and one_edit(w, words[other]):
                    yield k, other


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a group may reach over batches."""
    schema = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])
    key, size, words, times = None, 0, [], []
    out: list[tuple] = []

    def closed() -> None:
        if len(words) > 1:
            for i, j in near_in_group(size, words):
                x, y = (i, j) if words[i] < words[j] else (j, i)
                out.append((words[x], times[x], words[y], times[y]))

    for batch in batches:
        for k, s, w, n in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                closed()
                key, size, words, times = k, s, [], []
            words.append(w)
            times.append(n)
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
    closed()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def near_pairs(words: DataFrame, most: int = GROUP_WORDS) -> DataFrame:
    """(a, a_n, b, b_n) of words that are exactly one edit apart, each pair once, ``a`` the lesser; ``words`` are distinct."""
    rows = grouped(words, most).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_pairs, "a string, a_n long, b string, b_n long").distinct()


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last, twice as far in each round; there is no circle."""
    now = settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = settle(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        now = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = GROUP_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word.

    ``form`` is the near word that occurs most (of equals the first), if it occurs twice as often at least; a
    form occurs more often than its word, so forms end at a root.
    """
    words = settle(counted_words(docs, id_column, text_column), "spelling-words")
    pairs = settle(near_pairs(words, most), "spelling-pairs")
    # a word has no more near words than letters and places allow
    directed = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = directed.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("form"))).alias("_best"), F.first("a_n").alias("n"))
    chosen = -F.col("_best.minus") >= 2 * F.col("n")
    best = settle(best.select("word", "n_near", F.when(chosen, F.col("_best.form")).alias("form"), F.when(chosen, -F.col("_best.minus")).alias("form_n")), "spelling-forms")
    roots = rooted(best.where("form is not null"))
    found = words.join(best, "word", "left").join(roots, "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
