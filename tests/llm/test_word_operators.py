"""Decontamination, resampling and spelling against plain models, and on the cases that their docstrings define."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import DOCS, ODD

from passagework.llm import decontamination as D
from passagework.llm import queries, resampling, spelling, word_bytes

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The same rows with columns named as operators name theirs."""
    return df.withColumns({c: F.lit("x") for c in ("n_words", "spans", "items", "_row", "_text", "word", "form", "root", "n", "score", "rank", "id", "key", "_part")})


# --- words as bytes -----------------------------------------------------------------------------------


def test_words_and_checksums():
    rng = random.Random(3)
    texts = ["", " ", "\n\n", "A", "z9 É\x00x", "x" * 700 + " y", "ÀÈ a b"] + ["".join(rng.choice("aB9 .\né日\U0001f600") for _ in range(rng.randrange(60))) for _ in range(300)]
    found = word_bytes.words_of([t.encode() for t in texts])
    states = word_bytes.crc_states(found.data, found.starts, found.lengths, np.full(len(found.starts), 0xFFFFFFFF, np.uint32)) ^ np.uint32(0xFFFFFFFF)
    for k, t in enumerate(texts):
        mine = range(found.bounds[k], found.bounds[k + 1])
        got = [found.data[found.starts[i] : found.starts[i] + found.lengths[i]].tobytes().decode() for i in mine]
        assert got == words(t)
        assert [int(states[i]) for i in mine] == [zlib.crc32(w.encode()) for w in got]


# --- decontamination ----------------------------------------------------------------------------------


def hits(text, items, width=10):
    """(words, hit words, ids) of a text by comparing every run of words."""
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(width, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(i)
    w, hit, ids = words(text), set(), set()
    for k in {len(x) for x in windows}:
        for j in range(len(w) - k + 1):
            if (met := windows.get(tuple(w[j : j + k]))) is not None:
                hit |= set(range(j, j + k))
                ids |= met
    return len(w), len(hit), sorted(str(i) for i in ids - {None})


def contaminated(docs, items, **how):
    found = D.contaminated_words(clashing(docs), items, ["doc_id", "text"], **how)
    return found.withColumn("n_hit", D.n_hit(F.col("spans"))).collect()


@pytest.mark.parametrize("slice_bytes", [D.SLICE_BYTES, 2000])
def test_decontamination_equals_brute_force(spark, sf_dir, docs, slice_bytes):
    given = queries.table(spark, sf_dir, "documents").unionByName(docs)
    odd = [(9000, None), (9001, ""), (9002, "One two three"), (9003, "word"), (9004, "same line of"), (9005, "é ñ é ñ"), (None, "five six seven"), (9006, "word " * 30), (9006, "four five six")]
    items = queries.table(spark, sf_dir, "benchmark").unionByName(spark.createDataFrame(odd, ITEMS))
    plain = [tuple(r) for r in items.select("item_id", "text").collect()]
    rows = contaminated(given, items, slice_bytes=slice_bytes)
    assert len(rows) == given.count() and sum(r.n_hit > 0 for r in rows) > 5
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == hits(r.text, plain), r.doc_id
        assert all(a.behind < b.first for a, b in zip(r.spans, r.spans[1:]))


def test_decontamination_of_windows_that_share_most_of_their_bytes(spark):
    """Windows of one beginning, one end and one length; and texts with near misses."""
    rng = random.Random(1)
    stem = "alpha beta gamma delta epsilon {} eta theta iota kappa".split()
    items = [(i, " ".join(stem).format(f"z{i:04d}")) for i in range(300)]
    texts = [" ".join(stem).format(f"z{rng.randrange(600):04d}") + rng.choice(["", "x", " more words"]) for _ in range(400)]
    docs = spark.createDataFrame([(i, "Lead. " + t.upper() + ", " + t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    for r in contaminated(docs, spark.createDataFrame(items, ITEMS)):
        assert (r.n_words, r.n_hit, r["items"]) == hits(r.text, items)


def test_decontamination_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], ITEMS)
    assert all(r.n_hit == 0 and r["items"] == [] and r.n_words == len(words(r.text)) for r in contaminated(docs, none))
    assert contaminated(empty, none) == []
    assert contaminated(empty, spark.createDataFrame([(1, "a b")], ITEMS)) == []


# --- resampling ---------------------------------------------------------------------------------------


def draw(rows, target, percent=25, buckets=10_000, least=20):
    """(features, weight, score) of (id, text) rows, and how many are drawn."""

    def runs(text):
        w = words(text)
        return [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = Counter(b for _, x in rows for b in runs(x)), Counter(b for x in target for b in runs(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        f = runs(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least))
    may = sorted((o for o in out if o[4]), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[1], o[2]))
    n = percent * len(may) // 100
    ranked = [(*o[:4], k + 1 if k < n else None) for k, o in enumerate(may)] + [(*o[:4], None) for o in out if not o[4]]
    return sorted(ranked, key=repr)


def test_resampling_equals_a_model(spark, sf_dir, docs):
    # ids and texts twice, so that scores tie
    given = queries.table(spark, sf_dir, "documents").unionByName(docs).unionByName(queries.table(spark, sf_dir, "documents").limit(40))
    target = queries.table(spark, sf_dir, "benchmark")
    rows = [tuple(r) for r in given.select("doc_id", "text").collect()]
    got = resampling.resampled(clashing(given), target).collect()
    assert sorted((tuple(r[c] for c in ("id", "n_features", "weight", "score", "rank")) for r in got), key=repr) == draw(rows, [r.text for r in target.collect()])
    half = resampling.resampled(given, target, percent=60, n_buckets=64, least_words=3).collect()
    assert sorted((tuple(r[c] for c in ("id", "n_features", "weight", "score", "rank")) for r in half), key=repr) == draw(rows, [r.text for r in target.collect()], 60, 64, 3)


def test_resampling_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], ITEMS)
    got = resampling.resampled(docs, none).collect()
    assert sorted((tuple(r[c] for c in ("id", "n_features", "weight", "score", "rank")) for r in got), key=repr) == draw([(r[0], r[1]) for r in ODD], [])
    assert resampling.resampled(empty, none).collect() == []
    with pytest.raises(ValueError):
        resampling.resampled(docs, none, n_buckets=1 << 17)


# --- spelling -----------------------------------------------------------------------------------------


def variants(rows):
    """The rows of the operator from (id, text) rows, by comparing all words."""
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}

    def edits(w):
        letters = {c for x in n for c in x}
        return ({w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}) - {w}

    near = {w: sorted(edits(w) & set(n)) for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def test_spelling_equals_brute_force(spark, sf_dir, docs):
    given = queries.table(spark, sf_dir, "documents").limit(60).unionByName(docs)
    rows = [tuple(r) for r in given.select("doc_id", "text").collect()]
    want = variants(rows)
    assert len(want) > 300 and any(r[3] for r in want)
    assert sorted(tuple(r) for r in spelling.spelling_variants(clashing(given)).collect()) == want


@pytest.mark.parametrize("most", [2, 7, 1000])
def test_crowded_groups_are_dealt_again(spark, most):
    """One beginning in a third of all words, repeated letters, chains of forms, words of all lengths."""
    rng = random.Random(7)
    vocabulary = {"prefix" + "".join(rng.choice("abc") for _ in range(rng.randrange(5))) for _ in range(120)} | {"a" * k for k in range(5, 12)} | {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(150)}
    rows = [(None, " ".join(w for w in sorted(vocabulary) for _ in range(rng.choice([3, 4, 7, 20, 50]))))]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    want = variants(rows)
    assert any(r[5] != r[3] for r in want if r[3])
    assert sorted(tuple(r) for r in spelling.spelling_variants(docs, most=most).collect()) == want


def test_one_edit():
    assert spelling.one_edit("abcde", "abxde") and spelling.one_edit("abcde", "abcdef") and spelling.one_edit("abcde", "xabcde") and spelling.one_edit("aaaaa", "aaaaaa")
    assert not spelling.one_edit("abcde", "abcde") and not spelling.one_edit("abcde", "abdce") and not spelling.one_edit("abcde", "axbcdy")


def test_spelling_of_an_empty_table(empty):
    assert spelling.spelling_variants(empty).collect() == []
