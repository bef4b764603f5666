"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, trained from document labels.

A document is a bag of sentences.  A sentence's score is the logistic of a bias
and the weights of its words; a sentence without a known feature, or without a
word, scores 0, so that length alone makes nothing toxic.  A document is toxic
unless no sentence is: p = 1 - prod(1 - p_sentence).  The labels are of documents only; the gradient of
the document's log loss shares the blame among its sentences, so that the model
finds the offending ones.

The fit uses a bounded sample: at most about ``sample`` labelled documents, the same ones
whenever the ids are the same.  Its features are words, beginnings of words and
runs of letters that at least ``MIN_DOCS`` toxic documents hold and that toxic
documents hold more often than chance allows (``MOST_FEATURES`` at most).  Scores use whole texts of all documents, and
words only: no label, language, source or id.

Defined cases: null or empty text has no sentence and scores 0; several labels
for one id count as the largest; null labels and null ids teach nothing; with
only one class of labels (or none) every non-empty text scores the share of
label 1; repeated rows score alike; an empty table gives an empty result; extra
columns are left to the caller (``carry``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 8000
MIN_DOCS = 5
#: Least standardised excess of toxic documents, and most features, of the model.
LEAST_Z = 5.0
MOST_FEATURES = 50_000
BEGINNINGS = (3, 4, 5, 6)
GRAM = 5
#: Words whose weight a task remembers.
MEMO = 500_000
BIAS = -9.0
STEPS, STEP, RIDGE = 150, 0.35, 1e-5
LEAST_WEIGHT = 0.05
OFFENDING = 0.5

SENTENCE = re.compile(r"[^.!?\n]+")
#: Characters that only divide words.
DIVIDERS = ",;:\"'()[]{}<>#*$%&|=/\\_-+"


def words(sentence: str) -> list[str]:
    s = sentence.lower()
    if not s.isalnum():
        for c in DIVIDERS:
            if c in s:
                s = s.replace(c, " ")
    return s.split()


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        # a line for each sentence with a word
        lines = [[" ".join(sorted(set(words(m.group())))) for m in SENTENCE.finditer(t)] for t in part["text"]]
        yield pd.DataFrame({"toxic": part["toxic"], "bag": ["\n".join(filter(None, b)) for b in lines]})


def features(word: str) -> list[str]:
    """The word, its beginnings, and the runs of GRAM letters inside it."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k), *{"*" + word[i : i + GRAM] for i in range(1, len(word) - GRAM + 1)}]


def informative(bags: list[str], labels: np.ndarray) -> dict[str, int]:
    """Features that more toxic documents hold than chance would give, in a fixed order."""
    known: dict[str, list[str]] = {}
    held: list[dict[str, int]] = [{}, {}]
    for bag, y in zip(bags, labels.tolist()):
        seen: set[str] = set()
        for w in set(bag.split()):
            seen.update(known.get(w) or known.setdefault(w, features(w)))
        counts = held[y > 0]
        for f in seen:
            counts[f] = counts.get(f, 0) + 1
    share = float((labels > 0).mean()) if len(labels) else 0.0
    scored = []
    for f, n in held[1].items():
        expected = share * (n + held[0].get(f, 0))
        if n >= MIN_DOCS and n - expected >= LEAST_Z * expected**0.5:
            scored.append((-(n - expected) / expected**0.5, f))
    return {f: k for k, (_, f) in enumerate(sorted(scored)[:MOST_FEATURES])}


def fit(bags: list[str], labels: np.ndarray, steps: int = STEPS) -> tuple[float, dict[str, float]]:
    """Bias and feature weights that lower the noisy-or log loss, by Adam on the whole sample."""
    index = informative(bags, labels)
    of_word: dict[str, list[int]] = {}
    document_of, sentence_of, held = [], [], []
    n_sentences = 0
    for d, bag in enumerate(bags):
        for s in bag.split("\n") if bag else ():
            document_of.append(d)
            for w in s.split(" "):
                if w not in of_word:
                    of_word[w] = [index[f] for f in features(w) if f in index]
                held += of_word[w]
                sentence_of += [n_sentences] * len(of_word[w])
            n_sentences += 1
    document_of = np.array(document_of, np.int64)
    sentence_of, held = np.array(sentence_of, np.int64), np.array(held, np.int64)
    # as in scoring, a sentence without a known feature has no share
    heard = np.bincount(sentence_of, minlength=n_sentences) > 0
    weights = np.zeros(len(index))
    y = labels.astype(float)
    # both classes weigh alike
    balance = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    first, second = np.zeros(len(index)), np.zeros(len(index))
    for t in range(1, steps + 1):
        z = BIAS + np.bincount(sentence_of, weights[held], minlength=n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        total = np.bincount(document_of, np.where(heard, np.logaddexp(0, z), 0.0), minlength=len(y))
        safe = np.maximum(total, 1e-9)
        slope = balance * np.where(y > 0, -np.exp(-safe) / -np.expm1(-safe), 1.0)
        pull = slope[document_of] * p
        gradient = np.bincount(held, pull[sentence_of], minlength=len(index)) / len(y) + RIDGE * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        weights -= STEP * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return BIAS, {f: float(weights[k]) for f, k in index.items() if abs(weights[k]) >= LEAST_WEIGHT}


def learnt(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic") -> tuple[float, dict[str, float], float | None]:
    """Bias, weights, and the constant score where there is only one class."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_t_id")).agg(F.max(label).alias("toxic"))
    n, positive = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or positive in (0, n):
        return 0.0, {}, float(positive / n) if n else 0.0
    share = min(1.0, sample / n)
    known = known.where(F.pmod(F.xxhash64("_t_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # an id repeats in documents at will: one text for each id
    texts = docs.select(F.col(id_column).alias("_t_id"), F.col(text_column).cast("string").alias("text")).join(known, "_t_id").groupBy("_t_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    # copies would count as independent evidence
    texts = texts.where("text is not null").groupBy("text").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = texts.mapInPandas(_bags, "toxic int, bag string").orderBy(F.xxhash64("bag"), "toxic").toPandas()
    bias, weights = fit(list(rows["bag"]), rows["toxic"].to_numpy())
    return bias, weights, None


def _scorer(bias: float, weights: dict[str, float], constant: float | None):
    memo: dict[str, float] = {}

    def weight(word: str) -> float:
        if len(memo) > MEMO:
            memo.clear()
        memo[word] = x = sum(weights.get(f, 0.0) for f in features(word))
        return x

    def score(text: str) -> tuple[float, list[dict]]:
        total, offending = 0.0, []
        for m in SENTENCE.finditer(text):
            z = bias
            for w in {*words(m.group())}:
                x = memo.get(w)
                z += weight(w) if x is None else x
            # nothing known speaks: no share in the score
            if z == bias:
                continue
            loud = max(z, 0) + math.log1p(math.exp(-abs(z)))
            total += loud
            p = -math.expm1(-loud)
            if p >= OFFENDING:
                offending.append({"start": m.start(), "end": m.end(), "score": p})
        return (-math.expm1(-total) if constant is None else (constant if text else 0.0)), offending

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            scored = [score(t) for t in part.pop("_t_text")]
            yield part.assign(score=[s for s, _ in scored], offending=[o for _, o in scored])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, carry: list[str], sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``carry`` columns with ``score`` and ``offending``: (start, end, score) of each sentence that scores OFFENDING or more."""
    bias, weights, constant = learnt(docs, labels, sample, id_column, text_column)
    carry = [c for c in carry if c not in ("score", "offending")]
    given = docs.select(*carry, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_t_text"))
    schema = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in carry)
    return given.mapInPandas(_scorer(bias, weights, constant), f"{schema}, score double, offending array<struct<start:int,end:int,score:double>>")


def third(id_column: str) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3
