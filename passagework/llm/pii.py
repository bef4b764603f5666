"""Personal data by bootstrapped contextual extraction.

1. Seeds: regular expressions find e-mail addresses, IP addresses, card and
   phone numbers in whole texts (``base_spans``).  They are fixed results.
2. Each seed, and each other token (or row of number-like tokens) with a digit or an
   ``@`` and at least ``LEAST_LENGTH`` characters, is a candidate with a lexical
   context: the two words before it, and the word after it, as two one-sided
   patterns.  A pattern is (side, context words, kinds of characters in the candidate).
3. Spark scores the bipartite graph of patterns and instances (an instance is a
   candidate's text).  Instances start at 1 for seeds and 0 for others.  A pattern's
   score is the share of its instances that are believed to be of its kind, shrunk by
   ``PRIOR`` pseudo-misses; it is reliable from ``CONFIDENT`` on, with at least
   ``SUPPORT`` different believed instances.  An instance's belief is the noisy-or of
   its reliable patterns; from ``CONFIDENT`` on it is an identifier, and supports
   patterns itself.  What is believed stays so, and rounds go on until nothing new is.
4. All places of the identifiers found are added with their kind, unless they overlap a
   base span.

Every step aggregates by pattern or by instance after a partial aggregation, so
that a frequent pattern is one row for each task, and no group is gathered.
Instances and context words over ``LONG`` characters are known by their digests.

Defined cases: null text is empty and has no span; texts without a candidate
appear with empty spans; repeated rows and equal ids keep one row each; offsets
are code points with exclusive ends; an empty table gives an empty result;
extra columns are left to the caller (``carry`` names what is kept).  Scans of a text
take time in proportion to its length, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, settle

KINDS = ("email", "ip", "card", "phone")
PRIOR = 1.0
CONFIDENT = 0.8
SUPPORT = 5

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits starts, and takes whole runs.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A token that may be an identifier: it has a digit or an @.
TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
NUMBER_LIKE = re.compile(r"[0-9()+./-]+")
LEAST_LENGTH = 6
LONG = 64
EDGE = ".,;:!?\"'()[]{}<>#*$%&|="
SPACE = frozenset(SPACE_CHARS)
LETTER = re.compile(r"[^\W\d_]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of a local part, @ and a dotted domain, without a scan of words that have no @."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_PART:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of KINDS, then of start."""
    found = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return found


def character_kinds(token: str) -> str:
    """@ for a token that holds one, else 9a with a letter, else 9."""
    return "@" if "@" in token else "9a" if LETTER.search(token) else "9"


def known_as(text: str) -> str:
    return text if len(text) <= LONG else "#" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def words_before(text: str, at: int, n: int = 2) -> str:
    """The ``n`` words, or as many as there are, that end before white space at ``at``; in lower case."""
    words: list[str] = []
    while len(words) < n:
        end = at
        while end and text[end - 1] in SPACE:
            end -= 1
        if end == at or not end:
            break
        at = end
        while at and text[at - 1] not in SPACE:
            at -= 1
        words.insert(0, known_as(text[at:end].lower()))
    return " ".join(words)


def word_after(text: str, at: int) -> str:
    start = at
    while start < len(text) and text[start] in SPACE:
        start += 1
    if start == at:
        return ""
    end = start
    while end < len(text) and text[end] not in SPACE:
        end += 1
    return known_as(text[start:end].lower())


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an @; those of digits and their marks, set apart by one space, are one."""
    held = None
    for m in TOKEN.finditer(text):
        a, b = m.span()
        number = NUMBER_LIKE.fullmatch(text, a, b) is not None
        if held and number and a == held[1] + 1 and text[held[1]] == " ":
            held = (held[0], b)
            continue
        if held:
            yield held
        held = (a, b) if number else None
        if not number:
            yield a, b
    if held:
        yield held


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str | None, str, str, str, str]]:
    """(start, end, seed kind or None, token, kinds of characters, words before, word after) of seeds and other tokens."""
    out: list[tuple[int, int, str | None]] = sorted((a, b, k) for k, a, b in base)
    covered = [(a, b) for a, b, _ in out]
    i = reach = 0
    for a, b in tokens(text):
        while a < b and text[a] in EDGE:
            a += 1
        while b > a and text[b - 1] in EDGE:
            b -= 1
        # base spans ascend by start: those that start before the token's end reach as far as the farthest of them
        while i < len(covered) and covered[i][0] < b:
            reach = max(reach, covered[i][1])
            i += 1
        if b - a >= LEAST_LENGTH and reach <= a:
            out.append((a, b, None))
    return [(a, b, k, known_as(text[a:b]), character_kinds(text[a:b]), words_before(text, a), word_after(text, b)) for a, b, k in out]


FOUND = "spans array<struct<kind:string,start:int,end:int>>, near array<struct<start:int,end:int,kind:string,token:string,shape:string,before:string,after:string>>"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        spans, near = [], []
        for text in part.pop("_p_text"):
            base = base_spans(text)
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            near.append([dict(zip(("start", "end", "kind", "token", "shape", "before", "after"), row)) for row in candidates(text, base)])
        yield part.assign(spans=spans, near=near)


def scan(docs: DataFrame, text_column: str, carry: list[str]) -> DataFrame:
    """``carry`` columns with ``spans`` (base) and ``near`` (candidates with contexts) of each whole text."""
    given = docs.select(*carry, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_p_text"))
    schema = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in carry)
    return given.mapInPandas(_scan, f"{schema}, {FOUND}")


def pattern(side: str, of: str = "c") -> Column:
    """Key of the one-sided pattern; null where the candidate has no word there."""
    return F.when(F.col(f"{of}.{side}") != "", F.concat(F.lit(f"{side}|"), F.col(f"{of}.{side}"), F.lit("|"), F.col(f"{of}.shape")))


def graph(found: DataFrame) -> DataFrame:
    """Edges (pattern, token, kind) of the whole corpus, each once; ``kind`` is that of a seed, or null."""
    edges = found.select(F.explode("near").alias("c")).select("c.token", "c.kind", F.explode(F.array(pattern("before"), pattern("after"))).alias("pattern"))
    return edges.where("pattern is not null").groupBy("pattern", "token").agg(F.max("kind").alias("kind"))


def believed_instances(edges: DataFrame, prior: float = PRIOR, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """(token, kind) of the identifiers that are no seeds, after rounds of scoring until no new one is found."""
    # a pattern with fewer instances can never be reliable; most are such, and drop out before any join
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    edges = settle(edges.join(sizes, "pattern"), "pii-edges")
    seeds = edges.where("kind is not null").groupBy("token").agg(F.max("kind").alias("kind"))
    believed = settle(seeds.withColumn("seed", F.lit(True)), "pii-believed")
    while True:
        votes = [F.count(F.when(F.col("by") == k, 1)).alias(k) for k in KINDS]
        met = edges.join(believed.select("token", F.col("kind").alias("by")), "token").groupBy("pattern", "n").agg(*votes)
        best = F.greatest(*(F.struct(F.col(k).alias("votes"), F.lit(-i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)))
        scored = met.select("pattern", best.alias("best"), "n").select("pattern", "best.kind", "best.votes", (F.col("best.votes") / (F.col("n") + prior)).alias("score"))
        reliable = scored.where((F.col("votes") >= support) & (F.col("score") >= confident))
        unknown = edges.where("kind is null").select("pattern", "token").join(believed.select("token"), "token", "left_anti")
        belief = (
            unknown.join(reliable, "pattern")
            .groupBy("token")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("belief"), F.max(F.struct("score", "kind"))["kind"].alias("kind"))
        )
        new = settle(belief.where(F.col("belief") >= confident).select("token", "kind", F.lit(False).alias("seed")), "pii-new")
        if new.isEmpty():
            return believed.where(~F.col("seed")).select("token", "kind")
        believed = settle(believed.unionByName(new), "pii-believed")


def personal_data(docs: DataFrame, text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all unless given) with ``base`` and ``spans``: arrays of (kind, start, end), by kind, then start.

    ``spans`` holds the base spans and those of the identifiers that confident patterns find.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("base", "spans")]
    names = [f"_p_{i}" for i in range(len(carry))]
    renamed = docs.select(*(F.col(c).alias(n) for c, n in zip(carry, names)), F.col(text_column).alias("_p_given"))
    row_id = "_p_row"
    found = settle(scan(renamed.withColumn(row_id, F.monotonically_increasing_id()), "_p_given", [*names, row_id]), "pii-scan")
    identifiers = believed_instances(graph(found))
    near = found.select(row_id, F.explode("near").alias("c")).where("c.kind is null").select(row_id, "c.start", "c.end", "c.token")
    added = near.join(identifiers, "token").groupBy(row_id).agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    # few rows gain spans: written first, their size is known, and the texts move only if it is large
    added = settle(added, "pii-added")
    ranked = F.array_sort(
        F.transform(
            F.concat("spans", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))),
            lambda x: F.struct(F.array_position(F.array(*(F.lit(k) for k in KINDS)), x["kind"]).alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")),
        )
    )
    every = F.transform(ranked, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.join(added, row_id, "left").select(*(F.col(n).alias(c) for c, n in zip(carry, names)), F.col("spans").alias("base"), every.alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def without_spans(text: str, spans: list) -> str:
    """``text`` with each run of overlapping (start, end, kind) spans replaced by [KIND] of its first."""
    pieces, at = [], 0
    for start, back, kind in sorted((s, -e, k) for s, e, k in spans):
        if start >= at:
            pieces += [text[at:start], "[", kind.upper(), "]"]
        at = max(at, -back)
    return "".join([*pieces, text[at:]])


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans replaced by [KIND] of its first span; in time that grows with the text alone."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or x is None or not len(x) else without_spans(t, [(s["start"], s["end"], s["kind"]) for s in x]) for t, x in zip(texts, found)], dtype=object)

    return cut(text, spans)
