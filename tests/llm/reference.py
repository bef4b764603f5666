"""Plain Python models of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def distinct(rows, width=5, similarity=0.8):
    """Positions of the (id, text) rows that stay: the first of each group of linked texts, all pairs compared."""
    n = len(rows)
    order = sorted(range(n), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    sets = [set(shingles(t, width)) for _, t in rows]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            same = (rows[a][1] or "") == (rows[b][1] or "")
            near = len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
            if same or near:
                root[find(a)] = find(b)
    seen, stays = set(), []
    for k in order:
        if find(k) not in seen:
            seen.add(find(k))
            stays.append(k)
    return sorted(stays)


def simhash(text, width=4):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, width)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, budget=4):
    """{id: smallest reachable id} by union-find over all pairs."""
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= budget:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
    }


def substring_dedup(texts, width=400):
    """[(n_bytes, n_removed, n_spans, kept_sha256)] for texts of one corpus."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def mahalanobis(x, used, quality):
    """Squared distance of each row of ``x`` (in units) from the robust estimate of the ``used`` ones."""
    import numpy as np

    floors = np.diag(np.array(list(quality.FLOORS.values())) ** 2)
    factor = quality.consistency(quality.COVERAGE, 4)

    def middle(v):
        bins = np.sort(np.floor(v / quality.MIDDLE))
        return (bins[-(-len(bins) // 2) - 1] + 0.5) * quality.MIDDLE

    y, part = x / quality.UNIT, x[used]
    centre = np.array([middle(part[:, i]) for i in range(4)])
    spread = np.array([middle(np.abs(part[:, i] - centre[i])) for i in range(4)])
    found = []
    for mean, cov in ((y[used].mean(axis=0), np.cov(y[used].T, bias=True) + floors), (centre / quality.UNIT, np.diag((quality.NORMAL * spread / quality.UNIT) ** 2) + floors)):
        least = np.inf
        while True:
            d = np.einsum("ij,jk,ik->i", y - mean, np.linalg.inv(cov), y - mean)
            bins = np.minimum(np.floor(np.log2(d + 1) * quality.BINS), quality.BINS * 64)
            inside = used & (bins <= np.sort(bins[used])[int(np.ceil(used.sum() * quality.COVERAGE)) - 1])
            mean, cov = y[inside].mean(axis=0), factor * np.cov(y[inside].T, bias=True) + floors
            now = np.linalg.slogdet(cov)[1]
            if now < least:
                best = (now, mean, cov)
            if not now < least - quality.SETTLED:
                break
            least = now
        found.append(best)
    _, mean, cov = min(found, key=lambda f: f[0])
    return np.einsum("ij,jk,ik->i", y - mean, np.linalg.inv(cov), y - mean)


def passages(texts, size=256, words=50):
    """Maximal runs of repeated ``size``-byte strings that hold more than ``words`` words, for each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        spans = []
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + size
                else:
                    spans.append([i, i + size])
        out.append([(a, b) for a, b in spans if len(d[a:b].split()) > words])
    return out


def top_k(vectors, k=5):
    """{query: [(id, score)]} with floor(256 x) components; queries are ids divisible by 50."""
    import math

    live = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q, v in live.items():
        if q % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in live.items() if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out
