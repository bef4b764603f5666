"""Repeated substrings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a ``width``-byte string that covers it also starts elsewhere.  The
same sort marks ``passages``: maximal runs of repeated ``passage``-byte strings
that hold more than ``PASSAGE_WORDS`` words; nothing of them is removed.

Only suffixes at anchors are sorted.  A window of bytes has as its anchor the
least hash of ``GRAM`` bytes in its first ``HEAD`` bytes, the leftmost if several
are least; equal windows have their anchor at the same place.  What decides the
windows of an anchor is its context: the ``width`` bytes from it on, then the
bytes before it backwards, HEAD - GRAM of them.  All windows of an anchor share
its first ``passage - HEAD + GRAM`` bytes.

1. Documents are dealt into blocks of about BLOCK_BYTES, once; all steps read
   that same shuffle.
2. As in string sorting with distinguishing prefixes, hashes of shared parts are
   exchanged first, as rows, each once a block: those of the beginnings, and where these
   occur twice, those of the bytes that each ``STEP`` neighbouring windows of the
   anchor share.  A suffix with no such part that occurs twice cannot be part of a
   repeat, and is not sent at all.
3. A block sorts the contexts of the others into runs, one for each group of
   beginnings, equal contexts once, and sends each run front-coded: the lengths of
   the prefixes shared with the one before, and the rests, in one compressed row.
4. A group (sized so that about GROUP_BYTES of text belong to it) combines its
   runs by a loser tree over (common prefix, string): two heads with different
   common prefixes with the last winner need no look at their bytes, and others
   are compared behind the common prefix only.  The tree also yields the common
   prefix of each output with the one before it.
5. In that order the contexts with equal beginnings of any length are neighbours.
   For each possible distance of the window's start before the anchor, contexts
   that agree in the bytes on both sides are repeats; ranks by common prefixes of
   both sides tell that, not hashes.  The repeated windows of an anchor overlap,
   so they make one interval.
6. The intervals, a row each, go back to the blocks.

Rows follow the data alone, not the partitions: distinct shared parts of a block,
runs (never more than contexts with a repeated beginning, nor than pairs of a block and a
group, which bytes of text size), and intervals.

Contexts that a block holds twice are repeats: the block settles their places by
itself, and sends such a context once, as a partner for other blocks.  A
beginning that occurs more than ``most_places`` times would still bring many
different contexts (around a passage that very many documents share) to one
group.  Those of its windows whose shared part occurs twice are dealt by their own
128-bit BLAKE2 digests instead, each once a block, so that no group grows with the
number of documents that share a passage.

Defined cases: null text is empty; texts under ``width`` bytes lose nothing;
repeated rows are other places like any; null or equal ids keep a row each; an
empty table gives an empty result; extra columns are ignored.  Texts are UTF-8,
so the byte 255 never occurs in them, and pads contexts at a text's ends.  Rows
are numbered by partition and order: the input must read the same when it is read
again, as tables do (``settle`` others first).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, shuffle_width
from .packed import pack_bytes, unpack_bytes

WIDTH, PASSAGE = 400, 256
PASSAGE_WORDS = 50
HEAD = 128
GRAM = 8
PAD = 255
#: Odd multipliers of the hashes of bytes.
STIR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text of a block and of a group on average, and places whose hashes are held at once.
BLOCK_BYTES, GROUP_BYTES, PIECE = 8 << 20, 8 << 20, 1 << 20
MOST_PLACES = 4096
#: Neighbouring windows of an anchor that have a shared part of their own.
STEP = 32
#: Groups of windows, and intervals that are settled already, are numbered below zero.
WINDOWS, SETTLED = -(1 << 40), -1
PLACE = np.dtype([("hash", "V16"), ("row", "<i8"), ("start", "<u4"), ("width", "<u4"), ("twice", "u1")])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * STIR
    return x ^ (x >> np.uint64(32))


class Texts:
    """Texts of a block in one buffer; windows of the least of ``widths`` have anchors, contexts reach the greatest."""

    def __init__(self, texts: list[bytes], widths: tuple[int, ...] = (WIDTH, PASSAGE)):
        self.widths, self.least, self.width, self.texts = widths, min(widths), max(widths), texts
        self.head = min(HEAD, self.least)
        self.back = self.head - GRAM
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        data = b"".join(texts) + bytes(GRAM)
        self.size = len(data) - GRAM
        self.words = np.ndarray((self.size + 1,), "<u8", data, strides=(1,))

    def anchors(self) -> np.ndarray:
        """Places of the anchors of all windows, ascending; a piece of the buffer at a time."""
        counts = np.maximum(self.lengths - self.least + 1, 0)
        full = np.flatnonzero(counts)
        edge = np.zeros(self.size + 1, np.int8)
        edge[self.starts[full]] += 1
        edge[self.starts[full] + counts[full]] -= 1
        inside = np.cumsum(edge, dtype=np.int8).astype(bool)
        grams = self.head - GRAM + 1
        found, last = [], -1
        for at in range(0, self.size, PIECE):
            begin = np.flatnonzero(inside[at : at + PIECE])
            if not len(begin):
                continue
            words = self.words[at : min(at + PIECE + grams, self.size)]
            key = (mixed(words) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(words), dtype=np.uint64)
            reach = 1
            while reach * 2 <= grams:
                key = np.minimum(key[:-reach], key[reach:])
                reach *= 2
            if reach < grams:
                key = np.minimum(key[: len(key) - (grams - reach)], key[grams - reach :])
            place = (key[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64) + at
            place = place[np.concatenate([place[:1] != last, place[1:] != place[:-1]])]
            if len(place):
                found.append(place)
                last = place[-1]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def beginnings(self, anchors: np.ndarray) -> np.ndarray:
        """Hashes of the bytes that all windows of an anchor share."""
        shared = self.least - self.head + GRAM
        state = np.full(len(anchors), shared, np.uint64)
        for at in [*range(0, shared - GRAM, GRAM), shared - GRAM]:
            state = mixed(state ^ self.words[anchors + at]) * SPREAD
        return state

    def cores(self, anchors: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(least, greatest distance, hashes, whether the text holds them) of what each STEP neighbouring windows share."""
        behind, ahead = anchors - self.starts[owner], self.ends[owner] - anchors
        for low in range(0, self.back + 1, STEP):
            high = min(low + STEP - 1, self.back)
            length = self.least - (high - low)
            state = np.full(len(anchors), length << 16 | low, np.uint64)
            for at in [*range(0, length - GRAM, GRAM), length - GRAM]:
                state = mixed(state ^ self.words[np.clip(anchors - low + at, 0, self.size)]) * SPREAD
            yield low, high, state, (behind >= low) & (ahead >= self.least - high)

    def context(self, anchor: int, text: int) -> bytes:
        """``width`` bytes forwards, then ``back`` from before the anchor; padded at the text's ends."""
        at, own = anchor - int(self.starts[text]), self.texts[text]
        after, before = own[at : at + self.width], own[max(0, at - self.back) : at][::-1]
        return after.ljust(self.width, b"\xff") + before.ljust(self.back, b"\xff")


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of equally long strings, of which ``known`` bytes are known to agree."""
    n = len(a)
    step = 32
    while known < n:
        if a[known : known + step] != b[known : known + step]:
            while a[known] == b[known]:
                known += 1
            return known
        known += step
    return n


class PrefixLoserTree:
    """Merge runs of (common prefix with the one before, string, payload) without comparing known prefixes again."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs = runs
        self.k = len(runs)
        self.shared, self.strings, self.payloads = [0] * self.k, [None] * self.k, [None] * self.k
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._advance(i)
            self._play(i)

    def _advance(self, i: int) -> None:
        self.shared[i], self.strings[i], self.payloads[i] = next(self.runs[i], (0, None, None))

    def _beats(self, i: int, j: int) -> bool:
        """True if i comes first; the loser's common prefix is then that with the winner."""
        a, b = self.strings[i], self.strings[j]
        if a is None or b is None:
            return b is None and a is not None
        p, q = self.shared[i], self.shared[j]
        if p != q:
            return p > q
        at = common_prefix(a, b, p)
        first = at == len(a) or a[at] < b[at]
        self.shared[j if first else i] = at
        return first

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.k and self.strings[w := self.tree[0]] is not None:
            yield self.shared[w], self.strings[w], self.payloads[w]
            self._advance(w)
            self._play(w)


def front_coded(strings: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the one before, rest) of ascending strings."""
    before = b""
    for k, s in enumerate(strings):
        p = common_prefix(before, s, 0) if k else 0
        yield p, s[p:]
        before = s


def decoded(shared: list[int], rests: bytes, size: int, payloads: list) -> Iterator[tuple[int, bytes, object]]:
    """Strings of ``size`` bytes from their front coding."""
    before, at = b"", 0
    for p, payload in zip(shared, payloads):
        end = at + size - p
        before = before[:p] + rests[at:end]
        at = end
        yield p, before, payload


def _extent(contexts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the text from the anchor on, and before it, that each context holds."""
    return (contexts[:, :width] != PAD).sum(axis=1), (contexts[:, width:] != PAD).sum(axis=1)


def repeats(shared: np.ndarray, contexts: np.ndarray, times: np.ndarray, size: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of a repeated ``size``-byte window's start before the anchor (least > greatest: none).

    ``contexts`` are different, ascending byte rows, ``width`` bytes forwards and the rest
    backwards; ``shared`` their common prefixes with the row before, ``times`` how often each occurs.
    """
    n, back = len(contexts), contexts.shape[1] - width
    ahead, behind = _extent(contexts, width)
    low = np.maximum(0, size - ahead)
    # a context that occurs twice repeats in every window that it holds
    twice = (times > 1) & (behind >= low)
    least, most = np.where(twice, low, back + 1), np.where(twice, behind, -1)
    beginning = shared < size - back
    alone = beginning & np.append(beginning[1:], True)
    left = np.flatnonzero(~alone)
    if not len(left):
        return least, most
    # ranks of the bytes before the anchor: rows that agree in the first a of them are neighbours in this order
    behinds = np.ascontiguousarray(contexts[left, width:])
    by_back = np.array(sorted(range(len(left)), key=[x.tobytes() for x in behinds].__getitem__))
    equal = behinds[by_back[1:]] == behinds[by_back[:-1]]
    agree = np.append(0, np.where(equal.all(axis=1), back, equal.argmin(axis=1)))
    ahead, behind, times = ahead[left], behind[left], times[left]
    n = len(left)
    for a in range(back + 1):
        rows = np.flatnonzero((ahead >= size - a) & (behind >= a))
        if len(rows) < 2:
            continue
        rank = np.empty(n, np.int64)
        rank[by_back] = np.cumsum(agree < a)
        # contexts that agree in the first size - a bytes are neighbours
        key = np.cumsum(shared < size - a)[left[rows]] * (n + 1) + rank[rows]
        order = np.argsort(key)
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        met = np.zeros(len(rows), bool)
        met[order[1:]] |= same
        met[order[:-1]] |= same
        hit = left[rows[met]]
        least[hit] = np.minimum(least[hit], a)
        most[hit] = np.maximum(most[hit], a)
    return least, most


# --- Spark steps; each works on the rows of one key ------------------------------------------------

#: A packed run (part >= 0), packed windows (part <= WINDOWS), or an interval of a width that is settled.
RUNS = "part long, block long, body binary, row long, start long, end long, width int"
BEGINNINGS = "block long, begin long, times long"
#: Kinds of hashes that a block gets back: beginnings in too many places for one group, and shared parts of neighbouring windows that occur twice.
CROWDED, CORE = 0, 1
INTERVALS = "block long, row long, start long, end long, width int"


def _table(schema: str, *columns) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _texts_of(block: pa.Table, widths: tuple[int, ...]) -> tuple[np.ndarray, Texts]:
    """Row numbers and texts of a block, in order of the row numbers: shuffles keep no order."""
    rows = block.column("row").to_numpy()
    order = np.argsort(rows)
    return rows[order], Texts(block.column("text").take(pa.array(order)).to_pylist(), widths)


def _send_beginnings(widths: tuple[int, ...]):
    def run(block: pa.Table) -> pa.Table:
        _, texts = _texts_of(block, widths)
        found, counts = np.unique(texts.beginnings(texts.anchors()), return_counts=True)
        number = block.column("block")[0].as_py()
        return _table(BEGINNINGS, np.full(len(found), number), found.view(np.int64), counts)

    return run


def _settled(held: list[tuple[int, int, int]], context: bytes, widths: tuple[int, ...]) -> Iterator[tuple[int, int, int, int]]:
    """(row, start, end, width) for places of one context that a block holds twice."""
    (ahead,), (behind,) = _extent(np.frombuffer(context, np.uint8)[None, :], max(widths))
    for size in widths:
        low = max(0, size - int(ahead))
        if behind >= low:
            yield from ((row, at - int(behind), at - low + size, size) for row, at, _ in held)


def _window_rows(contexts: dict[bytes, list[tuple[int, int, int]]], groups: int, widths: tuple[int, ...]) -> tuple[dict[int, list], list[tuple[int, int, int, int]]]:
    """A block's windows of crowded beginnings by group: each once, with a place to take out if it turns out to repeat; and settled intervals.

    Places are (row, place, bits of the STEP windows with a repeated shared part).
    """
    width, found = max(widths), {}
    for context, held in contexts.items():
        (ahead,), (behind,) = (x.tolist() for x in _extent(np.frombuffer(context, np.uint8)[None, :], width))
        line, places = context[width : width + behind][::-1] + context[:width], held[:2]
        for size in widths:
            for a in range(max(0, size - ahead), behind + 1):
                if not places[0][2] >> a // STEP & 1:
                    continue
                key = (hashlib.blake2b(line[behind - a : behind - a + size], digest_size=16).digest(), size)
                # a window has several anchors: places count once.  Two of a context show that its windows repeat
                found.setdefault(key, {}).update({(row, at - a): None for row, at, _ in places})
    out: dict[int, list] = {}
    settled = []
    for (key, size), held in found.items():
        first = next(iter(held))
        out.setdefault(int.from_bytes(key[:6], "little") % groups, []).append((key, *first, size, len(held) > 1))
        if len(held) > 1:
            settled += [(r, start, start + size, size) for r, start in held]
    return out, settled


def joined_spans(found: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of intervals that overlap or touch."""
    spans: list[list[int]] = []
    for s, e in sorted(found):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    return spans


def _fewer(intervals: list[tuple[int, int, int, int]], widths: tuple[int, ...]) -> Iterator[tuple[int, int, int, int]]:
    """(row, start, end, width) joined where they overlap; what a wider window covers already is left out."""
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for row, start, end, size in intervals:
        found.setdefault((row, size), []).append((start, end))
    for (row, size), spans in found.items():
        wider = {(s, e) for w in widths if w > size for s, e in joined_spans(found.get((row, w), []))}
        yield from ((row, s, e, size) for s, e in joined_spans(spans) if (s, e) not in wider)


def _within(hashes: np.ndarray, sought: pa.Table) -> np.ndarray:
    """Which hashes are among those sought."""
    every = np.sort(sought.column("begin").to_numpy().view(np.uint64))
    return every[np.minimum(np.searchsorted(every, hashes), len(every) - 1)] == hashes if len(every) else np.zeros(len(hashes), bool)


def _send_cores(widths: tuple[int, ...]):
    def run(block: pa.Table, repeated: pa.Table) -> pa.Table:
        if not block.num_rows or not repeated.num_rows:
            return _table(BEGINNINGS, [], [], [])
        _, texts = _texts_of(block, widths)
        anchors = texts.anchors()
        anchors = anchors[_within(texts.beginnings(anchors), repeated)]
        held = [hashes[valid] for _, _, hashes, valid in texts.cores(anchors, np.searchsorted(texts.ends, anchors, side="right"))]
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        return _table(BEGINNINGS, np.full(len(found), block.column("block")[0].as_py()), found.view(np.int64), counts)

    return run


def _contexts(block: pa.Table, cores: pa.Table, crowded: pa.Table, groups: int, widths: tuple[int, ...]) -> dict[int, dict[bytes, list[tuple[int, int, int]]]]:
    """{group: {context: [(row, place, bits of the repeated parts)]}} of the anchors with one; crowded ones have the group -1."""
    rows, texts = _texts_of(block, widths)
    anchors = texts.anchors()
    owner = np.searchsorted(texts.ends, anchors, side="right")
    bits = np.zeros(len(anchors), np.int64)
    for low, _, hashes, valid in texts.cores(anchors, owner):
        bits |= (valid & _within(hashes, cores)).astype(np.int64) << (low // STEP)
    anchors, owner, bits = anchors[bits > 0], owner[bits > 0], bits[bits > 0]
    begin = texts.beginnings(anchors)
    group = np.where(_within(begin, crowded), -1, (mixed(begin) >> np.uint64(1)).astype(np.int64) % groups)
    held: dict[int, dict[bytes, list[tuple[int, int, int]]]] = {}
    for g, a, o, *place in zip(*(x.tolist() for x in (group, anchors, owner, rows[owner], anchors - texts.starts[owner], bits))):
        held.setdefault(g, {}).setdefault(texts.context(a, o), []).append(tuple(place))
    return held


def _send_runs(groups: int, widths: tuple[int, ...]):
    def run(block: pa.Table, wanted: pa.Table) -> pa.Table:
        if not block.num_rows or not wanted.num_rows:
            return _table(RUNS, *[[]] * 7)
        is_core = pa.compute.equal(wanted.column("kind"), CORE)
        held = _contexts(block, wanted.filter(is_core), wanted.filter(pa.compute.invert(is_core)), groups, widths)
        number = block.column("block")[0].as_py()
        crowd = held.pop(-1, {})
        out: list[tuple] = []
        for g, places in held.items():
            strings = sorted(places)
            coded = list(front_coded(strings))
            first = [places[x][0] for x in strings]
            body = pack_bytes(
                np.array([p for p, _ in coded], "<u2").tobytes(),
                b"".join(rest for _, rest in coded),
                np.array([min(2, len(places[x])) for x in strings], "u1").tobytes(),
                np.array([r for r, _, _ in first], "<i8").tobytes(),
                np.array([p for _, p, _ in first], "<u4").tobytes(),
            )
            out.append((g, number, body, None, None, None, None))
        windows, settled = _window_rows(crowd, groups, widths)
        out += [(WINDOWS - g, number, pack_bytes(np.array(x, PLACE).tobytes()), None, None, None, None) for g, x in windows.items()]
        for places in (crowd, *held.values()):
            for context, twice in places.items():
                if len(twice) > 1:
                    settled += _settled(twice, context, widths)
        out += [(SETTLED - number, number, None, *x) for x in _fewer(settled, widths)]
        return _table(RUNS, *(zip(*out) if out else [[]] * 7))

    return run


def _merge_group(widths: tuple[int, ...]):
    width = max(widths)
    size = width + min(HEAD, min(widths)) - GRAM

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        if SETTLED >= part > WINDOWS:
            return group.select(["block", "row", "start", "end", "width"])
        block = group.column("block").to_numpy()
        if part <= WINDOWS:
            found = [np.frombuffer(unpack_bytes(b.as_py())[0], PLACE) for b in group.column("body")]
            every = np.concatenate(found)
            _, at = np.unique(every["hash"], return_inverse=True)
            hit = np.bincount(at, 1 + every["twice"])[at] > 1
            every, block = every[hit], np.repeat(block, [len(f) for f in found])[hit]
            start, wide = every["start"].astype(np.int64), every["width"].astype(np.int64)
            made = [(b, *x) for b in np.unique(block).tolist() for x in _fewer(list(zip(*(y[block == b].tolist() for y in (every["row"], start, start + wide, wide)))), widths)]
            return _table(INTERVALS, *(zip(*made) if made else [[]] * 5))
        runs, owners, places, often, base = [], [], [], [], 0
        for body in group.column("body"):
            shared, rests, times, rows, at = unpack_bytes(body.as_py())
            often += list(times)
            owners.append(np.frombuffer(rows, "<i8"))
            places.append(np.frombuffer(at, "<u4").astype(np.int64))
            runs.append(decoded(np.frombuffer(shared, "<u2").tolist(), rests, size, list(range(base, len(often)))))
            base = len(often)
        prefixes, strings, times, context_of = [], [], [], np.empty(base, np.int64)
        for p, s, k in PrefixLoserTree(runs):
            if not strings or p < size:
                prefixes.append(p if strings else 0)
                strings.append(s)
                times.append(0)
            times[-1] += often[k]
            context_of[k] = len(strings) - 1
        contexts = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), size)
        row, place, block = np.concatenate(owners), np.concatenate(places), np.repeat(block, [len(x) for x in owners])
        made, outer = [], None
        for w in sorted(widths, reverse=True):
            least, most = (x[context_of] for x in repeats(np.array(prefixes), contexts, np.array(times), w, width))
            start, end = place - most, place - least + w
            kept = least <= most
            if outer is not None:  # what a wider window covers already is left out
                kept &= ~(outer[0] & (outer[1] <= start) & (end <= outer[2]))
            outer = (least <= most, start, end) if outer is None else outer
            made.append(_table(INTERVALS, block[kept], row[kept], start[kept], end[kept], np.full(int(kept.sum()), w, np.int32)))
        return pa.concat_tables(made)

    return run


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, passages array<struct<start:long,end:long>>"


def _removed(with_bytes: bool, width: int, passage: int | None):
    def run(block: pa.Table, intervals: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r, s, e, w in zip(*(intervals.column(c).to_pylist() for c in ("row", "start", "end", "width"))):
            found.setdefault((r, w), []).append((s, e))
        out = []
        for id_, row, text in zip(*(block.column(c).to_pylist() for c in ("id", "row", "text"))):
            spans = joined_spans(found.get((row, width), []))
            cuts = [0, *(x for span in spans for x in span), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
            # wider windows are made of repeated narrower ones
            passages = [] if passage is None else [{"start": a, "end": b} for a, b in joined_spans([x for w in {width, passage} for x in found.get((row, w), [])]) if len(text[a:b].split()) > PASSAGE_WORDS]
            out.append((id_, len(text), len(text) - len(kept), len(spans), kept if with_bytes else None, hashlib.sha256(kept).hexdigest(), passages))
        columns = list(zip(*out)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table(dict(zip(("id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "passages"), (pa.array(c, t) for c, t in zip(columns, kinds)))))

    return run


def without_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    with_bytes: bool = True,
    most_places: int = MOST_PLACES,
    passage: int | None = PASSAGE,
    block_bytes: int = BLOCK_BYTES,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256, passages) of each row.

    ``kept`` is null unless ``with_bytes``.  ``passages`` are byte ranges of repeated runs of over
    PASSAGE_WORDS words and at least ``passage`` bytes, at most ``width``; none if ``passage`` is None.
    """
    if passage is not None and not GRAM <= passage <= width:
        raise ValueError("passage must not exceed width")
    widths = (width,) if passage in (None, width) else (width, passage)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    given = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, groups = 1 + total // block_bytes, 1 + total // group_bytes
    n = max(shuffle_width(docs.sparkSession), 1 + blocks // 16)
    dealt = given.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).repartition(n, "block")

    def twice(hashes: DataFrame) -> DataFrame:
        return hashes.withColumn("places", F.sum("times").over(Window.partitionBy("begin"))).where("places > 1")

    # written, as it is read twice
    beginnings = settle(twice(dealt.groupBy("block").applyInArrow(_send_beginnings(widths), BEGINNINGS)).select("block", "begin", "places"), "suffix-beginnings")
    cores = twice(dealt.groupBy("block").cogroup(beginnings.groupBy("block")).applyInArrow(_send_cores(widths), BEGINNINGS))
    crowded = beginnings.where(F.col("places") > most_places).select("block", "begin", F.lit(CROWDED).alias("kind"))
    wanted = cores.select("block", "begin", F.lit(CORE).alias("kind")).unionByName(crowded)
    runs = dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_send_runs(groups, widths), RUNS)
    intervals = runs.groupBy("part").applyInArrow(_merge_group(widths), INTERVALS)
    return dealt.groupBy("block").cogroup(intervals.groupBy("block")).applyInArrow(_removed(with_bytes, width, passage), RESULT)
