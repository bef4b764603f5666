"""SimHash near-duplicates by a binary trie self-join.

1. ``fingerprints``: 64 majority bits of the XXH64 of each text's word shingles.
2. Equal fingerprints are one trie leaf, named by its smallest document id.
3. Two leaves at most ``budget`` bits apart agree on at least two of six blocks
   of bits (budget 4).  Each leaf is dealt out by one block, to all but the last,
   and the task refines what it gets by each later block: five rows are shuffled
   for the 15 subtrees that two blocks select.  ``trie_links`` walks each subtree
   against itself: pairs of nodes go down together, their differing bits add up,
   and a pair over the budget is pruned with all below it; nodes of at most
   ``BUCKET`` leaves are not split, their leaves are compared.  With so many leaves
   that two blocks would leave more than ``MOST_SHARED`` in a subtree, smaller
   blocks of which three or more agree are taken instead.  Where more than
   ``MOST_LEAVES`` leaves share a block they are dealt out by all those blocks, and
   where they share all anew by the blocks of their other bits; after three
   pairs of blocks at most 2^19 distinct leaves can share a subtree.
4. A task gives each leaf one link to the smallest id of its own links' group,
   never all pairs; ``components`` joins those links over all subtrees.

``distinct_documents`` keeps one document of each group whose texts are equal or are
joined by links of a ``similarity`` of word shingles that is verified; the tries of several
fingerprints offer the links, so a similar pair is missed only if it is over the budget in all of them.

Defined cases: null or empty text and text of white space only have fingerprint
zero and link like any other; fewer words than a shingle make one shingle of all
words; repeated rows share their component; a null id gets a fingerprint and the
component of its equals, and never names a component; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, shuffle_width
from .components import components

SHINGLE = 4
BUDGET = 4
SEED = 42
MOST_LEAVES = 1 << 18
#: Shingle hashes whose bits are counted at once, node pairs that are expanded at once, leaves that are walked at once, leaves
#: that are compared at once.
COUNT_BATCH, PAIR_BATCH, WALK_BATCH, ROW_BATCH = 1 << 17, 1 << 20, 1 << 16, 1 << 14
#: Nodes of at most so many leaves are not split: to compare two leaves takes far less than to split two nodes.
BUCKET = 256
#: With more leaves than this in the subtrees of even fingerprints, comparing them would take longer than to sort leaves into more subtrees.
MOST_SHARED = 512


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``width`` words, A-Z lowered; bytes.split() divides at U+0020 and U+0009 to U+000D."""
    words = (text or b"").lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda total, n: total + 1 + n))
    digest = xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends)]
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]


#: A byte's bits, each in a byte of its own: sums of up to 255 of them do not run over.
SPREAD = np.array([sum(1 << 8 * j for j in range(8) if b >> j & 1) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits set in over half of each run of hashes; an empty run gives 0."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    # runs in parts of 255 at most, whose eight counts at a time are bytes of one number
    parts = (sizes + 254) // 255
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(sizes) - sizes - 255 * first, parts) + 255 * np.arange(parts.sum())
    octets = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    over = np.empty((len(full), 8), np.uint8)
    for k in range(8):
        counts = np.add.reduceat(SPREAD[octets[k]], starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(counts, first, axis=0, dtype=np.int64)
        over[:, k] = np.packbits(2 * total > sizes[:, None], axis=1, bitorder="little")[:, 0]
    out[full] = over.view("<u8").ravel()
    return out


def _fingerprint_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held, sizes = [], [], []
            for text in batch.column(1):
                held_now = shingle_hashes(text.as_py(), width)
                held += held_now
                sizes.append(len(held_now))
                if len(held) >= COUNT_BATCH:
                    done.append(majority(np.array(held, np.uint64), np.array(sizes, np.int64)))
                    held, sizes = [], []
            done.append(majority(np.array(held, np.uint64), np.array(sizes, np.int64)))
            prints = np.concatenate(done).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed long with the same bits."""
    given = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    return given.mapInArrow(_fingerprint_batches(width), "id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _compared(fp: np.ndarray, nodes: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked leaves (as positions) of pairs of nodes ``[a0, a2) x [b0, b2)``, or of a node with itself: leaf by leaf."""
    wide = nodes[1] - nodes[0]
    for part in np.split(np.arange(nodes.shape[1]), np.flatnonzero(np.diff(np.cumsum(wide) // ROW_BATCH)) + 1):
        a0, _, b0, b2, _ = nodes[:, part]
        rows = wide[part]
        i = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows - a0, rows)
        at = np.where(np.repeat(a0 == b0, rows), i + 1, np.repeat(b0, rows))
        left = np.repeat(b2, rows) - at
        # those with most to be compared with come first: at each step the others are a tail that is done
        order = np.argsort(-left, kind="stable")
        i, at = i[order], at[order]
        own, going = fp[i], len(left) - np.cumsum(np.bincount(left))
        found = []
        for k, n in enumerate(going[:-1]):
            near = np.flatnonzero(popcount(own[:n] ^ fp[at[:n] + k]) <= budget)
            if len(near):
                found.append((i[near], at[near] + k))
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))


def _walk(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked leaves (as positions) of the subtrees [lo, hi) of ascending ``fp``, a batch at a time."""
    ones = {}

    def split(d: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((fp >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)])
        return b - (ones[d][b] - ones[d][a])

    big = hi - lo > 1
    nodes = np.stack([lo[big], hi[big], lo[big], hi[big], np.zeros(int(big.sum()), np.int64)])
    stack = [(0, nodes)]
    while stack:
        d, n = stack.pop()
        few = (np.maximum(n[1] - n[0], n[3] - n[2]) <= BUCKET) | (d == 64)
        yield from _compared(fp, n[:, few], budget)
        n = n[:, ~few]
        if not n.shape[1]:
            continue
        if n.shape[1] > PAIR_BATCH:
            half = n.shape[1] // 2
            stack += [(d, n[:, :half]), (d, n[:, half:])]
            continue
        a0, a2, b0, b2, cost = n
        a1, b1 = split(d, a0, a2), split(d, b0, b2)
        same = a0 == b0
        below = np.concatenate(
            [
                np.stack([a0, a1, b0, b1, cost]),
                np.stack([a1, a2, b1, b2, cost]),
                np.stack([a0, a1, b1, b2, cost + 1]),
                np.stack([a1, a2, b0, b1, cost + 1])[:, ~same],
            ],
            axis=1,
        )
        stack.append((d + 1, below[:, (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= budget)]))


def _united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels (first positions reached) after the positions ``i`` are linked to ``j``."""
    while True:
        apart = label[i] != label[j]
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        a, b = label[i], label[j]
        # labels alone are lowered, which takes along all that have them: a position on its own would leave those behind
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _labels(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf the first position that it reaches inside its subtree, and the number of its own links there."""
    label, degree = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    for i, j in _walk(fp, lo, hi, budget):
        degree += np.bincount(i, minlength=len(fp)) + np.bincount(j, minlength=len(fp))
        label = _united(label, i, j)
    return label, degree


def trie_links(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each leaf the first position of the leaves that it reaches inside its subtree."""
    return _labels(fp, lo, hi, budget)[0]


def block_masks(free: int, budget: int, agreed: int = 2) -> dict[int, list[int]]:
    """Of ``budget + agreed`` blocks of the bits set in ``free``: the mask of each that has enough later ones, and those of it with ``agreed - 1`` of them."""
    bits = [b for b in range(64) if free >> b & 1]
    blocks = [sum(1 << int(b) for b in block) for block in np.array_split(np.array(bits), budget + agreed)]
    return {a: [a | sum(more) for more in itertools.combinations(blocks[k:], agreed - 1)] for k, a in enumerate(blocks[: budget + 1], 1)}


def agreed_blocks(leaves: int, budget: int) -> int:
    """How many blocks two leaves of a subtree agree on, at least two: so many that even fingerprints leave at most ``MOST_SHARED`` leaves in one."""
    agreed = 2
    while leaves >> 64 * agreed // (budget + agreed) > MOST_SHARED:
        agreed += 1
    return agreed


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _link_batches(budget: int, most: int, walked: dict[int, list[int]]):
    """Rows (mask, key, fp, id, trie) in order of mask, key: links of the subtrees that the ``walked`` masks select, and the rows of larger ones as they are."""

    def links(mask, key, fp, ids) -> pa.RecordBatch:
        fp = fp.view(np.uint64)
        group = np.cumsum(np.concatenate([[False], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
        # bits of its own for each group; should two ever meet, that only compares more leaves
        tag = mixed(group.astype(np.uint64), 1)
        kinds, kind = np.unique(mask, return_inverse=True)
        finer = [walked[int(m)] for m in kinds]
        label, degree = np.arange(len(fp)), np.zeros(len(fp), np.int64)
        for k in range(max(map(len, finer))):
            own = np.flatnonzero(np.array([k < len(x) for x in finer])[kind])
            shared = (fp[own] & np.array([x[k] if k < len(x) else 0 for x in finer], np.uint64)[kind[own]]) ^ tag[own]
            order = np.argsort(shared)
            own, shared = own[order], shared[order]
            lo = np.flatnonzero(np.concatenate([[True], shared[1:] != shared[:-1]]))
            hi = np.append(lo[1:], len(own))
            for a, b in zip(lo[hi - lo > BUCKET], hi[hi - lo > BUCKET]):  # the others are not split
                own[a:b] = own[a:b][np.argsort(fp[own[a:b]])]
            part, links = _labels(fp[own], lo, hi, budget)
            degree[own] += links
            moved = np.flatnonzero(part != np.arange(len(own)))
            label = _united(label, own[moved], own[part[moved]])
        # all refinements of a group give each of its leaves one link, to the leaf that has most of its own: the likeliest to be similar
        order = np.lexsort((ids, -degree, label))
        hub = np.empty(len(fp), np.int64)
        first = order[np.concatenate([[True], label[order][1:] != label[order][:-1]])]
        hub[label[first]] = ids[first]
        root = hub[label]
        out = root != ids
        pairs = np.unique(np.stack([ids[out], root[out]]), axis=1)
        n = pairs.shape[1]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(n, pa.int32())], names=["mask", "fp", "u", "v", "trie"])

    def passed(mask, fp, ids, trie) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(mask), pa.array(fp), pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(trie)], names=["mask", "fp", "u", "v", "trie"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        large = None  # the subtree that is being passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, key, fp, ids, trie = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if large is not None:
                same = int(np.argmin(np.append((mask == large[0]) & (key == large[1]), False)))
                if same:
                    yield passed(mask[:same], fp[:same], ids[:same], trie[:same])
                mask, key, fp, ids, trie = mask[same:], key[same:], fp[same:], ids[same:], trie[same:]
                if not len(mask):
                    continue
                large = None
            held.append([mask, key, fp, ids, trie])
            if sum(len(x[0]) for x in held) < WALK_BATCH:
                continue
            mask, key, fp, ids, trie = (np.concatenate(x) for x in zip(*held))
            last = int(np.flatnonzero((mask != mask[-1]) | (key != key[-1])).max(initial=-1)) + 1
            if last:
                yield links(mask[:last], key[:last], fp[:last], ids[:last])
            mask, key, fp, ids, trie = mask[last:], key[last:], fp[last:], ids[last:], trie[last:]
            held = [[mask, key, fp, ids, trie]]
            if len(mask) > most:
                yield passed(mask, fp, ids, trie)
                large, held = (mask[0], key[0]), []
        if held:
            mask, key, fp, ids, _ = (np.concatenate(x) for x in zip(*held))
            if len(mask):
                yield links(mask, key, fp, ids)

    return run


def leaf_links(leaves: DataFrame, budget: int = BUDGET, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """Links (u, v) among (fp, id) leaves with distinct ``fp``: enough to connect all within ``budget`` bits.

    Leaves with a ``trie`` are those of several tries, which are walked in the same pass: a subtree is one trie's.
    """
    trie = F.col("trie").cast("int") if "trie" in leaves.columns else F.lit(0)
    spark = leaves.sparkSession
    found = None
    everything = (1 << 64) - 1
    most_of_a_trie = leaves.groupBy(trie.alias("trie")).count().agg(F.max("count")).first()[0] or 0
    level = {0: block_masks(everything, budget, agreed_blocks(most_of_a_trie, budget))}  # mask so far to the masks that deal its rows out, and those to what they are refined by
    rows = leaves.select(F.lit(0).cast("long").alias("mask"), "fp", "id", trie.alias("trie"))
    while True:
        finer = F.create_map(*itertools.chain.from_iterable((F.lit(_signed(m)), F.array(*(F.lit(_signed(m | x)) for x in more))) for m, more in level.items()))
        dealt = rows.select("fp", "id", "trie", F.explode(finer[F.col("mask")]).alias("mask"))
        # a subtree of one trie is told from another's by a hash; should two ever meet, that offers links that verification drops
        shared = F.col("fp").bitwiseAND(F.col("mask"))
        key = F.when(F.col("trie") == 0, shared).otherwise(F.xxhash64("trie", shared))
        # the key is worked out again where a row arrives: it would be a third of what is shuffled
        dealt = dealt.repartition(shuffle_width(spark), "mask", key).select("mask", key.alias("key"), "fp", "id", "trie").sortWithinPartitions("mask", "key")
        walked: dict[int, dict[int, None]] = {}
        for m, more in level.items():
            for x, both in more.items():
                walked.setdefault(m | x, {}).update(dict.fromkeys(m | y for y in both))
        whole = all(list(both) == [m] for m, both in walked.items())  # nothing is left to refine by
        free = min(bin(everything ^ m).count("1") for m in walked)
        most = most_leaves if not whole or free > budget + 2 else 1 << 62  # at the last level 2^free bounds a subtree
        batches = _link_batches(budget, most, {_signed(m): list(both) for m, both in walked.items()})
        made = settle(dealt.mapInArrow(batches, "mask long, fp long, u long, v long, trie int"), "simhash-links")
        links = made.where("v is not null").select("u", "v")
        found = links if found is None else found.unionByName(links)
        rows = made.where("v is null").select("mask", "fp", F.col("u").alias("id"), "trie")
        if rows.isEmpty():
            return found
        level = {m: block_masks(everything ^ m, budget) if whole else {y: [y] for y in both} for m, both in walked.items()}


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(id, fp, component): component is the smallest id that links of at most ``budget`` bits reach.

    Links run between fingerprints, not ids: rows with equal ids and different texts are rows of their own.  A
    null id names no component, but its text links others; it is null only where all that are reached are.
    """
    prints = settle(fingerprints(docs, id_column, text_column, width), "simhash-prints")
    leaves = settle(prints.groupBy("fp").agg(F.min("id").alias("id")), "simhash-leaves")
    joined = components(leaf_links(leaves.select("fp", F.col("fp").alias("id")), budget))
    rooted = settle(leaves.join(joined.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    named = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("id").alias("component")), "root").select("fp", "component")
    return prints.join(settle(named, "simhash-names"), "fp").select("id", "fp", "component")


# --- one document of each group ----------------------------------------------------------------------

NEAR_WIDTH, NEAR_BUDGET, SIMILARITY = 5, 7, 0.8
#: Fingerprints of a text, independent of each other.  Two texts of a similarity of 0.8 are within ``NEAR_BUDGET`` bits in one of
#: them with a chance of about 0.22, in any of nine with 0.9; at 0.85 it is 0.39 and 0.99.
NEAR_PRINTS = 9
#: Words of 64 row numbers that are sent to every task: of at least 134 million rows, whatever share of them is meant.
MOST_WORDS = 1 << 21


def mixed(hashes: np.ndarray, nth: int) -> np.ndarray:
    """Other hashes of the same shingles: the n-th is as independent of the first as if it had a seed of its own."""
    x = hashes + np.uint64(nth * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digest_batches(width: int, prints: int):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held, sizes = [], [], []

            def counted() -> None:
                hashes, n = np.array(held, np.uint64), np.array(sizes, np.int64)
                done.append(np.stack([majority(mixed(hashes, k), n) for k in range(prints)], axis=1))
                held.clear()
                sizes.clear()

            for text in batch.column("text"):
                own = shingle_hashes(text.as_py(), width)
                held += own
                sizes.append(len(own))
                if len(held) >= COUNT_BATCH:
                    counted()
            counted()
            fps = np.concatenate(done).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, fps.size + 1, prints, dtype=np.int32)), pa.array(fps.ravel()))
            same = pa.array([hashlib.sha256(t.as_py() or b"").digest() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), same, lists], names=["row", "id", "same", "fps"])

    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(t.as_py(), width), np.uint64)).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.list_(pa.int64()))], names=["row", "shingles"])

    return run


def _numbers(rows: DataFrame, name: str) -> DataFrame:
    """(_s_word, _s_bits): the numbers in ``row`` as bits of words of 64, which go to every task up to ``MOST_WORDS`` of them."""
    bit = F.expr("shiftleft(1L, cast(row % 64 as int))")
    words = settle(rows.groupBy(F.shiftright("row", 6).alias("_s_word")).agg(F.bit_or(bit).alias("_s_bits")), name)
    return F.broadcast(words) if words.count() <= MOST_WORDS else words


def _where_numbered(docs: DataFrame, numbers: DataFrame, there: bool) -> DataFrame:
    """The rows of ``docs`` whose ``_s_row`` is, or is not, among the numbers."""
    bit = F.coalesce(F.getbit("_s_bits", F.col("_s_row") % 64), F.lit(0))
    met = docs.withColumn("_s_word", F.shiftright("_s_row", 6)).join(numbers, "_s_word", "inner" if there else "left")
    return met.where(bit == int(there)).drop("_s_word", "_s_bits")


def _similar(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) of the links whose sets of shingles are similar."""
    # these are payload and no side to broadcast, whatever their estimate
    a, b = (sets.select(F.col("row").alias(row), F.col("shingles").alias(name)).hint("merge") for row, name in (("u", "a"), ("v", "b")))
    shared = F.size(F.array_intersect("a", "b"))
    every = F.size("a") + F.size("b") - shared
    return links.select("u", "v").join(a, "u").join(b, "v").where(shared >= similarity * every).select("u", "v")


def _unsettled(links: DataFrame, verified: DataFrame) -> DataFrame:
    """(row, near, label): the texts of groups that links join but verified ones do not, with the group of each kind.

    A task links a leaf to one other of its group.  Where that is not similar enough a third may be; groups of two have none.
    """
    near, joined = components(links), components(verified)
    members = near.unionByName(near.select(F.col("v").alias("u"), "v").distinct()).withColumnsRenamed({"u": "row", "v": "near"})
    named = members.join(joined.withColumnsRenamed({"u": "row", "v": "label"}), "row", "left").withColumn("label", F.coalesce("label", "row"))
    named = settle(named, "simhash-named")
    several = named.groupBy("near").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("n > 2 and a <> b").select("near")
    return named.join(several, "near").select("row", "near", "label")


def _prefix_pairs(unsettled: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): all pairs of a group with different labels that may be similar, by their rarest shingles.

    Similar sets share one of the first ``n - ceil(similarity * n) + 1`` of their shingles in any common order, and from the
    first that they share on both have enough left.  Shingles of one label alone come first here, where they can only use up places.
    """
    # pairs inside the largest label, which may be most of a group, are not even looked at
    largest = unsettled.groupBy("near", "label").count().groupBy("near").agg(F.max(F.struct("count", "label"))["label"].alias("largest"))
    known = unsettled.join(largest, "near").select("row", "near", "label", (F.col("label") == F.col("largest")).alias("main"))
    tokens = sets.join(settle(known, "simhash-known"), "row").select("row", "near", "label", "main", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    met = tokens.groupBy("near", "s").agg(F.count(F.lit(1)).alias("often"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("near", "s", "often")
    ranked = tokens.join(met, ["near", "s"]).groupBy("row", "near", "label", "main", "n").agg(F.array_sort(F.collect_list(F.struct("often", "s"))).alias("own"))
    # what a text has left from a shingle on, that one included
    placed = ranked.select("row", "near", "label", "main", "n", F.size("own").alias("all"), F.posexplode("own").alias("k", "t")).select("row", "near", "label", "main", "n", "t.s", (F.col("all") - F.col("k")).alias("left"))
    placed = settle(placed.where(F.col("left") >= similarity * F.col("n") - 1e-6), "simhash-prefixes")
    u, v = (placed.select("near", "s", *(F.col(c).alias(f"{c}_{x}") for c in ("row", "label", "main", "n", "left"))) for x in "uv")
    enough = F.least("left_u", "left_v") * (1 + similarity) >= similarity * (F.col("n_u") + F.col("n_v")) - 1e-6
    once = F.col("main_v") | (F.col("row_u") < F.col("row_v"))
    pairs = u.where("not main_u").join(v, ["near", "s"]).where((F.col("label_u") != F.col("label_v")) & once & enough)
    return pairs.select(F.least("row_u", "row_v").alias("u"), F.greatest("row_u", "row_v").alias("v")).distinct()


def distinct_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = NEAR_WIDTH, budget: int = NEAR_BUDGET, similarity: float = SIMILARITY, prints: int = NEAR_PRINTS) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates: of each group the one with the smallest id stays.

    Rows, not ids, stay or go: of repeated rows one stays, whatever their ids; a null id comes last, and
    equal ids go by their place.  Two texts are linked if they are equal, or the trie of one of their ``prints`` fingerprints finds
    them within ``budget`` bits and their sets of ``width``-word shingles have a Jaccard
    similarity of at least ``similarity``.  Texts without a word are equal to each other.  Rows are
    numbered by partition and order: the input must read the same when it is read again.
    """
    row = F.monotonically_increasing_id()
    given = docs.select(row.alias("row"), F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    rows = settle(given.mapInArrow(_digest_batches(width, prints), "row long, id long, same binary, fps array<long>"), "simhash-rows")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    # every different text is named by its first row; a fingerprint is a leaf of its trie, named by the least of these
    texts = settle(rows.groupBy("same").agg(F.min(order).alias("first"), F.first("fps").alias("fps")).select("same", "fps", "first", F.col("first.row").alias("name")), "simhash-texts")
    own = texts.select("name", F.posexplode("fps").alias("trie", "fp"))
    leaves = settle(own.groupBy("trie", "fp").agg(F.min("name").alias("id")), "simhash-leaves")
    equal = own.join(leaves, ["trie", "fp"]).where("name <> id").select(F.col("name").alias("u"), F.col("id").alias("v"))
    found = leaf_links(leaves, budget).unionByName(equal)
    links = settle(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "simhash-near")
    met = links.select(F.explode(F.array("u", "v")).alias("row")).distinct()
    # shingles of linked rows alone, whose texts are read where they are
    linked = _where_numbered(given.select(F.col("row").alias("_s_row"), "text"), _numbers(met, "simhash-met"), True)
    sets = settle(linked.select(F.col("_s_row").alias("row"), "text").mapInArrow(_shingle_sets(width), "row long, shingles array<long>"), "simhash-shingles")
    verified = settle(_similar(links, sets, similarity), "simhash-verified")
    unsettled = settle(_unsettled(links, verified), "simhash-unsettled")
    if not unsettled.isEmpty():
        more = settle(_prefix_pairs(unsettled, sets, similarity), "simhash-pairs")
        verified = verified.unionByName(_similar(more, sets, similarity))
    joined = components(verified)
    named = texts.join(joined.withColumnsRenamed({"u": "name", "v": "root"}), "name", "left").withColumn("root", F.coalesce("root", "name"))
    # the rows that go are told from the others by their numbers; texts stay where they are
    stays = named.groupBy("root").agg(F.min("first")["row"].alias("keeps"))
    goes = rows.select("row", "same").join(named.select("same", "root"), "same").join(stays, "root").where(F.col("row") != F.col("keeps")).select("row")
    return _where_numbered(docs.withColumn("_s_row", row), _numbers(goes, "simhash-goes"), False).drop("_s_row")
