"""Token counts by distinct pre-token.

The vocabulary of the piece tokenizer has no piece in which a space mark follows
another character, nor one with a line feed beside others (``splits_at_spaces``
checks both), so a text's pieces are those of its units: a word with the spaces
before it, or a line feed with the word after it.

1. A task reads its rows in blocks and turns each block round: for each distinct
   unit, which documents hold it and how often (``postings``).  Units are dealt
   by hash into groups, whose number follows the bytes of all texts and not the
   partitions; a block has one compressed row for each group that it has units of.
2. A group joins the blocks' units: every distinct unit's pieces are counted
   once, times the frequencies, and summed per document.  Ids of documents are
   never made.
3. A block's sums come together and go to its rows.

A unit that more than one in ``HOT`` documents of a block hold is dealt by unit and
block, so that no frequent word's postings meet in one group; such units, at
most a few thousand a block, are counted once in each group that they reach.

Blocks are numbered by partition and order of the rows: the input must read the
same when it is read again, as tables do (``settle`` others first).  Defined
cases: null and empty text have 0 tokens; repeated rows and equal or null ids
keep one row each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import pack_bytes, unpack_bytes

BLOCK_CHARS, BLOCK_ROWS = 12_000_000, 60_000
#: Bytes of all texts that a group of units stands for, and groups of any input.
GROUP_BYTES, LEAST_GROUPS = 32 << 20, 16
HOT = 32
MARK = "▁"
UNIT = re.compile(r" +[^ \n]+| +|\n[^ \n]*")
POSTING = np.dtype([("row", "<u2"), ("times", "u1")])
SUM = np.dtype([("row", "<u2"), ("tokens", "<u4")])

_processors: dict = {}


def processor(path: str):
    if path not in _processors:
        import sentencepiece

        _processors[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _processors[path]


def splits_at_spaces(path: str) -> bool:
    """True if units of the model's vocabulary never reach over a space or a line feed."""
    sp = processor(path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return all(MARK not in p.lstrip(MARK) and ("\n" not in p or p == "\n") for p in pieces)


def unit_tokens(sp, units: list[str]) -> np.ndarray:
    """Pieces of each unit, written without its first space; the model itself puts one before what it is given."""
    counts = np.array([len(ids) for ids in sp.encode(units, num_threads=1)], np.int64)
    for k, u in enumerate(units):
        if not u:
            counts[k] = 1
        elif u[0] == "\n":
            counts[k] -= 1
    return counts


def units_of(text: str) -> list[str]:
    """Units of any text, each without its first space."""
    marked = " " + text.replace(MARK, " ")
    return [u[1:] if u[0] == " " else u for u in UNIT.findall(marked)] if text else []


def block_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(units, the row of each) of a block; texts without runs of spaces split in Arrow, others one by one."""
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, MARK))
    plain = pc.and_(pc.invert(odd), pc.greater(pc.utf8_length(texts), 0))
    rows = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
    lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(rows)), "\n", " \n"), " ")
    found, where = [lists.flatten().cast(pa.large_string())], [np.repeat(rows, pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
    for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
        own = units_of(texts[k].as_py())
        found.append(pa.array(own, pa.large_string()))
        where.append(np.full(len(own), k))
    return pa.concat_arrays(found), np.concatenate(where)


def postings(texts: pa.Array, block: int, groups: int) -> Iterator[tuple[int, bytes]]:
    """(group, packed units and postings) of a block of texts."""
    units, where = block_units(texts)
    if not len(units):
        return
    coded = units.dictionary_encode()
    words = coded.dictionary.to_pylist()
    n_rows = len(texts)
    keys = np.sort(coded.indices.to_numpy().astype(np.int64) * n_rows + where)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.diff(np.append(first, len(keys)))
    unit, row = np.divmod(keys[first], n_rows)
    # a posting holds up to 255 occurrences
    more = (times + 254) // 255
    unit, row = np.repeat(unit, more), np.repeat(row, more)
    last = np.cumsum(more) - 1
    body = np.empty(len(unit), POSTING)
    body["row"], body["times"] = row, 255
    body["times"][last] = times - 255 * (more - 1)
    held = np.bincount(unit, minlength=len(words))
    raw = [w.encode() for w in words]
    hashed = np.fromiter((zlib.crc32(w) for w in raw), np.int64, len(raw))
    hot = held * HOT > n_rows
    group = np.where(hot, hashed ^ (block * 2654435761 & 0xFFFFFFFF), hashed) % groups
    order = np.argsort(group, kind="stable")
    starts = np.concatenate([[0], np.cumsum(held)])
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    for g in range(groups):
        mine = order[bounds[g] : bounds[g + 1]]
        if len(mine):
            chosen = [raw[k] for k in mine.tolist()]
            lengths = np.fromiter(map(len, chosen), "<u4", len(chosen))
            spans = held[mine]
            places = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            yield g, pack_bytes(lengths.tobytes(), b"".join(chosen), spans.astype("<u4").tobytes(), body[places].tobytes())


SCHEMA = "part long, block long, body binary"


def _rows(parts: list[int], blocks: list[int], bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blocks, pa.int64()), pa.array(bodies, pa.binary())], names=["part", "block", "body"])


def _block_batches(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                used = sizes[at - 1] if at else 0
                end = min(max(at + 1, int(np.searchsorted(sizes, used + BLOCK_CHARS))), at + BLOCK_ROWS, len(texts))
                part = texts.slice(at, end - at)
                ids = batch.column(0).slice(at, end - at)
                n_bytes = pc.binary_length(part).to_numpy(zero_copy_only=False).astype("<i8")
                none = ids.is_null().to_numpy(zero_copy_only=False).astype("u1")
                head = pack_bytes(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), none.tobytes(), n_bytes.tobytes())
                yield _rows([-1], [block], [head])
                for g, body in postings(part, block, groups):
                    yield _rows([g], [block], [body])
                block += 1
                at = end

    return run


def _count_group(path: str):
    def run(group: pa.Table) -> pa.Table:
        """Rows of one group of units, or a head on its own way to its block."""
        if not group.num_rows or group.column("part")[0].as_py() < 0:
            return group
        blocks = group.column("block").to_pylist()
        words, spans, bodies, sizes = [], [], [], []
        for data in group.column("body"):
            lengths, text, span, body = unpack_bytes(data.as_py())
            n = np.frombuffer(lengths, "<u4").astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)])
            words.append(pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text)))
            spans.append(np.frombuffer(span, "<u4").astype(np.int64))
            bodies.append(np.frombuffer(body, POSTING))
            sizes.append(len(n))
        coded = pa.concat_arrays(words).dictionary_encode()
        tokens = unit_tokens(processor(path), coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sums: dict[int, list[np.ndarray]] = {}
        at = 0
        for block, span, body, n in zip(blocks, spans, bodies, sizes):
            each = np.repeat(tokens[at : at + n], span) * body["times"]
            sums.setdefault(block, []).append(np.bincount(body["row"], each))
            at += n
        out = []
        for block, parts in sums.items():
            total = np.zeros(max(map(len, parts)))
            for p in parts:
                total[: len(p)] += p
            rows = np.flatnonzero(total)
            found = np.empty(len(rows), SUM)
            found["row"], found["tokens"] = rows, total[rows]
            out.append((block, pack_bytes(found.tobytes())))
        return pa.Table.from_batches([_rows([0] * len(out), [b for b, _ in out], [x for _, x in out])])

    return run


def _sum_block(block: pa.Table) -> pa.Table:
    parts = block.column("part").to_pylist()
    head = parts.index(-1)
    ids, none, n_bytes = unpack_bytes(block.column("body")[head].as_py())
    total = np.zeros(len(none), np.int64)
    for k, data in enumerate(block.column("body")):
        if k != head:
            found = np.frombuffer(unpack_bytes(data.as_py())[0], SUM)
            total[found["row"]] += found["tokens"]
    return pa.table(
        {
            "id": pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(none, "u1").astype(bool)),
            "n_bytes": pa.array(np.frombuffer(n_bytes, "<i8")),
            "n_tokens": pa.array(total),
        }
    )


def token_counts(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, n_bytes, n_tokens) of each row."""
    if not splits_at_spaces(model_path):
        raise ValueError("the vocabulary has pieces that reach over spaces or line feeds")
    given = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = LEAST_GROUPS + total // group_bytes
    blocks = given.mapInArrow(_block_batches(groups), SCHEMA)
    # heads keep apart: each is a group of its own
    apart = F.when(F.col("part") < 0, -1 - F.col("block")).otherwise(F.col("part"))
    sums = blocks.groupBy(apart.alias("_group")).applyInArrow(_count_group(model_path), SCHEMA)
    return sums.groupBy("block").applyInArrow(_sum_block, "id long, n_bytes long, n_tokens long")
