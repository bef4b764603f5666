"""Blocks of texts as one byte array with its words, for operators that work on words in numpy.

A text is lower-cased in A to Z alone; a word is a run of digits, lower-case letters
and code points above U+007F.  In UTF-8 all bytes of the latter are above 0x7F, so that
words can be told byte by byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are worked on together; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
SPACE, BREAK = 0x20, 0x0A
#: Words above these bytes take their checksum one by one.
LONG_WORD = 256

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else SPACE for b in range(256))


@dataclass
class Words:
    """``data``: words with one space before and behind each, texts parted by a line feed.

    ``starts`` and ``lengths`` are those of the words in ``data``; text k has the words
    ``bounds[k]`` to ``bounds[k + 1]``.
    """

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    if not texts:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), none, none, np.zeros(1, np.int64))
    raw = np.frombuffer(b" " + b" \n ".join([t.translate(_FOLD) for t in texts]) + b" ", np.uint8)
    space = raw == SPACE
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    data = raw[keep]
    space = data == SPACE
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    breaks = data[starts] == BREAK
    first = np.flatnonzero(breaks)
    # a line feed is never a word; what it leaves out is counted off the bounds
    bounds = np.concatenate([[0], first - np.arange(len(first)), [len(starts) - len(first)]])
    return Words(data, starts[~breaks], (ends - starts)[~breaks], bounds)


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, rows, texts as bytes) of a column, a block at a time; null is empty."""
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        used = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, used + most, "right")) - at)
        yield at, n, texts.slice(at, n).cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()
        at += n


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def crc_states(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the words, from the registers before them; all words go on byte by byte, the longest last."""
    order = np.argsort(-np.minimum(lengths, LONG_WORD + 1), kind="stable")
    at, size, now = starts[order], lengths[order], states[order].astype(np.uint32)
    long = int(np.searchsorted(-size, -LONG_WORD))
    for k in range(long):
        piece = data[at[k] : at[k] + size[k]].tobytes()
        now[k] = zlib.crc32(piece, int(now[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    at, size = at[long:], size[long:]
    live = now[long:]
    left = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    for k, n in enumerate(left.tolist()):
        part = live[:n]
        live[:n] = CRC[(part ^ data[at[:n] + k]) & 0xFF] ^ (part >> 8)
    out = np.empty(len(now), np.uint32)
    out[order] = now
    return out
