"""Several byte strings as one compressed value, for rows that carry arrays through a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack_bytes(*parts: bytes) -> bytes:
    sizes = np.array([len(p) for p in parts], "<i8").tobytes()
    body = b"".join(parts)
    head = len(parts).to_bytes(1, "little") + sizes + len(body).to_bytes(8, "little")
    return head + pa.compress(body, codec="zstd", asbytes=True) if body else head


def unpack_bytes(data: bytes) -> list[bytes]:
    n = data[0]
    sizes = np.frombuffer(data, "<i8", n, 1)
    total = int.from_bytes(data[1 + 8 * n : 9 + 8 * n], "little")
    body = pa.decompress(data[9 + 8 * n :], total, codec="zstd", asbytes=True) if total else b""
    ends = np.cumsum(sizes)
    return [body[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
