"""Arrays of whole numbers as small blocks of bytes, for rows that carry many of them."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, none negative: as many byte planes as the largest needs, compressed.

    A sorted array of unsigned 64-bit keys is given as it is; it is kept by its differences.
    """
    parts = []
    for values in arrays:
        ordered = values.dtype == np.uint64
        if ordered:
            values = np.diff(values, prepend=np.uint64(0))
        wide = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
        parts.append(struct.pack("<qB?", len(values), wide, ordered))
        parts.append(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes())
    raw = b"".join(parts)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(block: bytes) -> list[np.ndarray]:
    """The arrays of a block: sorted keys unsigned, all others as int64."""
    raw = pa.decompress(block[8:], struct.unpack_from("<q", block)[0], codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, wide, ordered = struct.unpack_from("<qB?", raw, at)
        at += 10
        planes = np.zeros((n, 8), dtype=np.uint8)
        planes[:, :wide] = np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T
        at += n * wide
        values = planes.view("<u8").reshape(-1)
        out.append(np.cumsum(values, dtype=np.uint64) if ordered else values.astype(np.int64))
    return out


def grouped(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The different keys in order, where each is found first, and the sums of the weights."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64), [w[:0] for w in weights]
    order, new = sorted_by(keys)
    starts = np.flatnonzero(new)
    return keys[order[starts]], order[starts], [np.add.reduceat(w[order], starts) for w in weights]


def sorted_by(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys, and where in it a key is found first."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return order, new
