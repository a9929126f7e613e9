"""Packed rows for large exchanges: many small records as arrays, one row for each target partition."""

from __future__ import annotations

import numpy as np
import zstandard

PLACES = "part int, ids binary, counts binary, steps binary"


def pack(values: np.ndarray, kind) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def places(doc: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted (text, word) places as text ids, places for each id and steps between places."""
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    counts = np.diff(np.append(new, len(doc)))
    steps = np.diff(pos, prepend=0)
    steps[new] = pos[new]
    return pack(ids[doc[new]], np.int64), pack(counts, np.uint32), pack(steps, np.uint32)


def read_places(ids: bytes, counts: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = unpack(ids, np.int64), unpack(counts, np.uint32).astype(np.int64)
    total = np.cumsum(unpack(steps, np.uint32).astype(np.int64))
    first = np.cumsum(counts) - counts
    before = np.where(first > 0, total[first - 1], 0)
    return np.repeat(ids, counts), total - np.repeat(before, counts)


def dealt(part: np.ndarray, doc, pos, ids, columns: dict[str, np.ndarray]):
    """One row for each value of ``part``: its places and the columns' values."""
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        at = order[a:b]
        i, c, s = places(doc[at], pos[at], ids)
        yield {"part": int(part[at[0]]), "ids": i, "counts": c, "steps": s,
               **{k: v[at].tobytes() for k, v in columns.items()}}


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
