"""Words of whole texts and their hashes, vectorised over a batch of texts inside a task.

A word is a longest run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text.  Word hashes
are polynomials over random byte values modulo 2^64; n-gram hashes combine them by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20  # bytes hashed at once, which bounds the working arrays
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _powers(n: int, seed: int) -> np.ndarray:
    base = _odd(1, seed + 77)[0]
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8(texts) -> list[bytes]:
    """Texts as UTF-8; a null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def text_sizes(texts) -> list[int]:
    return [0 if t is None else len(t) for t in texts]


def slices(sizes: list[int], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about ``most``; a larger row is a run of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


class Words:
    """Words of a run of texts: hashes, byte spans in ``data`` and the first word of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False, seeds: tuple[int, ...] = (1,)):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        hashes, starts, ends = [], [], []
        at = 0
        while at < len(self.data):
            stop = min(len(self.data), at + PIECE)
            if stop < len(self.data):  # end a piece behind its last separator
                cut = np.flatnonzero(_SEP[self.data[at:stop]])
                while not len(cut):
                    stop = min(len(self.data), stop + PIECE)
                    cut = np.flatnonzero(_SEP[self.data[at:stop]])
                stop = at + int(cut[-1]) + 1
            part = self.data[at:stop]
            h, s, e = _hash_piece(_LOWER[part] if lower else part, seeds)
            hashes.append(h), starts.append(s + at), ends.append(e + at)
            at = stop
        self.hashes = np.concatenate(hashes, axis=1)
        self.starts, self.ends = np.concatenate(starts), np.concatenate(ends)
        self.first = np.searchsorted(self.starts, begin)  # of each text, and one past the last
        self.counts = np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text's number, for each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, n: int, row: int = 0) -> np.ndarray:
        """Hash of the n words that start at each word; those that run past a text mean nothing."""
        return gram_hashes(self.hashes[row], n)

    def whole(self, n: int) -> np.ndarray:
        """Whether n words of the same text start at each word."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))
        return left >= n


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for k, factor in enumerate(_odd(n, 1000 + n)):
        out[: max(0, len(words) - k)] += words[k:] * factor
    return mix(out)


def _hash_piece(data: np.ndarray, seeds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sep = _SEP[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([1], sep.view(np.int8), [1]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros((len(seeds), 0), np.uint64), starts, ends
    size = ends - starts
    body = data[~sep]
    first = np.cumsum(size) - size
    within = np.arange(len(body)) - np.repeat(first, size)
    out = []
    for seed in seeds:
        value = _odd(256, seed)[body] * _powers(int(size.max()), seed)[within]
        out.append(mix(np.add.reduceat(value, first) + size.astype(np.uint64)))
    return np.array(out), starts, ends


def by_text(batches, lower: bool = False, seeds: tuple[int, ...] = (1,)):
    """For each batch of a mapInPandas, runs of its rows with the words of their ``text``."""
    for batch in batches:
        for a, b in slices(text_sizes(batch["text"])):
            rows = batch.iloc[a:b]
            yield rows, Words(utf8(rows["text"]), lower, seeds)
