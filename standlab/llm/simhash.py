"""Near duplicates by SimHash: segment-popcount embedding, grid range-join, exact verification.

A fingerprint's 32 segments of two bits are mapped to their bit counts.  One changed bit changes
one count by one, so the Manhattan distance of two count vectors is a lower bound of the number of
differing bits.  The vector is kept as a unary code in 64 bits (0, 01, 11 for each segment): the
distance of two vectors is then the number of bits in which their codes differ.

The grid splits the segments into ``distance + AGREE`` groups.  Vectors within ``distance`` of each
other differ in at most ``distance`` groups, so they lie in the same cell of at least one choice of
AGREE groups.  Every distinct fingerprint goes into its cell of every choice; in a cell, sorted by
total count, ranges of totals within ``distance`` are met, the Manhattan bound is tested, and what
passes is verified on the fingerprints.  A cell gives no pairs: each member is tied to the first one it
reaches within the cell.

Equal fingerprints are one class from the start.  A cell of more than ``limit`` classes is handed on
and dealt over a finer grid of its remaining segments, twice at most; cells that are large even then
are met in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from standlab.llm.registry import register
from standlab.llm.tables import components, ready, table
from standlab.llm.words import utf8
from standlab.session import cut_lineage, literal_table

SEED = 42
PIECE = 1 << 20  # bytes of a text that are split into words at once
SEGMENTS = 32  # of two bits each
AGREE = 2  # groups of segments that a cell fixes
LIMIT = 1 << 16  # classes that one task meets directly
REGRIDS = 2
SMALL = 48  # cells up to this size are met together
BLOCK = 1 << 22  # pairs tested at once
LOWEST = 0x5555555555555555  # the lower bit of every segment
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# -- fingerprints ---------------------------------------------------------------------------

def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, one array for each piece of the text."""
    carry, at, seen = [], 0, False
    while at < len(text):
        stop = at + PIECE
        if stop < len(text):
            space = _SPACE.search(text, stop)
            stop = space.start() if space else len(text)
        words = carry + text[at:stop].lower().split()
        at = stop
        if len(words) >= width:
            seen = True
            yield _hashed(words, width)
            carry = words[len(words) - width + 1:]
        else:
            carry = words
    if carry and not seen:
        yield _hashed(words, len(words))


def _hashed(words: list[bytes], width: int) -> np.ndarray:
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(start.tolist(), end[width - 1:].tolist())], np.uint64)


def fingerprint_of(text: bytes, width: int) -> np.uint64:
    """One bit for every bit that is set in over half of the shingle hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
        n += len(hashes)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]


def fingerprint(width: int):
    @F.pandas_udf(LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, width) for t in utf8(texts)], np.uint64).view(np.int64))
    return of


# -- embedding and grid ---------------------------------------------------------------------

def embedding(prints: np.ndarray) -> np.ndarray:
    """Unary codes of the bit counts of all segments."""
    high, low = prints >> np.uint64(1), np.uint64(LOWEST)
    return ((high & prints & low) << np.uint64(1)) | ((high | prints) & low)


def embedding_column(prints: Column) -> Column:
    high = F.shiftrightunsigned(prints, 1)
    low = F.lit(LOWEST)
    return F.shiftleft(high.bitwiseAND(prints).bitwiseAND(low), 1).bitwiseOR(high.bitwiseOR(prints).bitwiseAND(low))


def finer(mask: int, distance: int) -> list[int]:
    """The choices of groups among the segments that ``mask`` leaves free, each added to it."""
    free = [s for s in range(SEGMENTS) if not mask >> 2 * s & 1]
    groups = [sum(3 << 2 * s for s in g.tolist()) for g in np.array_split(free, distance + AGREE)]
    return sorted({mask | sum(chosen) for chosen in combinations([g for g in groups if g], AGREE)}) or [mask]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number reachable over the links (a, b), for each of n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(label[a], label[b]):
            return label


class Forest:
    """Links among n members, folded to a spanning forest whenever many have come in."""

    def __init__(self, n: int):
        self.n, self.a, self.b, self.new = n, [], [], 0

    def add(self, a, b):
        self.a.append(a), self.b.append(b)
        self.new += len(a)
        if self.new > BLOCK:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.new:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        label = roots(self.n, np.concatenate(self.a), np.concatenate(self.b))
        child = np.flatnonzero(label != np.arange(self.n))
        self.a, self.b, self.new = [child], [label[child]], 0
        return child, label[child]


def cell_links(prints: np.ndarray, cells: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within cells; ``cells`` numbers them and is sorted."""
    order = np.lexsort((np.bitwise_count(prints), cells))
    prints, cells = prints[order], cells[order]
    codes, total = embedding(prints), np.bitwise_count(prints).astype(np.int64)
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    size = np.diff(np.append(first, len(cells)))
    found = Forest(len(prints))

    def keep(a, b):
        near = np.bitwise_count(codes[a] ^ codes[b]) <= distance
        a, b = a[near], b[near]
        linked = np.bitwise_count(prints[a] ^ prints[b]) <= distance
        if linked.any():
            found.add(a[linked], b[linked])

    own = np.repeat(size, size)
    small = np.flatnonzero((own > 1) & (own <= SMALL))
    for step in range(1, SMALL):
        a, b = small[:-step], small[step:]
        if not len(a):
            break
        met = (cells[a] == cells[b]) & (total[b] - total[a] <= distance)
        keep(a[met], b[met])
    for at, n in zip(first[size > SMALL], size[size > SMALL]):
        done = 0
        while done < n - 1:
            rows = max(1, min(n - done, BLOCK // int(n)))
            lead = np.arange(at + done, at + done + rows)
            end = at + np.searchsorted(total[at:at + n], total[lead[-1]] + distance, "right")
            for low in range(at + done, end, BLOCK):
                near = np.bitwise_count(codes[lead, None] ^ codes[None, low:min(end, low + BLOCK)]) <= distance
                i, j = np.nonzero(near)
                i, j = i + lead[0], j + low
                keep(i[i < j], j[i < j])
            done += rows
    a, b = found.fold()
    return order[a], order[b]


def _meet(distance: int, limit: int | None):
    """Rows sorted by (mask, cell) to links (fp, other), or to rows (fp, mask) of cells over the limit."""
    def links(m, c, f):
        number = np.cumsum((np.diff(m, prepend=m[:1]) != 0) | (np.diff(c, prepend=c[:1]) != 0))
        over = np.zeros(len(f), bool) if limit is None else np.bincount(number)[number] > limit
        a, b = cell_links(f[~over].view(np.uint64), number[~over], distance)
        rest = f[~over]
        yield pd.DataFrame({"fp": rest[a], "other": pd.array(rest[b], "Int64"), "mask": pd.array([pd.NA] * len(a), "Int64")})
        if over.any():
            yield handed(m[over], f[over])

    def handed(m, f):
        return pd.DataFrame({"fp": f, "other": pd.array([pd.NA] * len(f), "Int64"), "mask": pd.array(m, "Int64")})

    def run(batches):
        held, large = [np.zeros(0, np.int64)] * 3, None  # the last cell so far; the key of a cell handed on
        for batch in batches:
            m, c, f = (np.concatenate([h, batch[k].to_numpy(np.int64)]) for h, k in zip(held, ("mask", "cell", "fp")))
            if large is not None:
                more = (m == large[0]) & (c == large[1])
                if more.any():
                    yield handed(m[more], f[more])
                m, c, f = m[~more], c[~more], f[~more]
            if not len(m):
                held = [m, c, f]
                continue
            last = (m == m[-1]) & (c == c[-1])
            held = [x[last] for x in (m, c, f)]
            if not last.all():
                yield from links(*(x[~last] for x in (m, c, f)))
            if limit is not None and len(held[0]) > limit:
                large = (m[-1], c[-1])
                yield handed(held[0], held[2])
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from links(*held)
    return run


def links(prints: DataFrame, distance: int = 4, limit: int = LIMIT) -> DataFrame:
    """a, b: a spanning forest, cell by cell, of the distinct fingerprints ``fp`` that differ in at
    most ``distance`` bits."""
    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, masks, found = prints.select("fp", F.lit(0).cast("long").alias("mask")), [0], []
    for level in range(REGRIDS + 1):
        step = [(mask, child) for mask in masks for child in finer(mask, distance)]
        masks = sorted({child for _, child in step})
        grid = literal_table(spark, [(_signed(m), _signed(c)) for m, c in step], "mask bigint, child bigint")
        cells = rows.join(F.broadcast(grid), "mask").select(
            "fp", F.col("child").alias("mask"), embedding_column(F.col("fp")).bitwiseAND(F.col("child")).alias("cell"))
        met = cut_lineage(cells.repartition(parts, "mask", "cell").sortWithinPartitions("mask", "cell").mapInPandas(
            _meet(distance, limit if level < REGRIDS else None), "fp long, other long, mask long"))
        found.append(met.filter("other IS NOT NULL").select(F.col("fp").alias("a"), F.col("other").alias("b")))
        rows = met.filter("mask IS NOT NULL").select("fp", "mask")
        if rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


HOTTEST, COMMON = 1000, 1000  # fingerprints of over COMMON rows; so many are broadcast at most


def simhash_components(docs: DataFrame, width: int = 4, distance: int = 4, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over rows whose fingerprints differ in at most
    ``distance`` bits, the row's own included.  A null or empty text, or one without words, has
    fingerprint zero and is linked like any other.  A row without doc_id links others and comes back
    with their smallest doc_id, or null where none of them has one.  Rows are judged one by one: equal rows come
    back as often as they came, and rows that share a doc_id but not the text are linked only by
    their fingerprints.  An empty table gives no rows; other columns are not used.
    """
    ready(docs.sparkSession)
    prints = cut_lineage(docs.select("doc_id", fingerprint(width)("text").alias("fp")))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    labels = components(links(classes, distance, limit))
    members = labels.select(F.col("node").alias("fp"), "component").union(
        labels.select(F.col("component").alias("fp"), "component").distinct())
    members = cut_lineage(members.join(classes.select("fp", "low"), "fp"))
    lowest = members.groupBy("component").agg(F.min("low").alias("component_id"))
    named = members.join(lowest, "component").select("fp", "component_id")
    found = cut_lineage(classes.join(named, "fp", "left").select(
        "fp", "n", F.coalesce("component_id", "low").alias("component_id")))
    # the classes of most rows reach theirs by broadcast, so no task gets all rows of one
    hot = cut_lineage(found.filter(F.col("n") > COMMON).orderBy(F.desc("n"), "fp").limit(HOTTEST))
    split = prints.join(F.broadcast(hot.select("fp", F.lit(True).alias("is_hot"), F.col("component_id").alias("named"))),
                        "fp", "left")
    rest = split.filter("is_hot IS NULL").select("doc_id", "fp").join(found.select("fp", "component_id"), "fp")
    out = split.filter("is_hot").select("doc_id", "fp", F.col("named").alias("component_id")).union(
        rest.select("doc_id", "fp", "component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op11_simhash")
def op11_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))
