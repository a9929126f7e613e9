"""N-gram Jaccard self-join by multiple-global-order filtering, and the components of its links.

A text's set holds the distinct shingles of ``width`` words; a text with fewer words has its
whole word sequence as the one shingle, a null or blank text an empty set, which links with
nothing.  Texts link when ``den * |A & B| >= num * |A | B|``.

Under any one order of all shingles, two linked sets share one of the first
``n - ceil(n * num / den) + 1`` shingles of each.  Several orders give as many independent
filters, and a pair goes on to verification only if it shares a prefix shingle under all of them:

* The first order puts rare shingles first.  Rarity comes from a count of all shingles of all
  documents in a fixed number of hash cells (any global order is exact, so shared cells cost
  time only).  Its prefixes are joined on the shingle, which makes the candidates.
* The other orders are of independent hashes.  A candidate's heads under each of them must share
  enough for the rest to make up a link; pairs that pass all orders are verified on whole sets.

Before that a pair meets its parity sketches.  Every shingle of a set flips one bit of its
sketch, so two sketches differ in no more bits than the sets in shingles; a pair whose sketches
differ in more than a link allows has none.

Equal sets are one class, so copies never meet each other.  The documents of a shingle pair up
where they are at most SMALL.  In larger groups each is paired with two leaders, one of the
whole group and one of those with the same smallest shingle under the second order; a leader
has the fewest rarer shingles of its own.  Then every document is verified against the one
with most candidates among those it may link with.  What is left, verified last, is the
candidates that these links leave apart, and for the larger groups each document outside
the largest component of its shingle with all documents of the shingle in other components.
After it every linked pair is in one component, and pairs inside a component have been skipped,
which can lose no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from standlab.llm.packed import PLACES, dealt, pack, part_of, read_places, unpack
from standlab.llm.registry import register
from standlab.llm.tables import components, near_ids, table, without_ids
from standlab.llm.words import Words, by_text, mix, slices, utf8
from standlab.session import cut_ids, cut_lineage

CELL_BITS = 22  # cells of the rarity count: 4 MB of classes, at every size of corpus
CELLS, BLOCK = 1 << CELL_BITS, 1 << 16
SMALL = 32  # documents of a shingle that pair up at once
BITS = 256  # of the smallest sketch, and of the one that joins test
PAIRS = 1 << 20  # made at once inside a task
SALT = 32  # documents verified against one other in one place
HEAD = 20  # percent of a set that an order's filter sees


def _sets(words: Words, width: int):
    """(text number, shingle) pairs, distinct and sorted by text."""
    shingles, whole = words.grams(width), words.whole(width)
    doc = words.doc()
    keep_doc, keep = doc[whole], shingles[whole]
    for n in range(1, width):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            keep_doc = np.concatenate([keep_doc, short])
            keep = np.concatenate([keep, words.grams(n)[words.first[short]]])
    order = np.lexsort((keep, keep_doc))
    keep_doc, keep = keep_doc[order], keep[order]
    new = np.ones(len(keep), bool)
    new[1:] = (keep_doc[1:] != keep_doc[:-1]) | (keep[1:] != keep[:-1])
    return keep_doc[new], keep[new]


def rarity(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles of all documents counted in CELLS cells by hash; tasks send their cells only."""
    def count(batches):
        cells = np.zeros(CELLS, np.uint32)
        for _, words in by_text(batches, lower=True):
            cell, n = np.unique(_cell(_sets(words, width)[1]), return_counts=True)
            cells[cell] += n.astype(np.uint32)
        for i in range(0, CELLS, BLOCK):
            part = cells[i:i + BLOCK]
            if part.any():
                yield pd.DataFrame({"block": [i // BLOCK], "cells": [pack(part, np.uint32)]})

    def add(key, parts):
        total = np.zeros(BLOCK, np.int64)
        for part in parts:
            for cells in part["cells"]:
                total += unpack(cells, np.uint32)
        yield pd.DataFrame({"block": [key[0]], "cells": [pack(total, np.int64)]})

    add.__annotations__ = {"key": tuple, "parts": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    rows = (docs.select("text").mapInPandas(count, "block int, cells binary")
            .groupBy("block").applyInPandas(add, "block int, cells binary").collect())
    total = np.zeros(CELLS, np.int64)
    for r in rows:
        total[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = unpack(r["cells"], np.int64)
    return total


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def rarity_class(cells: np.ndarray) -> np.ndarray:
    """Steps of a quarter of a root: all cells of one true mean spread over about two of them at any size."""
    return np.minimum(np.rint(4 * np.sqrt(cells)), 65535).astype(np.uint16)


def _order(shingles: np.ndarray, number: int) -> np.ndarray:
    """Rank key of an independent global order."""
    return mix(shingles ^ np.uint64(0xA5A5A5A5 * number))


def sketches(doc: np.ndarray, shingles: np.ndarray, n: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Parity sketches of n / 2 to n bits (BITS at least, a power of two), and all folded to BITS bits as longs."""
    at = mix(shingles ^ np.uint64(0x5BD1E995A7C3))
    size = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(n, 1) / 2)).astype(np.int64))
    first = np.cumsum(size) - size
    bits = np.bincount(first[doc] + (at & (size[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=int(size.sum())) & 1
    data = np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()
    small = np.bincount(doc * BITS + (at & np.uint64(BITS - 1)).astype(np.int64), minlength=len(n) * BITS) & 1
    folded = np.packbits(small.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(n), BITS // 64)
    return [data[i // 8:(i + k) // 8] for i, k in zip(first.tolist(), size.tolist())], folded


def sketch_distance(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Bits in which two sketches differ, the longer folded to the shorter's length."""
    out = np.empty(len(x), np.int64)
    for i, (p, q) in enumerate(zip(x, y)):
        p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        size = min(len(p), len(q))
        p, q = (np.bitwise_xor.reduce(v.reshape(-1, size)) for v in (p, q))
        out[i] = np.bitwise_count(p ^ q).sum()
    return out


FOLDS = [f"k{i}" for i in range(BITS // 64)]


def describe(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set size n, set signature (s1, s2), smallest shingle of the second order and parity sketches."""
    def run(batches):
        for rows, words in by_text(batches, lower=True):
            doc, shingles = _sets(words, width)
            n = np.bincount(doc, minlength=len(rows))
            s1, s2, least = (np.zeros(len(rows), np.uint64) for _ in range(3))
            if len(doc):
                has, first = np.flatnonzero(n), np.flatnonzero(np.diff(doc, prepend=-1))
                s1[has] = np.add.reduceat(mix(shingles), first)
                s2[has] = np.add.reduceat(mix(shingles ^ np.uint64(0xC0FFEE123457)), first)
                least[has] = np.minimum.reduceat(_order(shingles, 2), first)
            sketch, folded = sketches(doc, shingles, n)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n": n, "s1": s1.view(np.int64), "s2": s2.view(np.int64),
                                "least": least.view(np.int64), "sketch": sketch} | dict(zip(FOLDS, folded.T)))

    # ids travel as text: beside a null, whole numbers would turn into floats
    described = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        run, "doc_id string, n long, s1 long, s2 long, least long, sketch binary, " + ", ".join(f"{k} long" for k in FOLDS))
    return described.withColumn("doc_id", F.col("doc_id").cast("long"))


def _fits(n, at, m, at2, num: int, den: int):
    """Sizes must fit, and what follows the first common shingle must suffice; a linked pair
    passes at its first common shingle, whatever its other rows do."""
    return ((np.minimum(n, m) * den >= np.maximum(n, m) * num)
            & (np.minimum(n - at, m - at2) * (den + num) >= num * (n + m)))


def group_pairs(first: np.ndarray, size: np.ndarray):
    """Index pairs of all two members of groups, which begin at ``first``; some PAIRS at a time."""
    for k in np.unique(size[size > 1]):
        i, j = np.triu_indices(int(k), 1)
        begin = first[size == k]
        step = max(1, PAIRS // len(i))
        for at in range(0, len(begin), step):
            some = begin[at:at + step, None]
            yield (some + i).ravel(), (some + j).ravel()


def postings(docs: DataFrame, width: int, num: int, den: int, classes) -> DataFrame:
    """Candidate pairs (doc, other) of shingles in at most SMALL prefixes; of shingles in more prefixes the
    rows shingle, doc, n, at (the shingle's place in the prefix), with no other."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches):
        kinds = classes.value
        for rows, words in by_text(batches, lower=True):
            doc, shingles = _sets(words, width)
            n = np.bincount(doc, minlength=len(rows))
            order = np.lexsort((_order(shingles, 1), kinds[_cell(shingles)], doc))
            at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            keep = at < np.repeat(n - -(-n * num // den) + 1, n)
            doc, at, shingles = doc[keep], at[keep], shingles[order][keep]
            if len(doc):
                yield pd.DataFrame(dealt(part_of(shingles, parts), doc, at, rows["doc_id"].to_numpy(np.int64), {
                    "shingles": shingles, "sizes": n[doc].astype(np.int32)}))

    def meet(batches):
        rows = [r for batch in batches for r in batch.itertuples(index=False)]
        if not rows:
            return
        shingles = np.concatenate([np.frombuffer(r.shingles, np.int64) for r in rows])
        _, inverse, count = np.unique(shingles, return_inverse=True, return_counts=True)
        count = count[inverse]
        keep = np.flatnonzero(count > 1)
        doc, place, at = np.empty(len(keep), np.int64), np.empty(len(keep), np.int64), 0
        edges = np.searchsorted(keep, np.cumsum([0] + [len(r.shingles) // 8 for r in rows]))
        for r, a, b in zip(rows, edges[:-1], edges[1:]):
            if b > a:
                doc[a:b], place[a:b] = (v[keep[a:b] - at] for v in read_places(r.ids, r.counts, r.steps))
            at += len(r.shingles) // 8
        n = np.concatenate([np.frombuffer(r.sizes, np.int32) for r in rows])[keep].astype(np.int64)
        shingles, count = shingles[keep], count[keep]
        hot = count > SMALL
        if hot.any():
            yield pd.DataFrame({"shingle": shingles[hot], "doc": doc[hot], "n": n[hot], "at": place[hot], "other": pd.NA}
                               ).astype({"other": "Int64"})
        order = np.argsort(shingles, kind="stable")
        order = order[~hot[order]]
        first = np.flatnonzero(np.diff(shingles[order], prepend=shingles[order[:1]] + 1)) if len(order) else order
        found = []
        for i, j in group_pairs(first, count[order[first]]):
            i, j = order[i], order[j]
            ok = (doc[i] != doc[j]) & _fits(n[i], place[i], n[j], place[j], num, den)
            i, j = i[ok], j[ok]
            found.append(np.unique(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])], axis=1), axis=0))
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pd.DataFrame({"shingle": 0, "doc": pairs[:, 0], "n": 0, "at": 0, "other": pd.array(pairs[:, 1], "Int64")})

    packed = docs.select("doc_id", "text").mapInPandas(deal, PLACES + ", shingles binary, sizes binary")
    return (packed.repartitionById(parts, F.col("part"))
            .mapInPandas(meet, "shingle long, doc long, n long, at long, other long"))


def order_heads(doc: np.ndarray, shingles: np.ndarray, n: np.ndarray, number: int) -> list[bytes]:
    """The first HEAD of every set under another order, as 32 bits of the order's keys."""
    size = n - n * (100 - HEAD) // 100
    key = (_order(shingles, number) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((key, doc))
    keep = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(size, n)
    return _split(key[order][keep], size)


def _split(values: np.ndarray, size: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.split(values, np.cumsum(size)[:-1])]


def _rows(sets, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in sets], np.int64) // np.dtype(kind).itemsize
    return size, np.repeat(np.arange(len(size)), size), np.frombuffer(b"".join(sets), kind)


def common(row_x, x, row_y, y, size: int) -> np.ndarray:
    """For each row, how many values its x and its y have in common."""
    row, value = np.concatenate([row_x, row_y]), np.concatenate([x, y])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
    return np.bincount(row[1:][same], minlength=size)


def may_link(x, y, n, m, num: int, den: int) -> np.ndarray:
    """Order filter on the heads x and y of sets of n and m shingles.

    Up to the lower of the two last keys both sets are known; what lies behind can add no more
    than the smaller rest.  Equal 32-bit keys of unequal shingles only let a pair pass.
    """
    (nx, rx, vx), (ny, ry, vy) = _rows(x, np.uint32), _rows(y, np.uint32)
    end = np.minimum(vx[np.cumsum(nx) - 1], vy[np.cumsum(ny) - 1])
    kx, ky = vx <= end[rx], vy <= end[ry]
    both = common(rx[kx], vx[kx], ry[ky], vy[ky], len(nx))
    rest = np.minimum(n - np.bincount(rx[kx], minlength=len(nx)), m - np.bincount(ry[ky], minlength=len(nx)))
    return (both + np.maximum(rest, 0)) * (num + den) >= num * (n + m)


def linked(x, y, num: int, den: int) -> np.ndarray:
    (n, rx, vx), (m, ry, vy) = _rows(x, np.uint64), _rows(y, np.uint64)
    both = common(rx, vx, ry, vy, len(n))
    return den * both >= num * (n + m - both)


def _sketched(pairs: DataFrame, described: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sketches may link, each once."""
    def run(batches):
        for batch in batches:
            apart = sketch_distance(batch["xsketch"], batch["ysketch"])
            yield batch.loc[apart * (den + num) <= (batch["xn"] + batch["yn"]) * (den - num), ["a", "b"]]

    pairs = cut_ids(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sides = near_ids(described.select("doc_id", "n", "sketch"), nodes).dropDuplicates(["doc_id"])

    def side(key, letter):
        return sides.select(F.col("doc_id").alias(key), F.col("n").alias(letter + "n"), F.col("sketch").alias(letter + "sketch"))

    return pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").mapInPandas(run, "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int, orders: int) -> DataFrame:
    """The linked ones of the pairs (a, b), each given once: all other orders' filters, then the whole sets.

    The texts travel, compressed, to the places of a; the documents of an a with many pairs are spread over several.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def shrink(batches):
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [small.compress(t) for t in utf8(batch["text"])]})

    def linked_pairs(ids, hubs, texts):
        words = Words(texts, lower=True)
        doc, shingles = _sets(words, width)
        n = np.bincount(doc, minlength=len(ids))
        at, hub = np.flatnonzero(~hubs), np.flatnonzero(hubs)
        to = hub[np.searchsorted(hub, at) - 1]  # the rows of a place follow its hub
        for number in range(2, orders + 1):
            head = order_heads(doc, shingles, n, number)
            ok = may_link([head[i] for i in to], [head[i] for i in at], n[to], n[at], num, den) if len(at) else at
            at, to = at[ok], to[ok]
        if len(at):
            sets = _split(shingles, n)
            ok = linked([sets[i] for i in to], [sets[i] for i in at], num, den)
            yield pd.DataFrame({"a": ids[to[ok]], "b": ids[at[ok]]})

    def run(batches):
        rows = [batch for batch in batches if len(batch)]
        if not rows:
            return
        rows = pd.concat(rows, ignore_index=True)
        rows["other"] = rows["doc_id"] != rows["a"]
        rows = rows.drop_duplicates(["a", "salt", "doc_id"]).sort_values(["a", "salt", "other"], kind="stable")
        large = zstandard.ZstdDecompressor()
        start = np.append(np.flatnonzero(~rows["other"].to_numpy()), len(rows))
        ids, hubs, texts = rows["doc_id"].to_numpy(np.int64), ~rows["other"].to_numpy(), rows["text"].tolist()
        sizes = np.array([zstandard.frame_content_size(t) for t in texts])
        for i, j in slices(np.add.reduceat(sizes, start[:-1]).tolist()):
            a, b = start[i], start[j]
            yield from linked_pairs(ids[a:b], hubs[a:b], [large.decompress(t) for t in texts[a:b]])

    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("salts"))
    salted = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), F.col("b").alias("doc_id"))
    places = cut_ids(salted.unionByName(salted.select("a", "salt", F.col("a").alias("doc_id")).distinct()))
    texts = near_ids(docs.select("doc_id", "text"), places).mapInPandas(shrink, "doc_id long, text binary")
    return (texts.join(places, "doc_id").select("a", "salt", "doc_id", "text").repartition(parts, "a", "salt")
            .mapInPandas(run, "a long, b long"))


def _hubs(pairs: DataFrame) -> DataFrame:
    """(a, b): for each document b the one of its pairs that has most pairs, if it has more than b (ties: smaller ids)."""
    ends = pairs.union(pairs.select("b", "a")).toDF("a", "b")
    rank = ends.groupBy("a").agg(F.struct(F.count(F.lit(1)).alias("c"), (-F.col("a")).alias("m")).alias("rank"))
    best = ends.join(rank, "a").groupBy("b").agg(F.max("rank").alias("best"))
    return (best.join(rank.select(F.col("a").alias("b"), "rank"), "b").filter("best > rank")
            .select((-F.col("best.m")).alias("a"), "b"))


def _labels(links: DataFrame) -> DataFrame:
    """doc, label: documents with the same label are in one component.  ``links`` has a b once at most."""
    step = links.select(F.col("b").alias("doc"), F.col("a").alias("label"))
    far = step.select(F.col("doc").alias("label"), F.col("label").alias("far"))
    return step.join(far, "label", "left").select("doc", F.coalesce("far", "label").alias("label"))


def _labelled(rows: DataFrame, labels: DataFrame, doc: str, label: str) -> DataFrame:
    named = labels.select(F.col("doc").alias(doc), F.col("label").alias("_label"))
    return rows.join(named, doc, "left").withColumn(label, F.coalesce("_label", doc)).drop("_label")


def jaccard_components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100,
                       orders: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every row of ``docs`` (doc_id, text).

    class_id is the smallest doc_id with the same set.  A row with a null doc_id is in
    the class and component of documents with the same set, if there are any, else in none.  Rows that
    repeat a doc_id have the same text and come back as often as they came.
    Further columns of ``docs`` are not used.
    """
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(rarity_class(rarity(docs, width)))
    all_docs = cut_lineage(describe(docs, width))
    ids = cut_lineage(all_docs.filter("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n")
                      .agg(F.min("doc_id").alias("class_id")))
    # documents that are not their class's first, told without moving the others' texts
    copies = all_docs.filter("doc_id IS NOT NULL").join(
        ids.select(F.col("class_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id").distinct()
    firsts = without_ids(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"), cut_ids(copies))
    met = cut_lineage(postings(firsts, width, num, den, classes))
    classes.destroy()
    known = all_docs.filter("doc_id IS NOT NULL")
    hot = met.filter("other IS NULL").drop("other")
    kept = ["doc_id", "least", *FOLDS]
    told = cut_ids(hot.join(near_ids(known.select(kept), hot.select(F.col("doc").alias("doc_id")))
                                .dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "doc"), "doc"))
    # as _fits
    fit = (f"least(n, n2) * {den} >= greatest(n, n2) * {num} AND "
           f"least(n - at, n2 - at2) * {den + num} >= {num} * (n + n2)")

    def led(*keys):
        leaders = told.groupBy(*keys).agg(F.min(F.struct("at", F.xxhash64("doc"), "doc", "n")).alias("l")).select(
            *keys, F.col("l.doc").alias("doc2"), F.col("l.n").alias("n2"), F.col("l.at").alias("at2"))
        return told.join(leaders, list(keys)).filter(f"doc <> doc2 AND {fit}").select(F.col("doc").alias("a"), F.col("doc2").alias("b"))

    near = met.filter("other IS NOT NULL").select(F.col("doc").alias("a"), F.col("other").alias("b"))
    pairs = cut_lineage(_sketched(near.union(led("shingle")).union(led("shingle", "least")), known, num, den))
    links = cut_lineage(verify(cut_ids(_hubs(pairs)), docs, width, num, den, orders))
    labels = cut_ids(_labels(links))
    rest = _labelled(_labelled(pairs, labels, "a", "la"), labels, "b", "lb").filter("la <> lb").select("a", "b")
    told = cut_ids(_labelled(told, labels, "doc", "label"))
    main = (told.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle")
            .agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
            .select("shingle", F.col("m.label").alias("main")))
    outside = told.join(main, "shingle").filter("label <> main").drop("main")
    other = told.select(*[F.col(c).alias(c + "2") for c in ("shingle", "doc", "n", "at", "label", *FOLDS)])
    apart = " + ".join(f"bit_count({k} ^ {k}2)" for k in FOLDS)
    found = outside.join(other, F.expr(f"shingle = shingle2 AND label <> label2 AND {fit} AND "
                                       f"({apart}) * {den + num} <= (n + n2) * {den - num}"))
    found = _sketched(found.select(F.col("doc").alias("a"), F.col("doc2").alias("b")), known, num, den)
    last = cut_ids(rest.union(found).distinct())
    labels = components(links.union(verify(last, docs, width, num, den, orders)))
    named = labels.select(F.col("node").alias("class_id"), "component")
    ids = (ids.join(named, "class_id", "left")
           .select("s1", "s2", "n", "class_id", F.coalesce("component", "class_id").alias("component")))
    return (all_docs.select("doc_id", "n", "s1", "s2").join(ids, ["s1", "s2", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")))


def one_per_component(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents left when of each component only its smallest doc_id stays.

    Documents without words and documents without doc_id stay; of rows that share a doc_id and
    are kept, all stay.
    """
    found = cut_lineage(jaccard_components(docs, width, num, den).filter("component_id <> doc_id")
                        .select("doc_id").distinct())
    return without_ids(docs, found)


@register("op1_ngram_join", sql=r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS g
      FROM w),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
      WHERE 100 * shared >= 85 * (len(x.g) + len(y.g) - shared)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, len(g) AS n_shingles, least(doc_id, (SELECT min(b) FROM r WHERE a = doc_id)) AS component_id FROM s
""")
def op1_ngram_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
