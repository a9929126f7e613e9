"""Phrase collocations by direct-address tiling.

Frequent words get ids by language and falling frequency.  A phrase of two words is an address in
the square of ids, which is split into tiles of SIDE by SIDE.  Inside a task, addresses come in runs:
tiles that a run fills are counted by a dense ``bincount``, the others as sorted coordinates with
counts.  Tasks send counts, not occurrences; a reducer adds them up.  Texts are split into words once and
written as runs: a list of distinct words and each word's place in it, so that the later passes
look up the distinct words of a run only.  Frequent pairs are then ranked
by frequency themselves, and phrases of three words are addresses in (pair rank, word id), counted
the same way; only triples of two frequent pairs are looked at, as no other can be frequent.

The ids that travel to the tasks are bounded: HEAD words and PAIRS pairs.  Beyond them nothing is
lost.  Triples of a pair without a rank are coordinates of three word ids.  Phrases that hold a word
without an id are coordinates too, by a 64-bit hash; those whose hash is frequent are then counted by
their words, so a clash of hashes costs time, no count.  Bitmaps of fixed size say which words, pairs
and hashes are frequent; where they are wrong they let too much pass, never too little.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
import re

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from standlab.llm.packed import pack, unpack
from standlab.llm.registry import register
from standlab.llm.tables import ready, table
from standlab.llm.words import gram_hashes, mix, utf8
from standlab.session import cut_lineage

HEAD = 1 << 15  # words with an id
PAIRS = 1 << 16  # pairs with a rank
LONGEST = 64  # bytes of a word with an id
SIDE = 512  # of a tile
FULL = SIDE * SIDE // 8  # addresses of a run that make a tile dense
RUN = 1 << 20  # addresses counted at once
TILES = 48  # dense tiles a task holds
BITS = 20  # of a word id in a key
SLOTS = 1 << 24  # bits of a bitmap
PIECE = 1 << 21  # bytes of text that are split at once
HELD = 1 << 23  # bytes of texts of all languages that wait for their runs
RUNS = "lang string, carried int, words binary, found binary, places binary"
SEED = 42  # of word hashes, as Spark has it
EDGE = b"."  # stands for every end of a piece
_TABLE = bytes(ord(EDGE) if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c
               for c in range(256))
_GAP = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")


# -- words of texts -------------------------------------------------------------------------

def pieces(text: bytes, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Words of a text with EDGE where a piece ends; of a long text several lists, each led by up to
    ``size - 1`` words of the one before it, whose number is given, so that every phrase of ``size`` words lies whole in one."""
    at, carry = 0, []
    while at < len(text):
        stop = at + PIECE
        if stop < len(text):
            gap = _GAP.search(text, stop)
            stop = gap.start() if gap else len(text)
        words = carry + text[at:stop].translate(_TABLE).replace(EDGE, b" . ").split()
        yield len(carry), words
        carry = words[max(0, len(words) - size + 1):] if size > 1 else []
        at = stop


def word_runs(docs: DataFrame) -> DataFrame:
    """Texts of a language, one behind the other, as runs of about PIECE bytes: distinct words, how often each
    was found, and the place of every word.  The first ``carried`` words end the run before; they are not counted."""
    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch["lang"], utf8(batch["text"])):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    def rows(held):
        for lang, texts in held.items():
            for carried, words in pieces(EDGE.join(texts), 3):
                place = defaultdict()
                place.default_factory = place.__len__
                places = np.array([place[w] for w in words] + [place[EDGE]], np.int32)
                found = np.bincount(places[carried:], minlength=len(place))
                yield pd.DataFrame([(lang, carried, zstandard.compress(b" ".join(place), 1), pack(found, np.int32), pack(places, np.int32))],
                                   columns=["lang", "carried", "words", "found", "places"])

    return docs.mapInPandas(run, RUNS)


def word_counts(runs: DataFrame) -> DataFrame:
    """lang, word, c: occurrences of every word; an empty word carries the language's total."""
    def run(batches):
        counts, total = {}, Counter()
        for batch in batches:
            for lang, words, found in zip(batch["lang"], batch["words"], batch["found"]):
                mine = counts.setdefault(lang, {})
                get = mine.get
                for word, c in zip(zstandard.decompress(words).split(b" "), unpack(found, np.int32).tolist()):
                    mine[word] = get(word, 0) + c
                if sum(map(len, counts.values())) > RUN // 4:
                    yield rows(counts, total)
                    counts = {}
        yield rows(counts, total)
        yield pd.DataFrame([(lang, "", c) for lang, c in total.items()], columns=["lang", "word", "c"])

    def rows(counts, total):
        out = [(lang, w.decode("utf-8", "surrogatepass"), c) for lang, some in counts.items()
               for w, c in some.items() if w != EDGE and c]
        for lang, _, c in out:
            total[lang] += c
        return pd.DataFrame(out, columns=["lang", "word", "c"])

    parts = runs.select("lang", "words", "found").mapInPandas(run, "lang string, word string, c long")
    return parts.groupBy("lang", "word").agg(F.sum("c").alias("c"))


class Ids:
    """Word ids by language, built in each task from the plain lists that are broadcast."""

    def __init__(self, langs: list[str], words: list[bytes], frequent: np.ndarray | None):
        self.of: dict[str, dict[bytes, int]] = {}
        self.frequent = frequent
        for i, (lang, word) in enumerate(zip(langs, words)):
            self.of.setdefault(lang, {EDGE: -1})[word] = i
        self.none = {EDGE: -1}

    def array(self, lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and hashes of the words, and of an edge behind them.

        An id is -1 for an edge or a word that is not frequent, -2 for a frequent word without id.
        """
        get = self.of.get(lang, self.none).get
        ids = np.full(len(words) + 1, -1, np.int64)
        ids[:-1] = [get(w, -2) for w in words]
        hashes = mix(ids.view(np.uint64))
        at = np.flatnonzero(ids == -2)
        if len(at) and self.frequent is None:
            ids[at] = -1
        elif len(at):
            digest = xxhash.xxh64_intdigest
            own = np.array([digest(words[i], SEED) for i in at.tolist()], np.uint64)
            hashes[at] = own ^ np.uint64(digest(lang.encode("utf-8", "surrogatepass"), SEED))
            ids[at[~in_bitmap(self.frequent, own.view(np.int64))]] = -1
        return ids, hashes

    def run(self, lang: str, carried: int, words: bytes, places: bytes, size: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words of a run, and places, ids and hashes of its words, less those whose phrases of ``size`` words the run before has."""
        distinct = zstandard.decompress(words).split(b" ")
        ids, hashes = self.array(lang, distinct)
        places = unpack(places, np.int32)[max(0, carried - size + 1):]
        return distinct, places, ids[places], hashes[places]

    def runs(self, batch, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and hashes of a batch of runs, one behind the other."""
        both = [self.run(*row, size)[2:] for row in zip(*(batch[c] for c in ("lang", "carried", "words", "places")))]
        return tuple(np.concatenate(x) for x in zip(*both)) if both else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def with_tail(ids: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` frequent words, one without id among them at least, start at each word."""
    if len(ids) < size:
        return np.zeros(0, bool)
    whole, tail, n = ids != -1, ids == -2, len(ids) - size + 1
    return (np.logical_and.reduce([whole[k:k + n] for k in range(size)])
            & np.logical_or.reduce([tail[k:k + n] for k in range(size)]))


def tail_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    return gram_hashes(hashes, size)[:max(0, len(hashes) - size + 1)].view(np.int64)


def in_bitmap(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    slot = numbers % SLOTS
    return bits[slot >> 3] >> (slot & 7) & 1 > 0


# -- counting addresses ---------------------------------------------------------------------

def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Coordinates:
    """Counts of keys of one task, as sorted runs."""

    def __init__(self):
        self.runs, self.held = [], 0

    def add(self, keys: np.ndarray):
        keys = np.sort(keys)
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
        self.runs.append((keys[first], np.diff(np.append(first, len(keys)))))
        self.held += len(first)
        if self.held > 2 * RUN:
            self.runs = [add_up(*(np.concatenate(x) for x in zip(*self.runs)))]
            self.held = len(self.runs[0][0])

    def out(self) -> tuple[np.ndarray, np.ndarray]:
        """All counts so far; the task holds none afterwards."""
        runs, self.runs, self.held = self.runs, [], 0
        return add_up(*(np.concatenate(x) for x in zip(*runs))) if runs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Tiles:
    """Counts of addresses (left, right) of one task; lefts below ``ranked`` are ranks, others keys."""

    def __init__(self, ranked: int, rights: int):
        self.ranked, self.across = ranked, -(-rights // SIDE)
        self.dense: dict[int, np.ndarray] = {}
        self.waiting, self.n = [], 0
        self.sparse = Coordinates()

    def add(self, left: np.ndarray, right: np.ndarray):
        self.waiting.append((left, right))
        self.n += len(left)
        if self.n >= RUN:
            self.count()

    def full(self) -> bool:
        return self.sparse.held > RUN or len(self.dense) > TILES

    def count(self):
        if not self.waiting:
            return
        left, right = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.n = [], 0
        in_rank = np.flatnonzero(left < self.ranked)
        tile = left[in_rank] // SIDE * self.across + right[in_rank] // SIDE
        size = np.bincount(tile)
        is_full = size >= FULL
        full = np.flatnonzero(is_full)
        at = in_rank[is_full[tile]]
        slot = np.cumsum(is_full) - 1
        address = (slot[tile[is_full[tile]]] * SIDE + left[at] % SIDE) * SIDE + right[at] % SIDE
        counted = np.bincount(address, minlength=len(full) * SIDE * SIDE).reshape(len(full), SIDE * SIDE)
        for number, square in zip(full.tolist(), counted):
            if number in self.dense:
                self.dense[number] += square
            else:
                self.dense[number] = square.copy()
        rest = np.ones(len(left), bool)
        rest[at] = False
        self.sparse.add(left[rest] << BITS | right[rest])

    def out(self) -> tuple[np.ndarray, np.ndarray]:
        """All counts so far, in order of their keys; the task holds none afterwards."""
        self.count()
        parts = [self.sparse.out()]
        for number, square in self.dense.items():
            at = np.flatnonzero(square)
            left, right = number // self.across * SIDE + at // SIDE, number % self.across * SIDE + at % SIDE
            parts.append((left << BITS | right, square[at]))
        self.dense = {}
        return add_up(*(np.concatenate(x) for x in zip(*parts)))


def _dealt(kind: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pd.DataFrame:
    """Packed counts, one row for each target; a tile's rows of addresses are spread over targets."""
    part = (mix((keys >> np.int64(BITS + 3)).view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    keys, counts, part = keys[order], counts[order], part[order]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    rows = [(int(part[a]), kind, pack(np.diff(keys[a:b], prepend=0), np.int64), pack(counts[a:b], np.int64))
            for a, b in zip(first, np.append(first[1:], len(part)))]
    return pd.DataFrame(rows, columns=["part", "kind", "keys", "counts"])


def _added(least: int):
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def run(batches):
        done, new, size = [none, none], [[], []], [0, 0]
        for batch in batches:
            for kind, k, c in zip(batch["kind"], batch["keys"], batch["counts"]):
                new[kind].append((np.cumsum(unpack(k, np.int64)), unpack(c, np.int64)))
                size[kind] += len(new[kind][-1][0])
                if size[kind] > max(RUN, len(done[kind][0])):
                    done[kind] = add_up(*(np.concatenate(x) for x in zip(done[kind], *new[kind])))
                    new[kind], size[kind] = [], 0
        for kind in (0, 1):
            keys, counts = add_up(*(np.concatenate(x) for x in zip(done[kind], *new[kind])))
            often = np.flatnonzero(counts >= least)
            for at in range(0, len(often), RUN):
                k, c = keys[often[at:at + RUN]], counts[often[at:at + RUN]]
                yield pd.DataFrame({"lhs": k if kind else k >> BITS, "rhs": -1 if kind else k & ((1 << BITS) - 1), "a": c})
    return run


def _counted(runs: DataFrame, size: int, head, ranked: int, addresses, least: int) -> DataFrame:
    """lhs, rhs, a: what ``addresses(ids, hashes)`` names in the runs of words, found ``least`` times at least.

    It names addresses, and hashes of phrases with a word without id, which come as lhs beside rhs -1.
    """
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        langs, words, frequent = head.value
        ids, tiles, tail = Ids(langs, words, frequent), Tiles(ranked, max(1, len(words))), Coordinates()
        find = addresses()
        for batch in batches:
            left, right, others = find(*ids.runs(batch, size))
            tiles.add(left, right)
            tail.add(others)
            if tiles.full():
                yield _dealt(0, *tiles.out(), parts)
            if tail.held > RUN:
                yield _dealt(1, *tail.out(), parts)
        yield _dealt(0, *tiles.out(), parts)
        yield _dealt(1, *tail.out(), parts)

    packed = runs.select("lang", "carried", "words", "places").mapInPandas(run, "part int, kind int, keys binary, counts binary")
    return packed.repartitionById(parts, F.col("part")).mapInPandas(_added(least), "lhs long, rhs long, a long")


def pair_addresses():
    def find(ids, hashes):
        both = (ids[:-1] >= 0) & (ids[1:] >= 0)
        return ids[:-1][both], ids[1:][both], tail_hashes(hashes, 2)[with_tail(ids, 2)]
    return find


def triple_addresses(ranks, ranked: int):
    """(pair, word) of triples whose two pairs may be frequent; a pair without a rank stands for itself."""
    def make():
        keys, rank, pairs, tails = ranks.value

        def find(ids, hashes):
            known = (ids[:-1] >= 0) & (ids[1:] >= 0)
            pair = np.where(known, ids[:-1] << BITS | ids[1:], -1)
            left = np.full(len(pair), -1, np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                left = np.where(keys[at] == pair, rank[at], -1)
            if pairs is not None:
                may = np.flatnonzero(known & (left < 0))
                may = may[in_bitmap(pairs, pair_number(ids[may], ids[may + 1]))]
                left[may] = ranked + pair[may]
            both = (left[:-1] >= 0) & (left[1:] >= 0)
            others = np.zeros(0, np.int64)
            if tails is not None:
                of_tail = np.flatnonzero(with_tail(ids, 2))
                of_tail = of_tail[in_bitmap(tails, tail_hashes(hashes, 2)[of_tail])]
                fit = left >= 0
                fit[of_tail] = True
                others = tail_hashes(hashes, 3)[with_tail(ids, 3) & fit[:-1] & fit[1:]]
            return left[:-1][both], ids[2:][both], others
        return find
    return make


def pair_number(left, right):
    """A number of a pair of ids for the bitmap; for arrays and for columns alike."""
    return left * 1_000_003 + right


def bitmap(numbers: DataFrame) -> np.ndarray | None:
    """SLOTS bits, those of the column ``number`` set; none where there is no row."""
    place = F.pmod(F.col("number"), F.lit(SLOTS)) + 1
    rows = numbers.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(SLOTS // 8, np.uint8)
    for row in rows:
        part = np.frombuffer(row["bits"], np.uint8)
        out[(row["bucket"] - 1) * len(part):][:len(part)] |= part
    return out if rows else None


def tail_phrases(runs: DataFrame, head, often, least: int) -> DataFrame:
    """lang, phrase, size, a: phrases of two and three words, one without id among them at least,
    whose hashes are in the bitmap ``often``.  Tasks send packed counts of texts."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        ids, may, counts = Ids(*head.value), often.value, Counter()
        for batch in batches:
            for lang, carried, words, places in zip(*(batch[c] for c in ("lang", "carried", "words", "places"))):
                for size in (2, 3):
                    distinct, place, number, hashes = ids.run(lang, carried, words, places, size)
                    at = np.flatnonzero(with_tail(number, size))
                    at = at[in_bitmap(may, tail_hashes(hashes, size)[at])]
                    if not len(at):
                        continue
                    key = np.zeros(len(at), np.int64)  # a run has fewer than 2^21 distinct words
                    for k in range(size):
                        key = key << 21 | place[at + k]
                    _, first, found = np.unique(key, return_index=True, return_counts=True)
                    for i, c in zip(at[first].tolist(), found.tolist()):
                        counts[lang, size, b" ".join([distinct[j] for j in place[i:i + size].tolist()])] += c
            if len(counts) > RUN // 8:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    def rows(counts):
        dealt = {}
        for (lang, size, phrase), c in counts.items():
            dealt.setdefault((xxhash.xxh64_intdigest(phrase) % parts, lang, size), []).append((phrase, c))
        return pd.DataFrame([(*key, zstandard.compress(b"\n".join(p for p, _ in some)), pack(np.array([c for _, c in some]), np.int64))
                             for key, some in dealt.items()], columns=["part", "lang", "size", "phrases", "counts"])

    def added(batches):
        total = {}
        for batch in batches:
            for lang, size, phrases, counts in zip(batch["lang"], batch["size"], batch["phrases"], batch["counts"]):
                mine = total.setdefault((lang, size), Counter())
                for phrase, c in zip(zstandard.decompress(phrases).split(b"\n"), unpack(counts, np.int64).tolist()):
                    mine[phrase] += c
        for (lang, size), mine in total.items():
            found = [(lang, p.decode("utf-8", "surrogatepass"), size, c) for p, c in mine.items() if c >= least]
            yield pd.DataFrame(found, columns=["lang", "phrase", "size", "a"])

    packed = runs.select("lang", "carried", "words", "places").mapInPandas(
        run, "part int, lang string, size int, phrases binary, counts binary")
    return packed.repartitionById(parts, F.col("part")).mapInPandas(added, "lang string, phrase string, size int, a long")


# -- scores ---------------------------------------------------------------------------------

def _score(a, l, r):
    """floor(1000000 a a / (l r)) in exact whole numbers of up to 38 digits."""
    a, l, r = (f"CAST({x} AS DECIMAL(15,0))" for x in (a, l, r))
    return F.expr(f"CAST((CAST(1000000 AS DECIMAL(7,0)) * ({a} * {a})) div ({l} * {r}) AS BIGINT)")


def frequent_phrases(docs: DataFrame, least: int, head: int, ranked: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, w, c; an empty one with the language's total), pairs and triples (lang, w1, w2, w3, a)."""
    spark = docs.sparkSession
    runs = cut_lineage(word_runs(docs))
    words = cut_lineage(word_counts(runs).filter(f"c >= {least} OR word = ''").withColumnRenamed("word", "w"))
    known = words.filter("w <> ''")
    first = (known.filter(F.octet_length("w") <= LONGEST).orderBy(F.desc("c"), "lang", "w").limit(head)
             .toPandas().sort_values(["lang", "c", "w"], ascending=[True, False, True], kind="stable"))
    langs, texts = first["lang"].tolist(), first["w"].tolist()
    names = cut_lineage(spark.createDataFrame(list(zip(range(len(langs)), langs, texts)), "id long, lang string, w string"))
    others = known.join(names, ["lang", "w"], "left_anti")
    sent = spark.sparkContext.broadcast((langs, utf8(texts), bitmap(others.select(F.xxhash64("w").alias("number")))))

    def named(df, key, out):
        return df.join(names.select(F.col("id").alias(key), F.col("w").alias(out), *(["lang"] if out == "w1" else [])), key)

    found = cut_lineage(_counted(runs, 2, sent, len(langs), pair_addresses, least))
    pairs, tails = found.filter("rhs >= 0"), found.filter("rhs < 0").select(F.col("lhs").alias("number"))
    top = pairs.orderBy(F.desc("a"), "lhs", "rhs").limit(ranked).select("lhs", "rhs").toPandas()
    keys = (top["lhs"].to_numpy(np.int64) << BITS) | top["rhs"].to_numpy(np.int64)
    order = np.argsort(keys)
    unranked = None if len(keys) < ranked else bitmap(pairs.select(pair_number(F.col("lhs"), F.col("rhs")).alias("number")))
    ranks = spark.sparkContext.broadcast((keys[order], order, unranked, bitmap(tails)))
    found = cut_lineage(_counted(runs, 3, sent, ranked, triple_addresses(ranks, ranked), least))
    triples, tails = found.filter("rhs >= 0"), tails.union(found.filter("rhs < 0").select("lhs"))
    ranked_pairs = cut_lineage(spark.createDataFrame(pd.DataFrame(
        {"lhs": np.arange(len(keys)), "i1": keys >> BITS, "i2": keys & ((1 << BITS) - 1)}), "lhs long, i1 long, i2 long"))
    by_rank = triples.filter(F.col("lhs") < ranked).join(ranked_pairs, "lhs").select("i1", "i2", "rhs", "a")
    by_words = triples.filter(F.col("lhs") >= ranked).withColumn("lhs", F.col("lhs") - ranked).select(
        F.shiftright("lhs", BITS).alias("i1"), F.col("lhs").bitwiseAND((1 << BITS) - 1).alias("i2"), "rhs", "a")
    triples = named(named(named(by_rank.union(by_words), "i1", "w1"), "i2", "w2"), "rhs", "w3").select(
        "lang", "w1", "w2", "w3", "a")
    pairs = named(named(pairs, "lhs", "w1"), "rhs", "w2").select("lang", "w1", "w2", "a")
    often = bitmap(tails)
    if often is not None:
        tail = cut_lineage(tail_phrases(runs, sent, spark.sparkContext.broadcast(often), least))
        split = F.split("phrase", " ")
        pairs, triples = (df.union(tail.filter(F.col("size") == size).select("lang", *[split[i] for i in range(size)], "a"))
                          for df, size in ((pairs, 2), (triples, 3)))
    return words, cut_lineage(pairs), cut_lineage(triples)


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, within: int = 50, head: int = HEAD,
                 ranked: int = PAIRS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two and three words of each language.

    a, l and r count a phrase and the two parts of its lowest-scoring cut, n the language's words.
    Phrases found fewer than ``least`` times are no candidates, and one is dropped where a longer
    candidate around it has ``within`` hundredths of its count.  A null lang is ``und``, a null
    text is empty; each row counts, repeated or not.  Ties go to the phrase first in byte order.  An
    empty table gives no rows; columns other than lang and text are not used.  Counts up to 10^15 are
    exact, larger ones end the job with an error.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words, pairs, triples = frequent_phrases(docs, least, head, ranked)
    c = F.col

    def single(at, out):
        return words.filter("w <> ''").select("lang", c("w").alias(at), c("c").alias(out))

    def double(x, y, out):
        return pairs.select("lang", c("w1").alias(x), c("w2").alias(y), c("a").alias(out))

    around = triples.select("lang", "w1", "w2", "a").union(triples.select("lang", c("w2"), c("w3"), "a")).groupBy(
        "lang", "w1", "w2").agg(F.max("a").alias("longer"))
    two = (pairs.join(around, ["lang", "w1", "w2"], "left")
           .filter(f"longer IS NULL OR 100 * longer < {within} * a")
           .join(single("w1", "l"), ["lang", "w1"]).join(single("w2", "r"), ["lang", "w2"])
           .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score")))
    three = (triples.join(single("w1", "l1"), ["lang", "w1"]).join(double("w2", "w3", "r1"), ["lang", "w2", "w3"])
             .join(double("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(single("w3", "r2"), ["lang", "w3"])
             .withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")}))
    cut = F.when(c("s1") <= c("s2"), F.struct(c("l1").alias("l"), c("r1").alias("r"), c("s1").alias("score"))).otherwise(
        F.struct(c("l2").alias("l"), c("r2").alias("r"), c("s2").alias("score")))
    three = three.withColumn("cut", cut).select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.*")
    scored = two.union(three)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for shares in (512, 64, 8, 1):  # the best of shares of a language first, so that no task sorts all of one
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        scored = scored.withColumn("share", share).withColumn("rank", F.row_number().over(
            Window.partitionBy("lang", "share").orderBy(*order)).cast("long")).filter(c("rank") <= top)
    totals = words.filter("w = ''").select("lang", c("c").alias("n"))
    return scored.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@register("op12_collocations", sql=r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM g, (VALUES (1), (2), (3)) s(k)
      WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
x AS (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3),
y AS (SELECT lang, phrase, max(a) AS longer FROM x GROUP BY ALL),
h AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS cut FROM c),
m AS (SELECT *, array_to_string(w[1:cut], ' ') AS p1, array_to_string(w[cut + 1:], ' ') AS p2 FROM h),
u AS (SELECT m.lang, m.phrase, m.a, m.k, cut, l.a AS l, r.a AS r,
       ((1000000::HUGEINT * m.a * m.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM m JOIN f l ON l.lang = m.lang AND l.phrase = p1 JOIN f r ON r.lang = m.lang AND r.phrase = p2),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
z AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score,
       row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
      FROM b LEFT JOIN y ON b.k = 2 AND y.lang = b.lang AND y.phrase = b.phrase
      WHERE y.longer IS NULL OR 100 * y.longer < 50 * b.a)
SELECT z.lang, z.rank, z.phrase, z.a, z.l, z.r, n.n, z.score FROM z JOIN n USING (lang) WHERE z.rank <= 2000
""")
def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
