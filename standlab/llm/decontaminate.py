"""Benchmark decontamination: BM25 index of test items, searched by block-max WAND with every passage.

Test items are the indexed documents, passages of the training texts the queries.  Scores are
BM25 divided by the item's score against itself, so one threshold fits items of any length.  A leak that
verification accepts has four fifths of the item's shingles, so it scores well above the threshold.
A passage has twice the words of the longest item and starts every so many words, so a leaked item
is whole inside one passage.  Every passage is bounded first by the sum of its terms' highest
weights, then, for many passages at once, by the sums of its terms' block maxima; those that can
reach the threshold in some block are searched by WAND: lists sorted by their next item, a pivot
from term maxima, then the maxima of the blocks around the pivot, and only then scores.
Every item above the threshold is retrieved and verified on five-word shingles of its question and
of its answer.

Words are lower-cased (A-Z) runs of letters, digits and bytes above 127; other signs separate.
An item's answer is what follows its last question mark, or else its last sentence; an item
of one sentence has no answer and is judged by the question alone.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from standlab.llm.registry import register
from standlab.llm.tables import table, without_ids
from standlab.llm.words import Words, gram_hashes, slices, text_sizes, utf8
from standlab.session import cut_lineage

K1, B = 1.2, 0.75
BLOCK = 4  # items in a block of a posting list; their maxima bound 4 items at once
CELLS = 1 << 22  # bounds held at once
WIDTH = 5
SHARD_CHARS = 16 << 20  # text of test items that one broadcast index holds at most, but for one item
_SIGNS = bytes(b if 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b > 127 else 32 for b in range(256))


def _plain(text: str | None) -> bytes:
    return utf8([text])[0].translate(_SIGNS)


def question_and_answer(text: str) -> tuple[str, str]:
    at = text.rstrip().rfind("?") + 1
    if 0 < at < len(text.rstrip()):
        return text[:at], text[at:]
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", text.rstrip())]
    return (text[:ends[-1]], text[ends[-1]:]) if ends else (text, "")


def shingles(words: np.ndarray) -> np.ndarray:
    """Distinct five-word shingles; fewer words are one shingle."""
    if not len(words):
        return words
    width = min(WIDTH, len(words))
    return np.unique(gram_hashes(words, width)[: len(words) - width + 1])


class Index:
    """Inverted index of items: for each term the items and weights, with block maxima."""

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], n_items: int, mean: float):
        self.ids, self.question, self.answer = [], [], []
        triples, self.longest = [], 0
        for item, text in items:
            words = Words([_plain(text)], lower=True).hashes[0]
            if not len(words):
                continue
            k = len(self.ids)
            self.ids.append(item)
            q, a = (Words([_plain(t)], lower=True).hashes[0] for t in question_and_answer(text))
            self.question.append(shingles(q if len(q) else a)), self.answer.append(shingles(a if len(q) else q))
            self.longest = max(self.longest, len(words))
            terms, tf = np.unique(words, return_counts=True)
            d = np.array([df[t] for t in terms.tolist()], float)
            idf = np.log1p((n_items - d + 0.5) / (d + 0.5))
            weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            triples.append((terms, np.full(len(terms), k), weight / weight.sum()))
        self.ids = np.array(self.ids)
        terms, item, weight = (np.concatenate(x) if x else np.zeros(0) for x in (list(zip(*triples)) or [(), (), ()]))
        order = np.lexsort((item, terms))
        self.item, self.weight = item[order].astype(np.int64), weight[order]
        self.vocab, self.first = np.unique(terms[order], return_index=True)
        self.vocab = self.vocab.astype(np.uint64)
        self.end = np.append(self.first[1:], len(order))
        self.top = np.array([self.weight[a:b].max() for a, b in zip(self.first, self.end)])
        # block maxima: the posting's place -> highest weight of its term among items of its block
        block = self.item // BLOCK
        new = np.ones(len(order), bool)
        term_of = np.repeat(np.arange(len(self.vocab)), self.end - self.first)
        new[1:] = (block[1:] != block[:-1]) | (term_of[1:] != term_of[:-1])
        group = np.cumsum(new) - 1
        highest = np.zeros(group[-1] + 1 if len(group) else 0)
        np.maximum.at(highest, group, self.weight)
        self.block_top = highest[group] if len(group) else highest
        self.blocks = len(self.ids) // BLOCK + 1
        self.group_block, self.group_top = block[new], highest
        self.group_first = np.searchsorted(term_of[new], np.arange(len(self.vocab) + 1))

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes, -1 where no item has the word."""
        if not len(self.vocab):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == hashes, at, -1)

    def search(self, terms, threshold: float) -> list[tuple[int, float]]:
        """All items whose weights over the terms add up to the threshold, by block-max WAND."""
        item, weight, block_top, top = self.item, self.weight, self.block_top, self.top
        lists = [[int(item[self.first[t]]), int(self.first[t]), int(self.end[t]), float(top[t])] for t in terms]
        found = []
        slack = threshold - 1e-9
        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for i, entry in enumerate(lists):
                total += entry[3]
                if total >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            goal = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == goal:
                pivot += 1
            edge = (goal // BLOCK + 1) * BLOCK
            bound = 0.0
            for entry in lists[:pivot + 1]:
                if entry[0] < goal:  # bound of the list's part in the pivot's block
                    entry[1] += int(np.searchsorted(item[entry[1]:entry[2]], goal))
                    entry[0] = int(item[entry[1]]) if entry[1] < entry[2] else -1
                if entry[0] >= 0 and entry[0] < edge:
                    bound += float(block_top[entry[1]])
            if bound < slack:  # nothing in this block before the next list begins
                after = min([edge, *[e[0] for e in lists[pivot + 1:]]])
                for entry in lists[:pivot + 1]:
                    if 0 <= entry[0] < after:
                        entry[1] += int(np.searchsorted(item[entry[1]:entry[2]], after))
                        entry[0] = int(item[entry[1]]) if entry[1] < entry[2] else -1
            else:
                score = 0.0
                for entry in lists[:pivot + 1]:
                    if entry[0] == goal:
                        score += float(weight[entry[1]])
                        entry[1] += 1
                        entry[0] = int(item[entry[1]]) if entry[1] < entry[2] else -1
                if score >= slack:
                    found.append((goal, score))
            lists = [e for e in lists if e[0] >= 0]
        return found


def _passages(words: Words, index: Index, threshold: float):
    """(text number, first word, last word + 1, terms) of the passages that may reach the threshold."""
    step = index.longest
    term = index.terms(words.hashes[0])
    at = np.flatnonzero(term >= 0)
    if not len(at):
        return
    doc = words.doc()[at]
    number = (at - words.first[doc]) // step
    base = np.cumsum(words.counts // step + 1) - (words.counts // step + 1)
    own = base[doc] + number
    size = len(index.vocab)
    before = number > 0  # the passage that began a step earlier holds the word too
    key = np.unique(np.concatenate([own * size + term[at], (own[before] - 1) * size + term[at][before]]))
    passage, term = np.divmod(key, size)
    bound = np.bincount(passage, weights=index.top[term])
    first = np.searchsorted(passage, np.arange(len(bound) + 1))
    alive = np.flatnonzero(bound >= threshold - 1e-9)
    most = max(1, CELLS // index.blocks)
    for i in range(0, len(alive), most):
        for p in _blocks_reach(alive[i:i + most], first, term, index, threshold):
            d = int(np.searchsorted(base, p, "right")) - 1
            start = words.first[d] + (p - base[d]) * step
            yield d, start, min(start + 2 * step, words.first[d + 1]), term[first[p]:first[p + 1]]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _blocks_reach(passages: np.ndarray, first, term, index: Index, threshold: float) -> np.ndarray:
    """The passages for which the block maxima of some block add up to the threshold."""
    terms = term[_ranges(first[passages], first[passages + 1] - first[passages])]
    row = np.repeat(np.arange(len(passages)), first[passages + 1] - first[passages])
    count = index.group_first[terms + 1] - index.group_first[terms]
    at = _ranges(index.group_first[terms], count)
    cell = np.repeat(row, count) * index.blocks + index.group_block[at]
    bound = np.bincount(cell, weights=index.group_top[at], minlength=len(passages) * index.blocks)
    return passages[bound.reshape(-1, index.blocks).max(axis=1) >= threshold - 1e-9]


def _share(wanted: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(wanted, there).mean()) if len(wanted) else 1.0


def _shards(benchmark: DataFrame):
    """Indexes of at most SHARD_CHARS of item text each, with document frequencies of all items."""
    items = benchmark.filter("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct()
    shards = int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS + 1
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))

    def count(batches):
        for batch in batches:
            for shard, text in zip(batch["shard"], batch["text"]):
                words = Words([_plain(text)], lower=True).hashes[0]
                yield pd.DataFrame({"shard": shard, "term": np.unique(words).view(np.int64), "words": len(words)})

    terms = items.mapInPandas(count, "shard long, term long, words long")
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sizes = items.mapInPandas(
        lambda batches: (pd.DataFrame({"words": [len(_plain(t).split()) for t in b["text"]]}) for b in batches),
        "words long").filter("words > 0").agg(F.count(F.lit(1)), F.avg("words")).first()
    for shard in range(shards):
        mine = [(r["item_id"], r["text"]) for r in items.filter(F.col("shard") == shard).orderBy("item_id", "text").collect()]
        if mine and sizes[0]:
            known = terms.filter(F.col("shard") == shard).select("term").distinct().join(df, "term").toPandas()
            frequency = dict(zip(known["term"].to_numpy(np.int64).view(np.uint64).tolist(), known["df"].tolist()))
            yield Index(mine, frequency, sizes[0], sizes[1])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.7, overlap: float = 0.8) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified leak.

    One row for each pair, with the passage of the highest score (then question, then answer
    overlap).  Null or wordless texts and items take no part; rows without doc_id neither. Rows that
    repeat a doc_id are one document.  An empty benchmark gives no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = spark.createDataFrame([], schema)
    for index in _shards(benchmark):
        shared = spark.sparkContext.broadcast(vars(index))  # plain arrays: workers need no copy of the class

        def run(batches, shared=shared):
            index = Index.__new__(Index)
            vars(index).update(shared.value)
            for batch in batches:
                for a, b in slices(text_sizes(batch["text"])):
                    ids = batch["doc_id"].iloc[a:b].to_numpy()
                    words = Words([_plain(t) for t in batch["text"].iloc[a:b]], lower=True)
                    rows = []
                    for d, start, end, terms in _passages(words, index, threshold):
                        there = None
                        for k, score in index.search(terms.tolist(), threshold):
                            if there is None:
                                there = shingles_of(words.hashes[0][start:end])
                            q, w = (_share(side[k], there) for side in (index.question, index.answer))
                            if q >= overlap and w >= overlap:
                                rows.append((ids[d], index.ids[k], score, q, w))
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = found.union(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
                            .mapInPandas(run, schema))
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def shingles_of(words: np.ndarray) -> np.ndarray:
    """Shingles of a passage, also the short ones that stand for short questions and answers."""
    return np.concatenate([gram_hashes(words, n)[: max(0, len(words) - n + 1)] for n in range(1, WIDTH + 1)])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified leak; rows without doc_id stay."""
    return without_ids(docs, cut_lineage(contaminated(docs, benchmark).select("doc_id").distinct()))


@register("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
