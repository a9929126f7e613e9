"""Quality selection by importance resampling over hashed n-gram models.

Two bag-of-n-grams models are counted over hashed unigrams and bigrams: the target from texts
labelled good (at most TRAIN of them, the documented bound of this classifier), the raw one from
all texts.  A text's importance is the log ratio of its two
probabilities.  Selection is Gumbel top-k: the log ratio plus Gumbel noise of the text's own
(a fixed hash of its id), of which the k highest are kept, which samples k texts without
replacement in proportion to their importance.

k is set by the labels: the number of texts whose log ratio reaches the cut that best separates
labelled good from labelled bad texts, unless a share is given.
Counts cover all texts; a task sends one vector of ``buckets`` counts, whatever its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from standlab.llm.registry import register
from standlab.llm.tables import table
from standlab.llm.words import Words, mix, slices, text_sizes, utf8
from standlab.session import cut_lineage

BUCKETS = 1 << 14
TRAIN = 100_000  # good labels that teach the target model at most, by the hash of their ids
BINS = 4096  # of log ratios, for the cut and for the k-th key
_MARK = np.zeros(256, np.uint8)  # 1 letters and digits, 2 other signs, 0 white space
_MARK[33:127] = 2
_MARK[128:] = 1
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = 1


def _signs_apart(text: bytes) -> bytes:
    """Runs of letters and runs of signs as words of their own."""
    data = np.frombuffer(text, np.uint8)
    kind = _MARK[data]
    cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    return np.insert(data, cut, 32).tobytes()


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every unigram and bigram."""
    words = Words([_signs_apart(t) for t in texts])
    doc, one = words.doc(), words.hashes[0]
    two, pair = words.grams(2), words.whole(2)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    return (np.concatenate([doc, doc[pair]]),
            np.concatenate([mix(one) >> shift, two[pair] >> shift]).astype(np.int64))


def _runs(batch):
    for a, b in slices(text_sizes(batch["text"])):
        yield batch.iloc[a:b], utf8(batch["text"].iloc[a:b])


def bucket_counts(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Target and raw counts of each bucket; ``docs`` has text and good (true, false or null)."""
    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for rows, data in _runs(batch):
                doc, bucket = features(data, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                good = rows["good"].eq(True).to_numpy(bool)
                target += np.bincount(bucket[good[doc]], minlength=buckets)
        if raw.any():
            for block in range(0, buckets, 4096):
                at = slice(block, block + 4096)
                yield pd.DataFrame({"block": [block], "target": [target[at].tobytes()], "raw": [raw[at].tobytes()]})

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [0, 0]
        for part in parts:
            for i, side in enumerate(("target", "raw")):
                for x in part[side]:
                    sums[i] = sums[i] + np.frombuffer(x, np.int64)
        yield pd.DataFrame({"block": [key[0]], "target": [sums[0].tobytes()], "raw": [sums[1].tobytes()]})

    add.__annotations__ = {"key": tuple, "parts": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    schema = "block int, target binary, raw binary"
    rows = docs.mapInPandas(count, schema).groupBy("block").applyInPandas(add, schema).collect()
    target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in rows:
        at = slice(r["block"], r["block"] + 4096)
        target[at], raw[at] = np.frombuffer(r["target"], np.int64), np.frombuffer(r["raw"], np.int64)
    return target, raw


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket, smoothed by one count."""
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def importance(spark, weights: np.ndarray):
    """A column function of texts: the log ratio; 0 for a null text or one without words."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def log_ratio(texts: pd.Series) -> pd.Series:
        table_, out = shared.value, []
        for a, b in slices(text_sizes(texts)):
            doc, bucket = features(utf8(texts.iloc[a:b]), len(table_))
            out.append(np.bincount(doc, weights=table_[bucket], minlength=b - a))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return log_ratio


def best_cut(scored: DataFrame, care: float = 5) -> float:
    """The log ratio that best separates labelled good texts from bad ones, each class in shares;
    a good text lost weighs ``care`` times a bad one rejected.

    Found on labelled texts in equal bins of the squashed ratio, so only bin counts are collected.
    Without labels of both kinds it is minus infinity: nothing is rejected.
    """
    squash = F.floor((F.col("log_ratio") / (F.abs("log_ratio") + 10) + 1) / 2 * BINS)
    bins = (scored.filter("good IS NOT NULL").groupBy(squash.alias("bin"))
            .agg(F.sum(F.col("good").cast("int")).alias("good"), F.count(F.lit(1)).alias("n"),
                 F.min("log_ratio").alias("low")).orderBy("bin").collect())
    good = np.array([b["good"] for b in bins], float)
    bad = np.array([b["n"] - b["good"] for b in bins], float)
    if not good.sum() or not bad.sum():
        return -np.inf
    lost = np.concatenate([[0], np.cumsum(good)[:-1]]) / good.sum()
    rejected = np.concatenate([[0], np.cumsum(bad)[:-1]]) / bad.sum()
    return float(bins[int(np.argmax(rejected - care * lost))]["low"])


def gumbel_key(log_ratio, doc_id, seed: int):
    """The log ratio plus Gumbel noise that depends on the id only."""
    uniform = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return log_ratio - F.log(-F.log(uniform))


def fit(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 17,
        buckets: int = BUCKETS, train: int = TRAIN):
    """Log ratios of the buckets, and the k-th highest key over all texts."""
    marks = (labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
             .agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
             .select("doc_id", (F.col("low") == 1).alias("good")))
    # the bounded sample of good labels travels to the texts, which so are never shuffled
    good = marks.filter("good").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(train)
    known = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left")
    weights = log_ratios(*bucket_counts(known.select("text", "good"), buckets))
    scored = docs.select("doc_id", importance(docs.sparkSession, weights)("text").alias("log_ratio"))
    scored = cut_lineage(scored.withColumn("gumbel_key", gumbel_key(F.col("log_ratio"), "doc_id", seed)))
    if share is None:
        cut = best_cut(scored.join(marks, "doc_id"))
        k = scored.filter(F.col("log_ratio") >= cut).count()
    else:
        k = round(share * scored.count())
    return weights, kth_highest(scored, k)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 17,
             buckets: int = BUCKETS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text and any others) with log_ratio, gumbel_key and selected.

    ``labels`` has doc_id and quality (1 good, 0 bad); other values, and a doc_id with both, are no
    label.  A null or blank text has log_ratio 0 and is judged like any other.  Rows with the same
    doc_id and text get the same key; ties at the k-th key are all selected.  Without labels
    of both kinds all rows are selected, unless ``share`` names the part to keep.  Columns of
    ``docs`` with the three new names are replaced.
    """
    weights, least = fit(docs, labels, share, seed, buckets)
    docs = docs.withColumn("log_ratio", importance(docs.sparkSession, weights)("text"))
    docs = docs.withColumn("gumbel_key", gumbel_key(F.col("log_ratio"), "doc_id", seed))
    return docs.withColumn("selected", F.col("gumbel_key") >= least)


def kth_highest(scored: DataFrame, k: int) -> float:
    """The k-th highest gumbel_key, by counting in ever finer bins; no sort, only counts are sent."""
    if k <= 0:
        return np.inf
    low, high, n = scored.agg(F.min("gumbel_key"), F.max("gumbel_key"), F.count("gumbel_key")).first()
    if k >= n:
        return -np.inf
    above = 0
    while low < high:
        step = (high - low) / BINS
        place = F.least(F.floor((F.col("gumbel_key") - low) / step), F.lit(BINS - 1))
        rows = (scored.filter(F.col("gumbel_key").between(low, high)).groupBy(place.alias("bin"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("gumbel_key").alias("low"),
                     F.max("gumbel_key").alias("high")).orderBy(F.desc("bin")).collect())
        for r in rows:
            if above + r["n"] >= k:
                break
            above += r["n"]
        if above + r["n"] == k:
            return float(r["low"])
        low, high = r["low"], r["high"]
    return float(low)


@register("op7_quality_resampling")
def op7_quality_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels")).filter("selected").drop("text", "selected")
