"""Species occurrence: scoring, fitting, ranking quality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from standlab import constants as K
from standlab.session import cut_lineage


def occurrence(odds: dict[str, float | None]) -> Column:
    """Probability from odds ratios; terms without a ratio are not in the model."""
    score = F.lit(math.log(odds["intercept"]))
    for term, ratio in odds.items():
        if term != "intercept" and ratio is not None:
            score = score + F.col(term) * math.log(ratio)
    return 1 / (1 + F.exp(-score))


def suitability(df: DataFrame, odds: dict = K.SUITABILITY_ODDS, digits: int | None = None) -> DataFrame:
    """Probability per species and its share of the largest probability anywhere.

    The maximum is one aggregate over the table, used as a scalar.
    """
    scored = df.withColumns({f"p_{s.lower()}": occurrence(o) for s, o in odds.items()})
    top = {s: scored.agg(F.max(f"p_{s.lower()}")).scalar() for s in odds}
    return scored.withColumns({f"{s.lower()}_suitability": F.col(f"p_{s.lower()}") / top[s] for s in odds})


def fit_occurrence(df: DataFrame, label: str, terms: list[str]) -> DataFrame:
    """Logistic regression; coefficients as odds ratios."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=terms, outputCol="features").transform(
        df.dropna(subset=[label, *terms]).withColumn("label", F.col(label).cast("double")))
    model = LogisticRegression(maxIter=100, tol=1e-9).fit(rows.select("features", "label"))
    values = [("(Intercept)", float(model.intercept)),
              *[(t, float(v)) for t, v in zip(terms, model.coefficients)]]
    return df.sparkSession.createDataFrame(values, "term string, estimate double").withColumn(
        "odds_ratio", F.exp("estimate"))


def auc(df: DataFrame, label: str, score: str, per_unit: int = 256) -> DataFrame:
    """Area under the curve by mid-ranks, for scores between 0 and 1.

    Equal scores collapse first.  Counts below a score are counts of lower bins plus
    counts inside its own bin, so no task ranks everything.  Bins are even on the logit
    scale, where logistic scores spread out; a double leaves room for 1500 units.
    """
    c = F.col
    logit = F.greatest(F.lit(-750.0), F.least(F.lit(750.0), F.log(c(score) / (1 - c(score)))))
    at = F.floor(per_unit * F.when(c(score) <= 0, -750.0).when(c(score) >= 1, 750.0).otherwise(logit))
    values = (df.filter(c(score).isNotNull() & c(label).isNotNull()).groupBy(c(score).alias("_s")).agg(
        F.sum(F.when(c(label) == 1, 1).otherwise(0)).alias("_p"),
        F.sum(F.when(c(label) == 0, 1).otherwise(0)).alias("_q"), F.first(at).alias("_bin")))
    per_bin = values.groupBy("_bin").agg(F.sum("_p").alias("bp"), F.sum("_q").alias("bq"))
    # at most 1500 * per_unit rows, ordered in one task
    lower = W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    below = per_bin.select("_bin", F.coalesce(F.sum("bq").over(lower), F.lit(0)).alias("_below"))
    inside = W.partitionBy("_bin").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    ranked = values.join(F.broadcast(below), "_bin").withColumn(
        "_before", c("_below") + F.coalesce(F.sum("_q").over(inside), F.lit(0)))
    wins = F.sum(c("_p") * (c("_before") + c("_q") / 2))
    return ranked.agg((wins / (F.sum("_p") * F.sum("_q"))).alias("auc"),
                      F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"))


BINS = 32  # of a term
SLICE = 1 << 16  # rows packed together
_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)]) * (1 << 16)
_DRAWS = np.searchsorted(_STEPS, np.arange(1 << 16) + 0.5).astype(np.uint8)  # of a bootstrap: Poisson with mean 1


def forest_importance(df: DataFrame, y: str, terms: list[str], seeds: list[int] = (1, 2, 3),
                      trees: int = 20, depth: int = 6) -> DataFrame:
    """Random-forest importance averaged over seeds; terms above the mean are selected.

    Every tree sees its own bootstrap of all rows and each of its nodes a third of the terms.  Rows are kept as
    one byte a term and the response, packed; a level of all trees of all seeds takes one pass, in which tasks
    send sums by tree, node and bin.  A term of up to BINS values is cut at all of them, others at their quantiles.
    """
    names = [f"_{i}" for i in range(len(terms))]
    rows = df.select(F.col(y).cast("double").alias("_y"), *[F.col(t).cast("double").alias(n) for t, n in zip(terms, names)])
    for n in ("_y", *names):  # one by one, so that Spark drops rows ahead of joins
        rows = rows.filter(F.col(n).isNotNull() & ~F.isnan(n))
    rows = cut_lineage(rows)
    cuts, mean = _cuts(rows, names)
    slices = cut_lineage(rows.mapInPandas(_packed(cuts, mean, names), "bins binary, y binary").withColumn(
        "slice", F.monotonically_increasing_id()))
    grown = [(seed, tree) for seed in seeds for tree in range(trees)]
    size = -(-len(terms) // 3)
    tried = np.array([[np.random.default_rng([*g, node]).permutation(len(terms))[:size] for node in range(2 ** depth - 1)]
                      for g in grown])
    term, cut = np.full(tried.shape[:2], -1), np.zeros(tried.shape[:2], int)
    gains = np.zeros((len(grown), len(terms)))
    for level in range(depth):
        sums = slices.mapInPandas(_node_sums(grown, level, tried, term, cut), "tree int, sums binary")
        found = sums.groupBy("tree").applyInPandas(
            _best_cuts(level, tried), "tree int, node int, term int, cut int, gain double").collect()
        for r in found:
            term[r["tree"], r["node"]], cut[r["tree"], r["node"]] = r["term"], r["cut"]
            gains[r["tree"], r["term"]] += r["gain"]
        if not found:
            break
    total = np.zeros(len(terms))
    for some in np.split(gains, len(seeds)):
        forest = sum(g / g.sum() for g in some if g.sum() > 0)
        total += forest / np.sum(forest) / len(seeds) if np.any(forest) else 0
    data = [(t, v, v > float(total.mean())) for t, v in zip(terms, total.tolist())]
    return df.sparkSession.createDataFrame(data, "term string, importance double, selected boolean")


def _cuts(rows: DataFrame, names: list[str]) -> tuple[list[np.ndarray], float]:
    """Values at which each term may be cut, and the mean response."""
    share = [i / BINS for i in range(1, BINS)]
    row = rows.agg(F.avg("_y").alias("mean"), *[F.percentile_approx(n, share).alias(f"q{n}") for n in names],
                   *[F.approx_count_distinct(n).alias(f"d{n}") for n in names]).first()
    cuts = []
    for n in names:
        values = [] if row[f"d{n}"] > 2 * BINS else [r[0] for r in rows.select(n).distinct().limit(BINS + 1).collect()]
        cuts.append(np.sort(values)[:-1] if 0 < len(values) <= BINS else np.unique(row[f"q{n}"] or []).astype(float))
    return cuts, row["mean"]


def _packed(cuts: list[np.ndarray], mean: float, names: list[str]):
    """Rows as the bins of one term behind those of another, and responses less their mean."""
    def pack(df):
        bins = [np.searchsorted(c, df[n].to_numpy()).astype(np.uint8).tobytes() for n, c in zip(names, cuts)]
        return b"".join(bins), (df["_y"].to_numpy() - mean).tobytes()

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= SLICE:
                yield pd.DataFrame([pack(pd.concat(held))], columns=["bins", "y"])
                held, n = [], 0
        if n:
            yield pd.DataFrame([pack(pd.concat(held))], columns=["bins", "y"])
    return run


def _node_sums(grown, level: int, tried: np.ndarray, term: np.ndarray, cut: np.ndarray):
    """For each tree, sums of weights and of weighted responses by tried term, node of the level and bin."""
    first, nodes = 2 ** level - 1, 2 ** level

    def run(batches):
        sums = np.zeros((len(grown), tried.shape[2], 2, nodes * BINS))
        seen = False
        for batch in batches:
            for number, bins, y in zip(batch["slice"].tolist(), batch["bins"], batch["y"]):
                bins, y, seen = np.frombuffer(bins, np.uint8), np.frombuffer(y, np.float64), True
                rows, begin, tries = len(y), term * len(y), tried * len(y)  # where a term's bins begin
                for tree, (seed, copy) in enumerate(grown):
                    drawn = _DRAWS.take(np.random.default_rng([seed, copy, number]).integers(0, 1 << 16, rows, np.uint16))
                    at = np.flatnonzero(drawn)
                    node = np.zeros(len(at), np.int64)
                    for above in range(level):
                        if (term[tree, 2 ** above - 1:2 ** (above + 1) - 1] < 0).any():
                            goes_on = np.flatnonzero(term[tree].take(node) >= 0)
                            at, node = at.take(goes_on), node.take(goes_on)
                        node = 2 * node + 1 + (bins.take(begin[tree].take(node) + at) > cut[tree].take(node))
                    weight = drawn.take(at).astype(float)
                    response = weight * y.take(at)
                    place = (node - first) * BINS
                    for k in range(tried.shape[2]):
                        slot = place + bins.take(tries[tree, :, k].take(node) + at)
                        sums[tree, k, 0] += np.bincount(slot, weight, nodes * BINS)
                        sums[tree, k, 1] += np.bincount(slot, response, nodes * BINS)
        if seen:
            yield pd.DataFrame({"tree": range(len(grown)), "sums": [s.tobytes() for s in sums]})
    return run


def _best_cuts(level: int, tried: np.ndarray):
    """The cut of each node of a tree that lowers the squares most; none where no cut lowers them."""
    first, nodes = 2 ** level - 1, 2 ** level

    def run(df):
        tree = int(df["tree"].iloc[0])
        sums = sum(np.frombuffer(s, np.float64) for s in df["sums"]).reshape(-1, 2, nodes, BINS)
        n, s = np.moveaxis(np.cumsum(sums, axis=3), 1, 0)  # left of each cut, by tried term, node and bin
        of_all, other_n, other_s = s[..., -1:] ** 2 / np.maximum(n[..., -1:], 1), n[..., -1:] - n, s[..., -1:] - s
        parts = np.where((n > 0) & (other_n > 0), s ** 2 / np.maximum(n, 1) + other_s ** 2 / np.maximum(other_n, 1), 0)
        gain = np.where(parts - of_all > 1e-12 * parts, parts - of_all, 0)
        out = []
        for node in range(nodes):
            k, cut = np.unravel_index(np.argmax(gain[:, node]), gain[:, node].shape)
            if gain[k, node, cut] > 0:
                out.append((tree, first + node, int(tried[tree, first + node, k]), int(cut), float(gain[k, node, cut])))
        return pd.DataFrame(out, columns=["tree", "node", "term", "cut", "gain"])
    return run
