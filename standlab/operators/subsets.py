"""Best subsets of regression terms by leaps and bounds.

The rows are read once, for the cross-products.  What is searched is a tree: a node holds terms that
are in the model (``forced``) and terms that may still be (``free``); it branches on its strongest
free term, in or out.  With all its terms, the node's regression tells what dropping each free term
alone would add to the residual square.  A model of j terms must drop a known number of them, so it
adds at least the largest of that many smallest additions, and at least their sum over the largest
eigenvalue of the estimates' correlations.  A node that cannot beat the best model so far of any
size is cut off.

Subtrees are dealt to tasks, which search a given number of nodes and hand back what is left; the
best models of all tasks are the next round's bound.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from standlab.operators.gram import global_moments
from standlab.session import cut_lineage, literal_table

SAME = 1e-12  # share of the total square under which residual squares count as equal


class Search:
    """Search of subtrees over scaled cross-products of the terms and the response (last)."""

    def __init__(self, cross: np.ndarray, max_size: int, best: dict[int, tuple[float, tuple[int, ...]]]):
        self.cross, self.max_size, self.best = cross, max_size, dict(best)

    def residual(self, terms) -> float:
        a, b = self.cross[np.ix_(terms, terms)], self.cross[terms, -1]
        return float(self.cross[-1, -1] - b @ np.linalg.lstsq(a, b, rcond=1e-12)[0])

    def offer(self, terms):
        rss, key = self.residual(list(terms)), tuple(sorted(terms))
        if len(key) not in self.best or rss < self.best[len(key)][0] - SAME:
            self.best[len(key)] = (rss, key)

    def start(self):
        """Models to beat: terms added one by one, then single exchanges while they help."""
        chosen: list[int] = []
        k = len(self.cross) - 1
        for size in range(1, min(self.max_size, k) + 1):
            left = [c for c in range(k) if c not in chosen]
            chosen.append(min(left, key=lambda c: self.residual([*chosen, c])))
            moved = True
            while moved:
                moved = False
                for i in range(size):
                    rest = chosen[:i] + chosen[i + 1:]
                    swap = min((c for c in range(k) if c not in rest), key=lambda c: self.residual([*rest, c]))
                    if swap != chosen[i] and self.residual([*rest, swap]) < self.residual(chosen) - SAME:
                        chosen, moved = [*rest, swap], True
            self.offer(chosen)

    def solve(self, terms):
        """Inverse, coefficients and residual square of all terms; none where they depend on each other."""
        a, b = self.cross[np.ix_(terms, terms)], self.cross[terms, -1]
        if len(terms) and np.linalg.eigvalsh(a)[0] < 1e-10:
            return None
        inverse = np.linalg.inv(a)
        return inverse, inverse @ b, float(self.cross[-1, -1] - b @ inverse @ b)

    def beaten(self, size: int, rss: float) -> bool:
        return size in self.best and rss >= self.best[size][0] - SAME

    def hopeless(self, forced, free, state) -> bool:
        """Whether no model between ``forced`` and all terms can beat the best of its size."""
        total = len(forced) + len(free)
        sizes = range(len(forced) + 1, min(self.max_size, total) + 1)
        if state is None:
            least = self.residual([*forced, *free])
            return all(self.beaten(j, least) for j in sizes)
        inverse, beta, rss = state
        at = np.arange(len(forced), total)
        scale = np.diag(inverse)[at]
        adds = np.sort(beta[at] ** 2 / scale)
        need = [j for j in sizes if not self.beaten(j, rss + (adds[total - j - 1] if j < total else 0.0))]
        if not need:
            return True
        spread = np.sqrt(scale)
        largest = np.linalg.eigvalsh(inverse[np.ix_(at, at)] / np.outer(spread, spread))[-1]
        summed = np.cumsum(adds)
        return all(self.beaten(j, rss + (summed[total - j - 1] / largest * (1 - 1e-9) if j < total else 0.0)) for j in need)

    def branch(self, forced, free, state):
        """The children of a node: its strongest free term in, and out."""
        if state is None:
            # a term of the dependency first, so that leaving it out settles the rest
            terms = [*forced, *free]
            values, vectors = np.linalg.eigh(self.cross[np.ix_(terms, terms)])
            pick = int(np.argmax(np.abs(vectors[len(forced):, 0])))
            if abs(vectors[len(forced) + pick, 0]) < 1e-6:
                return []  # the forced terms depend on each other: smaller models do as well
        else:
            inverse, beta, _ = state
            at = np.arange(len(forced), len(forced) + len(free))
            pick = int(np.argmax(beta[at] ** 2 / np.diag(inverse)[at]))
        term, rest = free[pick], free[:pick] + free[pick + 1:]
        where = len(forced) + pick
        keep = [i for i in range(len(forced) + len(free)) if i != where]
        out = without = None
        if state is not None:
            inverse, beta, rss = state
            order = [*range(len(forced)), where, *[i for i in range(len(forced), len(forced) + len(free)) if i != where]]
            out = inverse[np.ix_(order, order)], beta[order], rss
            column, own = inverse[keep, where], inverse[where, where]
            without = (inverse[np.ix_(keep, keep)] - np.outer(column, column) / own,
                       beta[keep] - column * beta[where] / own, rss + beta[where] ** 2 / own)
        children = []
        if len(forced) + 1 <= self.max_size:
            self.offer([*forced, term])
            if rest and len(forced) + 1 < self.max_size:
                children.append(([*forced, term], rest, out))
        if rest:
            children.append((forced, rest, without))
        return children

    def run(self, nodes, budget: int, widen: int = 0) -> list:
        """Search ``budget`` nodes, or until ``widen`` wait; the nodes not searched yet."""
        waiting = deque((forced, free, None) for forced, free in nodes)
        while waiting and budget > 0 and not (widen and len(waiting) >= widen):
            forced, free, state = waiting.popleft() if widen else waiting.pop()
            if state is None:
                state = self.solve([*forced, *free])
            budget -= 1
            if not self.hopeless(forced, free, state):
                waiting.extend(reversed(self.branch(forced, free, state)))
        return [(forced, free) for forced, free, _ in waiting]


def _round(nodes: DataFrame, cross: np.ndarray, max_size: int, best: dict, budget: int) -> DataFrame:
    def run(batches):
        search = Search(cross, max_size, best)
        left = []
        for batch in batches:
            given = [([int(x) for x in a], [int(x) for x in b]) for a, b in zip(batch["forced"], batch["free"])]
            left += search.run(given, budget)
        found = [(size, rss, list(terms), None, None) for size, (rss, terms) in search.best.items()]
        yield pd.DataFrame(found + [(None, None, None, *node) for node in left],
                           columns=["size", "rss", "terms", "forced", "free"]).astype({"size": "Int32"})

    return nodes.mapInPandas(run, "size int, rss double, terms array<int>, forced array<int>, free array<int>")


def best_subsets(df: DataFrame, y: str, xs: list[str], max_size: int = 8, budget: int = 4000) -> DataFrame:
    """size, terms, rss, r2: the model of least residual square of each size up to ``max_size``.

    Rows with a null in a used column are left out, terms without variation are no candidates.  Of
    terms that depend on each other a model holds no more than it needs; sizes that only such
    models reach give no row.
    """
    spark = df.sparkSession
    _, _, cross = global_moments(df, [*xs, y])
    d = np.sqrt(np.diag(cross))
    names = [x for x, v in zip(xs, d[:-1]) if v > 0]
    if not names or not d[-1] > 0:
        return literal_table(spark, [("x", 0)], "terms string, size int").select(
            "size", "terms", F.lit(0.0).alias("rss"), F.lit(0.0).alias("r2")).limit(0)
    at = [i for i, v in enumerate(d[:-1]) if v > 0] + [len(xs)]
    scaled = cross[np.ix_(at, at)] / np.outer(d[at], d[at])
    search = Search(scaled, min(max_size, len(names)), {})
    search.start()
    tasks = spark.sparkContext.defaultParallelism
    left = search.run([([], list(range(len(names))))], budget, widen=8 * tasks)
    if left:
        nodes = spark.createDataFrame(left, "forced array<int>, free array<int>").repartition(tasks)
    while left:
        state = cut_lineage(_round(nodes, scaled, search.max_size, search.best, budget))
        for row in state.filter("size IS NOT NULL").groupBy("size").agg(F.min(F.struct("rss", "terms")).alias("b")).collect():
            if not search.beaten(row["size"], row["b"]["rss"]):
                search.best[row["size"]] = (row["b"]["rss"], tuple(row["b"]["terms"]))
        nodes = state.filter("forced IS NOT NULL").select("forced", "free").repartition(tasks)
        left = not nodes.isEmpty()
    syy = float(cross[-1, -1])
    return literal_table(spark, [(size, "+".join(names[i] for i in terms), max(rss, 0.0) * syy, 1 - rss)
                                 for size, (rss, terms) in sorted(search.best.items())],
                         "size int, terms string, rss double, r2 double")
