"""Hard negatives for anchors by anchor-clustered shared lists.

Anchors are clustered by direction.  A block holds anchors of one cluster, a slice some thousand
candidates; where they meet, the candidates are sorted once by an angular upper bound that holds for
the whole cluster: a candidate v at angle t to the cluster's centre has at most the product
``|a| |v| cos(t - spread)`` with any anchor a within ``spread`` of the centre.  Every member walks
that one list, and stops where its bound falls below the member's own threshold: no later candidate
can enter its result.

Positives are found first, with the anchor's k-th best as threshold, then negatives, whose
threshold starts at the lower end of the allowed band.  A first round meets every block with a slice of its own
cluster; the thresholds it gives, with the angle between the centres, leave out whole slices before
any vector travels.  Blocks and slices have bounded sizes, so no label, cluster or vector that many rows
share gathers in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from standlab.llm.registry import register
from standlab.llm.tables import ready, table
from standlab.session import cut_lineage

SAMPLE = 4096  # anchors that place the centres
CLUSTERS = 64  # centres at most
MEMBERS = 128  # anchors of a cluster, about, until there are CLUSTERS
BLOCK = 1024  # anchors in a block, about
SLICE = 8192  # candidates in a slice, about
STEP = 512  # candidates of the list that are multiplied at once
NONE = -(1 << 62)
NEVER = 1 << 62
SLACK = 1e-6  # of an angle, for rounding


def matrix(vectors) -> np.ndarray:
    rows = [np.asarray(v, float) for v in vectors]
    return np.array(rows).reshape(len(rows), -1) if rows and len(rows[0]) else np.zeros((len(rows), 0))


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact or an error."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a @ c.T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ c.astype(np.int64).T
    raise OverflowError("inner products beyond 64 bits")


def angles(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angle of each row to the centre; 0 for a row without length."""
    size = np.sqrt((v * v).sum(axis=1))
    cos = np.divide(v @ centre, size, out=np.ones(len(v)), where=size > 0)
    return np.arccos(np.clip(cos, -1, 1))


def place_centres(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of a spherical k-means."""
    size = np.sqrt((sample * sample).sum(axis=1, keepdims=True))
    x = sample[size[:, 0] > 0] / size[size[:, 0] > 0]
    if not len(x):
        return np.eye(1, sample.shape[1])
    at, away = [0], np.full(len(x), np.inf)
    for _ in range(min(k, len(x)) - 1):  # start from rows that are far from each other
        away = np.minimum(away, 1 - x @ x[at[-1]])
        at.append(int(np.argmax(away)))
    centres = x[at]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        total = np.array([x[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-300), centres)
    return centres


def centre_of(centres: dict, dim: int, cluster: int) -> np.ndarray:
    return centres[dim][cluster] if dim in centres else np.eye(1, dim)[0] if dim else np.zeros(0)


def walk(a, own, c, bound, ids, low, high, least, k: int):
    """Rows (anchor, target, id, score) of the k best of every target in the list ``c``.

    The list is sorted by ``bound``, an upper bound of the product with an anchor of length one.  A
    target allows scores from ``low`` to ``high`` (one column for each target of an anchor); scores
    under ``least`` are known not to matter.  Ties go to the smaller id, and the anchor's own id is
    left out.
    """
    length = np.sqrt((a * a).sum(axis=1))
    kth = np.where(low > high, NEVER, np.maximum(least, low))
    m, t = low.shape
    row, found, score = (np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(c), STEP):
        reach = length * bound[at] * (1 + 1e-9 * np.sign(bound[at])) + 1e-6
        active = np.flatnonzero(kth.min(axis=1) <= reach)
        if not len(active):
            break
        part = ids[at:at + STEP]
        s = products(a[active], c[at:at + STEP])
        other = own[active, None] != part[None, :]
        rows, fresh, values = [row], [found], [score]
        for j in range(t):
            i, col = np.nonzero((s >= kth[active, j, None]) & (s <= high[active, j, None]) & other)
            rows.append(active[i] * t + j), fresh.append(part[col]), values.append(s[i, col])
        row, found, score = np.concatenate(rows), np.concatenate(fresh), np.concatenate(values)
        order = np.lexsort((found, -score, row))
        row, found, score = row[order], found[order], score[order]
        first = np.searchsorted(row, row)
        rank = np.arange(len(row)) - first
        last = rank == k - 1
        flat = kth.reshape(-1)
        flat[row[last]] = np.maximum(flat[row[last]], score[last])
        row, found, score = row[rank < k], found[rank < k], score[rank < k]
    return row // t, row % t, found, score


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, v (whole components), dim of the rows that take part."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    rows = vectors.dropna(subset=[id_col, vec_col, label_col]).filter(~bad)
    whole = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                       whole.alias("v")).withColumn("dim", F.size("v"))


def _placed(rows: DataFrame, centres) -> DataFrame:
    """Rows with their nearest centre, the angle to it and their length."""
    def run(batches):
        known = centres.value
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                v = matrix(part["v"])
                cluster = np.argmax(v @ known[dim].T, axis=1) if dim in known else np.zeros(len(v), np.int64)
                angle = np.zeros(len(v))
                for number in np.unique(cluster):
                    mine = cluster == number
                    angle[mine] = angles(v[mine], centre_of(known, dim, number))
                yield part.assign(cluster=cluster, angle=angle, length=np.sqrt((v * v).sum(axis=1)))

    kept = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInPandas(run, kept + ", cluster int, angle double, length double")


def _dealt(rows: DataFrame, size: int, name: str, key: str) -> DataFrame:
    """Rows with a group of about ``size`` rows of their dimension and cluster."""
    pieces = cut_lineage(rows.groupBy("dim", "cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("pieces")))
    return rows.join(pieces, ["dim", "cluster"]).withColumn(
        name, F.concat_ws("/", "dim", "cluster", F.pmod(F.xxhash64(key, F.lit(5)), F.col("pieces")))).drop("pieces")


def _meet(anchors: DataFrame, candidates: DataFrame, pairs: DataFrame, centres, same: bool, k: int) -> DataFrame:
    """no, target, id, score: the best of every anchor's targets within every slice its block meets.

    ``low``, ``high`` and ``least`` of an anchor are arrays over its targets.
    """
    def run(left, right):
        out = []
        if len(left) and len(right):
            dim, cluster = int(left["dim"].iloc[0]), int(left["cluster"].iloc[0])
            v, length = matrix(right["v"]), right["length"].to_numpy()
            off = angles(v, centre_of(centres.value, dim, cluster)) - left["angle"].max() - SLACK
            bound = np.where(length > 0, length * np.cos(np.maximum(off, 0)), 0)
            order = np.argsort(-bound, kind="stable")
            v, bound, ids, kinds = v[order], bound[order], right["id"].to_numpy()[order], right["label"].to_numpy()[order]
            t = max(len(x) for x in left["low"])
            for label, part in left.groupby("label"):
                mine = (kinds == label) == same
                if mine.any():
                    low, high, least = (np.array([[*x, *[pad] * (t - len(x))] for x in part[name]], np.int64).reshape(-1, t)
                                        for name, pad in (("low", NEVER), ("high", NONE), ("least", NONE)))
                    i, j, found, score = walk(matrix(part["v"]), part["id"].to_numpy(), v[mine], bound[mine], ids[mine],
                                              low, high, least, k)
                    out.append(pd.DataFrame({"no": part["no"].to_numpy()[i], "target": j, "id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"no": [], "target": [], "id": [], "score": []}).astype("int64")

    left = anchors.join(pairs, "block").groupBy("block", "slice")
    right = candidates.select("id", "label", "v", "length", "slice").join(pairs, "slice").groupBy("block", "slice")
    return left.cogroup(right).applyInPandas(run, "no long, target int, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("no", "target").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(scale * x), scores integer inner products.  An anchor's positives are its
    best rows of the same label; to each belong the first ``negatives`` rows of another label whose
    score lies between ``low`` and ``high`` hundredths of the positive's.  Ties go to the smaller
    id.  ``is_anchor`` is a condition on the id column.  Rows with a null id or label or whose
    vector is null or holds null or non-finite components take no part; vectors of another dimension than the anchor's
    are no partners, empty ones have score 0.  Each row counts, also where rows are equal or share an
    id, but an anchor never meets a row of its own id.  Sums beyond 64 bits end the job with an
    error.  An empty table gives no rows; other columns are not used.
    """
    spark = ready(vectors.sparkSession)
    rows = cut_lineage(usable(vectors, id_col, vec_col, label_col, scale))
    anchors = rows.filter(is_anchor(F.col("id")))
    counts = {r["dim"]: r["count"] for r in anchors.filter("dim > 0").groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(SAMPLE).collect()}
    sample = anchors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    fitted = {int(dim): place_centres(matrix(part["v"]), min(CLUSTERS, -(-counts.get(dim, 1) // MEMBERS)))
              for dim, part in sample.groupby("dim") if dim > 0}
    centres = spark.sparkContext.broadcast(fitted)
    placed = cut_lineage(_placed(rows, centres))
    candidates = cut_lineage(_dealt(placed, SLICE, "slice", "id"))
    members = cut_lineage(_dealt(placed.filter(is_anchor(F.col("id"))), BLOCK, "block", "id").withColumn(
        "no", F.monotonically_increasing_id()))
    slices = cut_lineage(candidates.groupBy("dim", "cluster", "slice").agg(
        F.max("angle").alias("spread"), F.max("length").alias("longest"), F.count(F.lit(1)).alias("n")))
    home = cut_lineage(members.select("dim", "cluster", "block").distinct().join(slices.groupBy("dim", "cluster").agg(
        F.max_by("slice", F.struct("n", "slice")).alias("slice")), ["dim", "cluster"]).select("block", "slice"))
    between = [(dim, i, j, float(np.arccos(np.clip(x @ y, -1, 1)))) for dim, some in fitted.items()
               for i, x in enumerate(some) for j, y in enumerate(some)]
    gaps = cut_lineage(spark.createDataFrame(between, "dim int, cluster int, other int, gap double"))

    def within_reach(known: DataFrame) -> DataFrame:
        """(block, slice) that may still hold something for a member, other than the first round's."""
        need = F.when(F.col("length") > 0, F.array_min("least") / F.col("length")).otherwise(F.lit(float("-inf")))
        blocks = known.groupBy("dim", "cluster", "block").agg(F.max("angle").alias("around"), F.min(need).alias("need"))
        met = blocks.join(slices.select("dim", F.col("cluster").alias("other"), "slice", "spread", "longest"), "dim")
        met = met.join(gaps, ["dim", "cluster", "other"], "left").withColumn(
            "off", F.greatest(F.lit(0.0), F.coalesce("gap", F.lit(0.0)) - F.col("spread") - F.col("around") - F.lit(2 * SLACK)))
        reach = F.col("longest") * F.greatest(F.lit(0.0), F.cos("off")) * F.lit(1 + 1e-9) + F.lit(1e-6)
        return met.filter(reach >= F.col("need")).select("block", "slice").join(home, ["block", "slice"], "left_anti")

    def mine(known: DataFrame, same: bool, k: int) -> DataFrame:
        first = cut_lineage(_meet(known, candidates, home, centres, same, k))
        lasts = first.groupBy("no", "target").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).filter(
            F.col("n") >= k).groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("target", "last"))).alias("lasts"))
        better = known.join(lasts, "no", "left").withColumn("least", F.transform(
            "least", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("lasts", i), F.lit(NONE))))).drop("lasts")
        better = cut_lineage(better)
        rest = _meet(better, candidates, cut_lineage(within_reach(better)), centres, same, k)
        return _best(first.union(rest), k)

    base = ["no", "id", "label", "v", "dim", "cluster", "angle", "length", "block"]
    one = [F.array(F.lit(x).cast("long")).alias(n) for x, n in ((NONE, "low"), (NEVER, "high"), (NONE, "least"))]
    chosen = cut_lineage(mine(members.select(*base, *one), True, positives).select(
        "no", (F.col("rank") - 1).alias("at"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    listed = chosen.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("at", "positive_score"))).alias("p"))
    hundred = F.lit(100).cast("decimal(3,0)")

    def part(share, rounded):
        return lambda p: rounded(p["positive_score"].cast("decimal(20,0)") * F.lit(share).cast("decimal(5,0)") / hundred).cast("long")

    banded = members.select(*base).join(listed, "no").select(
        *base, F.transform("p", part(low, F.ceil)).alias("low"), F.transform("p", part(high, F.floor)).alias("high")).withColumn(
        "least", F.zip_with("low", "high", lambda a, b: F.when(a > b, F.lit(NEVER)).otherwise(a)))
    found = mine(cut_lineage(banded), False, negatives).select(
        "no", F.col("target").alias("at"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (found.join(chosen, ["no", "at"]).join(members.select("no", F.col("id").alias("anchor_id")), "no")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


@register("op13_hard_negatives", sql=r"""
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
       list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
       list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM u a JOIN u c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
""")
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, lambda i: i % 100 == 0)
