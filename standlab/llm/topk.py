"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets, longest first, and every block of queries meets every
bucket.  For a query q with a known k-th best product t, a vector v of a bucket whose longest
vector has length l can only matter if its cosine reaches ``t / (|q| l)``, the bucket's local
threshold.  For each query and bucket the cheaper test is chosen from that threshold:

* above 1 the bucket is skipped (length pruning of the whole bucket);
* a low threshold: only vectors at least ``t / |q|`` long are multiplied (length pruning);
* a high threshold: coordinate pruning.  On the query's FOCUS largest coordinates the partial
  product is computed, and ``|q_rest| |v_rest|`` bounds what the others can add.

Survivors are verified by whole products, in integers that floats hold exactly, or else in
arbitrary integers.  A first pass over the bucket of the longest vectors gives every query its t;
the second pass meets the other buckets.  Blocks of queries and buckets are joined on keys, so a
task holds one block and one bucket; no pair of vectors is a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from standlab.llm.registry import register
from standlab.llm.tables import table
from standlab.session import cut_lineage

BUCKET = 4096  # vectors in a bucket, about
QUERIES = 512  # queries in a block, about
FOCUS = 16  # coordinates of a query that prune
HIGH = 0.35  # local thresholds from here on use coordinates
EXACT = float(1 << 53)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: floats where every sum stays below 2^53."""
    most = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    if most < EXACT:
        return (q @ v.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in v]
    return np.array([[sum(int(a) * b for a, b in zip(row, w)) for w in whole] for row in q], dtype=object)


def best(query_ids, ids, scores, k: int):
    """Rows (query, vector, score) of the k highest of every query, ties to the smaller id; an id
    equal to the query's is left out.  ``scores`` has minus infinity where a vector was pruned."""
    rows = []
    for i, query in enumerate(query_ids):
        own = scores[i]
        at = np.flatnonzero((ids != query) & (own != PRUNED))
        if len(at) > 4 * k and own.dtype != object:
            least = np.partition(own[at], len(at) - k)[len(at) - k]
            at = at[own[at] >= least]
        order = sorted(at.tolist(), key=lambda j: (-int(own[j]), int(ids[j])))[:k]
        rows += [(int(query), int(ids[j]), int(own[j])) for j in order]
    return rows


PRUNED = np.iinfo(np.int64).min


def pruned_products(q: np.ndarray, v: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Products of block and bucket, PRUNED where they cannot reach the query's ``least``."""
    nq, nv = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    out = np.full((len(q), len(v)), PRUNED, np.int64)
    if not len(q) or not len(v):
        return out
    if not q.shape[1] or np.abs(q).max() * np.abs(v).max() * q.shape[1] >= EXACT:
        return products(q, v)
    longest = nv.max()
    slack = 1e-9 * (nq * longest + 1)
    local = np.where(nq * longest > 0, (least - slack) / np.maximum(nq * longest, 1e-300),
                     np.where(least <= 0, -1.0, 2.0))
    low = np.flatnonzero(local < HIGH)
    if len(low):
        need = np.where(least[low] > 0, (least[low] - slack[low]) / np.maximum(nq[low], 1e-300), 0)
        long_enough = np.flatnonzero(nv >= need.min())
        if len(long_enough):
            out[np.ix_(low, long_enough)] = products(q[low], v[long_enough])
    for i in np.flatnonzero((local >= HIGH) & (local <= 1)):
        focus = np.argsort(-np.abs(q[i]))[:FOCUS]
        part = v[:, focus] @ q[i, focus]
        q_rest = np.sqrt(max(0.0, float(nq[i] ** 2 - (q[i, focus] ** 2).sum())))
        v_rest = np.sqrt(np.maximum(0.0, nv ** 2 - (v[:, focus] ** 2).sum(axis=1)))
        at = np.flatnonzero(part + q_rest * v_rest >= least[i] - slack[i])
        if len(at):
            out[i, at] = (v[at] @ q[i]).astype(np.int64)
    return out


def _whole(x, scale: int):
    return F.floor(F.lit(float(scale)) * x.cast("double"))


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, whole components, dim and length of the vectors that take part."""
    big = F.lit(float("inf"))
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == big))
    return (vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(~bad)
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(vec_col, lambda x: _whole(x, scale).cast("double")).alias("v"))
            .withColumn("dim", F.size("v"))
            .withColumn("length", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x, F.sqrt)))


def _pairs(queries: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """The k best of every query within every bucket its block meets."""
    def run(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, v = np.array(left["v"].tolist(), float), np.array(right["v"].tolist(), float)
        q, v = (x.reshape(len(x), -1) if x.size else np.zeros((len(x), 0)) for x in (q, v))
        scores = pruned_products(q, v, left["least"].to_numpy(float))
        return pd.DataFrame(best(left["id"].to_numpy(), right["id"].to_numpy(), scores, k),
                            columns=["query_id", "vec_id", "score"])

    return queries.groupBy("block", "bucket").cogroup(buckets.groupBy("block", "bucket")).applyInPandas(
        run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query from its buckets' best; every bucket gave k rows at most."""
    order = F.struct((-F.col("score")).alias("s"), "vec_id", "score")
    lists = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("top"))
    return lists.select("query_id", F.posexplode("top").alias("at", "t")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query row.

    Components are floor(scale * x).  ``is_query`` is a condition on the id column.  Vectors that
    are null or hold null or non-finite components take no part, nor do rows without id; vectors of
    another dimension than the query's are no candidates, and empty ones have product 0.  Ties go to
    the smaller id; of rows that share an id each is a candidate, but for queries of that id.
    Sums beyond 64 bits end the job with an error.  Other columns are not used.
    """
    spark = vectors.sparkSession
    all_rows = cut_lineage(usable(vectors, id_col, vec_col, scale))
    # buckets hold about BUCKET vectors of like length: bounds are quantiles of all lengths
    counts = {r["dim"]: (r["n"], r["q"]) for r in all_rows.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.sum(is_query(F.col("id")).cast("long")).alias("q")).collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = {d: max(1, -(-n // BUCKET)) for d, (n, _) in counts.items()}
    blocks = {d: max(1, -(-int(q or 0) // QUERIES)) for d, (_, q) in counts.items()}
    bounds = {d: _bounds(all_rows.filter(F.col("dim") == d), parts[d]) for d in counts}

    def by_dim(values):
        return F.create_map(*[x for d, v in values.items() for x in (F.lit(d), v)])[F.col("dim")]

    edges = by_dim({d: F.array(*[F.lit(float(b)) for b in bounds[d]]).cast("array<double>") for d in counts})
    # level 0 holds the longest; a level of many vectors, as of equal lengths, is dealt in pieces
    levels = all_rows.withColumn("level", F.size(F.filter(edges, lambda e: e > F.col("length"))))
    sizes = cut_lineage(levels.groupBy("dim", "level").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET)).alias("pieces")))
    known = cut_lineage(levels.join(sizes, ["dim", "level"]).withColumn(
        "bucket", F.concat_ws("/", "dim", "level", F.pmod(F.xxhash64("id", F.lit(7)), F.col("pieces")))).drop("pieces"))
    listing = cut_lineage(known.groupBy("dim", "bucket").agg(F.max("length").alias("longest")))
    first = listing.groupBy("dim").agg(F.max(F.struct("longest", "bucket")).alias("m")).select("dim", "m.bucket")
    queries = cut_lineage(known.filter(is_query(F.col("id"))).withColumn("block", F.concat_ws(
        "/", "dim", F.pmod(F.xxhash64("id", F.lit(3)), by_dim({d: F.lit(blocks[d]) for d in counts})))).select(
        "id", "v", "dim", "block"))
    block_list = cut_lineage(queries.select("dim", "block").distinct())

    def meet(queries, chosen):
        met = block_list.join(chosen, "dim").select("block", "bucket")
        left = queries.join(chosen, "dim").select("id", "v", "least", "block", "bucket")
        right = known.select("id", "v", "bucket").join(met, "bucket")
        return _pairs(left, right, k)

    start = cut_lineage(meet(queries.withColumn("least", F.lit(float("-inf"))), first))
    least = start.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).filter(
        F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("low").cast("double").alias("least"))
    others = listing.select("dim", "bucket").join(first, ["dim", "bucket"], "left_anti")
    rest = meet(queries.join(least, "id", "left").fillna(float("-inf"), ["least"]), others)
    return _ranked(start.union(rest), k)


def _bounds(rows: DataFrame, parts: int) -> list[float]:
    """Lengths that part the rows into about equal groups; equal lengths stay together."""
    if parts == 1:
        return []
    at = [i / parts for i in range(1, parts)]
    return sorted(set(rows.agg(F.percentile_approx("length", at, 10000)).first()[0]))


@register("op3_topk", sql=r"""
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op3_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
