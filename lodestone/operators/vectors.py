"""Vectors: nearest neighbours by cosine in blocks, best match per concept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES = 4096, 1024


def top_cosine(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k highest cosines, rounded to 5 places, ties to smaller ids.

    vectors: (vec_id, v), queries: (query_id, q). Both are dealt into blocks by hash; each pair of blocks is one matrix
    product in one bounded task, and the k best of each are ranked again.
    """
    n_v, n_q = (max(1, -(-df.count() // size)) for df, size in ((vectors, BLOCK), (queries, QUERIES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = vectors.select(deal("vec_id", n_v).alias("b"), every(n_q).alias("c"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v")
    right = queries.select(every(n_v).alias("b"), deal("query_id", n_q).alias("c"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.col("q").alias("v"))

    def block(part: pa.Table) -> pa.Table:
        kind, ids = part["kind"].to_numpy().astype(bool), part["id"].to_numpy()
        x = np.array(part["v"].to_pylist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        out = []
        if kind.any() and not kind.all():
            own = ids[~kind]
            for q, s in zip(ids[kind], np.round(x[kind] @ x[~kind].T, 5) + 0.0, strict=True):
                best = np.lexsort((own, -s))[:k]
                out += zip([int(q)] * len(best), own[best].tolist(), s[best].tolist(), strict=True)
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = left.unionByName(right).groupBy("b", "c").applyInArrow(block, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def best_per_concept(matches: DataFrame, query: str, concept: str, score: str, name: str) -> DataFrame:
    """Of each concept's names the best match."""
    return matches.groupBy(query, concept).agg(F.max(score).alias(score), F.min_by(name, F.struct(-F.col(score), name)).alias(name))
