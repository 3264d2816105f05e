"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import ship, table

#: Rows in a block of candidates and of queries.
CANDIDATES, QUERIES = 4096, 2048
#: Depth of the first step down the lists; each step doubles it.
FIRST_STEP = 8


class Lists:
    """A block of vectors with, for every dimension, the rows in ascending order of their component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        keep = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[keep], vectors[keep]
        self.order = np.argsort(self.x, axis=0, kind="stable")
        self.values = np.take_along_axis(self.x, self.order, axis=0)

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), ties to smaller ids, but for the row whose id is `own`.

        Every list with a nonzero weight is read from its best end, in steps. Each row met is scored in full. No row
        not yet met can score above the sum of weight times the value at the lists' present depth; once the k-th best
        is above that bound, the search ends. At the same score a row not met could still win by its id, so it goes on.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = np.zeros(n, bool)
        best: list[tuple[int, int]] = []
        a, step = 0, FIRST_STEP
        while a < n:
            b = min(n, a + step)
            seen = np.zeros(n, bool)
            if len(up) + len(down):
                seen[self.order[n - b:n - a, up]] = True
                seen[self.order[a:b, down]] = True
            else:
                seen[:] = True
            rows = np.flatnonzero(seen & ~met)
            met[rows] = True
            if len(rows):
                scores, ids = self.x[rows] @ query, self.ids[rows]
                if own is not None:
                    scores, ids = scores[ids != own], ids[ids != own]
                if len(scores) > 4 * k and scores.dtype != object:
                    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                    scores, ids = scores[scores >= cut], ids[scores >= cut]
                    if len(scores) > k:
                        first = np.lexsort((ids, -scores))[:k]
                        scores, ids = scores[first], ids[first]
                best = sorted([*best, *((int(s), int(i)) for s, i in zip(scores, ids, strict=True))], key=lambda x: (-x[0], x[1]))[:k]
            if met.all():
                break
            bound = self.values[n - b, up] @ query[up] + self.values[b - 1, down] @ query[down]
            if len(best) == k and best[-1][0] > bound:
                break
            a, step = b, 2 * step
        return best


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, filled up with zeros; doubles where these are exact for products."""
    values, lengths = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    for row, x in zip(out, np.split(values, np.cumsum(lengths)[:-1]), strict=True):
        row[:len(x)] = x
    return out


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def search_block(k: int):
    """Top k of each query of one block among the candidates of another."""
    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        kind = part["kind"].to_numpy().astype(bool)
        ids, column = part["vec_id"].to_numpy(), part["v"].combine_chunks()
        width = int(np.diff(column.offsets.to_numpy()).max(initial=0))
        x = matrix(column, width)
        most = float(np.abs(x.astype(float)).max(initial=0))
        x = x.astype(float) if most * most * width < 2**53 else x.astype(object)
        out: list[tuple] = []

        def once(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of rows that share an id, the one whose vector comes first."""
            order = sorted(rows, key=lambda r: (ids[r], tuple(x[r]))) if len(np.unique(ids[rows])) < len(rows) else rows
            first = np.unique(ids[order], return_index=True)[1]
            return ids[np.asarray(order)[first]], x[np.asarray(order)[first]]

        candidates, queries = np.flatnonzero(~kind), np.flatnonzero(kind)
        if len(candidates) and len(queries):
            lists = Lists(*once(candidates))
            for own, q in zip(*once(queries), strict=True):
                out += [(int(own), i, max(-2**63, min(2**63 - 1, s))) for s, i in lists.top(q, own, k)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[], [], []])], schema=FOUND)
    return run


def whole_numbers(embedding: Column) -> Column:
    """floor(256 x) of every component, x as double."""
    return F.transform(embedding, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k best other rows.

    Rows with a null vec_id, and vectors that are null or hold null, NaN or infinite components, take no part. Shorter
    vectors count as filled up with zeros. Of rows that share a vec_id the one with the first vector counts. Ties go to
    smaller vec_ids. Candidates and queries are dealt into blocks by a hash of vec_id, whose number follows from their
    counts; each pair of blocks is one bounded task, and the k best of each are ranked again. Empty tables give no
    rows; other columns are ignored. Scores beyond 64 bits are set to the limit.
    """
    spark = embeddings.sparkSession
    ship(spark)
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
            .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
            .select("vec_id", whole_numbers(F.col("embedding")).alias("v")))
    asked = F.col("vec_id") % every == 0
    n, m = embeddings.select(F.count(F.lit(1)), F.count_if(asked)).head()
    n_c, n_q = max(1, -(-n // candidates)), max(1, -(-m // queries))
    deal = lambda what, count: F.pmod(F.xxhash64("vec_id", F.lit(what)), F.lit(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    offered = rows.select(deal("c", n_c).alias("cb"), all_of(n_q).alias("qb"), F.lit(0).alias("kind"), "vec_id", "v")
    wanted = rows.where(asked).select(all_of(n_c).alias("cb"), deal("q", n_q).alias("qb"), F.lit(1).alias("kind"), "vec_id", "v")
    found = offered.unionByName(wanted).groupBy("cb", "qb").applyInArrow(search_block(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op1_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best for every fiftieth vector."""
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = {"op1_topk_threshold": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""}
