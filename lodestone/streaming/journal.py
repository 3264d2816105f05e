"""Journals of requests to a service: what was tried, what came of it, and what a restarted run still has to do."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.client import ask

JOURNAL = "id string, attempt int, ok boolean, payload string, input_tokens bigint, cached_tokens bigint, output_tokens bigint"
#: Requests that a worker has open at once (fixed value).
CONCURRENCY = 8


def read(spark: SparkSession, path: str) -> DataFrame:
    """A journal of JSON lines; a torn last line is left out."""
    return spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path)


def replay(journal: DataFrame) -> DataFrame:
    """id, attempts, done, payload (of the last success) and the tokens of all attempts."""
    last = F.max_by("payload", F.when(F.col("ok"), F.col("attempt")))
    return journal.where("id is not null").groupBy("id").agg(
        F.count_distinct("attempt").alias("attempts"), F.bool_or("ok").alias("done"), last.alias("payload"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")])


def remaining(requests: DataFrame, journal: DataFrame, most: int = 6) -> DataFrame:
    """Requests (id, ...) that no attempt has answered and that were tried fewer than `most` times, with their next attempt."""
    tried = replay(journal).select("id", "attempts", "done")
    x = requests.join(tried, "id", "left").where(~F.coalesce("done", F.lit(False)) & (F.coalesce("attempts", F.lit(0)) < most))
    return x.withColumn("attempt", F.coalesce("attempts", F.lit(0)).cast("int") + 1).drop("attempts", "done")


def answered(requests: DataFrame, text: str, call: Callable[[str], str], at_once: int = CONCURRENCY) -> DataFrame:
    """id, attempt, ok, payload: every request asked, at most `at_once` open in a task; a failure is a row that is not ok.

    requests: (id, attempt, text).
    """
    def one(t: str) -> tuple[bool, str | None]:
        try:
            return True, ask(lambda: call(t))
        except Exception as e:  # goes into the journal
            return False, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                got = list(pool.map(one, b.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.string())],
                                                 names=["id", "attempt", "ok", "payload"])

    return requests.select("id", F.col("attempt").cast("int"), text).mapInArrow(run, "id string, attempt int, ok boolean, payload string")


def complete(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Keys that both branches have finished, and those that one of them still owes, with the branch that does."""
    both = left.select(key, F.lit(True).alias("l")).distinct().join(right.select(key, F.lit(True).alias("r")).distinct(), key, "full_outer")
    return both.where("l and r").select(key), both.where("l is null or r is null").select(key, F.when(F.col("l").isNull(), "left").otherwise("right").alias("owed"))
