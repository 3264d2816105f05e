"""Incremental runs: files arriving in a folder go through a stage once each, in numbered batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def run_once(spark: SparkSession, source: str, schema: StructType | str, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
             files_per_batch: int = 1, name: str = "parquet") -> None:
    """Process all files not yet seen and stop.

    Each batch is written to a folder of its own number, overwritten if it runs again, so a batch that was cut short
    leaves nothing twice; the checkpoint records which files belong to it.
    """
    def write(df: DataFrame, number: int) -> None:
        stage(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(name).load(source)
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def results(spark: SparkSession, out: str) -> DataFrame:
    """All batches' rows."""
    return spark.read.parquet(out)


def pending(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requests without a result: what a restarted run still has to ask for."""
    return requests.join(done.select(key).distinct(), key, "left_anti")


def usage(results_: DataFrame) -> DataFrame:
    """Sums of token counts, and the share read from the cache, to 6 places."""
    return results_.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.sum("output_tokens").alias("output_tokens"),
                        F.round(F.sum("cached_tokens") / F.greatest(F.sum("input_tokens"), F.lit(1)), 6).alias("cache_rate"))
