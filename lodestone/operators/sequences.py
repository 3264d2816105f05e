"""Sequences: spans from token labels, windows over tokens, running offsets and contiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_spans(tokens: DataFrame, group: str, order: list[str], tag: str, start: str, end: str) -> DataFrame:
    """Spans of runs of one label: a run begins at B, at another label and after O. A label without B- or I- is a B."""
    w = Window.partitionBy(group).orderBy(*order)
    mark = F.when(F.col(tag).rlike("^[BI]-"), F.substring(tag, 1, 1)).otherwise("B")
    label = F.when(F.col(tag).rlike("^[BI]-"), F.substring(F.col(tag), F.lit(3), F.length(tag))).otherwise(F.col(tag))
    t = tokens.withColumns({"__l": F.when(F.col(tag) != "O", label), "__m": mark})
    before = F.lag("__l").over(w)
    t = t.withColumn("__new", F.col("__l").isNotNull() & ((F.col("__m") == "B") | before.isNull() | (before != F.col("__l"))))
    t = t.withColumn("__run", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__l is not null")
    return t.groupBy(group, "__run").agg(F.first("__l").alias("label"), F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("tokens")).drop("__run")


def token_windows(tokens: Column, length: int, stride: int = 128) -> Column:
    """Overlapping windows over an array: each `length` long, sharing `stride` with the one before."""
    step = max(1, length - stride)
    last = F.greatest(F.ceil((F.size(tokens) - length) / step), F.lit(0)).cast("int")
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("at"), F.slice(tokens, i * step + 1, F.lit(length)).alias("tokens")))).otherwise(
        F.array().cast("array<struct<at:int,tokens:array<string>>>"))


def best_label(logits: DataFrame, key: list[str], scores: str, n: int) -> DataFrame:
    """Mean scores of a token over all windows that hold it, and the place of the highest."""
    mean = logits.groupBy(*key).agg(F.array(*[F.avg(F.get(scores, F.lit(i))) for i in range(n)]).alias("mean"))
    return mean.withColumn("best", (F.array_position("mean", F.array_max("mean")) - 1).cast("int"))


def running_offset(rows: DataFrame, group: str, order: list[str], text: str, gap: int = 2) -> DataFrame:
    """Add `offset`: where a text begins if those before stand in front of it with a gap after each."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.length(text) + gap).over(w), F.lit(0)))


def runs(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Per group: runs of equal values and distinct values; equal numbers mean that each value stands in one piece."""
    w = Window.partitionBy(group).orderBy(*order)
    new = (F.lag(value).over(w).isNull() | (F.lag(value).over(w) != F.col(value))).cast("int")
    return rows.select(group, value, new.alias("__new")).groupBy(group).agg(F.sum("__new").alias("runs"), F.count_distinct(value).alias("values"))
