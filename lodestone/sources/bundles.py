"""Bundles: parts put together in order, and cut again by paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bundle(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts (each with seq), numbered in order of part and seq: `line`, from 0.

    Lines are numbered by ranges of seq, counted first, so no task holds a whole part.
    """
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        rows = p if rows is None else rows.unionByName(p)
    rows = rows.withColumn("__range", F.floor(F.col("seq") / RANGE))
    counts = rows.groupBy("part", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("part", "__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = Window.partitionBy("part", "__range").orderBy("seq")
    return rows.join(starts, ["part", "__range"]).withColumn("line", F.col("__from") + F.row_number().over(own) - 1).drop("__range", "__from")


#: Numbers in a range.
RANGE = 10_000


def broken_papers(rows: DataFrame, paper: str = "paper_id", line: str = "line") -> DataFrame:
    """Papers whose lines do not stand in one piece: lines between their first and last belong to others."""
    span = rows.groupBy(paper).agg(F.count(F.lit(1)).alias("lines"), (F.max(line) - F.min(line) + 1).alias("span"))
    return span.where("lines <> span")


def split(rows: DataFrame, path: str, paper: str = "paper_id", line: str = "line") -> None:
    """One folder per paper with its lines in order. Raises ValueError if a paper's lines do not stand in one piece."""
    if not broken_papers(rows, paper, line).isEmpty():
        raise ValueError("the lines of a paper do not stand in one piece")
    rows.repartition(paper).sortWithinPartitions(paper, line).write.mode("overwrite").partitionBy(paper).option("compression", "gzip").json(path)
