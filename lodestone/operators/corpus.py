"""Corpora: resolving records to papers, merging them, and adding what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.linking import components
from lodestone.tables import counted, looked_up


def resolve(records: DataFrame, seq: str, keys: list[Column]) -> DataFrame:
    """Add `paper`: the smallest seq of all records joined to one, over any number of steps, by an equal key.

    Every key's records are joined to its first one, so a frequent key gives a row per record.
    """
    named = F.filter(F.array(*[F.concat(F.lit(f"{i}:"), F.nullif(k, F.lit(""))) for i, k in enumerate(keys)]), lambda k: k.isNotNull())
    rows = records.select(F.col(seq).alias("id"), F.explode(named).alias("key"))
    first = rows.groupBy("key").agg(F.min("id").alias("first"))
    rows, total = counted(rows)
    labels = components(looked_up(rows, first, "key", total=total).select(F.col("id").alias("x"), F.col("first").alias("y")))
    return records.join(labels.select(F.col("id").alias(seq), "component"), seq, "left").withColumn("paper", F.coalesce("component", seq)).drop("component")


def merge(records: DataFrame, paper: str, seq: str, first: list[str], longest: list[str], sets: list[str], last: list[str] = ()) -> DataFrame:
    """One row per paper: the first filled value of some fields, the longest of others (first of ties), the sorted
    union of arrays, and the last filled value of the rest."""
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    return records.groupBy(paper).agg(
        *[F.min_by(c, F.when(some(c).isNotNull(), F.col(seq))).alias(c) for c in first],
        *[F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col(seq))).alias(c) for c in longest],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets],
        *[F.max_by(c, F.when(some(c).isNotNull(), F.col(seq))).alias(c) for c in last])


def added(new: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """New rows of which no key is in the base. A null key matches nothing."""
    for k in keys:
        new = new.join(base.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    return new


def chunks(docs: DataFrame, key: Column, text: str = "text") -> DataFrame:
    """One row per line that is not blank after cleaning: doc_key, chunk_id from 1, base, chunk."""
    from lodestone.functions.ids import chunk_base
    from lodestone.functions.text import sanitize_chunk

    lines = docs.select(key.alias("doc_key"), F.filter(F.transform(F.split(text, "\n"), sanitize_chunk), lambda x: x != "").alias("lines"))
    out = lines.select("doc_key", F.posexplode("lines").alias("i", "chunk"))
    return out.select("doc_key", (F.col("i") + 1).alias("chunk_id"), chunk_base(F.col("doc_key"), F.col("i") + 1).alias("base"), "chunk")


def fetch_again(pmcid: Column, version: Column, current: str, status: Column, checked: Column, now: Column) -> Column:
    """Whether a full text is to be fetched: another version, no lasting answer yet, or a denial of 7 days ago."""
    retry = F.coalesce(status, F.lit("")).isin("failed", "pending_retry", "service_error", "", "downloaded")
    return (F.when(pmcid.isNull() | (pmcid == ""), False).when(F.coalesce(version, F.lit("")) != current, True).when(retry, True)
            .when(status != "not_available", F.lit(False)).otherwise(checked.isNull() | (checked <= now - F.expr("INTERVAL 7 DAYS"))))


def joined_text(rows: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """key, joined: the texts of a document's chunks, in order, with a line end between."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n").alias("joined"))


def most_alike(docs: DataFrame, items: DataFrame, key: str, item: str) -> DataFrame:
    """key, item, jaccard: for every document the item whose words overlap its own most (the smaller of ties).

    docs: (key, words), items: (item, words), words without repeats. Documents meet items at the words they share, so no
    pair without a common word is made; items are the query set, whose size the planner knows.
    """
    of = lambda df, k, n: df.select(k, F.size("words").alias(n), F.explode("words").alias("word"))
    both = of(docs, key, "n").join(of(items, item, "m"), "word").groupBy(key, item, "n", "m").agg(F.count(F.lit(1)).alias("both"))
    scored = both.withColumn("jaccard", F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
    return scored.groupBy(key).agg(F.min(F.struct((-F.col("jaccard")).alias("far"), item)).alias("b")).select(key, f"b.{item}", (-F.col("b.far")).alias("jaccard"))
