"""Operators around a model that the caller gives: labelling tokens window by window, and encoding names with a cache."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import sequences

#: Tokens in a window and shared by two windows, windows and names in a call (fixed values).
LENGTH, STRIDE, WINDOWS, NAMES = 512, 128, 4, 64
TOKEN = re.compile(r"\w+|[^\w\s]")


def tokens(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, token, start, end of every token of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n, m[0], m.start(), m.end()) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, m in enumerate(TOKEN.finditer(t or ""))]
            kinds = (b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[key, "n", "token", "start", "end"])

    return chunks.select(key, text).mapInArrow(run, f"{key} {chunks.schema[key].dataType.simpleString()}, n int, token string, start int, end int")


def recognise(chunks: DataFrame, key: str, text: str, model: Callable[[list[list[str]]], list[list[list[float]]]], labels: list[str],
              length: int = LENGTH, stride: int = STRIDE) -> DataFrame:
    """key, label, start, end, tokens, mention of the spans that a model finds.

    model gives, for some windows of tokens, a score per token and label. A token that several windows hold gets the mean
    of its scores; the best label of each is read as spans (B-, I- and O). Texts without tokens give no rows.
    """
    kind = chunks.schema[key].dataType.simpleString()
    t = tokens(chunks, key, text)
    whole = t.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t")).select(key, F.transform("t", lambda x: x["token"]).alias("t"))
    windows = whole.select(key, F.explode(sequences.token_windows(F.col("t"), length, stride)).alias("w")).select(key, "w.at", "w.tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, WINDOWS):
                part = b.slice(a, WINDOWS)
                scores = model(part.column(2).to_pylist())
                rows = [(k, at + i, s) for k, at, w in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), scores, strict=True) for i, s in enumerate(w)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()),
                                                  pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=[key, "n", "scores"])

    scored = windows.mapInArrow(run, f"{key} {kind}, n int, scores array<double>")
    best = sequences.best_label(scored, [key, "n"], "scores", len(labels))
    tagged = t.join(best, [key, "n"]).withColumn("tag", F.get(F.array(*[F.lit(x) for x in labels]), F.col("best")))
    spans = sequences.label_spans(tagged, key, ["n"], "tag", "start", "end")
    return spans.join(chunks.select(key, text), key).select(key, "label", "start", "end", "tokens", F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")).alias("mention"))


def encoded(names: DataFrame, cache: DataFrame, encode: Callable[[list[str]], list[list[float]]], name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Vectors of some names: (all wanted, those new to the cache). Each distinct name that the cache lacks is encoded once.

    cache: (name, vector).
    """
    wanted = names.select(name).where(F.col(name).isNotNull()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, NAMES):
                part = b.slice(a, NAMES)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encode(part.column(0).to_pylist()), pa.list_(pa.float64()))], names=[name, "vector"])

    new = wanted.join(cache.select(name), name, "left_anti").mapInArrow(run, f"{name} string, vector array<double>")
    return cache.join(wanted, name, "left_semi").select(name, "vector").unionByName(new), new
