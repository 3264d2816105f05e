"""Chunks made ready for a relation model, and its answers made into relation rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import annotations, relations


def prepare(chunks: DataFrame) -> DataFrame:
    """Add `spans` (start, end, type, key, tag), `entities` (id, obj, mention, key), `eligible` and `tagged`.

    chunks: (base, chunk, annotations of (obj, start, end, mention, identity)). Spans outside the text go, equal ones
    count once, of crossing ones the longer stays. Tags are numbered per prefix by where a key first stands. A chunk
    is eligible if its tags have two prefixes, for then some relation may join them.
    """
    prefix = F.create_map(*[F.lit(x) for kv in annotations.TAGS.items() for x in kv])
    end = lambda a: annotations.span_end(F.col("chunk"), a["start"], a["end"], a["mention"])
    kind = lambda a: F.lower(F.trim(a["obj"]))
    own = lambda a: F.coalesce(F.nullif(F.trim(a["identity"]), F.lit("")), F.nullif(F.concat(F.lit("mention:"), F.lower(F.trim(a["mention"]))), F.lit("mention:")),
                               F.concat_ws(":", F.lit("span"), a["start"].cast("string"), a["end"].cast("string")))
    family = lambda a: F.when(kind(a) == "protein", "gene").otherwise(kind(a))
    spans = F.transform("annotations", lambda a: F.struct(a["start"].alias("start"), end(a).alias("end"), kind(a).alias("type"), F.concat(family(a), F.lit(":"), own(a)).alias("key")))
    valid = F.filter(spans, lambda s: s["end"].isNotNull() & F.try_element_at(prefix, s["type"]).isNotNull())
    x = chunks.withColumn("__s", F.explode(F.array(annotations.non_crossing(F.array_distinct(valid)))))
    keys = F.array_distinct(F.transform("__s", lambda s: F.struct(F.try_element_at(prefix, s["type"]).alias("p"), s["key"].alias("key"))))
    x = x.withColumn("__k", F.explode(F.array(keys)))
    tag = lambda s: F.concat(F.try_element_at(prefix, s["type"]), F.array_position(F.transform(F.filter("__k", lambda k: k["p"] == F.try_element_at(prefix, s["type"])), lambda k: k["key"]), s["key"]).cast("string"))
    x = x.withColumn("spans", F.transform("__s", lambda s: F.struct(s["start"], s["end"], s["type"], s["key"], tag(s).alias("tag"))))
    first = F.array_distinct(F.transform("spans", lambda s: s["tag"]))
    at = lambda t: F.get(F.filter("spans", lambda s: s["tag"] == t), F.lit(0))
    x = x.withColumn("entities", F.transform(first, lambda t: F.struct(t.alias("id"), F.when(at(t)["type"] == "protein", "gene").otherwise(at(t)["type"]).alias("obj"),
                                                                     F.substring(F.col("chunk"), at(t)["start"] + 1, at(t)["end"] - at(t)["start"]).alias("mention"), at(t)["key"].alias("key"))))
    x = x.withColumn("eligible", F.size(F.array_distinct(F.transform(first, lambda t: F.substring(t, 1, 1)))) > 1).drop("__s", "__k")
    return annotations.render_tags(x, "chunk", "spans")


def answered(prepared: DataFrame, ask: Callable[[list[str]], list[str]], size: int = 8) -> DataFrame:
    """base, answer of the eligible chunks, asked for in lots by the caller's function; others are never asked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, size):
                part = b.slice(a, size)
                yield pa.record_batch([part.column(0), pa.array(ask(part.column(1).to_pylist()), pa.string())], names=["base", "answer"])
    return prepared.where("eligible").select(F.col("base").cast("string"), "tagged").mapInArrow(run, "base string, answer string")


def relation_rows(prepared: DataFrame, answers: DataFrame, need_context: bool = False) -> DataFrame:
    """Each chunk with its clean triples and the entities that they name; without an answer both are empty."""
    x = prepared.join(answers, "base", "left")
    tags = F.transform("entities", lambda e: e["id"])
    x = x.withColumn("relations", F.explode(F.array(relations.clean_triples(F.col("answer"), tags, need_context))))
    return x.withColumn("entities", relations.referenced(F.col("entities"), F.col("relations"))).drop("answer", "spans", "tagged", "eligible")
