"""Relations: validating what a model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import legal

ANSWER = "struct<triples:array<struct<subject:string,predicate:string,object:string,cell_context:array<string>>>>"
MOST_TRIPLES = 50


def clean_triples(answer: Column, visible: Column, need_context: bool = False) -> Column:
    """The valid triples of a JSON answer, distinct and in order.

    Only the first 50 are looked at. Ends must be visible tags that the predicate may join; context is kept, as sorted
    visible cells, for a hormone and a gene only, and may be required there.
    """
    raw = F.slice(F.coalesce(F.from_json(answer, ANSWER)["triples"], F.array().cast(ANSWER[15:-1])), 1, MOST_TRIPLES)
    pair = lambda t: F.concat(F.substring(F.trim(t["subject"]), 1, 1), F.substring(F.trim(t["object"]), 1, 1))
    mixed = lambda t: pair(t).isin("HG", "GH")
    number = lambda x: F.struct(F.substring(x, 1, 1).alias("p"), F.substring(x, 2, 9).cast("int").alias("n"), x.alias("x"))
    cells = lambda t: F.transform(F.array_sort(F.transform(F.array_distinct(F.filter(F.transform(F.coalesce(t["cell_context"], F.array().cast("array<string>")), lambda c: F.trim(c)),
        lambda c: c.rlike(r"^C\d+$") & F.array_contains(visible, c))), number)), lambda s: s["x"])
    done = F.transform(raw, lambda t: F.struct(number(F.trim(t["subject"])).alias("s"), F.lower(F.trim(t["predicate"])).alias("predicate"), number(F.trim(t["object"])).alias("o"),
                                              F.when(mixed(t), cells(t)).otherwise(F.array().cast("array<string>")).alias("context"), mixed(t).alias("mixed")))
    good = F.filter(done, lambda t: F.coalesce(F.array_contains(visible, t["s"]["x"]) & F.array_contains(visible, t["o"]["x"]) & legal(t["s"]["x"], t["predicate"], t["o"]["x"])
                                               & (~t["mixed"] | (F.size(t["context"]) > 0) | F.lit(not need_context)), F.lit(False)))
    return F.transform(F.array_sort(F.array_distinct(good)), lambda t: F.struct(
        t["s"]["x"].alias("subject"), t["predicate"].alias("predicate"), t["o"]["x"].alias("object"), t["context"].alias("cell_context")))


def referenced(entities: Column, triples: Column) -> Column:
    """Entities that a triple or its context names, in order of tag."""
    names = F.flatten(F.transform(triples, lambda t: F.concat(F.array(t["subject"], t["object"]), t["cell_context"])))
    kept = F.filter(entities, lambda e: F.array_contains(names, e["id"]))
    keyed = F.transform(kept, lambda e: F.struct(F.substring(e["id"], 1, 1).alias("p"), F.substring(e["id"], 2, 9).cast("int").alias("n"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda s: s["e"])


def windows(rows: DataFrame, seq: str, size: int = 500) -> DataFrame:
    """Add `window`: rows in lots of `size` by their number from 0."""
    return rows.withColumn("window", F.floor(F.col(seq) / size))


def counters(valid: DataFrame) -> DataFrame:
    """name, value: relations, relations by predicate and by direction, and those of hormone and gene with and without a
    context."""
    from lodestone.operators.graph import direction

    kinds = F.array(
        F.lit("relations"), F.concat(F.lit("predicate:"), F.col("predicate")),
        F.concat(F.lit("direction:"), direction(F.col("predicate"), F.col("subject_type"), F.col("object_type"))),
        F.when((F.col("subject_type") == "hormone") & (F.col("object_type") == "gene"),
               F.concat(F.lit("hormone_gene:"), F.when(F.size("context") > 0, "with_context").otherwise("without_context"))))
    return valid.select(F.explode(kinds).alias("name")).where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("value"))
