"""Normalising mentions: by abbreviations, by a document's own long forms, or by an encoder; and what comes of it."""

from __future__ import annotations

import pandas as pd
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.functions.similarity import abbreviation_threshold
from lodestone.functions.text import abbreviation_key, abbreviation_variants, looks_abbreviated, singular_text

#: Shortest key that is compared by spelling, and candidates asked for and kept by route (fixed values).
FUZZY_LENGTH = 4
ASKED = {"encoder": (20, 1), "ambiguous": (50, 5), "fuzzy": (1, 1)}


@F.pandas_udf(DoubleType())
def key_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Spelling ratio of two keys; 0 if either is empty."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def requests(mentions: DataFrame) -> DataFrame:
    """document_key, normalized_text and the first mention of each pair, by seq. mentions: (seq, document_key, mention)."""
    x = mentions.withColumn("normalized_text", singular_text(F.col("mention"))).where("normalized_text <> ''")
    return x.groupBy("document_key", "normalized_text").agg(F.min_by("mention", "seq").alias("mention"))


def long_forms(wanted: DataFrame, forms: DataFrame) -> DataFrame:
    """document_key, key, long_form, method, matched, score: what a document itself says that an abbreviation means.

    wanted: (document_key, key); forms: (document_key, short_form, long_form), of whose equal keys the smallest long form
    counts. An equal key comes first, then one with or without a plural s; both are joins. Only what is left is compared
    with the document's keys by spelling: the most alike is taken (the smaller key of ties) if it is alike enough for the
    key's length.
    """
    f = forms.select("document_key", abbreviation_key(F.col("short_form")).alias("matched"), "long_form").where("matched <> ''")
    f = f.groupBy("document_key", "matched").agg(F.min("long_form").alias("long_form"))
    wanted = wanted.select("document_key", "key").distinct()
    tried = wanted.select("document_key", "key", F.posexplode(abbreviation_variants(F.col("key"))).alias("order", "matched"))
    equal = tried.join(f, ["document_key", "matched"]).groupBy("document_key", "key").agg(F.min(F.struct("order", "matched", "long_form")).alias("b"))
    equal = equal.select("document_key", "key", "b.long_form", F.when(F.col("b.order") == 0, "exact_key").otherwise("exact_variant").alias("method"), "b.matched", F.lit(1.0).alias("score"))
    left = wanted.join(equal, ["document_key", "key"], "left_anti").where(abbreviation_threshold(F.col("key")) < 1.0)
    near = left.join(f, "document_key").withColumn("score", key_ratio("key", "matched")).where(F.col("score") >= abbreviation_threshold(F.col("key")))
    best = near.groupBy("document_key", "key").agg(F.min(F.struct((-F.col("score")).alias("far"), "matched", "long_form")).alias("b"))
    return equal.unionByName(best.select("document_key", "key", "b.long_form", F.lit("fuzzy_key").alias("method"), "b.matched", (-F.col("b.far")).alias("score")))


def lookup(rows: DataFrame) -> DataFrame:
    """key, short_form, ids: identifiers by abbreviation key. rows: (short_form, matched_id)."""
    x = rows.select(abbreviation_key(F.col("short_form")).alias("key"), "short_form", F.explode(F.split("matched_id", r"\s*,\s*")).alias("id")).where("key <> '' and trim(id) not in ('', '-')")
    return x.groupBy("key").agg(F.min("short_form").alias("short_form"), F.array_sort(F.collect_set(F.trim("id"))).alias("ids"))


def routed(asked: DataFrame, known: DataFrame, forms: DataFrame) -> DataFrame:
    """Every request with its route, query and, if it needs no model, its identifier.

    asked: (document_key, normalized_text, mention), known: lookup(), forms: as in long_forms(). A mention that looks like
    an abbreviation and whose key, or its plural variant, is known with one identifier is `direct`; with several it is
    `ambiguous` and asks for the document's long form, if there is one. One with an unknown key of more than 4 characters
    is `fuzzy`: an encoder may find its key. All others are for the `encoder`.
    """
    x = asked.withColumn("key", abbreviation_key(F.col("mention"))).withColumn("short", looks_abbreviated(F.col("mention")))
    tried = x.where("short").select("document_key", "normalized_text", F.posexplode(abbreviation_variants(F.col("mention"))).alias("order", "found"))
    found = tried.join(known.withColumnRenamed("key", "found"), "found").groupBy("document_key", "normalized_text").agg(F.min(F.struct("order", "found", "ids")).alias("k"))
    x = x.join(found, ["document_key", "normalized_text"], "left")
    many = x.where(F.size("k.ids") > 1).select("document_key", F.col("k.found").alias("key"))
    long = long_forms(many, forms).select("document_key", F.col("key").alias("said"), "long_form", "method", "matched", "score")
    x = x.withColumn("said", F.when(F.size("k.ids") > 1, F.col("k.found"))).join(long, ["document_key", "said"], "left")
    route = (F.when(F.size("k.ids") == 1, "direct").when(F.col("long_form").isNotNull(), "ambiguous")
             .when(F.col("short") & F.col("k").isNull() & (F.length("key") > FUZZY_LENGTH), "fuzzy").otherwise("encoder"))
    query = F.when(route == "ambiguous", singular_text(F.col("long_form"))).when(route == "fuzzy", F.col("key")).otherwise(F.col("normalized_text"))
    return x.select("document_key", "normalized_text", "mention", route.alias("route"), F.when(route != "direct", query).alias("query"),
                    F.when(route == "direct", F.get("k.ids", F.lit(0))).alias("identifier"), "long_form", F.col("method").alias("long_form_method"))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The first candidate of each request, by score, then identifier. candidates: (document_key, normalized_text, identifier,
    preferred_label, score, source)."""
    rank = F.row_number().over(Window.partitionBy("document_key", "normalized_text").orderBy(F.desc("score"), "identifier"))
    return candidates.withColumn("rank", rank).where("rank = 1").drop("rank")


def final_rows(mentions: DataFrame, best: DataFrame) -> DataFrame:
    """Every mention with its request's best candidate and `normalization_status`: normalized, or unresolved without one."""
    x = mentions.withColumn("normalized_text", singular_text(F.col("mention"))).join(best, ["document_key", "normalized_text"], "left")
    return (x.withColumn("normalization_status", F.when(F.col("identifier").isNull(), "unresolved").otherwise("normalized"))
            .withColumnsRenamed({"identifier": "cell_ontology_id", "preferred_label": "cell_ontology_label", "score": "normalization_score", "source": "normalization_source"}))


def rate(rows: DataFrame) -> DataFrame:
    """cells, normalized and the rate in percent, to 2 places."""
    n = F.count_if(F.col("normalization_status") == "normalized")
    return rows.agg(F.count(F.lit(1)).alias("cells"), n.alias("normalized"), F.round(100 * n / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("rate"))


def labelled(items: DataFrame, key: str, sources: list[DataFrame], mention: str) -> DataFrame:
    """Items with `label` and `label_source` from the first of some lookups (key, label, name of the lookup) that knows the
    key; else the mention itself."""
    names = []
    for i, s in enumerate(sources):
        items = items.join(s.select(key, F.struct("label", "label_source").alias(f"__{i}")), key, "left")
        names.append(F.when(F.coalesce(F.col(f"__{i}.label"), F.lit("")) != "", F.col(f"__{i}")))
    own = F.struct(F.col(mention).alias("label"), F.lit("mention").alias("label_source"))
    return items.withColumn("__l", F.coalesce(*names, own)).select(*[c for c in items.columns if not c.startswith("__")], "__l.label", "__l.label_source")
