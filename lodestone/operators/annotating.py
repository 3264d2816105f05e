"""Annotating chunks from an annotation service's documents: full texts first, abstracts for what they leave uncovered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.functions.text import service_type
from lodestone.operators.matching import match_passages

#: Sections whose chunks an abstract can cover (fixed values).
ABSTRACT_SECTIONS = ("TITLE", "ABSTRACT")
#: Lookup calls: ids in a call.
LOT = 40


def annotation_rows(passages: DataFrame) -> DataFrame:
    """One row per place and identifier of a passage's gene and chemical annotations, repeats left out.

    passages: paper, pos, text, offset, annotations (structs type, identifier, text, locations (offset, length)). A gene's
    identifiers are numbers, a chemical's descriptor numbers; an annotation without one, or of another type, gives no row.
    start counts from the passage's beginning.
    """
    a = passages.select("paper", "pos", "offset", F.explode("annotations").alias("a")).withColumn("kind", service_type(F.col("a.type"))).where("kind is not null")
    found = F.when(F.col("kind") == "gene", ids.gene_ids(F.col("a.identifier"))).otherwise(ids.chemical_ids(F.col("a.identifier")))
    a = a.select("paper", "pos", "offset", "kind", F.col("a.text").alias("mention"), F.explode("a.locations").alias("l"), found.alias("found"))
    a = a.select("paper", "pos", "kind", "mention", (F.col("l.offset") - F.col("offset")).cast("int").alias("start"), F.col("l.length").cast("int").alias("length"), F.explode("found").alias("concept_id"))
    return a.where("start >= 0 and length > 0").withColumn("end", F.col("start") + F.col("length")).drop("length").distinct()


def covered(matched: DataFrame) -> DataFrame:
    """Chunks (paper, chunk_id) that a passage took."""
    return matched.select("paper", "chunk_id").distinct()


def uncovered(chunks: DataFrame, matched: DataFrame) -> DataFrame:
    """Title and abstract chunks that no passage took."""
    own = chunks.where(F.upper("section").isin(*ABSTRACT_SECTIONS))
    return own.join(covered(matched), ["paper", "chunk_id"], "left_anti")


def two_passes(chunks: DataFrame, full: DataFrame, abstracts: DataFrame) -> DataFrame:
    """paper, chunk_id, pos, source of every chunk covered: by passages of full texts, then, for title and abstract chunks
    still uncovered, by passages of abstracts. Passages: (paper, pos, section, text); chunks: (paper, chunk_id, section, chunk)."""
    first = match_passages(full, chunks)
    rest = uncovered(chunks, first)
    second = match_passages(abstracts.join(rest.select("paper").distinct(), "paper", "left_semi"), rest)
    return first.withColumn("source", F.lit("full text")).unionByName(second.withColumn("source", F.lit("abstract")))


def to_requested(documents: DataFrame, requested: DataFrame, keys: list[str], by_pmid: DataFrame) -> DataFrame:
    """Documents with the requested id that one of their own ids, in order, names; a pmid also by its article id.

    requested: (id); by_pmid: (pmid, pmcid). Where a single id was asked for, a document that names none is the answer.
    """
    names = documents.withColumn("__d", F.monotonically_increasing_id())
    spread = names.select("__d", F.posexplode(F.array(*[F.col(k).cast("string") for k in keys])).alias("order", "name")).where("name is not null")
    other = spread.join(by_pmid.select(F.col("pmid").alias("name"), "pmcid"), "name").select("__d", (F.col("order") + len(keys)).alias("order"), F.col("pmcid").alias("name"))
    best = (spread.unionByName(other).join(requested.select(F.col("id").alias("name")).distinct(), "name").groupBy("__d").agg(F.min_by("name", "order").alias("requested_id")))
    only = requested.agg(F.count_distinct("id").alias("n"), F.min("id").alias("only"))
    out = names.join(best, "__d", "left").join(F.broadcast(only))  # one row
    return out.withColumn("requested_id", F.coalesce("requested_id", F.when(F.col("n") == 1, F.col("only")))).drop("__d", "n", "only")


def concept_sets(rows: DataFrame) -> DataFrame:
    """Distinct concepts of every type."""
    return rows.groupBy("kind").agg(F.count_distinct("concept_id").alias("concepts"))


def type_counts(chunks: DataFrame) -> DataFrame:
    """name, value: chunks, annotations, and annotations by type, of rows with `annotations` (structs with obj)."""
    x = chunks.select(F.explode("annotations").alias("a")).groupBy(F.concat(F.lit("type:"), F.coalesce("a.obj", F.lit("unknown"))).alias("name")).agg(F.count(F.lit(1)).alias("value"))
    total = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.size("annotations")), F.lit(0)).alias("annotations"))
    return total.select(F.stack(F.lit(2), F.lit("chunks"), "chunks", F.lit("annotations"), "annotations").alias("name", "value")).unionAll(x)


def first_present(stats: Column, *names: str) -> Column:
    """The first of some names that a map of numbers holds; 0 for none."""
    return F.coalesce(*[F.try_element_at(stats, F.lit(n)) for n in names], F.lit(0)).cast("long")


def stat_sums(stats: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row: every number summed over rows with a map `stats`, under the first of its names that is there."""
    return stats.agg(*[F.coalesce(F.sum(first_present(F.col("stats"), *n)), F.lit(0)).alias(k) for k, n in names.items()])


def corpus_counts(papers: DataFrame) -> DataFrame:
    """Papers, those with an abstract, with and without an article id, reused and new. papers: (abstract, pmcid, reused)."""
    some = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(None)).isNotNull()
    return papers.agg(F.count(F.lit(1)).alias("papers"), F.count_if(some("abstract")).alias("abstracts"), F.count_if(some("pmcid")).alias("with_pmcid"),
                      F.count_if(~some("pmcid")).alias("without_pmcid"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("new"))


def usage_of(answer: Column) -> Column:
    """Token counts that a model's answer (JSON) reports; 0 for what is not there."""
    u = F.from_json(answer, "usage struct<input_tokens:bigint,output_tokens:bigint,input_tokens_details:struct<cached_tokens:bigint>>")["usage"]
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return F.struct(n(u["input_tokens"]).alias("input_tokens"), n(u["input_tokens_details"]["cached_tokens"]).alias("cached_tokens"), n(u["output_tokens"]).alias("output_tokens"))


def segments(spans: DataFrame, group: str) -> DataFrame:
    """Overlapping highlights (start, end, key) cut at every border: start, end and the keys that cover each piece, in order
    of start, the longer first. Pieces that nothing covers are left out."""
    borders = spans.select(group, F.explode(F.array("start", "end")).alias("at")).distinct()
    from pyspark.sql import Window
    piece = borders.withColumn("to", F.lead("at").over(Window.partitionBy(group).orderBy("at"))).where("to is not null")
    over = piece.join(spans, (piece[group] == spans[group]) & (F.col("start") <= F.col("at")) & (F.col("end") >= F.col("to"))).drop(spans[group])
    keys = F.transform(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("far"), "key"))), lambda s: s["key"])
    return over.groupBy(group, F.col("at").alias("piece_start"), F.col("to").alias("piece_end")).agg(keys.alias("keys"))
