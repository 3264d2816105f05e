"""Ontology: paths, children and merged hierarchies of a graph of terms with several parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEEPEST = 100


def paths(parents: DataFrame, roots: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """All simple paths from roots: term, path, depth. parents: rows (term, parent); self-parents are ignored.

    The terms of a level are joined to their children level by level, until there are none or the depth is reached.
    """
    step = parents.where("term <> parent").select(F.col("parent").alias("__p"), F.col("term").alias("__t")).distinct()
    level = roots.select("term", F.array("term").alias("path"))
    out, at = level, 1
    while at < depth:
        level = (level.join(step, F.col("term") == F.col("__p")).where(~F.array_contains("path", F.col("__t")))
                 .select(F.col("__t").alias("term"), F.array_append("path", F.col("__t")).alias("path")))
        if level.isEmpty():
            break
        out, at = out.unionAll(level), at + 1
    return out.withColumn("depth", F.size("path"))


def first_paths(found: DataFrame, most: int) -> DataFrame:
    """At most so many paths of each term, in order."""
    rank = F.row_number().over(Window.partitionBy("term").orderBy("path"))
    return found.withColumn("n", rank).where(F.col("n") <= most).drop("n")


def children(parents: DataFrame) -> DataFrame:
    """Terms with the numbers of their parents and children."""
    e = parents.where("term <> parent").distinct()
    up = e.groupBy("term").agg(F.count(F.lit(1)).alias("parents"))
    down = e.groupBy(F.col("parent").alias("term")).agg(F.count(F.lit(1)).alias("children"))
    return up.join(down, "term", "full_outer").select("term", F.coalesce("parents", F.lit(0)).alias("parents"), F.coalesce("children", F.lit(0)).alias("children"))


def merged(found: DataFrame) -> DataFrame:
    """The tree that several terms' paths make: every beginning of a path once, with the terms below it counted."""
    heads = found.select("term", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n"), "path")
    return heads.select("term", F.slice("path", 1, F.col("n")).alias("head")).groupBy("head").agg(F.count_distinct("term").alias("terms"))


def resolve(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names with the term that they are an alias of, else themselves."""
    return names.join(aliases.select("name", "term"), "name", "left").withColumn("term", F.coalesce("term", "name"))


def named_terms(terms: DataFrame) -> DataFrame:
    """One row per label and synonym of a term: term, name, is_preferred, normal (singular). terms: (id, label, synonyms)."""
    from lodestone.functions.text import singular_text, squeeze

    names = F.array_prepend(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("label"))
    x = terms.where(F.coalesce(F.trim("label"), F.lit("")) != "").select(F.col("id").alias("term"), F.posexplode(names).alias("n", "name"))
    x = x.withColumn("name", squeeze(F.col("name"))).where("name <> ''")
    return x.groupBy("term", "name").agg(F.min("n").alias("n")).select("term", "name", (F.col("n") == 0).alias("is_preferred"), singular_text(F.col("name")).alias("normal"))


def hierarchy(terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms (first row of each id), links (term, parent; a term is not its own parent), and aliases (name, term; a term's own
    id and label go before others' aliases). terms: (id, label, definition, synonyms, parents, aliases), with a row `_meta`
    that is no term."""
    t = terms.where("id <> '_meta'").dropDuplicates(["id"])
    links = t.select(F.col("id").alias("term"), F.explode("parents").alias("parent")).where("term <> parent").distinct()
    own = t.select(F.explode(F.array("id", "label")).alias("name"), F.lit(0).alias("rank"), F.col("id").alias("term"))
    other = t.select(F.explode(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"), F.lit(1).alias("rank"), F.col("id").alias("term"))
    aliases = own.unionAll(other).where("name <> ''").groupBy("name").agg(F.min(F.struct("rank", "term")).alias("b")).select("name", "b.term")
    return t.select("id", "label", "definition"), links, aliases


def in_graph(terms: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """term, id: the strongest node (papers, then id) among those whose identifier is the term or an alias of it."""
    n = resolve(nodes.where("entity_type = 'cell'").select(F.col("normalized_id").alias("name"), "id", "paper_count"), aliases)
    best = n.groupBy("term").agg(F.max(F.struct("paper_count", "id")).alias("b"))
    return terms.select("term").distinct().join(best, "term", "left").select("term", F.col("b.id").alias("id"))


def descendants(found: DataFrame, of_graph: DataFrame) -> DataFrame:
    """Per beginning of a path, the graph's ids of all terms at or below it, sorted. found: paths(), of_graph: in_graph()."""
    heads = found.select("term", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n")).select("term", F.slice("path", 1, F.col("n")).alias("head"))
    return heads.join(of_graph.where("id is not null"), "term").groupBy("head").agg(F.array_sort(F.collect_set("id")).alias("ids"))
