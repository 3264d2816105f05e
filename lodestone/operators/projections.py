"""Rows as they are handed from stage to stage: identity columns, compact annotations, normalised records, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.functions.text import clean_text, given
from lodestone.operators.annotations import PRIORITY

#: What identifies a chunk in every file (fixed values): of sources, and of rows that are compared.
IDENTITY = ("base", "doc_key", "canonical_id", "pmid", "pmcid", "journal", "pub_year", "section_type", "chunk_id")
COMPARED = ("base", "doc_key", "canonical_id", "pmid", "pmcid", "section_type", "chunk_id")
#: Fields of authors, which records lose (fixed values).
AUTHORS = ("author", "authors", "author_string", "authorString")
#: Optional fields of a gene's annotation (fixed values).
GENE_FIELDS = ("tax_id", "tax_name", "taxonomy_source", "gene_record_status")


def filled(x: Column) -> Column:
    return F.nullif(x.cast("string"), F.lit(""))


def identity(rows: DataFrame) -> DataFrame:
    """The identity columns that the rows have."""
    return rows.select(*[c for c in IDENTITY if c in rows.columns])


def chunk_rows(rows: DataFrame) -> DataFrame:
    """Chunks without their text, with an empty list of annotations; journal and year empty instead of null."""
    out = identity(rows)
    for c in ("journal", "pub_year"):
        if c in out.columns:
            out = out.withColumn(c, given(F.col(c)))
    return out.withColumn("annotations", F.array().cast("array<struct<obj:string,start:int,end:int,mention:string,concept_id:string,preferred_label:string>>"))


def field(a: Column, name: str, has: list[str]) -> Column:
    return a[name].cast("string") if name in has else F.lit(None).cast("string")


def compact_cell(a: Column, has: list[str], source: str = "model") -> Column:
    """A cell's annotation: its concept and label under either name, its place and mention, and the source that the caller
    names. has: fields of the struct."""
    return F.struct(F.lit("cell").alias("obj"), a["start"].cast("int").alias("start"), a["end"].cast("int").alias("end"), F.coalesce(field(a, "mention", has), F.lit("")).alias("mention"),
                    F.coalesce(field(a, "concept_id", has), field(a, "cell_ontology_id", has)).alias("concept_id"),
                    F.coalesce(field(a, "preferred_label", has), field(a, "cell_ontology_label", has)).alias("preferred_label"),
                    F.lit(source).alias("normalization_source"))


def compact_entity(a: Column, has: list[str], source: str = "service") -> Column:
    """A gene's or hormone's annotation with the fields of its type; null for other types. Absent fields are null."""
    kind = F.lower(F.coalesce(filled(field(a, "entity_type", has)), field(a, "obj", has), F.lit("")))
    of = lambda t, x: F.when(kind == t, x)
    hormone = F.coalesce(filled(field(a, "hormone_id", has)), filled(field(a, "chemical_id", has)))
    return F.when(kind.isin("gene", "hormone"), F.struct(
        kind.alias("obj"), a["start"].cast("int").alias("start"), a["end"].cast("int").alias("end"), F.coalesce(field(a, "mention", has), F.lit("")).alias("mention"),
        field(a, "concept_id", has).alias("concept_id"), field(a, "preferred_label", has).alias("preferred_label"), F.lit(source).alias("normalization_source"),
        of("gene", field(a, "gene_id", has)).alias("gene_id"), *[of("gene", filled(field(a, f, has))).alias(f) for f in GENE_FIELDS],
        of("hormone", hormone).alias("hormone_id"), of("hormone", F.coalesce(filled(field(a, "chemical_id", has)), hormone)).alias("chemical_id"),
        of("hormone", F.coalesce(filled(field(a, "source_entity_type", has)), F.lit("Chemical"))).alias("source_entity_type"),
        *[filled(field(a, f, has)).alias(f) for f in ("label_source", "hormone_classification_source")]))


def compact_document(documents: DataFrame) -> DataFrame:
    """Documents whose passages keep offset, infons and text alone."""
    keep = lambda p: F.struct(p["offset"].alias("offset"), p["infons"].alias("infons"), p["text"].alias("text"))
    return documents.withColumn("passages", F.transform("passages", keep))


def in_order(annotations: Column) -> Column:
    """Annotations by start, end, type, mention (whatever its case) and concept."""
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    keyed = F.transform(annotations, lambda a: F.struct(F.coalesce(a["start"], F.lit(0)), F.coalesce(a["end"], F.lit(0)), F.coalesce(F.try_element_at(rank, given(a["obj"])), F.lit(99)),
                                                       F.lower(given(a["mention"])), given(a["concept_id"]), a.alias("a")))
    return F.transform(F.array_sort(keyed), lambda k: k["a"])


def once(annotations: Column) -> Column:
    """Annotations without repeats of type, place, mention, concept and label: the first of each stays."""
    sign = lambda a: F.to_json(F.struct(a["obj"], a["start"], a["end"], a["mention"], a["concept_id"], a["preferred_label"]))
    signs = F.transform(annotations, sign)
    return F.filter(annotations, lambda a, i: F.array_position(signs, sign(a)) == i + 1)


def normal_record(records: DataFrame) -> DataFrame:
    """Records with normalised identifiers and cleaned texts, without authors; sources are distinct, sorted, with the
    single source among them."""
    out = records.drop(*AUTHORS)
    for c, f in (("pmid", ids.pmid), ("pmcid", ids.pmcid), ("doi", ids.doi)):
        if c in out.columns:
            out = out.withColumn(c, f(F.col(c)))
    for c in ("title", "abstract", "journal"):
        if c in out.columns:
            out = out.withColumn(c, clean_text(F.col(c)))
    if "pub_year" in out.columns:
        out = out.withColumn("pub_year", F.nullif(clean_text(F.col("pub_year")), F.lit("")))
    some = F.coalesce(F.col("sources"), F.array().cast("array<string>")) if "sources" in out.columns else F.array().cast("array<string>")
    one = F.array(F.col("source")) if "source" in out.columns else F.array().cast("array<string>")
    sources = F.filter(F.transform(F.concat(some, one), clean_text), lambda s: s != "")
    return out.withColumn("sources", F.array_sort(F.array_distinct(sources)))


#: Sources whose records count as described (fixed values).
DESCRIBING = ("pubmed", "europepmc")


def has_metadata(records: DataFrame) -> Column:
    """Whether a record comes from a describing source or has a title, abstract or journal."""
    said = F.coalesce(*[filled(clean_text(F.col(c))) for c in ("title", "abstract", "journal") if c in records.columns], F.lit(None).cast("string")).isNotNull()
    sources = F.coalesce(F.col("sources"), F.array().cast("array<string>"))
    return said | F.arrays_overlap(sources, F.array(*[F.lit(x) for x in DESCRIBING]))


def same_identity(a: str, b: str, columns: tuple[str, ...] = COMPARED) -> Column:
    """Whether two structs agree in all identity columns, nulls with nulls."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def aligned(left: DataFrame, right: DataFrame, columns: tuple[str, ...] = COMPARED) -> DataFrame:
    """Rows of both on base, with `problem` where one is missing or the identities differ."""
    pair = left.select("base", F.struct(*left.columns).alias("l")).join(right.select("base", F.struct(*right.columns).alias("r")), "base", "full_outer")
    wrong = F.when(F.col("l").isNull(), "left missing").when(F.col("r").isNull(), "right missing").when(~same_identity("l", "r", columns), "identity differs")
    return pair.withColumn("problem", wrong)


def paper_order() -> list[Column]:
    """The newest papers first (a year that is no number counts as 0), then by title."""
    return [F.coalesce(F.expr("try_cast(pub_year as int)"), F.lit(0)).desc(), F.lower("title").asc()]


def reuse(papers: DataFrame, manifest: DataFrame, files: DataFrame, new: DataFrame, rebuild: DataFrame) -> DataFrame:
    """papers (paper) with `decision`: rebuild, if asked for; new, if not in the manifest or among the new ones; missing,
    if its file is gone; else reuse. manifest, files, new and rebuild: (paper)."""
    flag = lambda df, name: df.select("paper", F.lit(True).alias(name)).distinct()
    x = papers.join(flag(manifest, "known"), "paper", "left").join(flag(files, "there"), "paper", "left").join(flag(new, "new"), "paper", "left").join(flag(rebuild, "again"), "paper", "left")
    return x.select(papers["*"], F.when(F.col("again"), "rebuild").when(F.col("new") | F.col("known").isNull(), "new").when(F.col("there").isNull(), "missing").otherwise("reuse").alias("decision"))


def updated(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a new row takes the old one's place."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of every key by time; of equal times the greatest."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("r")).select(key, *[F.col(f"r.{c}") for c in rest])
