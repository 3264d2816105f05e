"""Record sources: JSON lines, concatenated JSON, BioC documents, PubMed and JATS XML, and fetching by id."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PASSAGE = "struct<offset:bigint,infons:map<string,string>,text:string>"
DOCUMENT = f"id string, infons map<string,string>, passages array<{PASSAGE}>"


def jsonl(spark: SparkSession, path: str, schema: StructType | str, tolerant: bool = False) -> DataFrame:
    """JSON lines, plain or gzipped. A bad line fails the job, or is dropped if tolerant."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def paper_index(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers of the rows that have any."""
    rows = jsonl(spark, path, "canonical_id string, pmid string, pmcid string", tolerant=True)
    return rows.where(F.coalesce(*[F.nullif(c, F.lit("")) for c in rows.columns]).isNotNull())


def json_values(raw: str) -> list[Any]:
    """All JSON values of a text: one, one a line, or several that stand side by side or between commas."""
    decoder, at, out = json.JSONDecoder(), 0, []
    while True:
        while at < len(raw) and raw[at] in " \t\r\n,﻿":
            at += 1
        if at >= len(raw):
            return out
        value, at = decoder.raw_decode(raw, at)
        out.append(value)


def bioc_documents(value: Any) -> Iterator[dict]:
    """Every object with a list of passages, wherever it is nested."""
    if isinstance(value, dict):
        passages = value.get("passages", value.get("passage"))
        if isinstance(passages, list):
            yield {"id": str(value.get("id") or ""), "infons": texts(value.get("infons")), "passages": [
                {"offset": p.get("offset"), "infons": texts(p.get("infons")), "text": p.get("text")} for p in passages if isinstance(p, dict)]}
        else:
            for v in value.values():
                yield from bioc_documents(v)
    elif isinstance(value, list):
        for v in value:
            yield from bioc_documents(v)


def texts(infons: Any) -> dict[str, str]:
    return {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in (infons or {}).items() if v is not None} if isinstance(infons, dict) else {}


def bioc(files: DataFrame, raw: str = "value") -> DataFrame:
    """Documents (id, infons, passages) of texts with JSON values in any arrangement."""
    i = files.columns.index(raw)
    kind = pa.schema([("id", pa.string()), ("infons", pa.map_(pa.string(), pa.string())),
                      ("passages", pa.list_(pa.struct([("offset", pa.int64()), ("infons", pa.map_(pa.string(), pa.string())), ("text", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [d for x in b.column(i).to_pylist() if x for v in json_values(x) for d in bioc_documents(v)]
            for r in rows:
                r["infons"] = list(r["infons"].items())
                for p in r["passages"]:
                    p["infons"] = list(p["infons"].items())
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return files.mapInArrow(run, DOCUMENT)


def first_infon(infons: Column, *keys: str) -> Column:
    """The first filled value under one of the keys, upper-cased; UNKNOWN for none."""
    return F.coalesce(*[F.nullif(F.upper(F.trim(F.try_element_at(infons, F.lit(k)))), F.lit("")) for k in keys], F.lit("UNKNOWN"))


def passages(documents: DataFrame) -> DataFrame:
    """One row per passage whose text is not blank, with its section and type."""
    p = documents.select("id", F.posexplode("passages").alias("pos", "p")).where(F.trim(F.coalesce("p.text", F.lit(""))) != "")
    return p.select("id", "pos", "p.text", "p.infons", first_infon(F.col("p.infons"), "section_type", "section").alias("section_type"),
                    F.lower(F.coalesce(F.try_element_at("p.infons", F.lit("type")), F.lit(""))).alias("passage_type"))


#: Types of body passages, sections that hold no body, and those that are passed over (fixed values).
BODY_TYPES = ("paragraph", "paragrpah", "body", "text", "section", "subsection")
FRONT_SECTIONS = ("TITLE", "ABSTRACT", "FRONT", "META")
#: Least passages, characters and characters of unknown sections for a body without labels (fixed values).
LEAST_PASSAGES, LEAST_CHARACTERS, LEAST_UNKNOWN = 3, 1000, 400


def has_body(passages: Column) -> Column:
    """Whether passages (structs section, type, text; blank texts do not count) hold more than title and abstract.

    Outside the front sections a body type or a named section decides. Without one, three passages of 1,000 characters
    do, of which 400 stand in unknown sections under another type than title, abstract or front.
    """
    p = F.filter(passages, lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) != "")
    section = lambda x: F.upper(F.coalesce(x["section"], F.lit("")))
    kind = lambda x: F.lower(F.coalesce(x["type"], F.lit("")))
    outside = F.filter(p, lambda x: ~section(x).isin(*FRONT_SECTIONS))
    body = F.exists(outside, lambda x: kind(x).isin(*BODY_TYPES) | ~section(x).isin("", "UNKNOWN"))
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x["text"]))
    unknown = F.filter(outside, lambda x: (section(x) == "UNKNOWN") & ~kind(x).isin("title", "abstract", "front"))
    return body | ((F.size(p) >= LEAST_PASSAGES) & (size(p) >= LEAST_CHARACTERS) & (size(unknown) >= LEAST_UNKNOWN))


def pubmed(spark: SparkSession, path: str) -> DataFrame:
    """Records of PubMed XML: pmid, doi, pmcid, title, abstract with labelled parts, journal, year."""
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").option("valueTag", "_text").schema(
        "MedlineCitation struct<PMID:struct<_text:string>,Article:struct<ArticleTitle:string,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,"
        "Abstract:struct<AbstractText:array<struct<_Label:string,_text:string>>>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_text:string>>>>").load(path)
    a, ids = F.col("MedlineCitation.Article"), F.col("PubmedData.ArticleIdList.ArticleId")
    known = lambda kind: F.get(F.transform(F.filter(ids, lambda x: x["_IdType"] == kind), lambda x: x["_text"]), F.lit(0))
    part = lambda x: F.concat(F.when(F.coalesce(x["_Label"], F.lit("")) != "", F.concat(x["_Label"], F.lit(": "))).otherwise(""), F.trim(x["_text"]))
    date = a["Journal"]["JournalIssue"]["PubDate"]
    return raw.select(F.col("MedlineCitation.PMID._text").alias("pmid"), known("doi").alias("doi"), known("pmc").alias("pmcid"), a["ArticleTitle"].alias("title"),
                      F.array_join(F.transform(a["Abstract"]["AbstractText"], part), "\n\n").alias("abstract"), a["Journal"]["Title"].alias("journal"),
                      F.coalesce(F.nullif(date["Year"], F.lit("")), F.nullif(F.regexp_extract(date["MedlineDate"], r"\b((?:18|19|20)\d\d)\b", 1), F.lit(""))).alias("pub_year"))


#: Elements whose paragraphs are not the body's (fixed values).
NOT_BODY = frozenset("table-wrap table-wrap-group fig ref-list ack fn-group supplementary-material permissions".split())


def jats_passages(xml: str) -> list[dict] | None:
    """Title, abstract and body paragraphs of an article with their section and running offset; None without a body
    paragraph. Raises ParseError for malformed XML.

    Texts of abstracts count once each, whatever their case; an abstract without paragraphs is one. Paragraphs in
    tables, figures, references and the like are left out. A section is named by the nearest heading above.
    """
    import xml.etree.ElementTree as ET

    name = lambda e: e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""
    text = lambda e: " ".join("".join(e.itertext()).split())
    title, abstracts, body = [], {}, []

    def walk(e, heading: str, where: frozenset) -> None:
        kind = name(e)
        if kind == "article-title" and not title:
            title.append(text(e))
        if kind == "abstract":
            for x in [p for p in e.iter() if name(p) == "p"] or [e]:
                abstracts.setdefault(text(x).casefold(), text(x))
        if kind == "sec":
            heading = next((text(c) for c in e if name(c) == "title"), heading)
        if kind == "p" and "body" in where and not where & NOT_BODY:
            body.append((heading, text(e)))
        for c in e:
            walk(c, heading, where | {kind})

    walk(ET.fromstring(xml), "", frozenset())
    body = [(h, t) for h, t in body if t]
    if not body:
        return None
    out, at = [], 0
    for section, kind, t in [*(("TITLE", "title", t) for t in title), *(("ABSTRACT", "abstract", t) for t in abstracts.values()), *((h or "BODY", "paragraph", t) for h, t in body)]:
        if t:
            out.append({"offset": at, "section": section, "type": kind, "text": t})
            at += len(t) + 2
    return out


def jats(files: DataFrame, raw: str = "value") -> DataFrame:
    """One row per passage of JATS texts: every other column, pos, offset, section, type, text. Articles without a body
    and malformed ones give no rows."""
    import xml.etree.ElementTree as ET

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    i, keep = files.columns.index(raw), [c for c in files.columns if c != raw]
    places = [files.columns.index(c) for c in keep]
    fields = [files.schema[c] for c in keep]
    schema = StructType([*fields, StructField("pos", LongType()), StructField("offset", LongType()), *(StructField(c, StringType()) for c in ("section", "type", "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, x in enumerate(b.column(i).to_pylist()):
                try:
                    found = jats_passages(x) if x else None
                except ET.ParseError:
                    found = None
                for n, p in enumerate(found or []):
                    at.append(k)
                    rows.append((n, p["offset"], p["section"], p["type"], p["text"]))
            took = b.take(pa.array(at, pa.int64()))
            new = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(took.column(k) for k in places), *new], names=[*keep, "pos", "offset", "section", "type", "text"])

    return files.mapInArrow(run, schema)


def fetched(ids: DataFrame, fetch: Callable[[list[str]], dict[str, str]], size: int = 20) -> DataFrame:
    """id, status (found, missing, failed) and payload, asked for in lots by a function given by the caller."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(0).to_pylist()
            for a in range(0, len(wanted), size):
                lot = wanted[a:a + size]
                try:
                    got, status = fetch(lot), "missing"
                except Exception:  # a failed lot is reported, and asked for again by the caller
                    got, status = {}, "failed"
                yield pa.RecordBatch.from_pylist([{"id": i, "status": "found" if i in got else status, "payload": got.get(i)} for i in lot],
                                                 schema=pa.schema([("id", pa.string()), ("status", pa.string()), ("payload", pa.string())]))
    return ids.select("id").mapInArrow(run, "id string, status string, payload string")


def fallback(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The first source that found each id; a denial counts only if every source gave one, else the id is to be retried."""
    out = first.select("id", F.struct("status", "payload", F.lit(1).alias("source")).alias("r1"))
    for n, o in enumerate(others, 2):
        out = out.join(o.select("id", F.struct("status", "payload", F.lit(n).alias("source")).alias(f"r{n}")), "id", "left")
    every = [F.col(f"r{n}") for n in range(1, len(others) + 2)]
    found = F.coalesce(*[F.when(r["status"] == "found", r) for r in every])
    denied = sum((F.when(r["status"] == "missing", 1).otherwise(0) for r in every[1:]), F.when(every[0]["status"] == "missing", 1).otherwise(0))
    return out.select("id", F.when(found.isNotNull(), "downloaded").when(denied == len(every), "not_available").otherwise("pending_retry").alias("status"),
                      found["source"].alias("source"), found["payload"].alias("payload"))
