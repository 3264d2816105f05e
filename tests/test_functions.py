import hashlib
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestone.functions import ids, similarity, text
from lodestone.plans import table_queries
from lodestone.sources import html


def values(spark, f, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


@pytest.mark.parametrize("f,cases", [
    (text.clean_text, {None: "", "a\r\nb\rc \n d e\x85f\x00": "a\nb\nc\n d\ne\nf", " x ": "x"}),
    (text.sanitize_chunk, {"a|b  c­d\x00": "a b c d", None: ""}),
    (text.squeeze, {" a \t b ": "a b"}),
    (text.singular, {"cells": "cell", "viruses": "virus", "bodies": "body", "classes": "class", "houses": "house", "virus": "virus", "mass": "mass", "movies": "movy", "shoes": "shoe", "cell": "cell"}),
    (text.abbreviation_key, {"T-reg– x": "Tregx"}),
    (ids.pmid, {"PMID: 00123": "123", "0": None, "1234567890": None, "none": None}),
    (ids.pmcid, {"PMC123": "PMC123", "12.1": "PMC12", "x": None, "PMC:123": None, "see pmc 7": "PMC7", "PMCID: 9": "PMC9", "9 x": None}),
    (text.looks_abbreviated, {"alpha/beta long name here": True, "-a": False, "abc\u2010def\u2010ghi\u2010jk": True, "a b": False, "X cell": True}),
    (text.abbreviation_variants, {"s": ["s"], "T-regs": ["Tregs", "Treg"]}),
    (text.strict_pmcid, {"a pmc 12 b": "PMC12", "xPMC12": None, "12": None}),
    (text.service_type, {"Gene/Protein": "gene", "drug": "chemical", "species": None}),
    (html.plain, {"caf&#233; &mdash; &#x1F600;<b>x</b>&amp;lt; &#xD800;": "café \u2014 😀 x &lt; &#xD800;", None: ""}),
    (ids.doi, {"https://doi.org/10.1/X": "10.1/x", "doi:10.2": "10.2", "": None}),
    (ids.tax_id, {"09606": "9606", "0": "", "x": ""}),
    (ids.cell_ontology_id, {"CL_0000001": "CL:0000001", "XCL:0000001": None}),
    (text.section_label, {"Materials and Methods": "METHODS", "Anything": "BODY"}),
])
def test_scalars(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_occurrences_and_nearest(spark):
    r = spark.sql("select 'aAaa' t").select(text.occurrences(F.col("t"), F.lit("aa")).alias("a"), text.occurrences(F.col("t"), F.lit("AAA")).alias("b"),
                                            text.nearest(F.array(F.lit(1), F.lit(5)), F.lit(3)).alias("n")).head()
    assert (r.a, r.b, r.n) == ([2], [0, 1], 1)


def test_text_queries_read_whole_documents(spark, tmp_path):
    """Long, repeated, null and empty texts of documents, against brute force."""
    long = "The cells, é😀 thethe Que classes 中文 bodies_viruses " * 2500
    texts = [long, long, None, "", "IDIOT x", "und " * 3000 + "houses", "😀the"]
    spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: [tuple(r) for r in table_queries.QUERIES[name](spark, str(tmp_path)).collect()]
    want = []
    for i, t in enumerate(texts):
        for term in table_queries.DICTIONARY:
            at = next((p for p in ([m.start() for m in re.finditer(f"(?={term})", x)] for x in (t or "", (t or "").lower())) if p), [])
            if at:
                want.append((i, term, len(at), min(at, key=lambda p: (abs(p - 50), p))))
    assert sorted(run("text_occurrences_documents")) == sorted(want)
    words = {w for t in texts for w in re.findall(r"[^\W_]+|[^\w\s]|_", t or "") if re.fullmatch("[a-zA-Z]+", w)}
    got = dict(run("text_singularize_documents"))
    assert set(got) == words and (got["bodies"], got["classes"], got["viruses"]) == ("body", "class", "virus")
    atoms = {}
    for i, t in enumerate(texts):
        if t is not None:
            low = f'"{t.lower().split(" ")[0]} x" and {t.lower()}'
            found = {p.strip() for p in re.findall('"([^"]+)"', low)} | {w for w in re.findall(r"[a-z][a-z0-9_-]*\*?", low) if w not in ("and", "or", "not")}
            atoms[i] = (len(found), "|".join(sorted(found)))
    assert {i: (n, x) for i, n, x in run("text_keyword_atoms_documents")} == atoms


def test_node_and_edge_ids(spark):
    e = spark.sql("select named_struct('obj', 'Protein', 'gene_id', ' 101 ', 'mention', 'm') e")
    who = ids.node_identity(F.col("e"), ["obj", "gene_id", "mention"])
    r = e.select(ids.node_id(who["type"], who["field"], who["identity"]).alias("n")).head()
    assert r.n == "G-" + hashlib.sha256(b"gene\x1fgene_id\x1f101").hexdigest()[:24]


def test_keep_passage(spark):
    rows = [("ABSTRACT", "paragraph", True), ("METHODS", "paragraph", False), ("TITLE", "front", True), ("INTRO", "fig_caption", False), ("", "", True), ("RESULTS", "title", False)]
    df = spark.createDataFrame(rows, "s string, t string, k boolean").select(text.keep_passage(F.col("s"), F.col("t")).alias("got"), "k")
    assert all(r.got == r.k for r in df.collect())


def test_ratio_and_gates(spark):
    df = spark.createDataFrame([("alpha beta", "alpha bete"), ("abc", "abc"), ("a", "abcdef")], "a string, b string")
    got = [tuple(r) for r in df.select(similarity.plain_ratio("a", "b"), similarity.passage_gate(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (SequenceMatcher(None, "alpha beta", "alpha bete", autojunk=False).ratio(), None)
    assert got[1][1] == 1.0 and got[2][1] == 0.0
