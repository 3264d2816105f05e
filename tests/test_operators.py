import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import annotations, corpus, ontology, relations, sequences
from lodestone.sources import query_input, records
from lodestone.streaming import windows


def test_non_crossing_keeps_long_and_nested(spark):
    spans = [(0, 10, "cell", "a"), (5, 15, "gene", "b"), (2, 4, "gene", "c"), (0, 10, "gene", "d")]
    df = spark.createDataFrame([(spans,)], "s array<struct<start:int,end:int,type:string,key:string>>")
    got = [tuple(x) for x in df.select(annotations.non_crossing(F.col("s"))).head()[0]]
    assert got == [(0, 10, "cell", "a"), (0, 10, "gene", "d"), (2, 4, "gene", "c")]


def test_rendered_tags_strip_back_to_the_text(spark):
    rng = random.Random(1)
    rows = []
    for n in range(60):
        text = "".join(rng.choice("ab cd😀") for _ in range(20))
        spans = [(s, e, t, f"G{i}") for i, (s, e, t) in enumerate([(0, 20, "gene"), (2, 9, "cell"), (2, 9, "gene"), (4, 6, "gene"), (9, 12, "cell")])]
        rows.append((text, rng.sample(spans, n % 6)))
    df = spark.createDataFrame([*rows, (None, None)], "text string, spans array<struct<start:int,end:int,type:string,tag:string>>")
    for r in annotations.render_tags(df).collect():
        assert re.sub(r"\[/?G\d+\]", "", r.tagged) == (r.text or "")
        stack, at = [], 0
        for close, tag in re.findall(r"\[(/?)(G\d+)\]", r.tagged):
            assert not close or stack.pop() == tag
            stack += [] if close else [tag]
        for s in r.spans or []:
            assert re.sub(r"\[/?G\d+\]", "", r.tagged.split(f"[{s.tag}]")[1].split(f"[/{s.tag}]")[0]) == r.text[s.start:s.end]


def test_clean_triples(spark):
    answer = ('{"triples":[{"subject":"H1","predicate":"Binding","object":"G1","cell_context":["C2","C1","C9"]},{"subject":"G1","predicate":"binding","object":"H1"},'
              '{"subject":"G1","predicate":"activation","object":"C1","cell_context":["C1"]},{"subject":"G1","predicate":"activation","object":"C1"}]}')
    got = spark.range(1).select(relations.clean_triples(F.lit(answer), F.array(*map(F.lit, ("H1", "G1", "C1", "C2"))))).head()[0]
    assert [tuple(x) for x in got] == [("G1", "activation", "C1", []), ("H1", "binding", "G1", ["C1", "C2"])]
    assert spark.range(1).select(relations.clean_triples(F.lit("no json"), F.array(F.lit("H1")))).head()[0] == []


def test_merge_branches_and_candidate_keys(spark):
    a, b = (spark.createDataFrame(r, "k string, v string") for r in ([("1", "x"), ("2", ""), ("3", "z")], [("1", "y"), ("2", "q"), ("4", "")]))
    got = {r.k: r.problem for r in annotations.merge_branches(a, b, "k", ["v"]).collect()}
    assert got == {"1": "v differs", "2": None, "3": "right missing", "4": "left missing"}
    items = spark.createDataFrame([(1, "a", "b"), (2, None, "c"), (3, "x", "b")], "i int, k1 string, k2 string")
    targets = spark.createDataFrame([(10, "a", "b"), (11, "y", "b"), (12, None, "c")], "t int, k1 string, k2 string")
    assert {r.i: r.t for r in annotations.by_candidate_keys(items, targets, "i", "t", ["k1", "k2"]).collect()} == {1: 10, 2: 12, 3: None}


def test_resolve_follows_chains_and_merge_takes_first_and_longest(spark):
    r = spark.createDataFrame([(1, "p1", None, "", "aa"), (2, "p1", "c1", "T", "aaa"), (3, None, "c1", "U", "bbb"), (4, None, None, "V", "")], "s long, pmid string, pmcid string, title string, abstract string")
    done = corpus.resolve(r, "s", [F.col("pmid"), F.col("pmcid")])
    assert {x.s: x.paper for x in done.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    m = {x.paper: x for x in corpus.merge(done, "paper", "s", ["title"], ["abstract"], []).collect()}
    assert (m[1].title, m[1].abstract) == ("T", "aaa")


def test_paths_of_a_diamond(spark):
    p = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "a")], "term string, parent string")
    got = {tuple(r.path) for r in ontology.paths(p, spark.createDataFrame([("a",)], "term string")).collect()}
    assert got == {("a",), ("a", "b"), ("a", "c"), ("a", "b", "d"), ("a", "c", "d")}


def test_label_spans_and_windows(spark):
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate(["B-c", "I-c", "B-c", "O", "I-c", "I-g"])], "g int, i int, tag string")
    got = sorted((r.start, r.end, r.label) for r in sequences.label_spans(t, "g", ["i"], "tag", "i", "i").collect())
    assert got == [(0, 1, "c"), (2, 2, "c"), (4, 4, "c"), (5, 5, "g")]
    w = spark.range(1).select(sequences.token_windows(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("string")), 4, 2)).head()[0]
    assert [x.at for x in w] == [0, 2, 4, 6] and w[-1].tokens == ["6", "7", "8", "9"]


def test_json_values_and_bioc(spark):
    raw = '{"id":1,"passages":[{"offset":0,"infons":{"section_type":"abstract"},"text":"x"},{"text":" "}]}, {"Docs":[{"id":"2","passages":[]}]}\n[]'
    assert len(records.json_values(raw)) == 3
    docs = records.bioc(spark.createDataFrame([(raw,)], "value string"))
    assert {r.id for r in docs.collect()} == {"1", "2"}
    assert [(r.text, r.section_type) for r in records.passages(docs).collect()] == [("x", "ABSTRACT")]


def test_xml_sources(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">7</PMID><Article><ArticleTitle>T</ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate>'
                                    '<MedlineDate>Winter 1998-1999</MedlineDate></PubDate></JournalIssue></Journal><Abstract><AbstractText Label="AIM">a</AbstractText><AbstractText>b</AbstractText></Abstract></Article></MedlineCitation>'
                                    '<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>')
    r = records.pubmed(spark, str(tmp_path / "p.xml")).head()
    assert (r.pmid, r.doi, r.abstract, r.pub_year) == ("7", "10.1/x", "AIM: a\n\nb", "1998")
    jats = "<article><front><article-title>T</article-title><abstract><p>A a</p><p>a A</p></abstract></front><body><sec><title>Intro</title><p>B <i>b</i></p><fig><p>no</p></fig></sec></body></article>"
    assert [(p["offset"], p["section"], p["text"]) for p in records.jats_passages(jats)] == [(0, "TITLE", "T"), (3, "ABSTRACT", "A a"), (8, "Intro", "B b")]
    assert records.jats_passages("<article/>") is None


def test_user_input():
    p = query_input.parse('insulin, "beta cell", not mouse, PMID: 0123, PMC77, insulin, not: rat, not-for-profit, 77 [PMID], pmcid=PMC 8.2, nothing')
    assert (p.keywords, p.exclusions) == (["insulin", "beta cell", "insulin", "not-for-profit", "nothing"], ["mouse", "rat"])
    assert (p.pmids, p.pmcids) == (["123", "77"], ["PMC77", "PMC8"])
    for bad in ("not", "not:", "not PMC1", "not 7", "12345678901", "PMCID: x", "PMCfoo", "PMID x", "***", "0", '"open'):
        with pytest.raises(ValueError):
            query_input.parse(bad)
    new, left_out = query_input.effective(p, {"insulin*"}, {"123"})
    assert (new.keywords, new.pmids, left_out) == (["beta cell", "not-for-profit", "nothing"], ["77"], 3)
    assert query_input.clause("a", new) == '((a) OR "beta cell" OR not-for-profit OR nothing) NOT mouse NOT rat'


def test_covered_keywords():
    assert query_input.atoms('"Beta  Cell" AND insulin*[ti] PMC12 not x') == {"beta cell", "beta", "cell", "insulin*", "x"}
    assert query_input.covered("insulins", {"insulin*"}) and not query_input.covered("ins", {"insulin"})
    assert query_input.covered("ins*", {"insulin"}) and not query_input.covered("insulin resistance", {"insulin*"})
    assert query_input.covered("beta cell", {"beta", "cell"}) and not query_input.covered('"beta cell"', {"beta", "cell"})


def test_body_text(spark):
    long = "x" * 400
    cases = {True: [[("INTRO", "", "a")], [("", "paragraph", "a")], [("UNKNOWN", "x", long)] * 3, [("METHODS", "title", "a")]],
             False: [[], [("TITLE", "title", "a"), ("ABSTRACT", "paragraph", "a")], [("META", "body", long)] * 4, [("UNKNOWN", "front", long)] * 3, [("INTRO", "body", " ")], [("UNKNOWN", "x", "a")] * 3]}
    rows = [(want, ps) for want, lists in cases.items() for ps in lists]
    df = spark.createDataFrame(rows, "want boolean, p array<struct<section:string,type:string,text:string>>")
    assert all(r.got == r.want for r in df.select("want", records.has_body(F.col("p")).alias("got")).collect())


def test_jats_documents(spark):
    article = ("<article><front><article-title>T</article-title><abstract>whole</abstract><abstract><p>A</p><p>a</p></abstract></front><body><p>one</p><table-wrap-group><p>no</p></table-wrap-group>"
               "<fig><caption><p>no</p></caption></fig><boxed-text><caption><p>yes</p></caption></boxed-text></body><sub-article><body><sec><title>M</title><sec><p>two</p></sec></sec></body></sub-article></article>")
    df = spark.createDataFrame([("k", article), ("bad", "<a>"), ("none", "<article><body/></article>"), ("null", None)], "id string, value string")
    got = [(r.id, r.pos, r.offset, r.section, r.text) for r in records.jats(df).orderBy("pos").collect()]
    assert got == [("k", 0, 0, "TITLE", "T"), ("k", 1, 3, "ABSTRACT", "whole"), ("k", 2, 10, "ABSTRACT", "A"), ("k", 3, 13, "BODY", "one"), ("k", 4, 18, "BODY", "yes"), ("k", 5, 23, "M", "two")]


def test_fetch_fallback(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")

    def broken(lot):
        raise OSError

    one, two, three = records.fetched(ids, lambda lot: {"a": "A"}), records.fetched(ids, lambda lot: {"b": "B"}), records.fetched(ids, broken)
    assert {r.id: (r.status, r.source) for r in records.fallback(one, two).collect()} == {"a": ("downloaded", 1), "b": ("downloaded", 2), "c": ("not_available", None)}
    assert {r.id: r.status for r in records.fallback(one, three).collect()} == {"a": "downloaded", "b": "pending_retry", "c": "pending_retry"}


def test_incremental_run_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    for part in ([(1, "a")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(part, "i long, x string").coalesce(1).write.mode("append").parquet(src)
        windows.run_once(spark, src, "i long, x string", lambda df: df.withColumn("y", F.upper("x")), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = windows.results(spark, str(tmp_path / "out"))
    assert sorted((r.i, r.y) for r in got.collect()) == [(1, "A"), (2, "B"), (3, "C")]
    assert windows.pending(spark.range(5).withColumnRenamed("id", "i"), got, "i").count() == 2
