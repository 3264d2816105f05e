import json

import pytest
from pyspark.sql import functions as F

from lodestone import engine
from lodestone.operators import annotating, corpus, linking, models, normalizing, projections
from lodestone.sources import artifacts, bundles, client
from lodestone.streaming import journal


def test_components_and_resolution(spark):
    rounds = []
    links = spark.range(300).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    assert linking.components(links, rounds).select(F.max("component"), F.count("*")).head() == (0, 301) and sum(rounds) <= 12
    rows = [(1, "a", None), (2, "a", "p"), (3, None, "p"), (4, "", ""), (5, "z", None)] + [(10 + i, f"k{i}", f"k{i + 1}") for i in range(30)]
    df = spark.createDataFrame(rows, "seq long, doi string, pmid string")
    got = {r.seq: r.paper for r in corpus.resolve(df, "seq", [F.col("doi"), F.col("pmid")]).collect()}
    assert (got[1], got[2], got[3], got[4], got[5]) == (1, 1, 1, 4, 5) and got[20] == 20


def test_long_forms_and_routes(spark):
    forms = spark.createDataFrame([("d", "T reg", "regulatory T"), ("d", "ABCDE1", "alphas"), ("e", "NKs", "natural killers")], "document_key string, short_form string, long_form string")
    wanted = spark.createDataFrame([("d", "Treg"), ("d", "Tregs"), ("d", "ABCDE1x"), ("d", "zzz"), ("e", "NK"), ("e", "NKx")], "document_key string, key string")
    got = {(r.document_key, r.key): (r.long_form, r.method) for r in normalizing.long_forms(wanted, forms).collect()}
    assert got == {("d", "Treg"): ("regulatory T", "exact_key"), ("d", "Tregs"): ("regulatory T", "exact_variant"), ("d", "ABCDE1x"): ("alphas", "fuzzy_key"), ("e", "NK"): ("natural killers", "exact_variant")} or \
        got == {("d", "Treg"): ("regulatory T", "exact_key"), ("d", "Tregs"): ("regulatory T", "exact_variant"), ("e", "NK"): ("natural killers", "exact_variant")}
    known = normalizing.lookup(spark.createDataFrame([("Tregs", "CL:1"), ("NK", "CL:2,CL:3")], "short_form string, matched_id string"))
    asked = spark.createDataFrame([("d", "treg", "Treg"), ("e", "nk", "NK"), ("d", "nk", "NK"), ("d", "long name", "long name"), ("d", "abcdef", "ABCDEF")], "document_key string, normalized_text string, mention string")
    got = {(r.document_key, r.mention): (r.route, r.query, r.identifier) for r in normalizing.routed(asked, known, forms).collect()}
    assert got == {("d", "Treg"): ("direct", None, "CL:1"), ("e", "NK"): ("ambiguous", "natural killer", None), ("d", "NK"): ("encoder", "nk", None),
                   ("d", "long name"): ("encoder", "long name", None), ("d", "ABCDEF"): ("fuzzy", "ABCDEF", None)}


def test_two_passes_cover_what_is_left(spark):
    chunks = spark.createDataFrame([("p", 1, "TITLE", "a title of cells"), ("p", 2, "ABSTRACT", "what was done"), ("p", 3, "BODY", "long body of the text"), ("q", 1, "TITLE", "t")],
                                   "paper string, chunk_id int, section string, chunk string")
    kind = "paper string, pos int, section string, text string"
    full = spark.createDataFrame([("p", 0, "TITLE", "a title of cells"), ("p", 1, "BODY", "long body of the texts")], kind)
    abstracts = spark.createDataFrame([("p", 0, "TITLE", "a title of cells"), ("p", 1, "ABSTRACT", "what was done"), ("q", 0, "TITLE", "t"), ("r", 0, "TITLE", "t")], kind)
    got = sorted((r.paper, r.chunk_id, r.source) for r in annotating.two_passes(chunks, full, abstracts).collect())
    assert got == [("p", 1, "full text"), ("p", 2, "abstract"), ("p", 3, "full text"), ("q", 1, "abstract")]


def test_annotation_rows_of_passages(spark):
    schema = "paper string, pos int, text string, offset long, annotations array<struct<type:string,identifier:string,text:string,locations:array<struct<offset:long,length:int>>>>"
    rows = [("p", 0, "x", 100, [("Gene", "12;9606:13", "ab", [(101, 2), (101, 2), (90, 2)]), ("Chemical", "MESH:D001", "c", [(105, 1)]), ("Species", "1", "s", [(100, 1)]), ("Gene", "-", "n", [(100, 1)])])]
    got = sorted((r.kind, r.concept_id, r.start, r.end) for r in annotating.annotation_rows(spark.createDataFrame(rows, schema)).collect())
    assert got == [("chemical", "D001", 5, 6), ("gene", "12", 1, 3), ("gene", "13", 1, 3)]


def test_documents_find_their_request(spark):
    docs = spark.createDataFrame([("PMC1", None, "a"), (None, "7", "b"), (None, None, "c")], "pmcid string, pmid string, name string")
    by = spark.createDataFrame([("7", "PMC2")], "pmid string, pmcid string")
    ask = lambda ids: {r.name: r.requested_id for r in annotating.to_requested(docs, spark.createDataFrame([(i,) for i in ids], "id string"), ["pmcid", "pmid"], by).collect()}
    assert ask(["PMC1", "PMC2"]) == {"a": "PMC1", "b": "PMC2", "c": None} and ask(["PMC1"]) == {"a": "PMC1", "b": "PMC1", "c": "PMC1"}


def test_compact_annotations(spark):
    kind = "a struct<entity_type:string,start:int,end:int,mention:string,gene_id:string,chemical_id:string,cell_ontology_id:string,tax_id:string>"
    df = spark.createDataFrame([(("Gene", 1, 3, "x", "7", None, "CL:1", ""),), (("hormone", 1, 3, None, None, "D1", None, "9"),), (("species", 1, 3, "x", None, None, None, None),)], kind)
    has = df.schema["a"].dataType.fieldNames()
    got = [r.e for r in df.select(projections.compact_entity(F.col("a"), has).alias("e")).collect()]
    assert (got[0].obj, got[0].gene_id, got[0].tax_id, got[0].hormone_id) == ("gene", "7", None, None)
    assert (got[1].mention, got[1].hormone_id, got[1].chemical_id, got[1].source_entity_type, got[1].tax_id) == ("", "D1", "D1", "Chemical", None) and got[2] is None
    assert df.select(projections.compact_cell(F.col("a"), has).alias("c")).head().c.concept_id == "CL:1"


def test_bundles_split_by_paper(spark, tmp_path):
    parts = [spark.createDataFrame([(1, "p"), (0, "p")], "seq long, paper_id string"), spark.createDataFrame([(3, "q"), (25_000, "q")], "seq long, paper_id string")]
    lines = bundles.bundle(parts)
    assert [(r.paper_id, r.seq) for r in lines.orderBy("line").collect()] == [("p", 0), ("p", 1), ("q", 3), ("q", 25_000)]
    bundles.split(lines, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).groupBy("paper_id").count().count() == 2
    with pytest.raises(ValueError):
        bundles.split(lines.withColumn("paper_id", F.when(F.col("line") == 3, "p").otherwise(F.col("paper_id"))), str(tmp_path / "no"))


def test_asking_again():
    waits, answers = [], [client.Refused(503), client.Refused(429, 7.0), "ok"]

    def call():
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert client.ask(call, sleep=waits.append) == "ok" and waits == [1.0, 7.0]
    with pytest.raises(client.Refused):
        answers[:] = [client.Refused(400)]
        client.ask(call, sleep=waits.append)
    answers[:] = [client.Refused(404)]
    assert client.ask(call, accepted=frozenset({404})) is None
    assert [client.backoff(n) for n in (1, 2, 3, 10)] == [1, 2, 4, 60]


def test_lookups_survive_failed_lots():
    asked = []

    def fetch(lot):
        asked.append(lot)
        if "c" in lot or "e" in lot:
            raise OSError
        return {i: i.upper() for i in [*lot, "other"] if i != "b"}

    assert client.looked_up(list("abcdef"), fetch, 2) == ({"a": "A"}, ["b", "c", "d", "e", "f"])
    asked.clear()
    client.looked_up(list("cdefab"), fetch, 2, client.Breaker(2))
    assert asked == [["c", "d"], ["e", "f"]]


def test_pace_and_progress():
    now, slept = [0.0], []
    pace = client.Pace(2.0, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    pace()
    now[0] = 0.5
    pace()
    assert slept == [1.5] and client.fraction(1, 0) == 0 and client.fraction(5, 4) == 1 and client.scaled(0.5, 10, 20) == 15


def test_usage_of_answers(spark):
    raw = [json.dumps({"usage": {"input_tokens": 9, "output_tokens": 2, "input_tokens_details": {"cached_tokens": 4}}}), "{}", "no json", None]
    got = [tuple(r.u) for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").orderBy("i").select(annotating.usage_of(F.col("x")).alias("u")).collect()]
    assert got == [(9, 4, 2), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_recognised_spans(spark):
    def model(windows):
        return [[[0, 2, 0] if t == "beta" else [0, 0, 2] if t == "cells" else [1, 0, 0] for t in w] for w in windows]

    df = spark.createDataFrame([(1, "The beta cells, and beta beta cells."), (2, ""), (3, "x " * 40 + "beta cells")], "id long, text string")
    got = sorted((r.id, r.start, r.mention, r.label) for r in models.recognise(df, "id", "text", model, ["O", "B-cell", "I-cell"], 8, 3).collect())
    assert got == [(1, 4, "beta cells", "cell"), (1, 20, "beta", "cell"), (1, 25, "beta cells", "cell"), (3, 80, "beta cells", "cell")]


def test_names_are_encoded_once(spark):
    cache = spark.createDataFrame([("a", [1.0])], "name string, vector array<double>")
    names = spark.createDataFrame([("a",), ("bb",), ("bb",), (None,)], "name string")
    every, new = models.encoded(names, cache, lambda xs: [[float(len(x))] for x in xs])
    assert {r.name: r.vector for r in every.collect()} == {"a": [1.0], "bb": [2.0]} and [r.name for r in new.collect()] == ["bb"]


def test_journal_replays_and_goes_on(spark, tmp_path):
    lines = ['{"id": "a", "attempt": 1, "ok": false, "input_tokens": 5}', '{"id": "a", "attempt": 2, "ok": true, "payload": "x", "input_tokens": 6}', '{"id": "b", "attempt": 1, "ok": false}', '{"id": "c", "att']
    (tmp_path / "j.jsonl").write_text("\n".join(lines))
    j = journal.read(spark, str(tmp_path / "j.jsonl"))
    state = {r.id: (r.attempts, r.done, r.payload, r.input_tokens) for r in journal.replay(j).collect()}
    assert state == {"a": (2, True, "x", 11), "b": (1, False, None, 0)}
    todo = journal.remaining(spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "bad")], "id string, text string"), j)
    assert {r.id: r.attempt for r in todo.collect()} == {"b": 2, "c": 1}

    def call(t):
        if t == "bad":
            raise ValueError(t)
        return t.upper()

    assert {r.id: (r.ok, r.payload) for r in journal.answered(todo, "text", call).collect()} == {"b": (True, "T"), "c": (False, "bad")}
    done, owed = journal.complete(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("b",), ("c",)], "id string"), "id")
    assert [r.id for r in done.collect()] == ["b"] and {r.id: r.owed for r in owed.collect()} == {"a": "right", "c": "left"}


def test_artifacts_are_checked(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    d = artifacts.digest(spark, str(tmp_path / "a.jsonl"))
    assert artifacts.verified(spark, str(tmp_path / "a.jsonl"), d) and artifacts.rows_in(spark, str(tmp_path / "a.jsonl")) == 2
    with pytest.raises(ValueError):
        artifacts.verified(spark, str(tmp_path / "a.jsonl"), "0")
    assert artifacts.gzipped(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "z")) == 2 == artifacts.gzipped(spark, str(tmp_path / "gone"), str(tmp_path / "z"))
    root = "/r"
    papers = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "paper string")
    manifest = spark.createDataFrame([("1", "/r/x"), ("2", "/etc/x"), ("3", "/r/../x")], "paper string, path string")
    files = spark.createDataFrame([("/r/x",), ("/r/1.bioc.json",), ("/etc/x",), ("/r/2.bioc.json.gz",), ("/r/../x",)], "path string")
    assert {r.paper: r.path for r in artifacts.cached_paths(papers, manifest, files, root).collect()} == {"1": "/r/x", "2": "/r/2.bioc.json.gz", "3": None, "4": None}


def test_terms_in_view(spark):
    nodes = spark.createDataFrame([("C-1", "cell", "N1", "b"), ("C-2", "cell", "N1", "a"), ("G-1", "gene", "g", "g")], "id string, entity_type string, normalized_id string, label string")
    edges = spark.createDataFrame([("e", "C-1", "G-1", 2, 2)], "id string, subject_id string, object_id string, paper_count long, evidence_count long")
    of = spark.createDataFrame([("N1", "C-1"), ("N2", None)], "term string, id string")
    kind, found = engine.term_view("N1", of, nodes, edges)
    assert kind == "graph" and found.count() == 1 and engine.term_view("N2", of, nodes, edges) == ("ontology", None)
    assert [(r.term, r.id) for r in engine.visible_terms(nodes).collect()] == [("N1", "C-2")]
    assert engine.evidence_filter(nodes, " B ", ["label", "id"]).count() == 1 and engine.evidence_filter(nodes, "", ["label"]).count() == 3
