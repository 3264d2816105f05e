"""Queries over text, events, vectors and pages for the operators outside the graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import ids, similarity, text
from lodestone.operators import annotations, corpus, matching, ontology, relations, sequences, vectors
from lodestone.plans.star import table
from lodestone.sources import html, query_input

QUERIES: dict = {}
ORACLE_SQL: dict = {}
WORDS = r"[^\s]+"
#: Dictionary of mentions that are looked for in texts.
DICTIONARY = ("the", "que", "und", "idiot")
NOW = "2024-01-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


SQUEEZED = r"trim(regexp_replace(regexp_replace({x}, '[|\x{{FFFD}}\p{{C}}]', ' ', 'g'), '[\pZ\s]+', ' ', 'g'))"


@query(f"SELECT doc_id, {SQUEEZED.format(x='text')} AS clean FROM documents")
def text_sanitize(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sanitize_chunk(F.col("text")).alias("clean"))


@query(rf"""WITH l AS (SELECT doc_id, i, {SQUEEZED.format(x='line')} AS chunk FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
SELECT CAST(doc_id AS VARCHAR) AS doc_key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS chunk_id,
  md5(doc_id || '::' || row_number() OVER (PARTITION BY doc_id ORDER BY i)) AS base, chunk FROM l WHERE chunk <> ''""")
def text_chunks(spark, d):
    return corpus.chunks(table(spark, d, "documents"), F.col("doc_id").cast("string"))


@query("""SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN false WHEN lang = 'en' THEN true ELSE false END AS kept FROM documents""")
def text_passage_filter(spark, d):
    section = F.when(F.col("source") == "src1", "METHODS").when(F.col("source") == "src2", "Author notes").when(F.col("lang") == "en", "ABSTRACT").otherwise("RESULTS")
    kind = F.when(F.col("lang") == "en", "paragraph").otherwise("ref_entry")
    return table(spark, d, "documents").select("doc_id", text.keep_passage(section, kind).alias("kept"))


@query()
def text_paragraphs_html(spark, d):
    return html.paragraphs(table(spark, d, "pages").select("page_id", "html"))


@query(r"""SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 200) AS doc_key,
  substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 64) || '-' || substr(sha256(url), 1, 12) AS file FROM pages""")
def text_doc_key(spark, d):
    none = F.lit(None).cast("string")
    return table(spark, d, "pages").select("page_id", text.doc_key(none, none, F.col("url")).alias("doc_key"), text.safe_name(F.col("url")).alias("file"))


@query(r"""WITH q AS (SELECT item_id, '"' || list_extract(string_split(lower(text), ' '), 1) || ' x" AND ' || regexp_replace(text, '[\pZ\s]+', ' ', 'g') AS q FROM benchmark),
z AS (SELECT item_id, regexp_replace(regexp_replace(lower(regexp_replace(q, '[\pZ\s]+', ' ', 'g')), '(pmcid ?[:=]? ?)?pmc ?[0-9]+(\.[0-9]+)?', ' ', 'g'), '\[[^\]]+\]', ' ', 'g') AS q FROM q),
w AS (SELECT item_id, unnest(list_distinct(list_concat(list_transform(regexp_extract_all(q, '"([^"]+)"', 1), lambda p: trim(p)), list_filter(regexp_extract_all(q, '([a-z][a-z0-9_-]*\*?)', 1), lambda x: x NOT IN ('and', 'or', 'not'))))) AS atom FROM z)
SELECT item_id, count(*) AS atoms, string_agg(atom, '|' ORDER BY atom) AS list FROM w GROUP BY 1""")
def text_keyword_atoms(spark, d):
    return _keyword_atoms(table(spark, d, "benchmark"), "item_id")


@query()
def text_keyword_atoms_documents(spark, d):
    return _keyword_atoms(table(spark, d, "documents").where(F.col("text").isNotNull()), "doc_id")


def _keyword_atoms(x: DataFrame, key: str) -> DataFrame:
    q = F.concat(F.lit('"'), F.get(F.split(F.lower("text"), " "), F.lit(0)), F.lit(' x" AND '), text.squeeze(F.col("text")))
    atoms = F.array_sort(text.keyword_atoms(q))
    return x.select(key, F.size(atoms).cast("long").alias("atoms"), F.array_join(atoms, "|").alias("list"))


@query(r"""SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(text), 'que')) AND NOT contains(lower(text), 'idiot')""")
def text_boolean_search(spark, d):
    said = query_input.parse("the, que, not idiot")
    return table(spark, d, "documents").where(text.boolean_match(F.col("text"), said.keywords, said.exclusions)).select("doc_id")


@query(r"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(text, '([\p{L}\p{N}\p{M}]+|[^\w\s]|_)')) AS w FROM benchmark),
u AS (SELECT DISTINCT w FROM t WHERE regexp_full_match(w, '[a-zA-Z]+'))
SELECT w, CASE WHEN NOT ends_with(w, 's') THEN w WHEN ends_with(w, 'viruses') THEN w[:-3]
  WHEN ends_with(w, 'ies') AND NOT ends_with(w, 'eies') AND NOT ends_with(w, 'aies') THEN w[:-4] || 'y'
  WHEN ends_with(w, 'es') AND NOT ends_with(w, 'aes') AND NOT ends_with(w, 'ees') AND NOT ends_with(w, 'oes') THEN CASE WHEN ends_with(w, 'sses') THEN w[:-3] ELSE w[:-2] END
  WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w ELSE w[:-2] END AS singular FROM u""")
def text_singularize(spark, d):
    return _singular_words(table(spark, d, "benchmark"))


@query()
def text_singularize_documents(spark, d):
    return _singular_words(table(spark, d, "documents"))


def _singular_words(x: DataFrame) -> DataFrame:
    w = x.select(F.explode(text.split_tokens(F.col("text"))).alias("w")).where(F.col("w").rlike("^[a-zA-Z]+$")).distinct()
    return w.select("w", text.singular(F.col("w")).alias("singular"))


@query(r"""WITH t(term) AS (VALUES ('the'), ('que'), ('und'), ('idiot')), b AS (SELECT item_id, text, term FROM benchmark, t),
p AS (SELECT item_id, term, text, unnest(range(1, length(text) - length(term) + 2)) AS i FROM b),
h AS (SELECT item_id, term, i - 1 AS place FROM p WHERE substr(text, i, length(term)) = term),
l AS (SELECT item_id, term, i - 1 AS place FROM p WHERE substr(lower(text), i, length(term)) = term AND (item_id, term) NOT IN (SELECT (item_id, term) FROM h)),
a AS (FROM h UNION ALL FROM l)
SELECT item_id, term, count(*) AS places, CAST(arg_min(place, abs(place - 50) * 100000 + place) AS INTEGER) AS nearest FROM a GROUP BY 1, 2""")
def text_occurrences(spark, d):
    return _term_places(table(spark, d, "benchmark"), "item_id")


@query()
def text_occurrences_documents(spark, d):
    return _term_places(table(spark, d, "documents"), "doc_id")


def _term_places(x: DataFrame, key: str) -> DataFrame:
    x = x.select(key, "text", F.explode(F.array(*[F.lit(t) for t in DICTIONARY])).alias("term"))
    x = x.select(key, "term", text.occurrences(F.col("text"), F.col("term")).alias("at")).where(F.size("at") > 0)
    return x.select(key, "term", F.size("at").cast("long").alias("places"), text.nearest(F.col("at"), F.lit(50)).alias("nearest"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract(text, '(\d+)', 1) AS x, regexp_extract(upper(text), 'PMC\s*([0-9]+)', 1) AS c FROM documents)
SELECT doc_id, CASE WHEN length(ltrim(x, '0')) BETWEEN 1 AND 9 THEN ltrim(x, '0') END AS pmid, CASE WHEN c <> '' THEN 'PMC' || c END AS pmcid,
  lower(substr(md5(doc_id || '::1'), 1, 8)) AS short FROM m WHERE x <> ''""")
def text_ids(spark, d):
    x = table(spark, d, "documents").where(F.col("text").rlike(r"\d"))
    return x.select("doc_id", ids.pmid(F.col("text")).alias("pmid"), ids.pmcid(F.col("text")).alias("pmcid"),
                    F.substring(ids.chunk_base(F.col("doc_id").cast("string"), F.lit(1)), 1, 8).alias("short"))


@query(r"SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS whole FROM conversations GROUP BY 1")
def text_concat_by_doc(spark, d):
    return corpus.joined_text(table(spark, d, "conversations"), "conv_id", ["turn", "role"], "text").withColumnRenamed("joined", "whole")


@query(r"""SELECT md5(text) AS text_key, min(doc_id) AS first, count(*) AS copies, arg_min(source, doc_id) AS source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1""")
def corpus_exact_dups(spark, d):
    x = table(spark, d, "documents").select(F.md5("text").alias("text_key"), "doc_id", "source", F.array("lang").alias("lang"))
    counts = x.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    m = corpus.merge(x, "text_key", "doc_id", ["source"], [], ["lang"])
    return m.join(counts, "text_key").select("text_key", "first", "copies", "source", F.array_join("lang", ",").alias("langs"))


@query("""SELECT doc_id, source FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND source NOT IN ('src0', 'src3')""")
def corpus_anti_baseline(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit(None).cast("string").alias("source"))
    known = spark.createDataFrame([("src0",), ("src3",)], "source string").select(F.lit(None).cast("long").alias("doc_id"), "source")
    return corpus.added(table(spark, d, "documents").select("doc_id", "source"), good.unionByName(known), ["doc_id", "source"])


@query(r"""WITH RECURSIVE k AS (SELECT doc_id, 'a' || md5(lower(trim(regexp_replace(text, '[\pZ\s]+', ' ', 'g')))) AS key FROM documents
  UNION ALL SELECT doc_id, 'b' || source || '/' || n_chars FROM documents WHERE source IS NOT NULL),
f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY 1),
e AS (SELECT DISTINCT doc_id AS x, first AS y FROM k JOIN f USING (key) WHERE doc_id <> first),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.seen = b.x)
SELECT doc_id, min(seen) AS paper FROM r GROUP BY 1""")
def corpus_components(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.md5(text.norm(F.col("text"))).alias("a"), F.concat("source", F.lit("/"), F.col("n_chars").cast("string")).alias("b"))
    return corpus.resolve(x, "doc_id", [F.col("a"), F.col("b")]).select("doc_id", "paper")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'left missing' WHEN l.doc_id IS NULL THEN 'right missing'
  WHEN d.flag <> l.flag THEN 'flag differs' END AS problem FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN '0' ELSE '' END AS flag FROM documents) d
  FULL JOIN (SELECT doc_id, CAST(toxic AS VARCHAR) AS flag FROM labels) l ON d.doc_id = l.doc_id
  WHERE true""".replace("d.flag <> l.flag", "d.flag <> '' AND d.flag <> l.flag"))
def annot_align_merge(spark, d):
    left = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "0").otherwise("").alias("flag"))
    right = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("string").alias("flag"))
    return annotations.merge_branches(left, right, "doc_id", ["flag"]).select("doc_id", "problem")


@query("""WITH o AS (SELECT o_orderkey AS t, [CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderdate AS DATE), CAST(o_custkey AS VARCHAR)] AS k FROM orders),
e AS (SELECT event_id AS i, [CAST(user_id AS VARCHAR) || '/' || CAST(ts AS DATE), CAST(user_id AS VARCHAR)] AS k FROM events),
u AS (SELECT p, key, min(t) AS t FROM (SELECT t, unnest(k) AS key, generate_subscripts(k, 1) AS p FROM o) GROUP BY 1, 2 HAVING count(DISTINCT t) = 1),
m AS (SELECT i, unnest(k) AS key, generate_subscripts(k, 1) AS p FROM e)
SELECT i AS event_id, coalesce((SELECT arg_min(u.t, u.p) FROM m x JOIN u ON u.p = x.p AND u.key = x.key WHERE x.i = e.i), -1) AS o_orderkey FROM e""")
def annot_candidate_keys(spark, d):
    day = lambda who, when: F.concat_ws("/", F.col(who).cast("string"), F.to_date(when).cast("string")).alias("a")
    orders = table(spark, d, "orders").select("o_orderkey", day("o_custkey", "o_orderdate"), F.col("o_custkey").cast("string").alias("b"))
    events = table(spark, d, "events").select("event_id", day("user_id", "ts"), F.col("user_id").cast("string").alias("b"))
    return annotations.by_candidate_keys(events, orders, "event_id", "o_orderkey", ["a", "b"]).withColumn("o_orderkey", F.coalesce("o_orderkey", F.lit(-1)))


@query("""SELECT CASE WHEN p_size IS NULL THEN 'unresolved' WHEN p_size > 25 THEN 'human' ELSE 'other' END AS kept, count(*) AS genes
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY 1""")
def annot_lookup_filter(spark, d):
    known = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("gene_id"), F.when(F.col("p_size") > 25, matching.HUMAN).otherwise("10090").alias("tax_id"))
    found = matching.human_genes(table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("gene_id")), known)
    return found.groupBy("kept").agg(F.count(F.lit(1)).alias("genes"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'true' WHEN bool_or(o_orderstatus = 'F') THEN 'true' WHEN bool_and(o_orderstatus <> 'P') THEN 'false' ELSE 'unknown' END AS positive FROM orders GROUP BY 1""")
def annot_three_valued(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.bool_or(F.col("o_orderstatus") == "F").alias("b"), F.every(F.col("o_orderstatus") != "P").alias("c"))
    return g.select("o_custkey", F.coalesce(annotations.three_valued(F.col("a"), F.col("b"), F.col("c")).cast("string"), F.lit("unknown")).alias("positive"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.v, v.v), 5) + 0.0 AS score FROM v q, v WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""")
def vec_topk(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return vectors.top_cosine(v, q, 20).select("query_id", "vec_id", "score", "rank")


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(q.v, v.v), 5) + 0.0 AS score FROM v q, v WHERE q.vec_id % 100 = 0),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 50)
SELECT query_id, label, max(score) AS score, arg_min(vec_id, -score * 1e9 + vec_id / 1e6) AS vec_id FROM t GROUP BY 1, 2""")
def vec_best_per_label(spark, d):
    e = table(spark, d, "embeddings")
    v = e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    top = vectors.top_cosine(v, q, 50).join(e.select("vec_id", "label"), "vec_id")
    return vectors.best_per_concept(top, "query_id", "label", "score", "vec_id")


@query(r"""WITH w AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\pZ\s]+'), lambda x: x <> ''))) AS w FROM benchmark),
v AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\pZ\s]+'), lambda x: x <> ''))) AS w FROM documents),
n AS (SELECT item_id, count(*) AS n FROM w GROUP BY 1), m AS (SELECT doc_id, count(*) AS m FROM v GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS c FROM v JOIN w USING (w) GROUP BY 1, 2),
j AS (SELECT doc_id, item_id, CAST(c AS DOUBLE) / (n + m - c) AS j FROM c JOIN n USING (item_id) JOIN m USING (doc_id))
SELECT doc_id, item_id, round(j, 6) AS jaccard FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, item_id) = 1""")
def sim_jaccard(spark, d):
    items = table(spark, d, "benchmark").select("item_id", similarity.word_set(F.col("text")).alias("words"))
    docs = table(spark, d, "documents").select("doc_id", similarity.word_set(F.col("text")).alias("words"))
    return corpus.most_alike(docs, items, "doc_id", "item_id").withColumn("jaccard", F.round("jaccard", 6))


@query()
def sim_ratio(spark, d):
    x = table(spark, d, "benchmark")
    b = x.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    p = x.join(b, "item_id").withColumn("gate", similarity.passage_gate(F.col("text"), F.col("other")))
    # only pairs that the cheap gate leaves open go to Python
    done = p.where("gate is not null").select("item_id", F.col("gate").alias("score"))
    return done.unionAll(p.where("gate is null").select("item_id", similarity.plain_ratio("text", "other").alias("score")))


@query("""WITH t AS (SELECT user_id, event_type AS l, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
r AS (SELECT *, sum(CASE WHEN l <> 'click' AND (b IS NULL OR b = 'click' OR b <> l) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM t)
SELECT user_id, l AS label, min(event_id) AS start, max(event_id) AS "end", count(*) AS tokens FROM r WHERE l <> 'click' GROUP BY user_id, run, l""")
def bio_islands(spark, d):
    t = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "click", "O").otherwise(F.concat(F.lit("I-"), F.col("event_type"))).alias("tag"))
    return sequences.label_spans(t, "user_id", ["ts", "event_id"], "tag", "event_id", "event_id")


@query("""SELECT conv_id, turn, role, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM conversations""")
def win_running_offset(spark, d):
    return sequences.running_offset(table(spark, d, "conversations"), "conv_id", ["turn", "role", "text"], "text").select("conv_id", "turn", "role", "offset")


@query("""SELECT conv_id, CAST(sum(n) AS BIGINT) AS runs, count(DISTINCT role) AS "values" FROM (
  SELECT conv_id, role, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN 1 ELSE 0 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) GROUP BY 1""")
def win_contiguity(spark, d):
    return sequences.runs(table(spark, d, "conversations"), "conv_id", ["turn", "role", "text"], "role")


@query("""WITH f AS (SELECT user_id, event_type, k, min(event_id) AS first FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) GROUP BY ALL)
SELECT user_id, event_type, k, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY first, k) AS INTEGER) AS number FROM f""")
def tag_numbering(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), "event_id")
    return annotations.tag_numbers(e, "user_id", "event_type", "k", "event_id").select("user_id", "event_type", "k", "number").distinct()


@query()
def span_noncrossing(spark, d):
    types = F.array(F.lit("cell"), F.lit("gene"), F.lit("hormone"))
    n = F.length("text")
    spans = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(
        F.pmod(F.xxhash64("doc_id", i), n).cast("int").alias("start"), (F.pmod(F.xxhash64("doc_id", i), n) + 1 + F.pmod(F.xxhash64("doc_id", i, F.lit(1)), F.lit(40))).cast("int").alias("end"),
        F.get(types, F.pmod(F.xxhash64("doc_id", i, F.lit(2)), F.lit(3)).cast("int")).alias("type"), i.cast("string").alias("key")))
    x = table(spark, d, "documents").select("doc_id", spans.alias("spans"))
    return x.select("doc_id", annotations.non_crossing(F.col("spans")).alias("s")).select("doc_id", F.inline("s"))


@query("""SELECT event_type, count(*) AS events, count(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS numbers, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def json_props(spark, d):
    k = text.json_number(F.col("props"), "$.k")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count(k).alias("numbers"), F.sum(k).alias("total"))


@query(f"""SELECT event_id, CASE WHEN user_id % 10 = 0 THEN false WHEN event_type = 'view' THEN true WHEN value < 10 THEN true ELSE ts <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY END AS again FROM events""")
def ttl_recheck(spark, d):
    e = table(spark, d, "events")
    again = corpus.fetch_again(F.when(F.col("user_id") % 10 != 0, "PMC1"), F.when(F.col("event_type") == "view", "old").otherwise("v1"), "v1",
                               F.when(F.col("value") < 10, "failed").otherwise("not_available"), F.col("ts"), F.lit(NOW).cast("timestamp"))
    return e.select("event_id", again.alias("again"))


@query("""SELECT CAST(floor(event_id / 500) AS BIGINT) AS "window", event_type, count(*) AS rows, round(sum(value), 4) AS total, round(avg(value), 6) AS rate FROM events GROUP BY 1, 2""")
def microbatch_rollup(spark, d):
    w = relations.windows(table(spark, d, "events"), "event_id", 500)
    return w.groupBy("window", "event_type").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("rate"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'default' ELSE 'custom' END AS part FROM documents WHERE doc_id % 2 = 0 OR source NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 0 AND source IS NOT NULL)""")
def delta_union(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source")
    base = x.where("doc_id % 2 = 0")
    new = corpus.added(x.where("doc_id % 2 <> 0"), base, ["source"])
    return base.select("doc_id", F.lit("default").alias("part")).unionAll(new.select("doc_id", F.lit("custom").alias("part")))


def _terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and customers as terms; a customer of an even key has a second parent."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, d, "nation").select(name("N", "n_nationkey").alias("term"), name("R", "n_regionkey").alias("parent"))
    c = table(spark, d, "customer")
    one = c.select(name("C", "c_custkey").alias("term"), name("N", "c_nationkey").alias("parent"))
    two = c.where("c_custkey % 2 = 0").select(name("C", "c_custkey").alias("term"), F.concat(F.lit("N"), ((F.col("c_nationkey") + 1) % 25).cast("string")).alias("parent"))
    return n.unionAll(one).unionAll(two), table(spark, d, "region").select(name("R", "r_regionkey").alias("term"))


_EDGES = """WITH RECURSIVE p AS (SELECT 'N' || n_nationkey AS term, 'R' || n_regionkey AS parent FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'C' || c_custkey, 'N' || ((c_nationkey + 1) % 25) FROM customer WHERE c_custkey % 2 = 0),
w AS (SELECT 'R' || r_regionkey AS term, ['R' || r_regionkey] AS path FROM region UNION ALL SELECT p.term, list_append(path, p.term) FROM w JOIN p ON p.parent = w.term WHERE NOT list_contains(path, p.term))
"""


@query(_EDGES + "SELECT term, array_to_string(path, '/') AS path, CAST(len(path) AS INTEGER) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY path) AS k FROM w) WHERE k <= 3")
def ontology_paths(spark, d):
    parents, roots = _terms(spark, d)
    return ontology.first_paths(ontology.paths(parents, roots), 3).select("term", F.array_join("path", "/").alias("path"), "depth")


@query(_EDGES + "SELECT coalesce(a.term, b.term) AS term, coalesce(up, 0) AS parents, coalesce(down, 0) AS children FROM (SELECT term, count(DISTINCT parent) AS up FROM p GROUP BY 1) a FULL JOIN (SELECT parent AS term, count(DISTINCT term) AS down FROM p GROUP BY 1) b ON a.term = b.term")
def ontology_children(spark, d):
    return ontology.children(_terms(spark, d)[0])


@query(_EDGES + "SELECT array_to_string(path[:n], '/') AS head, count(DISTINCT term) AS terms FROM w, unnest(range(1, len(path) + 1)) AS u(n) GROUP BY 1")
def ontology_merged(spark, d):
    parents, roots = _terms(spark, d)
    return ontology.merged(ontology.paths(parents, roots)).select(F.array_join("head", "/").alias("head"), "terms")
