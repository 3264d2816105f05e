"""Queries of the stages around the graph (normalising, annotating, handing on), over stand-in tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import ids, text
from lodestone.operators import annotating, normalizing, ontology, projections
from lodestone.plans.star import table
from lodestone.sources import bundles

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


def mentions(spark, d) -> DataFrame:
    """Events as mentions: a user is a document, the kind of event what it mentions."""
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("document_key"), F.col("event_type").alias("mention"), "value", "ts", "user_id")


def forms(spark, d) -> DataFrame:
    """Users with a purchase above 50 say what their abbreviations mean."""
    rich = table(spark, d, "events").where("event_type = 'purchase' and value > 50").select(F.col("user_id").cast("string").alias("document_key")).distinct()
    return rich.select("document_key", F.lit("errors").alias("short_form"), F.lit("errors of cells").alias("long_form")).unionAll(
        rich.select("document_key", F.lit("vie").alias("short_form"), F.lit("very important event").alias("long_form")))


def lookup(spark) -> DataFrame:
    rows = [("clicks", "CL:1"), ("error", "CL:2, CL:3"), ("er-ror", "CL:2"), ("zz", "-")]
    return normalizing.lookup(spark.createDataFrame(rows, "short_form string, matched_id string"))


RICH = "rich AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS document_key FROM events WHERE event_type = 'purchase' AND value > 50)"
ASKED = "asked AS (SELECT CAST(user_id AS VARCHAR) AS document_key, event_type AS normalized_text FROM events GROUP BY ALL)"


@query("SELECT CAST(user_id AS VARCHAR) AS document_key, event_type AS normalized_text, event_type AS mention FROM events GROUP BY ALL")
def annot_requests(spark, d):
    return normalizing.requests(mentions(spark, d))


@query(f"""WITH {ASKED}, {RICH}, r AS (SELECT a.*, r.document_key IS NOT NULL AS rich FROM asked a LEFT JOIN rich r USING (document_key)),
t AS (SELECT *, CASE WHEN normalized_text = 'click' THEN 'direct' WHEN normalized_text = 'error' AND rich THEN 'ambiguous' WHEN normalized_text = 'error' THEN 'encoder'
  WHEN length(normalized_text) > 4 THEN 'fuzzy' ELSE 'encoder' END AS route FROM r)
SELECT document_key, normalized_text, route, CASE route WHEN 'direct' THEN NULL WHEN 'ambiguous' THEN 'error of cell' ELSE normalized_text END AS query,
  CASE route WHEN 'direct' THEN 'CL:1' END AS identifier FROM t""")
def annot_route(spark, d):
    x = normalizing.routed(normalizing.requests(mentions(spark, d)), lookup(spark), forms(spark, d))
    return x.select("document_key", "normalized_text", "route", "query", "identifier")


@query(f"""WITH {ASKED}, {RICH}, w AS (SELECT DISTINCT document_key, k AS key FROM asked, (VALUES ('vie'), ('vies'), ('no')) AS t(k))
SELECT document_key, key, 'very important event' AS long_form, CASE key WHEN 'vie' THEN 'exact_key' ELSE 'exact_variant' END AS method, 'vie' AS matched
FROM w JOIN rich USING (document_key) WHERE key <> 'no'""")
def annot_long_forms(spark, d):
    wanted = mentions(spark, d).select("document_key", F.explode(F.array(F.lit("vie"), F.lit("vies"), F.lit("no"))).alias("key"))
    return normalizing.long_forms(wanted, forms(spark, d)).select("document_key", "key", "long_form", "method", "matched")


def candidates(spark, d) -> DataFrame:
    x = mentions(spark, d).where("mention in ('click', 'signup')")
    return x.select("document_key", F.col("mention").alias("normalized_text"), F.concat(F.lit("CL:"), F.col("seq")).alias("identifier"), F.col("mention").alias("preferred_label"),
                    F.floor("value").alias("score"), F.lit("encoder").alias("source"))


CANDIDATES = """b AS (SELECT CAST(user_id AS VARCHAR) AS document_key, event_type, 'CL:' || event_id AS identifier FROM events WHERE event_type IN ('click', 'signup')
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(value) DESC, 'CL:' || event_id) = 1)"""


@query(f"""WITH {CANDIDATES} SELECT event_id AS seq, identifier AS cell_ontology_id, CASE WHEN identifier IS NULL THEN 'unresolved' ELSE 'normalized' END AS normalization_status
FROM events e LEFT JOIN b ON b.document_key = CAST(user_id AS VARCHAR) AND b.event_type = e.event_type""")
def annot_final_rows(spark, d):
    x = normalizing.final_rows(mentions(spark, d), normalizing.best_candidate(candidates(spark, d)))
    return x.select("seq", "cell_ontology_id", "normalization_status")


@query("""SELECT count(*) AS cells, count(*) FILTER (event_type IN ('click', 'signup')) AS normalized, round(100 * count(*) FILTER (event_type IN ('click', 'signup')) / count(*), 2) AS rate FROM events""")
def annot_rate(spark, d):
    return normalizing.rate(normalizing.final_rows(mentions(spark, d), normalizing.best_candidate(candidates(spark, d))))


@query("""SELECT s_suppkey, CASE WHEN n_regionkey = 0 THEN n_name WHEN n_regionkey IN (0, 1) THEN r_name ELSE s_name END AS label,
  CASE WHEN n_regionkey = 0 THEN 'current' WHEN n_regionkey IN (0, 1) THEN 'cache' ELSE 'mention' END AS label_source
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def annot_labelled(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    now = n.where("n_regionkey = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("label"), F.lit("current").alias("label_source"))
    cache = n.where("n_regionkey in (0, 1)").select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("label"), F.lit("cache").alias("label_source"))
    return normalizing.labelled(table(spark, d, "supplier"), "s_nationkey", [now, cache], "s_name").select("s_suppkey", "label", "label_source")


def turns(spark, d) -> DataFrame:
    """Conversations as papers: the first turn is the title, the second the abstract, the rest the body."""
    section = F.when(F.col("turn") == 0, "TITLE").when(F.col("turn") == 1, "ABSTRACT").otherwise("BODY")
    return table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("paper"), F.col("turn").alias("chunk_id"), section.alias("section"), F.col("text").alias("chunk"), "role")


@query("""SELECT CAST(conv_id AS VARCHAR) AS paper, turn AS chunk_id, CASE turn WHEN 0 THEN 'TITLE' ELSE 'ABSTRACT' END AS section FROM conversations
WHERE turn IN (0, 1) AND (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM conversations WHERE role = 'assistant')""")
def annot_uncovered(spark, d):
    x = turns(spark, d)
    return annotating.uncovered(x, x.where("role = 'assistant'")).select("paper", "chunk_id", "section")


@query("""SELECT 'chunks' AS name, count(*) AS value FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT 'annotations', count(*) FROM events
UNION ALL SELECT 'type:' || CASE event_type WHEN 'click' THEN 'cell' WHEN 'error' THEN 'gene' ELSE 'hormone' END, count(*) FROM events GROUP BY 1""")
def annot_type_counts(spark, d):
    kind = F.when(F.col("event_type") == "click", "cell").when(F.col("event_type") == "error", "gene").otherwise("hormone")
    x = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct(kind.alias("obj"))).alias("annotations"))
    return annotating.type_counts(x)


@query("""SELECT event_type AS kind, count(DISTINCT user_id) AS concepts FROM events GROUP BY 1""")
def annot_concept_sets(spark, d):
    return annotating.concept_sets(table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("concept_id")))


@query("""SELECT CAST(sum(CASE WHEN event_type = 'error' THEN CAST(floor(value) AS BIGINT) WHEN event_type = 'click' THEN event_id ELSE 0 END) AS BIGINT) AS failed,
  CAST(sum(user_id) AS BIGINT) AS users FROM events""")
def annot_stat_sums(spark, d):
    e = table(spark, d, "events")
    own = F.when(F.col("event_type") == "error", F.create_map(F.lit("failed"), F.floor("value").cast("long"), F.lit("failures"), F.lit(7).cast("long"))).when(
        F.col("event_type") == "click", F.create_map(F.lit("failures"), F.col("event_id"))).otherwise(F.create_map(F.lit("other"), F.lit(1).cast("long")))
    stats = F.map_concat(own, F.create_map(F.lit("users"), F.col("user_id")))
    return annotating.stat_sums(e.select(stats.alias("stats")), {"failed": ("failed", "failures"), "users": ("users",)})


@query("""SELECT event_id, CAST(coalesce(user_id, 0) AS BIGINT) AS input_tokens, CAST(CASE WHEN event_type = 'view' THEN event_id ELSE 0 END AS BIGINT) AS cached_tokens, CAST(0 AS BIGINT) AS output_tokens FROM events""")
def annot_usage(spark, d):
    cached = F.when(F.col("event_type") == "view", F.concat(F.lit(', "input_tokens_details": {"cached_tokens": '), F.col("event_id"), F.lit("}"))).otherwise("")
    answer = F.concat(F.lit('{"id": "x", "usage": {"input_tokens": '), F.col("user_id"), cached, F.lit("}}"))
    return table(spark, d, "events").select("event_id", annotating.usage_of(answer).alias("u")).select("event_id", "u.*")


@query("""WITH s AS (SELECT DISTINCT user_id, CAST(floor(value) AS INTEGER) AS a, CAST(floor(value) AS INTEGER) + length(event_type) AS b, event_type AS key FROM events),
p AS (SELECT user_id, at, lead(at) OVER (PARTITION BY user_id ORDER BY at) AS t FROM (SELECT user_id, a AS at FROM s UNION SELECT user_id, b FROM s))
SELECT p.user_id, at AS piece_start, t AS piece_end, string_agg(key, ',' ORDER BY a, -b, key) AS keys FROM p JOIN s ON s.user_id = p.user_id AND a <= at AND b >= t GROUP BY ALL""".replace(" AS at ", " AS begins ").replace("a AS at FROM", "a AS begins FROM").replace("at, lead(at)", "begins, lead(begins)").replace("ORDER BY at)", "ORDER BY begins)").replace("at AS piece_start", "begins AS piece_start").replace("a <= at", "a <= begins"))
def span_segments(spark, d):
    start = F.floor("value").cast("int")
    spans = table(spark, d, "events").select("user_id", start.alias("start"), (start + F.length("event_type")).alias("end"), F.col("event_type").alias("key")).distinct()
    return annotating.segments(spans, "user_id").withColumn("keys", F.array_join("keys", ","))


@query("""WITH a AS (SELECT DISTINCT user_id, CAST(floor(value) AS INTEGER) AS s, event_type, CASE event_type WHEN 'click' THEN 'cell' WHEN 'error' THEN 'gene' ELSE 'hormone' END AS obj FROM events)
SELECT user_id, string_agg(s || ':' || obj || ':' || event_type, '|' ORDER BY s, s + 5, CASE obj WHEN 'cell' THEN 0 WHEN 'hormone' THEN 1 ELSE 2 END, event_type) AS list FROM a GROUP BY 1""")
def annot_in_order(spark, d):
    kind = F.when(F.col("event_type") == "click", "cell").when(F.col("event_type") == "error", "gene").otherwise("hormone")
    one = F.struct(kind.alias("obj"), F.floor("value").cast("int").alias("start"), (F.floor("value") + 5).cast("int").alias("end"), F.col("event_type").alias("mention"),
                   F.lit("c").alias("concept_id"), F.lit("l").alias("preferred_label"))
    x = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(one).alias("a"))
    said = F.transform(projections.in_order(projections.once(F.col("a"))), lambda a: F.concat_ws(":", a["start"], a["obj"], a["mention"]))
    return x.select("user_id", F.array_join(said, "|").alias("list"))


def papers(spark, d) -> DataFrame:
    """Documents as chunk rows with identity columns."""
    x = table(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    return x.select(ids.chunk_base(key, F.lit(1)).alias("base"), key.alias("doc_key"), F.concat(F.lit("doi:"), key).alias("canonical_id"), F.col("source").alias("pmid"),
                    F.col("lang").alias("pmcid"), F.col("source").alias("journal"), F.lit(None).cast("string").alias("pub_year"), F.lit("BODY").alias("section_type"), F.lit(1).alias("chunk_id"),
                    F.col("text").alias("chunk"), F.lit("x").alias("extra"))


@query("""SELECT md5(doc_id || '::1') AS base, CAST(doc_id AS VARCHAR) AS doc_key, 'doi:' || doc_id AS canonical_id, source AS pmid, lang AS pmcid, coalesce(source, '') AS journal, '' AS pub_year,
  'BODY' AS section_type, 1 AS chunk_id, 0 AS annotations FROM documents""")
def corpus_projection(spark, d):
    return projections.chunk_rows(papers(spark, d)).withColumn("annotations", F.size("annotations"))


@query("""SELECT l.doc_id, CASE WHEN l.lang = 'es' THEN 'left missing' WHEN l.lang = 'fr' THEN 'right missing' WHEN l.lang = 'de' THEN 'identity differs' END AS problem FROM documents l""")
def corpus_alignment(spark, d):
    p = papers(spark, d)
    left = p.where("pmcid is null or pmcid <> 'es'")
    right = p.where("pmcid is null or pmcid <> 'fr'").withColumn("section_type", F.when(F.col("pmcid") == "de", "TITLE").otherwise(F.col("section_type")))
    return projections.aligned(left, right).select(F.coalesce("l.doc_key", "r.doc_key").cast("long").alias("doc_id"), "problem")


@query("""SELECT doc_id, CASE WHEN doc_id = 0 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS pmid, 'PMC' || doc_id AS pmcid, '10.1/x' || doc_id AS doi, lang AS title,
  array_to_string(list_sort(list_distinct(list_filter([lang, 'pubmed', source], lambda x: x IS NOT NULL AND x <> ''))), ',') AS sources, true AS has_metadata FROM documents""")
def corpus_normal_record(spark, d):
    x = table(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    r = x.select("doc_id", F.concat(F.lit("PMID: 00"), i).alias("pmid"), F.concat(F.lit(" pmc "), i).alias("pmcid"), F.concat(F.lit("https://doi.org/10.1/X"), i).alias("doi"),
                 F.concat(F.lit(" "), F.col("lang"), F.lit("\r\n")).alias("title"), F.array("lang", F.lit("pubmed"), F.lit("")).alias("sources"), "source", F.lit("a").alias("authors"))
    out = projections.normal_record(r)
    return out.select("doc_id", "pmid", "pmcid", "doi", "title", F.array_join("sources", ",").alias("sources"), projections.has_metadata(out).alias("has_metadata"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY coalesce(TRY_CAST(coalesce(CAST(quality AS VARCHAR), 'n/a') AS INTEGER), 0) DESC, lower(lang), doc_id) AS place
FROM (SELECT d.doc_id, lang, max(quality) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL)""")
def corpus_paper_order(spark, d):
    best = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    x = table(spark, d, "documents").select("doc_id", F.col("lang").alias("title")).join(best, "doc_id", "left")
    x = x.withColumn("pub_year", F.coalesce(F.col("q").cast("string"), F.lit("n/a")))
    return x.select("doc_id", F.row_number().over(Window.orderBy(*projections.paper_order(), "doc_id")).alias("place"))


@query("""SELECT d.doc_id AS paper, CASE WHEN lang = 'es' THEN 'rebuild' WHEN d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR d.doc_id NOT IN (SELECT doc_id FROM labels) THEN 'new'
  WHEN d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'missing' ELSE 'reuse' END AS decision FROM documents d""")
def corpus_reuse(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").withColumnRenamed("doc_id", "paper")
    of = lambda df: df.select("paper")
    again = docs.where("lang = 'es'").select(F.col("doc_id").alias("paper"))
    return projections.reuse(docs.select(F.col("doc_id").alias("paper")), of(labels), of(labels.where("quality = 1")), of(labels.where("toxic = 1")), again)


@query("""SELECT count(*) AS papers, count(*) FILTER (trim(text) <> '') AS abstracts, count(*) FILTER (source <> '') AS with_pmcid, count(*) FILTER (source IS NULL OR source = '') AS without_pmcid,
  count(*) FILTER (lang = 'en') AS reused, count(*) FILTER (lang <> 'en') AS new FROM documents""")
def corpus_counts(spark, d):
    x = table(spark, d, "documents")
    return annotating.corpus_counts(x.select(F.col("text").alias("abstract"), F.col("source").alias("pmcid"), (F.col("lang") == "en").alias("reused")))


@query("""SELECT user_id, CAST(epoch_us(max(ts)) AS BIGINT) AS at, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1""")
def cache_latest(spark, d):
    x = projections.latest(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts")
    return x.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'ordered' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def cache_updated(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("c_mktsegment", F.lit("ordered"))
    return projections.updated(c, new.join(c.select("c_custkey"), "c_custkey", "left_semi"), "c_custkey")


@query("""SELECT o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS part,
  row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) - 1 AS line FROM orders""")
def bundle_lines(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), "o_orderstatus")
    return bundles.bundle([o.where("o_orderstatus = 'F'").select("seq"), o.where("o_orderstatus = 'O'").select("seq"), o.where("o_orderstatus not in ('F', 'O')").select("seq")])


@query("""SELECT o_custkey AS paper_id, count(*) AS lines, max(o_orderkey) - min(o_orderkey) + 1 AS span FROM orders GROUP BY 1 HAVING count(*) <> max(o_orderkey) - min(o_orderkey) + 1""")
def bundle_broken(spark, d):
    return bundles.broken_papers(table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("line")))


def terms(spark, d) -> DataFrame:
    """Regions and nations as terms: a nation stands below its region, and below the nation numbered one less in its region."""
    none = F.array().cast("array<string>")
    r = table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit("d").alias("definition"), none.alias("synonyms"),
                                         F.array(F.concat(F.lit("R"), "r_regionkey")).alias("parents"), none.alias("aliases"))
    n = table(spark, d, "nation")
    before = F.lag("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    n = n.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("d").alias("definition"),
                 F.array(F.concat(F.lit(" old  cells of "), F.col("n_name")), F.col("n_name")).alias("synonyms"),
                 F.array_compact(F.array(F.concat(F.lit("R"), "n_regionkey"), F.concat(F.lit("N"), before))).alias("parents"), F.array(F.concat(F.lit("A"), "n_nationkey")).alias("aliases"))
    return r.unionByName(n)


@query(r"""WITH t AS (SELECT 'R' || r_regionkey AS term, r_name AS name, true AS is_preferred FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, true FROM nation
  UNION ALL SELECT 'N' || n_nationkey, 'old cells of ' || n_name, false FROM nation)
SELECT *, replace(replace(name, '_', ' _ '), 'cells', 'cell') AS normal FROM t""")
def ontology_named_terms(spark, d):
    return ontology.named_terms(terms(spark, d))


@query("""SELECT 'A' || n_nationkey AS name, 'N' || n_nationkey AS term FROM nation UNION ALL SELECT 'N' || n_nationkey, 'N' || n_nationkey FROM nation UNION ALL SELECT n_name, 'N' || n_nationkey FROM nation
UNION ALL SELECT ' old  cells of ' || n_name, 'N' || n_nationkey FROM nation UNION ALL SELECT 'R' || r_regionkey, 'R' || r_regionkey FROM region UNION ALL SELECT r_name, 'R' || r_regionkey FROM region""")
def ontology_aliases(spark, d):
    return ontology.hierarchy(terms(spark, d))[2]


@query("""WITH k AS (SELECT n_nationkey, n_regionkey, lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation)
SELECT 'N' || n_nationkey AS term, 'R' || n_regionkey AS parent FROM k UNION ALL SELECT 'N' || n_nationkey, 'N' || b FROM k WHERE b IS NOT NULL""")
def ontology_links(spark, d):
    return ontology.hierarchy(terms(spark, d))[1]


def cell_nodes(spark, d) -> DataFrame:
    """Suppliers as cells found in texts, named by their nation's alias."""
    return table(spark, d, "supplier").select(F.concat(F.lit("C-"), "s_suppkey").alias("id"), F.lit("cell").alias("entity_type"), F.concat(F.lit("A"), "s_nationkey").alias("normalized_id"), F.floor("s_acctbal").alias("paper_count"))


@query("""WITH t AS (SELECT 'N' || n_nationkey AS term FROM nation UNION ALL SELECT 'R' || r_regionkey FROM region),
s AS (SELECT 'N' || s_nationkey AS term, 'C-' || s_suppkey AS id FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal) DESC, 'C-' || s_suppkey DESC) = 1)
SELECT term, id FROM t LEFT JOIN s USING (term)""")
def ontology_in_graph(spark, d):
    t, _, aliases = ontology.hierarchy(terms(spark, d))
    return ontology.in_graph(t.select(F.col("id").alias("term")), cell_nodes(spark, d), aliases)


@query("""WITH s AS (SELECT s_nationkey, n_regionkey, 'C-' || s_suppkey AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey
  QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal) DESC, 'C-' || s_suppkey DESC) = 1)
SELECT 'R' || n_regionkey AS head, string_agg(id, ',' ORDER BY id) AS ids FROM s GROUP BY 1 UNION ALL SELECT 'R' || n_regionkey || '>N' || s_nationkey, id FROM s""")
def ontology_descendants(spark, d):
    t, links, aliases = ontology.hierarchy(terms(spark, d))
    found = ontology.paths(links.where("parent like 'R%'"), t.where("id like 'R%'").select(F.col("id").alias("term")))
    of = ontology.in_graph(t.select(F.col("id").alias("term")), cell_nodes(spark, d), aliases)
    return ontology.descendants(found, of).select(F.array_join("head", ">").alias("head"), F.array_join("ids", ",").alias("ids"))


@query("""SELECT doc_id, substr(sha256(coalesce(source, '')), 1, 24) AS key, md5(doc_id || '::1') || ':cell:3:9' AS mention_id FROM documents""")
def ids_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.paper_key(F.col("source")).alias("key"),
                                               ids.mention_id(ids.chunk_base(F.col("doc_id").cast("string"), F.lit(1)), F.lit(3), F.lit(9)).alias("mention_id"))


@query(r"""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'PMC' || event_id WHEN event_type = 'error' THEN NULL ELSE 'PMC' || event_id END AS implied,
  CASE WHEN event_type IN ('click', 'view') THEN 'PMC' || event_id END AS strict FROM events""")
def ids_strict_pmcid(spark, d):
    raw = F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("see pmc "), "event_id", F.lit(" there"))).when(
        F.col("event_type") == "error", F.concat(F.lit("xPMC"), "event_id", F.lit("y"))).otherwise(F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", text.strict_pmcid(raw, True).alias("implied"), text.strict_pmcid(raw).alias("strict"))


@query(r"""SELECT page_id, regexp_matches(lower(substr(html, 1, 1000)), 'not found|no document|not available|no full text|does not exist') AS unavailable FROM pages""")
def text_unavailable(spark, d):
    return table(spark, d, "pages").select("page_id", text.says_unavailable(F.col("html")).alias("unavailable"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'gene' WHEN 'error' THEN 'chemical' WHEN 'view' THEN 'gene' END AS kind, CASE WHEN event_type <> 'view' THEN CAST(event_id AS VARCHAR) END AS name FROM events""")
def text_service_types(spark, d):
    kind = F.when(F.col("event_type") == "click", " Gene/Protein").when(F.col("event_type") == "error", "Chemical  Entity").when(F.col("event_type") == "view", "PROTEIN").otherwise("species")
    infons = F.create_map(F.lit("Article-Id pmc"), F.when(F.col("event_type") != "view", F.col("event_id").cast("string")).otherwise(" "), F.lit("b"), F.lit("x"))
    return table(spark, d, "events").select("event_id", text.service_type(kind).alias("kind"), text.infon(infons, "id", "article_id_pmc").alias("name"))
