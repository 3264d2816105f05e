"""Graph queries over the stand-in corpus, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import engine
from lodestone.functions import ids
from lodestone.operators import graph, relations
from lodestone.plans import star
from lodestone.tables import durable

SUPPORT = 35


def coarse(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolved(star.rows(spark, d))


def coarse_table(spark: SparkSession, d: str, fine: bool = False) -> DataFrame:
    """The resolved rows as a table, for queries that use them more than once."""
    return durable(graph.resolved(star.rows(spark, d, fine)))


def graph_relation_types(spark, d):
    return graph.relation_types(durable(graph.edges(coarse(spark, d))), SUPPORT)


def graph_edges_supported(spark, d):
    r = coarse_table(spark, d)
    e = graph.edges(r).where(F.col("paper_count") >= SUPPORT)
    return graph.labelled(e, graph.labels(r)).select("id", "subject_label", "predicate", "object_label", "paper_count", "evidence_count", "context_evidence_count")


def graph_nodes_stats(spark, d):
    return graph.nodes(coarse_table(spark, d))


def graph_node_labels(spark, d):
    return graph.labels(star.rows(spark, d, fine=True))


def graph_direction_counts(spark, d):
    return graph.direction_counts(graph.edges(coarse(spark, d)))


def graph_induced_top_nodes(spark, d):
    r = coarse_table(spark, d)
    e = durable(graph.edges(r))
    top = graph.connected(graph.nodes(r, e), e, SUPPORT).orderBy(*graph.node_order()).select("id").limit(20)
    return graph.induced(e, top, SUPPORT).select("id", "subject_id", "predicate", "object_id", "paper_count")


def graph_initial_refill(spark, d):
    r = coarse_table(spark, d)
    e = durable(graph.edges(r))
    return graph.initial_graph(graph.nodes(r, e), e, 40, SUPPORT)[1].select("id", "subject_id", "predicate", "object_id", "paper_count")


def graph_neighborhood(spark, d):
    e = graph.edges(star.rows(spark, d, fine=True))
    root = spark.range(1).select(ids.node_id(F.lit("cell"), F.lit("concept_id"), F.lit("S1"))).head()[0]
    return graph.neighbourhood(e, root, 150, 1).select("id", "subject_id", "predicate", "object_id", "paper_count", "evidence_count")


def graph_search(spark, d):
    r = coarse_table(spark, d, fine=True)
    names = durable(graph.aliases(r))
    return graph.search(graph.nodes(r, of_names=names), names, "Red W", 30).select("id", "label", "entity_type", "normalized_id", "relation_count", "paper_count", "rank")


def graph_predicate_breakdown(spark, d):
    return graph.predicate_breakdown(graph.edges(coarse(spark, d)))


def graph_edge_evidence(spark, d):
    r = coarse_table(spark, d)
    ev = graph.evidence(r)
    best = graph.edges(r).orderBy(*graph.edge_order()).select("id").head()
    return graph.edge_evidence(ev, best[0] if best else "").select("edge_id", "base", "paper_id", "pub_year", F.array_join("context", ",").alias("context"))


def graph_node_evidence(spark, d):
    return graph.node_evidence(graph.evidence(coarse(spark, d))).groupBy("node_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("edge_id").alias("edges"))


def graph_entity_index(spark, d):
    r = coarse_table(spark, d)
    e = durable(graph.edges(r))
    x = graph.entity_index(graph.nodes(r, e), graph.aliases(r), e)
    return x.select("id", "label", F.array_join(F.transform("mentions", lambda m: F.concat_ws(":", m["alias_norm"], m["count"].cast("string"))), "|").alias("mentions"),
                    F.array_join(F.transform("relations", lambda m: F.concat_ws(":", m["edge"], m["direction"])), "|").alias("relations"))


def graph_predicate_filter(spark, d):
    n, e = engine.of_predicates(*_tables(spark, d), ["Secreted", "binding ", "unheard-of"], SUPPORT)
    return n.select("id", "entity_type", "label", "paper_count")


def _tables(spark, d):
    r = coarse_table(spark, d)
    e = durable(graph.edges(r))
    return graph.nodes(r, e), e


def graph_triple_validate(spark, d):
    x = graph.relations(coarse(spark, d))
    return x.groupBy("predicate", "subject_type", "object_type", "valid").agg(F.count(F.lit(1)).alias("rows"))


def graph_node_size(spark, d):
    r = coarse_table(spark, d)
    n = graph.nodes(r).select("id", "paper_count")
    all_ = n.agg(F.min("paper_count").alias("lo"), F.max("paper_count").alias("hi"))
    sized = n.join(F.broadcast(all_)).select("id", graph.log_size(F.col("paper_count"), F.col("lo"), F.col("hi")).alias("size"))  # one row
    side = lambda s: sized.select(F.col("id").alias(f"{s}_id"), F.col("size").alias(f"{s}_size"))
    e = graph.edges(r).where(F.col("paper_count") >= SUPPORT).join(side("subject"), "subject_id").join(side("object"), "object_id")
    return e.select("id", F.round("subject_size", 6).alias("subject_size"), graph.edge_length(F.round("subject_size", 6), F.round("object_size", 6)).alias("length"))


def graph_ids(spark, d):
    return graph.edges(star.rows(spark, d, fine=True)).select("id", "subject_id", "predicate", "object_id")


def graph_totals(spark, d):
    r = coarse_table(spark, d)
    ev = durable(graph.keyed_evidence(r))
    e = durable(graph.edges(ev))
    return engine.totals(graph.nodes(r, e), e, ev)


def graph_edge_contexts(spark, d):
    r = coarse_table(spark, d)
    return graph.edge_contexts(graph.evidence(r), graph.nodes(r))


def graph_edge_details(spark, d):
    n, e = _tables(spark, d)
    return graph.edge_details(e, n).select("id", "subject_label", "subject_type", "predicate", "object_label", "object_type", "directed", "paper_count")


def graph_surface_forms(spark, d):
    return graph.surface_forms(graph.mentions(star.rows(spark, d, fine=True)))


def graph_undirected_counts(spark, d):
    return graph.undirected_counts(graph.edges(coarse(spark, d)))


def graph_evidence_entities(spark, d):
    r = coarse_table(spark, d)
    x = graph.evidence_entities(graph.evidence(r).where("predicate = 'binding'"), graph.mentions(r))
    return x.select("edge_id", "base", F.array_join(F.transform("entities", lambda m: F.concat_ws(":", m["node_id"], m["mention"])), "|").alias("entities"))


def graph_in_order(spark, d):
    wanted = [r[0] for r in spark.createDataFrame([("PROMO",), ("HOUSEHOLD",), ("MACHINERY",), ("BUILDING",), ("HOUSEHOLD",)], "x string").select(
        ids.node_id(F.lit("hormone"), F.lit("hormone_id"), F.col("x"))).collect()]
    return graph.in_order(graph.nodes(coarse_table(spark, d)), "id", wanted).select("place", "id", "label", "paper_count")


def graph_payload(spark, d):
    return graph.payload(graph.nodes(coarse_table(spark, d))).withColumn("size", F.round("size", 6))


def graph_relation_counters(spark, d):
    return relations.counters(graph.keyed_relations(coarse(spark, d)).where("valid"))


QUERIES = {f.__name__: f for f in (
    graph_relation_types, graph_edges_supported, graph_nodes_stats, graph_node_labels, graph_direction_counts, graph_induced_top_nodes,
    graph_initial_refill, graph_neighborhood, graph_search, graph_predicate_breakdown, graph_edge_evidence, graph_node_evidence,
    graph_entity_index, graph_predicate_filter, graph_triple_validate, graph_node_size, graph_ids, graph_totals,
    graph_edge_contexts, graph_edge_details, graph_surface_forms, graph_undirected_counts, graph_evidence_entities, graph_in_order, graph_payload,
    graph_relation_counters)}

C, FINE = star.sql(), star.sql(fine=True)
ORDER = "paper_count DESC, relation_count DESC, chunk_count DESC, label_norm, id"
ORACLE_SQL = {
    "graph_relation_types": C + f"""
SELECT predicate, count(*) AS total_edge_count, count(*) FILTER (paper_count >= {SUPPORT}) AS edge_count,
  CAST(coalesce(sum(paper_count) FILTER (paper_count >= {SUPPORT}), 0) AS BIGINT) AS paper_support,
  CAST(coalesce(sum(evidence_count) FILTER (paper_count >= {SUPPORT}), 0) AS BIGINT) AS evidence_count,
  (SELECT count(*) FROM (SELECT subject_id FROM e k WHERE k.predicate = e.predicate AND paper_count >= {SUPPORT}
                         UNION SELECT object_id FROM e k WHERE k.predicate = e.predicate AND paper_count >= {SUPPORT})) AS node_count
FROM e GROUP BY predicate""",
    "graph_edges_supported": C + f"""
SELECT e.id, s.label AS subject_label, predicate, o.label AS object_label, paper_count, evidence_count, context_evidence_count
FROM e JOIN l s ON s.node_id = subject_id JOIN l o ON o.node_id = object_id WHERE paper_count >= {SUPPORT}""",
    "graph_nodes_stats": C + "SELECT id, entity_type, normalized_id, label, label_norm, occurrence_count, paper_count, chunk_count, relation_count, incoming_count, outgoing_count, context_count FROM n",
    "graph_node_labels": FINE + "SELECT node_id, label, label_norm FROM l",
    "graph_direction_counts": C + "SELECT CASE WHEN predicate = 'binding' THEN 'hormone--gene' ELSE subject_type || '->' || object_type END AS direction, count(*) AS edges FROM e GROUP BY 1",
    "graph_induced_top_nodes": C + f""", t AS (SELECT id FROM n WHERE id IN (SELECT subject_id FROM e WHERE paper_count >= {SUPPORT} UNION SELECT object_id FROM e WHERE paper_count >= {SUPPORT}) ORDER BY {ORDER} LIMIT 20)
SELECT id, subject_id, predicate, object_id, paper_count FROM e WHERE paper_count >= {SUPPORT} AND subject_id IN (FROM t) AND object_id IN (FROM t)""",
    "graph_neighborhood": FINE + """, root AS (SELECT 'C-' || substr(sha256('cell' || chr(31) || 'concept_id' || chr(31) || 's1'), 1, 24) AS id)
SELECT id, subject_id, predicate, object_id, paper_count, evidence_count FROM e
WHERE subject_id IN (FROM root) OR object_id IN (FROM root) ORDER BY paper_count DESC, evidence_count DESC, id LIMIT 150""",
    "graph_search": FINE + """, m AS (
  SELECT id, CASE WHEN label_norm = 'red w' THEN 0 WHEN starts_with(label_norm, 'red w') THEN 1 ELSE 3 END AS rank FROM n WHERE contains(label_norm, 'red w')
  UNION ALL SELECT node_id, CASE WHEN alias_norm = 'red w' THEN 0 WHEN starts_with(alias_norm, 'red w') THEN 2 ELSE 4 END FROM a WHERE contains(alias_norm, 'red w')),
b AS (SELECT id, CAST(min(rank) AS INTEGER) AS rank FROM m GROUP BY id)
SELECT n.id, label, entity_type, normalized_id, relation_count, paper_count, rank FROM n JOIN b USING (id) ORDER BY rank, paper_count DESC, relation_count DESC, label_norm, id LIMIT 30""",
    "graph_predicate_breakdown": C + """
SELECT id, predicate, CAST(sum(CASE WHEN o AND predicate <> 'binding' THEN 1 ELSE 0 END) AS BIGINT) AS outgoing,
  CAST(sum(CASE WHEN NOT o AND predicate <> 'binding' THEN 1 ELSE 0 END) AS BIGINT) AS incoming,
  CAST(sum(CASE WHEN predicate = 'binding' THEN 1 ELSE 0 END) AS BIGINT) AS undirected, CAST(sum(evidence_count) AS BIGINT) AS evidence
FROM (SELECT subject_id AS id, predicate, true AS o, evidence_count FROM e UNION ALL SELECT object_id, predicate, false, evidence_count FROM e) GROUP BY 1, 2""",
    "graph_edge_evidence": C + """, best AS (SELECT id FROM e ORDER BY paper_count DESC, evidence_count DESC, id LIMIT 1)
SELECT edge_id, base, paper_id, pub_year, coalesce(ctx, '') AS context FROM ev WHERE edge_id IN (FROM best) ORDER BY pub_year DESC, paper_id, base LIMIT 100""",
    "graph_node_evidence": C + """
SELECT node_id, count(*) AS rows, count(DISTINCT edge_id) AS edges FROM (
  SELECT subject_id AS node_id, edge_id, base FROM ev UNION SELECT object_id, edge_id, base FROM ev UNION SELECT ctx, edge_id, base FROM ev WHERE ctx IS NOT NULL) GROUP BY 1""",
    "graph_entity_index": C + """, r AS (
  SELECT subject_id AS id, paper_count, id AS edge, predicate, object_id AS other, CASE WHEN predicate = 'binding' THEN 'undirected' ELSE 'outgoing' END AS d FROM e
  UNION ALL SELECT object_id, paper_count, id, predicate, subject_id, CASE WHEN predicate = 'binding' THEN 'undirected' ELSE 'incoming' END FROM e)
SELECT id, label, (SELECT string_agg(alias_norm || ':' || count, '|' ORDER BY alias_norm) FROM a WHERE node_id = n.id) AS mentions,
  (SELECT string_agg(edge || ':' || d, '|' ORDER BY paper_count, edge, predicate, other) FROM r WHERE r.id = n.id) AS relations FROM n""",
    "graph_predicate_filter": C + f""", k AS (SELECT * FROM e WHERE predicate IN ('secreted', 'binding') AND paper_count >= {SUPPORT})
SELECT id, entity_type, label, paper_count FROM n WHERE id IN (SELECT subject_id FROM k UNION SELECT object_id FROM k)""",
    "graph_triple_validate": C + """
SELECT CASE flag WHEN 'R' THEN 'secreted' WHEN 'A' THEN 'activation' WHEN 'NO' THEN 'binding' ELSE 'proliferation' END AS predicate,
  CASE flag WHEN 'A' THEN 'gene' WHEN 'NO' THEN 'hormone' ELSE 'cell' END AS subject_type, CASE flag WHEN 'A' THEN 'cell' ELSE 'gene' END AS object_type,
  flag <> 'NF' AS valid, count(*) AS rows FROM x GROUP BY ALL""",
    "graph_node_size": C + f""", z AS (SELECT id, round(8 + 24 * (ln(1 + paper_count) - ln(1 + min(paper_count) OVER ())) / (ln(1 + max(paper_count) OVER ()) - ln(1 + min(paper_count) OVER ())), 6) AS size FROM n)
SELECT e.id, s.size AS subject_size, CAST(floor(90 + 2.2 * (s.size + o.size)) AS INTEGER) AS length FROM e JOIN z s ON s.id = subject_id JOIN z o ON o.id = object_id WHERE paper_count >= {SUPPORT}""",
    "graph_ids": FINE + "SELECT id, subject_id, predicate, object_id FROM e",
    "graph_totals": C + """
SELECT 'evidence' AS name, count(*) AS value FROM ev UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'nodes', count(*) FROM n
UNION ALL SELECT 'papers', count(DISTINCT paper_id) FROM ev UNION ALL SELECT 'predicate:' || predicate, count(*) FROM e GROUP BY 1""",
    "graph_edge_contexts": C + "SELECT edge_id, ctx AS id, count(*) AS evidence_count, label FROM ev JOIN n ON n.id = ctx GROUP BY edge_id, ctx, label",
    "graph_edge_details": C + """SELECT e.id, s.label AS subject_label, subject_type, predicate, o.label AS object_label, object_type, predicate <> 'binding' AS directed, e.paper_count
FROM e JOIN n s ON s.id = subject_id JOIN n o ON o.id = object_id""",
    "graph_surface_forms": FINE + "SELECT node_id, lower(mention) AS form, min(mention) AS text, count(*) AS count FROM ent GROUP BY 1, 2",
    "graph_undirected_counts": C + "SELECT id, count(*) AS undirected_count FROM (SELECT subject_id AS id FROM e WHERE predicate = 'binding' UNION ALL SELECT object_id FROM e WHERE predicate = 'binding') GROUP BY 1",
    "graph_evidence_entities": C + """, m AS (SELECT base, string_agg(node_id || ':' || mention, '|' ORDER BY CASE entity_type WHEN 'cell' THEN 0 WHEN 'gene' THEN 1 ELSE 2 END) AS entities FROM ent GROUP BY 1)
SELECT edge_id, base, entities FROM ev LEFT JOIN m USING (base) WHERE predicate = 'binding'""",
    "graph_in_order": C + """, w AS (SELECT CAST(i AS INTEGER) AS place, 'H-' || substr(sha256('hormone' || chr(31) || 'hormone_id' || chr(31) || lower(x)), 1, 24) AS id
  FROM (VALUES (0, 'PROMO'), (1, 'HOUSEHOLD'), (2, 'MACHINERY'), (3, 'BUILDING')) AS t(i, x))
SELECT place, id, label, paper_count FROM w JOIN n USING (id)""",
    "graph_payload": C + """SELECT id, label, label || ' | ' || normalized_id AS title, CASE entity_type WHEN 'cell' THEN '#2f7fb5' WHEN 'gene' THEN '#3d9a5f' ELSE '#c2703d' END AS colour,
  round(8 + 24 * (ln(1 + paper_count) - ln(1 + min(paper_count) OVER ())) / (ln(1 + max(paper_count) OVER ()) - ln(1 + min(paper_count) OVER ())), 6) AS size FROM n""",
    "graph_relation_counters": C + """SELECT 'relations' AS name, count(*) AS value FROM rel UNION ALL SELECT 'predicate:' || predicate, count(*) FROM rel GROUP BY 1
UNION ALL SELECT 'direction:' || CASE WHEN predicate = 'binding' THEN 'hormone--gene' ELSE subject_type || '->' || object_type END, count(*) FROM rel GROUP BY 1
UNION ALL SELECT 'hormone_gene:' || CASE WHEN ctx IS NULL THEN 'without_context' ELSE 'with_context' END, count(*) FROM rel WHERE subject_type = 'hormone' AND object_type = 'gene' GROUP BY 1""",
}
