"""Stand-in corpus: the order tables read as papers, chunks, tagged entities and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Predicate by return flag and line status; the last is illegal between these types, so that some rows are rejected.
PREDICATES = {"R": "secreted", "A": "activation", "NO": "binding", "NF": "proliferation"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    """One row per lineitem: its order is the paper, a supplier's nation (or the supplier) a cell, a brand (or part) a
    gene, a market segment a hormone, and the flags give the predicate.

    nation is a fixed table and supplier, part, customer and orders join on their keys, sized by the planner.
    """
    t = lambda name: table(spark, sf_dir, name)
    s = t("supplier").join(F.broadcast(t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")), "s_nationkey")
    x = (t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey")
         .join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
         .join(s.select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey", "n_name"), "l_suppkey")
         .join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey"))
    none = F.lit(None).cast("string")
    entity = lambda tag, obj, concept, gene, hormone, label, mention: F.struct(
        F.lit(tag).alias("id"), F.lit(obj).alias("obj"), mention.alias("mention"), concept.alias("concept_id"), label.alias("preferred_label"),
        gene.alias("gene_id"), hormone.alias("hormone_id"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    cell = entity("C1", "cell", text("S", "l_suppkey") if fine else text("N", "s_nationkey"), none, none, F.col("s_name" if fine else "n_name"), F.col("s_name"))
    gene = entity("G1", "protein", none, text("P", "l_partkey") if fine else F.col("p_brand"), none, F.col("p_name" if fine else "p_brand"), F.col("p_name"))
    hormone = entity("H1", "hormone", none, none, F.col("c_mktsegment"), F.col("c_mktsegment"), F.col("c_mktsegment"))
    flag = F.when(F.col("l_returnflag") == "N", F.concat("l_returnflag", "l_linestatus")).otherwise(F.col("l_returnflag"))
    pick = lambda r, a, no, nf: F.when(flag == "R", r).when(flag == "A", a).when(flag == "NO", no).otherwise(nf)
    relation = F.struct(pick("C1", "G1", "H1", "C1").alias("subject"), pick(*PREDICATES.values()).alias("predicate"), pick("G1", "C1", "G1", "G1").alias("object"),
                        F.when(flag == "NO", F.array(F.lit("C1"))).otherwise(F.array().cast("array<string>")).alias("cell_context"))
    return x.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("base"),
                    text("O", "l_orderkey").alias("paper_id"), F.col("l_orderkey").alias("seq"), F.year("o_orderdate").cast("string").alias("pub_year"),
                    F.array(cell, gene, hormone).alias("entities"), F.array(relation).alias("relations"))


def sql(fine: bool = False) -> str:
    """The same rows for the oracle: views ent (a row per entity), rel (a row per relation), ev, e (edges), a (names), l (labels), n (nodes)."""
    cell, cell_label = ("'S' || l_suppkey", "s_name") if fine else ("'N' || s_nationkey", "n_name")
    gene, gene_label = ("'P' || l_partkey", "p_name") if fine else ("p_brand", "p_brand")
    node = lambda p, t, f, x: f"'{p}-' || substr(sha256('{t}' || chr(31) || '{f}' || chr(31) || lower({x})), 1, 24)"
    return f"""
WITH x AS (
  SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_returnflag || '-' || l_linestatus AS base, 'O' || l_orderkey AS paper_id,
    CAST(year(o_orderdate) AS VARCHAR) AS pub_year, CASE WHEN l_returnflag = 'N' THEN l_returnflag || l_linestatus ELSE l_returnflag END AS flag,
    {node('C', 'cell', 'concept_id', cell)} AS c, {node('G', 'gene', 'gene_id', gene)} AS g, {node('H', 'hormone', 'hormone_id', 'c_mktsegment')} AS h
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey),
ent AS (
  SELECT base, paper_id, c AS node_id, 'cell' AS entity_type, {cell} AS normalized_id, {cell_label} AS preferred, s_name AS mention FROM x
  UNION ALL SELECT base, paper_id, g, 'gene', {gene}, {gene_label}, p_name FROM x
  UNION ALL SELECT base, paper_id, h, 'hormone', c_mktsegment, c_mktsegment, c_mktsegment FROM x),
rel AS (
  SELECT base, paper_id, pub_year, c AS subject_id, 'secreted' AS predicate, g AS object_id, 'cell' AS subject_type, 'gene' AS object_type, NULL AS ctx FROM x WHERE flag = 'R'
  UNION ALL SELECT base, paper_id, pub_year, g, 'activation', c, 'gene', 'cell', NULL FROM x WHERE flag = 'A'
  UNION ALL SELECT base, paper_id, pub_year, h, 'binding', g, 'hormone', 'gene', c FROM x WHERE flag = 'NO'),
ev AS (SELECT DISTINCT 'R-' || substr(sha256(subject_id || chr(31) || predicate || chr(31) || object_id), 1, 24) AS edge_id, * FROM rel),
e AS (SELECT edge_id AS id, subject_id, subject_type, predicate, object_id, object_type, count(DISTINCT paper_id) AS paper_count,
        count(*) AS evidence_count, count(ctx) AS context_evidence_count FROM ev GROUP BY ALL),
names AS (SELECT node_id, preferred AS alias, 2 AS kind FROM ent UNION ALL SELECT node_id, mention, 1 FROM ent UNION ALL SELECT node_id, normalized_id, 0 FROM ent),
a AS (SELECT node_id, lower(alias) AS alias_norm, min(alias) AS alias, max(kind) AS alias_kind, count(*) AS count FROM names GROUP BY 1, 2),
l AS (SELECT node_id, alias AS label, alias_norm AS label_norm FROM a QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY alias_kind DESC, count DESC, length(alias), lower(alias), alias) = 1),
n0 AS (SELECT node_id AS id, entity_type, min(normalized_id) AS normalized_id, count(*) AS occurrence_count, count(DISTINCT paper_id) AS paper_count, count(DISTINCT base) AS chunk_count FROM ent GROUP BY 1, 2),
n AS (SELECT n0.*, label, label_norm,
    (SELECT count(*) FROM e WHERE subject_id = n0.id) + (SELECT count(*) FROM e WHERE object_id = n0.id) AS relation_count,
    (SELECT count(*) FROM e WHERE object_id = n0.id AND predicate <> 'binding') AS incoming_count,
    (SELECT count(*) FROM e WHERE subject_id = n0.id AND predicate <> 'binding') AS outgoing_count,
    (SELECT count(*) FROM ev WHERE ctx = n0.id) AS context_count
  FROM n0 JOIN l ON l.node_id = n0.id)
"""
