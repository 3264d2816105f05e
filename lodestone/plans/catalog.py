"""All queries of the engine over the test tables, and their SQL equivalents."""

from lodestone.plans import graph_queries, pipeline_queries, table_queries

QUERIES = {**graph_queries.QUERIES, **table_queries.QUERIES, **pipeline_queries.QUERIES}
ORACLE_SQL = {**graph_queries.ORACLE_SQL, **table_queries.ORACLE_SQL, **pipeline_queries.ORACLE_SQL}
