"""Every query of the library's own operators, with the SQL that checks it."""

from thermalis.plans import exposure_queries, index_queries, model_queries, text_queries

QUERIES: dict = index_queries.QUERIES | text_queries.QUERIES | exposure_queries.QUERIES | model_queries.QUERIES
ORACLE_SQL: dict = index_queries.ORACLE_SQL | text_queries.ORACLE_SQL | exposure_queries.ORACLE_SQL | model_queries.ORACLE_SQL
