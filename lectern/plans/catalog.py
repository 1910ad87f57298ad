"""Registered queries of the retrieval engine and their DuckDB equivalents."""

from lectern.plans import answers, conversation, forms, ingest, papers, search, services

QUERIES: dict = {**search.QUERIES, **ingest.QUERIES, **answers.QUERIES, **papers.QUERIES, **forms.QUERIES, **services.QUERIES, **conversation.QUERIES}
ORACLE_SQL: dict = {**search.ORACLE_SQL, **ingest.ORACLE_SQL, **answers.ORACLE_SQL, **papers.ORACLE_SQL, **forms.ORACLE_SQL, **services.ORACLE_SQL, **conversation.ORACLE_SQL}
