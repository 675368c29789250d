"""The registered queries and their SQL twins."""

from orderlake.plans import analyses, marts, runs, streams, tables, texts

MODULES = [marts, runs, analyses, tables, texts, streams]
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
