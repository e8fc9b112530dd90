"""Every query of the core, with its SQL where SQL can say it."""

from __future__ import annotations

from tuffstone.functions.text import with_blanks_stripped
from tuffstone.plans import advisory_queries, boot_queries, content_queries, data_queries, ingest_queries, kernel_queries, key_queries, package_queries, report_queries, scan_queries

MODULES = [data_queries, advisory_queries, ingest_queries, content_queries, package_queries, kernel_queries, key_queries, boot_queries, report_queries, scan_queries]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: with_blanks_stripped(sql) for m in MODULES for name, sql in m.ORACLE.items()}
