"""Queries over the driver's tables, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from quarry.plans import answers, library, retrieval, service, texts

PARTS = (retrieval, texts, answers, library, service)


def flagship(spark, sf_dir):
    return retrieval.flagship(spark, sf_dir)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
