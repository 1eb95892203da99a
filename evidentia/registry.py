"""Queries of the engine's own operators, by name."""

from __future__ import annotations

from evidentia.queries import documents, fixtures


def queries():
    return documents.QUERIES | fixtures.QUERIES


def oracle_sql():
    return documents.ORACLE | fixtures.ORACLE


def entry(spark, sf_dir):
    return documents.verify_rule(spark, sf_dir)
