"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations


def queries() -> dict:
    from skyquad.llm.registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from skyquad.llm.registry import SQL

    return dict(SQL)
