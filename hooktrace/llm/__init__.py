"""Operators for preparing training text. Nothing else in the library imports this package."""

from __future__ import annotations


def queries() -> dict:
    """The named queries of this package."""
    from hooktrace.llm.catalog import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those of them that SQL can express."""
    from hooktrace.llm.catalog import ORACLES

    return dict(ORACLES)
