"""Names of the registered queries."""

from __future__ import annotations

from . import market


def queries() -> dict:
    return dict(market.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(market.SQL)
