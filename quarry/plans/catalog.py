"""All registered queries of the core and their SQL."""

from __future__ import annotations

from quarry.plans import reading, store, upkeep


def queries():
    return reading.QUERIES | store.QUERIES | upkeep.QUERIES


def oracle_sql():
    return reading.SQL | store.SQL | upkeep.SQL
