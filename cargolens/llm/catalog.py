"""Queries and oracle SQL of this subpackage, for the entry file."""
from __future__ import annotations

from .queries import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
