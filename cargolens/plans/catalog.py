"""All registered queries. Importing the modules below fills the registry."""
from __future__ import annotations

from . import extraction, gateway, inputs, lifecycle, mails, queues, running  # noqa: F401
from .registry import ORACLES, QUERIES, Tables, expand


def run(name, spark, sf_dir):
    return QUERIES[name](Tables(spark, sf_dir))


def queries():
    return {n: (lambda spark, sf_dir, n=n: run(n, spark, sf_dir)) for n in QUERIES}


def oracle_sql():
    return {n: expand(sql, recursive=True) for n, sql in ORACLES.items()}
