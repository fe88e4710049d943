"""Registry of queries with their oracle SQL, and the input tables of one run."""
from __future__ import annotations

import re
from functools import cached_property
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixtures import VIEWS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Named DuckDB sub-queries the oracles share; written apart from the Spark operators.
STEPS: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def step(name: str, sql: str) -> None:
    STEPS[name] = sql


def expand(sql: str, recursive: bool = False) -> str:
    """Prefix a statement with every named sub-query it refers to."""
    known = {**VIEWS, **STEPS}
    order: list[str] = []
    busy: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:fx|ox)_\w+", text):
            if name in known and name not in order and name not in busy:
                busy.add(name)
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql.strip()
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({known[n].strip()})" for n in order) + "\n" + sql.strip()


class Tables:
    """The parquet tables of one directory and the fixture views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        text = expand(text)
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                self(t).createOrReplaceTempView(t)
        for n, df in frames.items():
            df.createOrReplaceTempView(n)
        return self.spark.sql(text)

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    @cached_property
    def mails(self) -> DataFrame:
        att = F.filter(F.split("attachments_csv", r"\|"), lambda a: a != "")
        return self.view("fx_emails").withColumn("attachments", att).drop("attachments_csv")

    @cached_property
    def docs(self) -> DataFrame:
        # The view is built from a few small files and would reach extraction as one task;
        # texts from a real store arrive in many splits and need no such step.
        return self.view("fx_docs").repartition(2 * self.spark.sparkContext.defaultParallelism, "path")
