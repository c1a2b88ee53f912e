"""Every query of the library by name: the Spark callable, and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemolake.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AREAS = [
    "operators.analytics",
    "operators.logs",
    "operators.lifecycle",
    "operators.timeline",
    "operators.search",
    "operators.similarity",
    "operators.causal",
    "operators.clusters",
    "operators.conflict",
    "operators.graph",
    "operators.knowledge",
    "operators.filters",
    "operators.questions",
    "operators.ingest",
    "sources.files",
    "streaming.streams",
    "functions.sql",
]


def query(name: str, tables: str, sql: str | None = None, **params):
    """Register an operator as a query over the named tables with the given parameters; the operator itself stays general."""

    def add(operator):
        names = tables.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return operator(*[views.view(spark, sf_dir, t) for t in names], **params)

        QUERIES[name] = run
        if sql is not None:
            used = [t for t in names if t in views.DUCKDB]
            given = ", ".join(f"{t} AS ({views.DUCKDB[t]})" for t in used)
            body = sql.strip().replace("{AS_OF}", f"TIMESTAMP '{views.AS_OF}'")
            recursive = "RECURSIVE " if body.startswith("WITH RECURSIVE ") else ""
            more = body[5 + len(recursive) :] if body.startswith("WITH ") else None
            if not given:
                ORACLES[name] = body
            elif more is not None:
                ORACLES[name] = f"WITH {recursive}{given}, {more}"
            else:
                ORACLES[name] = f"WITH {given}\n{body}"
        return operator

    return add


def load() -> None:
    """Import every area, which registers its queries."""
    for area in AREAS:
        importlib.import_module(f"mnemolake.{area}")
