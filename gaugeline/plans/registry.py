"""Registry of named queries: a Spark callable and, where SQL can say it, DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(name: str, text: str | None = None) -> Callable[[Runner], Runner]:
    def keep(run: Runner) -> Runner:
        QUERIES[name] = run
        if text is not None:
            ORACLES[name] = text
        return run

    return keep


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def mid(s: str) -> str:
    """DuckDB text: median of a sorted list."""
    return f"(0.5 * ({s}[(len({s}) + 1) // 2] + {s}[len({s}) // 2 + 1]))"


def sorted_list(value: str, keep: str = "true") -> str:
    return f"list_sort(list({value}) FILTER (WHERE {keep}))"
