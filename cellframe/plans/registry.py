"""Registration of queries: one Spark callable and one oracle SQL text per name.

The ``cols`` string fixes the result's columns and types for both sides, e.g.
``"cell_id:l sb:d name:s"`` (l whole number, d double rounded to six places, s text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.demo import Demo, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def _parse(cols: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in cols.split()]


def _shape(df: DataFrame, cols: str) -> DataFrame:
    out = []
    for name, kind in _parse(cols):
        c = F.col(name)
        if kind == "l":
            c = c.cast("long")
        elif kind == "d":
            # adding zero turns a negative zero into zero
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def _shape_sql(sql: str, cols: str, uses: str) -> str:
    out = []
    for name, kind in _parse(cols):
        if kind == "l":
            out.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        elif kind == "d":
            out.append(f'round(CAST("{name}" AS DOUBLE), {DIGITS}) + CAST(0 AS DOUBLE) AS "{name}"')
        else:
            out.append(f'CAST("{name}" AS VARCHAR) AS "{name}"')
    ctes = view_sql(*uses.split())
    # extra CTEs of the query itself come before a line '----'
    if "----" in sql:
        own, sql = sql.split("----")
        ctes.append(own.strip().rstrip(","))
    head = f"WITH RECURSIVE {', '.join(ctes)} " if ctes else ""
    return f"{head}SELECT {', '.join(out)} FROM ({sql.strip()}) result_"


def query(name: str, cols: str, sql: str | None = None, *, uses: str = ""):
    """Register ``fn(demo) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Demo], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _shape(fn(Demo(spark, sf_dir)), cols)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _shape_sql(sql, cols, uses)
        return fn

    return register
