"""Query registry: a Spark callable, its output columns, and the equivalent SQL.

Output columns are written as ``name:kind`` and shaped alike on both sides:
f double rounded to 6 places, g double as 7-digit scientific text, i bigint,
s text, d date text, b boolean.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def rounded(x: Column) -> Column:
    """``x`` to 6 places, as ``round`` gives it. Away from halves the nearest whole number of millionths is the same and far cheaper
    than a decimal a value."""
    scaled = x * F.lit(1e6)
    near = F.rint(scaled)
    return F.when((F.abs(scaled) < 1e12) & (F.abs(scaled - near) < 0.499), near / F.lit(1e6)).otherwise(F.round(x, 6))


def spark_shape(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "f":
        c = rounded(c.cast("double")) + F.lit(0.0)
    elif kind == "g":
        c = F.when(c.isNotNull(), F.format_string("%.6e", c.cast("double") + F.lit(0.0)))
    elif kind == "i":
        c = c.cast("bigint")
    elif kind == "d":
        c = F.date_format(c, "yyyy-MM-dd")
    elif kind == "s":
        c = c.cast("string")
    elif kind == "b":
        c = c.cast("boolean")
    return c.alias(name)


def sql_shape(name: str, kind: str) -> str:
    body = {
        "f": f"round(CAST({name} AS DOUBLE), 6) + 0.0",
        "g": f"format('{{:.6e}}', CAST({name} AS DOUBLE) + 0.0)",
        "i": f"CAST({name} AS BIGINT)",
        "d": f"strftime(CAST({name} AS DATE), '%Y-%m-%d')",
        "s": f"CAST({name} AS VARCHAR)",
        "b": f"CAST({name} AS BOOLEAN)",
    }[kind]
    return f"{body} AS {name}"


def with_ctes(ctes: list[str], body: str) -> str:
    seen = list(dict.fromkeys(ctes))
    return (f"WITH {', '.join(seen)} " if seen else "") + body


def query(name: str, columns: str, sql: str | None = None, ctes: list[str] | None = None) -> Callable[[Run], Run]:
    fields = [tuple(c.split(":")) for c in columns.split()]

    def register(build: Run) -> Run:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            # As in ``local_session``: wide projections run faster outside whole-stage code, whatever session calls.
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            return build(spark, sf_dir).select(*[spark_shape(n, k) for n, k in fields])

        text = None
        if sql is not None:
            shaped = ", ".join(sql_shape(n, k) for n, k in fields)
            text = with_ctes([*(ctes or []), f"answer AS ({sql})"], f"SELECT {shaped} FROM answer")
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, run, text)
        return build

    return register
