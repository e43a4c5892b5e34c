"""Registering a query together with the SQL that checks it.

A query has a name, a column list, a Spark function and usually a SQL body. The column list gives both sides the
same names and comparable types: plain name for text, `:i` whole number, `:f` double at six decimals, `:t` time as
text, `:b` boolean.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    columns: list[tuple[str, str]]
    sql: str | None


# Short decimals often end in an exact 5 at the seventh place. Shifting the rounding points off the decimal grid
# keeps engines that sum in a different order from rounding such a value to different sides.
TIE_SHIFT = 0.0858

QUERIES: dict[str, Query] = {}
CTES: dict[str, str] = {}
STORED: set[str] = set()


def parse_columns(spec: str) -> list[tuple[str, str]]:
    return [(name, kind or "s") for name, _, kind in (c.partition(":") for c in spec.split())]


def query(name: str, spec: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")
        QUERIES[name] = Query(fn, parse_columns(spec), sql)
        return fn

    return register


def cte(name: str, sql: str, stored: bool = False) -> None:
    """A named part of the SQL; `stored` keeps the database from expanding it at each use."""
    CTES[name] = sql.strip()
    if stored:
        STORED.add(name)


def spark_result(q: Query, spark: SparkSession, folder: str) -> DataFrame:
    def shown(name: str, kind: str):
        c = F.col(name)
        out = {
            "s": lambda: c.cast("string"), "i": lambda: c.cast("long"), "b": lambda: c.cast("boolean"),
            "f": lambda: F.rint(c.cast("double") * 1e6 - TIE_SHIFT) / 1e6 + F.lit(0.0),
            "t": lambda: F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss"),
        }[kind]()
        return out.alias(name)

    return q.run(spark, folder).select([shown(n, k) for n, k in q.columns])


def _needed(sql: str) -> list[str]:
    """CTEs that `sql` names, directly or through others, in dependency order."""
    found: list[str] = []
    open_names: set[str] = set()  # a recursive table names itself

    def visit(text: str) -> None:
        words = set(re.findall(r"[a-z_0-9]+", text))
        for name, body in CTES.items():
            if name in words and name not in found and name not in open_names:
                open_names.add(name)
                visit(body)
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def oracle_text(q: Query) -> str:
    def shown(name: str, kind: str) -> str:
        return {
            "s": f"cast({name} as varchar)", "i": f"cast({name} as bigint)", "b": f"cast({name} as boolean)",
            "f": f"round(cast({name} as double) * 1e6 - {TIE_SHIFT}) / 1e6 + 0.0",
            "t": f"strftime(cast({name} as timestamp), '%Y-%m-%d %H:%M:%S')",
        }[kind] + f" AS {name}"

    parts = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in STORED else ''}({CTES[name]})" for name in _needed(q.sql))
    head = f"WITH RECURSIVE {parts}\n" if parts else ""
    return f"{head}SELECT {', '.join(shown(n, k) for n, k in q.columns)} FROM ({q.sql.strip()}) AS result"
