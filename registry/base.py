"""Query registration: one Spark function, one SQL text, one output schema.

The schema string lists ``name:kind``; kinds are s string, b boolean, i integer, d date,
fN double rounded to N decimals (f alone is 6).  The same casts are applied to both
sides, so results compare by value.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry.sources_sql import with_tables
from tickloom.sources.derived import Tables


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    columns: str
    sql: str | None

    def dataframe(self, spark, folder: str) -> DataFrame:
        return shape(self.run(Tables(spark, folder)), self.columns)

    def oracle(self) -> str | None:
        return None if self.sql is None else with_tables(shape_sql(self.sql, self.columns))


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = Query(fn, columns, sql)
        return fn

    return add


def parse(columns: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in columns.split()]


def shape(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in parse(columns):
        c = F.col(name)
        if kind == "i":
            c = c.cast("long")
        elif kind == "b":
            c = c.cast("boolean")
        elif kind in "sd":
            c = c.cast("string")
        else:
            p = float(10 ** int(kind[1:] or 6))
            c = F.rint(c.cast("double") * p) / p + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def shape_sql(sql: str, columns: str) -> str:
    out = []
    for name, kind in parse(columns):
        if kind == "i":
            c = f"CAST(\"{name}\" AS BIGINT)"
        elif kind == "b":
            c = f"CAST(\"{name}\" AS BOOLEAN)"
        elif kind in "sd":
            c = f"CAST(\"{name}\" AS VARCHAR)"
        else:
            p = f"{10 ** int(kind[1:] or 6)}e0"
            c = f"round_even(CAST(\"{name}\" AS DOUBLE) * {p}, 0) / {p} + 0e0"
        out.append(f"{c} AS \"{name}\"")
    return f"SELECT {', '.join(out)} FROM ({sql}) AS result"
