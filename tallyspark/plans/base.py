"""What the query modules share: the registry, table access, inline fixtures in both languages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver's tables by name, and the session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


class Fixture:
    """A few literal rows, as a DataFrame and as a common table expression."""

    def __init__(self, name: str, schema: str, rows: Sequence[tuple]):
        self.name, self.schema, self.rows = name, schema, list(rows)

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def cte(self) -> str:
        kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INT", "double": "DOUBLE", "boolean": "BOOLEAN"}
        names, types = zip(*(x.split() for x in self.schema.split(", ")), strict=True)
        cells = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in self.rows)
        cast = ", ".join(f"{n}::{kinds[k]} AS {n}" for n, k in zip(names, types, strict=True))
        return f"{self.name} AS (SELECT {cast} FROM (VALUES {cells}) AS x({', '.join(names)}))"


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool) or not isinstance(v, str):
        return str(v)
    return "'" + v.replace("'", "''") + "'"
