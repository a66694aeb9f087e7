"""Registries: functions by name, for Python and SQL, and handlers by event type."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class Registry:
    """Things by name; a name is taken once."""

    def __init__(self) -> None:
        self.items: dict[str, Callable] = {}

    def register(self, name: str) -> Callable:
        def add(f: Callable) -> Callable:
            if name in self.items:
                raise ValueError(f"{name} is registered already")
            self.items[name] = f
            return f

        return add

    def __getitem__(self, name: str) -> Callable:
        if name not in self.items:
            raise KeyError(f"{name} is not one of {sorted(self.items)}")
        return self.items[name]


class Functions(Registry):
    """Arrow UDFs that SQL may call by their name."""

    def register_all(self, spark: SparkSession) -> None:
        for name, f in self.items.items():
            spark.udf.register(name, f)


FUNCTIONS = Functions()


@FUNCTIONS.register("shout")
@F.pandas_udf(StringType())
def _shout(x: pd.Series) -> pd.Series:
    return x.str.upper() + "!"


class Handlers(Registry):
    """Columns by event type, made into one chain of conditions."""

    def add(self, kind: str, build: Callable[[], Column]) -> None:
        self.register(kind)(build)

    def column(self, kind: Column, otherwise: Column) -> Column:
        out: Column | None = None
        for name, build in self.items.items():
            out = F.when(kind == name, build()) if out is None else out.when(kind == name, build())
        return otherwise if out is None else out.otherwise(otherwise)
