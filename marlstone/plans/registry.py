"""Registry of queries over driver tables, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .stand_ins import Tables, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _wide(df: DataFrame) -> DataFrame:
    """Integers as long and decimals as double, so that a result has one schema whatever engine made it."""
    narrow = [c for c, t in df.dtypes if t in ("int", "smallint", "tinyint")]
    exact = [c for c, t in df.dtypes if t.startswith("decimal") or t == "float"]
    return df.withColumns({c: df[c].cast("long") for c in narrow} | {c: df[c].cast("double") for c in exact})


def query(sql: str | None = None, name: str | None = None):
    """Register a function of ``Tables`` under its name, and its SQL twin."""

    def register(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is there already")
        QUERIES[key] = lambda spark, sf_dir: _wide(f(Tables(spark, sf_dir)))
        if sql:
            ORACLES[key] = duck(sql)
        return f

    return register
