"""Catalog of registered queries: each has a Spark plan and (where SQL can say
it) an equivalent DuckDB oracle over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .oracle_adapters import with_adapters

# Comparison rounding: about twelve significant digits, by magnitude tier, so
# that float-sum order differences between engines do not show, while values
# with few exact decimals (sums / power-of-two counts) are kept exactly.
TIERS = [(1e15, -4), (1e12, -1), (1e9, 2), (1e6, 5), (1e3, 8), (1.0, 11)]
LAST_DIGITS = 12


def _scaled(c, d: int):
    # round-half-away-from-zero of c * 10^d, identical on both engines
    return (F.round(c * (10 ** d), 0) / (10 ** d)) if d >= 0 else (F.round(c / (10 ** -d), 0) * (10 ** -d))


def rounded(c):
    a = F.abs(c)
    out = None
    for lim, d in TIERS:
        out = F.when(a >= lim, _scaled(c, d)) if out is None else out.when(a >= lim, _scaled(c, d))
    return out.otherwise(_scaled(c, LAST_DIGITS))


def _sql_scaled(c: str, d: int) -> str:
    return f"(round({c} * {10 ** d}) / {10 ** d})" if d >= 0 else f"(round({c} / {10 ** -d}) * {10 ** -d})"


def sql_rounded(c: str) -> str:
    arms = " ".join(f"WHEN abs({c}) >= {lim} THEN {_sql_scaled(c, d)}" for lim, d in TIERS)
    return f"(CASE {arms} ELSE {_sql_scaled(c, LAST_DIGITS)} END)"


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    adapters: tuple[str, ...] = ()
    floats: tuple[str, ...] = ()
    ids: tuple[str, ...] = field(default_factory=tuple)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql
        if self.floats:
            repl = ", ".join(f"{sql_rounded(c)} AS {c}" for c in self.floats)
            body = f"SELECT * REPLACE ({repl}) FROM (\n{body}\n) AS q"
        return with_adapters(body, self.adapters)


REGISTRY: dict[str, Query] = {}


def finish(df: DataFrame) -> DataFrame:
    """Comparison-friendly output: doubles rounded to ~10 significant digits (both sides)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(rounded(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def register(name: str, sql: str | None = None, adapters=(), floats=(), ids=()):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir))

        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, sql, tuple(adapters), tuple(floats), tuple(ids))
        return fn

    return deco
