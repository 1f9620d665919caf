"""Shared registry and helpers for the registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    """Register a Spark query (and optionally its oracle SQL) under ``name``."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c) -> Column:
    """Round a double to 6 decimals the same way the oracle does: round(x * 1e6) / 1e6, half away from zero
    on the binary value (Spark's ``round(x, 6)`` rounds the shortest decimal string instead, which disagrees on
    exact ties), with -0.0 normalised to 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    scaled = F.round(c * F.lit(1e6), 0)
    return F.when(scaled == F.lit(0.0), F.lit(0.0)).otherwise(scaled / F.lit(1e6))


def rnd(df: DataFrame) -> DataFrame:
    """Round every double/float column (top level) to 6 decimals (see ``r6``)."""
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: r6(c) for c in cols}) if cols else df
