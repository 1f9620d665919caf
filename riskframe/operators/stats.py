"""Statistics-then-apply: one distributed aggregate, a bounded result on the driver, applied as literals.

This is the Spark ML ``Estimator``/``Model`` split: ``fit`` runs a single ``agg`` whose output size is fixed by
the number of statistics (never by the number of rows); ``transform`` inlines the values as literals, so the
apply step is a narrow projection inside whole-stage codegen with no join at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def agg_row(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """Run one global aggregate with all statistics; return them as a dict (a single row)."""
    if not exprs:
        return {}
    row = df.agg(*[e.alias(k) for k, e in exprs.items()]).collect()[0]
    return row.asDict()


def lit_or_null(v, dtype: str = "double") -> Column:
    return F.lit(None).cast(dtype) if v is None else F.lit(v).cast(dtype)

