"""Joins, set operations, limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complement(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` not in ``sample`` (null-safe left anti join on the row identity; a hash split's complement
    can instead use the complementary predicate and skip the join)."""
    other = sample.select(sample[key].alias("__key"))
    return df.join(other, df[key].eqNullSafe(other["__key"]), "left_anti")


def left_join_features(df: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Left equi-join of a derived feature table (computed by another job) on the row identity.
    AQE turns it into a broadcast join when the feature table is measured small, else sort-merge."""
    return df.join(features, key, "left")


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """T4: union all by column name; columns missing in a frame are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def top_n(df: DataFrame, col: str, n: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """T5: top n by ``col`` descending (TakeOrderedAndProject: per-partition top n, then a merge of n x partitions)."""
    return df.orderBy(F.desc(col), *tiebreak).limit(n)
