"""Sampling, splitting, rebalancing (H1-H8).

Splits are deterministic hash predicates on the row identity: ``md5(id ':' seed)`` -> first 32 bits -> bucket.
They need no shuffle, give the same rows on every re-run and after executor loss (unlike ``randomSplit`` on an
unordered input), and can be restated in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.stats import agg_row


def _md5(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.lit(str(seed))))


def hash_unit(id_col: str, seed: int) -> Column:
    """A 32-bit unsigned integer from md5(id ':' seed); a NULL id counts as the empty text, so its row is in one
    part of every split."""
    h = _md5(id_col, seed)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def hash_bucket(id_col: str, seed: int, buckets: int = 100) -> Column:
    return hash_unit(id_col, seed) % F.lit(buckets)


def hash_split(df: DataFrame, id_col: str, test_pct: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """H1: (train, test) with test = bucket < test_pct of 100."""
    b = hash_bucket(id_col, seed)
    return df.filter(b >= F.lit(test_pct)), df.filter(b < F.lit(test_pct))


def with_split(df: DataFrame, id_col: str, test_pct: int = 20, seed: int = 42, col: str = "split") -> DataFrame:
    """H1 as a label column (train / test)."""
    return df.withColumn(col, F.when(hash_bucket(id_col, seed) < F.lit(test_pct), "test").otherwise("train"))


def three_way_split(df: DataFrame, id_col: str, test_pct: int = 20, val_pct: int = 20, seeds=(2, 3),
                    col: str = "split") -> DataFrame:
    """H2: test from seed 1; validation = val_pct of the remainder from seed 2 (0.64 / 0.16 / 0.20)."""
    b1, b2 = hash_bucket(id_col, seeds[0]), hash_bucket(id_col, seeds[1])
    return df.withColumn(col, F.when(b1 < F.lit(test_pct), "test").when(b2 < F.lit(val_pct), "validation")
                         .otherwise("train"))


def in_fraction(id_col: str, fraction: float, seed: int = 786) -> Column:
    """Whether a row is in the ``fraction_sample``; its negation is the complement, without a join."""
    return hash_bucket(id_col, seed, 10000) < F.lit(int(round(fraction * 10000)))


def fraction_sample(df: DataFrame, id_col: str, fraction: float, seed: int = 786) -> DataFrame:
    """H3: without replacement, exact repeatability; resolution 1/10000."""
    return df.filter(in_fraction(id_col, fraction, seed))


def fixed_size_sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """H4: n rows with the smallest hash (TakeOrderedAndProject: per-partition top-n, no full sort)."""
    h = _md5(id_col, seed)
    return df.orderBy(h, F.col(id_col)).limit(n)


def kfold(df: DataFrame, id_col: str, k: int = 10, seed: int = 0, col: str = "fold") -> DataFrame:
    """H5: fold = hash % k (usable as ``CrossValidator(foldCol=...)``)."""
    return df.withColumn(col, (hash_unit(id_col, seed) % F.lit(k)).cast("int"))


def ordered_validation(df: DataFrame, order_col: str, fraction: float = 0.2, col: str = "is_validation") -> DataFrame:
    """H8: the LAST ``fraction`` of rows in ``order_col`` order (Keras validation_split), from one count and one
    approximate-free quantile of the order column: rows whose rank > floor(n * (1 - fraction))."""
    from riskframe.operators.quality import dense_row_numbers
    n = df.count()
    split_at = int(n * (1.0 - fraction))
    numbered = dense_row_numbers(df, order_col, "__rn")
    return numbered.withColumn(col, F.col("__rn") >= F.lit(split_at)).drop("__rn")


def class_weights(df: DataFrame, label: str, col: str = "weight") -> DataFrame:
    """H7: sklearn 'balanced' weights n / (k * n_c), n and k over the rows with a label; rows without one get NULL.
    The class counts are a table that is joined, whatever the number of classes."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    s = agg_row(counts, {"n": F.sum("__n"), "k": F.count(F.lit(1))})
    weights = counts.select(label, (F.lit(float(s["n"] or 0)) / (F.lit(s["k"]) * F.col("__n"))).alias(col))
    return df.join(weights, label, "left").select(*df.columns, col)
