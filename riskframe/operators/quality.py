"""Projections, row filters, de-duplication and row identity (B*, C*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.stats import agg_row
from riskframe.session import input_partitions, materialize


class MissingColumnsError(ValueError):
    pass


# ---- B1-B5 --------------------------------------------------------------------------------------------------
def select_strict(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B1: select in the given order; a missing column is a hard error (as in the reference)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing columns: {missing}")
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B2."""
    return df.drop(*columns)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by map; names absent from the frame are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def cohort_filter(df: DataFrame, column: str, value) -> DataFrame:
    """Equality filter (pushed down to the scan by Catalyst)."""
    return df.filter(F.col(column) == F.lit(value))


def drop_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Drop rows where the predicate is true; a NULL predicate keeps the row (pandas mask semantics)."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


# ---- B6 / B7 ------------------------------------------------------------------------------------------------
def any_null(columns: Sequence[str]) -> Column:
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.col(c).isNull()
    return cond


def dropna_with_report(df: DataFrame, subset: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
    """Drop rows with any NULL; report before / after / removed counts from one aggregate."""
    cols = list(subset or df.columns)
    stats = agg_row(df, {"rows_before": F.count(F.lit(1)),
                         "rows_removed": F.sum(F.when(any_null(cols), 1).otherwise(0))})
    stats["rows_removed"] = int(stats["rows_removed"] or 0)
    stats["rows_after"] = int(stats["rows_before"]) - stats["rows_removed"]
    return df.dropna("any", subset=cols), stats


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None, dtype: str = "double") -> DataFrame:
    """B7 (first half): bad values become NULL instead of failing (``try_cast``)."""
    cols = list(columns or df.columns)
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS {dtype})") for c in cols})


def coerce_and_dropna(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Coerce every listed column to double, then drop rows that have a NULL in any of them."""
    cols = list(columns or df.columns)
    return coerce_numeric(df, cols).dropna("any", subset=cols)


# ---- B8 -----------------------------------------------------------------------------------------------------
def drop_label_value(df: DataFrame, label: str, value=0) -> DataFrame:
    """``df[label != value]`` keeps missing labels; Spark's ``!=`` would drop them, so use null-safe."""
    return df.filter(~F.col(label).eqNullSafe(F.lit(value)))


# ---- B9 -----------------------------------------------------------------------------------------------------
def sigma_filter(df: DataFrame, columns: Sequence[str], k: float = 3.0) -> tuple[DataFrame, list[dict]]:
    """Sequential k-sigma filter; each column's bounds use the sample std of the rows that survived the
    previous columns; bounds are strict. Each step is one aggregate whose bounds come back as literals, so the
    next step's predicate is pushed into the scan. A zero-variance column removes every row (as in the reference).
    """
    report = []
    out = df
    for c in columns:
        s = agg_row(out, {"mean": F.avg(c), "std": F.stddev_samp(c)})
        mean, std = s["mean"], s["std"]
        if mean is None or std is None:
            out = out.filter(F.lit(False))
            report.append({"column": c, "mean": mean, "std": std, "lower": None, "upper": None})
            continue
        lower, upper = mean - k * std, mean + k * std
        report.append({"column": c, "mean": mean, "std": std, "lower": lower, "upper": upper})
        out = out.filter((F.col(c) > F.lit(lower)) & (F.col(c) < F.lit(upper)))
    return out, report


# ---- B10-B13 ------------------------------------------------------------------------------------------------
def backfill_columns(df: DataFrame, features: Sequence[str], fill=0.0, keep: Sequence[str] = ()) -> DataFrame:
    """Add absent feature columns as constants, then fix the column order."""
    missing = {c: F.lit(fill).cast("double") for c in features if c not in df.columns}
    return df.withColumns(missing).select(*keep, *features)


def first_n(df: DataFrame, n: int, order_col: str = "row_seq") -> DataFrame:
    """The first n rows in file order (TakeOrderedAndProject: per-partition top-n, no full sort)."""
    return df.orderBy(order_col).limit(n)


def blank_strings_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Whitespace-only strings become NULL (opt-in)."""
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and (columns is None or f.name in columns)]
    return df.withColumns({c: F.when(F.trim(F.col(c)) == F.lit(""), F.lit(None)).otherwise(F.col(c)) for c in cols})


def above_threshold(p, threshold: float = 0.5) -> Column:
    """B13."""
    p = F.col(p) if isinstance(p, str) else p
    return p > F.lit(threshold)


# ---- C1-C3 --------------------------------------------------------------------------------------------------
def dedupe_first(df: DataFrame, key: str = "PatientId", order_col: str = "row_seq") -> DataFrame:
    """Keep the first row per key in file order (``order_col`` must be unique, e.g. the row sequence). Rows
    without a key count as one key, as in the reference, so the first of them stays.

    ``min(order_col)`` per key is a partial + final hash aggregate over two narrow columns, so a hot key is
    collapsed map-side before the shuffle; the survivors are then selected with a null-safe semi-join on
    ``(key, order_col)``, which hash-partitions on a unique pair and therefore cannot skew.
    """
    firsts = df.groupBy(F.col(key).alias("__key")).agg(F.min(order_col).alias("__first"))
    return df.join(firsts, df[key].eqNullSafe(firsts["__key"]) & (df[order_col] == firsts["__first"]), "left_semi")


def keep_max_per_key(df: DataFrame, key: str, value: str, tiebreak: str) -> DataFrame:
    """Keep the row with the highest ``value`` per key (NULL values last); ties go to the smallest ``tiebreak``.

    ``(key, tiebreak)`` must be unique; NULL keys form one key. The winner per key is an aggregate (partial
    aggregation absorbs hot keys), then a null-safe semi-join on the unique pair picks the row.
    """
    best = (df.groupBy(F.col(key).alias("__key"))
            .agg(F.min(F.struct(F.col(value).isNull().alias("missing"), (-F.col(value)).alias("neg"),
                                F.col(tiebreak).alias("tb"))).alias("best"))
            .select("__key", F.col("best.tb").alias("__tb")))
    return df.join(best, df[key].eqNullSafe(best["__key"]) & df[tiebreak].eqNullSafe(best["__tb"]), "left_semi")


def dense_row_numbers(df: DataFrame, order_col: str, out: str = "row_id", num_partitions: int | None = None) -> DataFrame:
    """Dense row numbers from 0 (as a fresh row index) in ``order_col`` order, without a single-partition window.

    Range-partition and sort within partitions, materialise (so partition contents are stable), count rows per
    partition (one small aggregate, one row per partition), then number locally: offset of the partition plus
    the position inside it, which ``monotonically_increasing_id`` encodes in its low 33 bits.
    """
    n = num_partitions or input_partitions(df)
    ranged = materialize(df.repartitionByRange(n, order_col).sortWithinPartitions(order_col), columnar=False)
    pid = F.spark_partition_id()
    placed = ranged.withColumns({"__pid": pid, "__pos": F.monotonically_increasing_id()
                                 - F.shiftleft(pid.cast("long"), 33)})
    counts = {r["__pid"]: r["n"] for r in placed.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, running = [], 0
    for p in sorted(counts):
        offsets.append((p, running))
        running += counts[p]
    # one row per partition of this stage, so its size is that of the stage's task list
    table = df.sparkSession.createDataFrame(offsets, "__pid int, __offset long")
    return (placed.join(F.broadcast(table), "__pid")
            .withColumn(out, F.col("__offset") + F.col("__pos")).select(*df.columns, out))
