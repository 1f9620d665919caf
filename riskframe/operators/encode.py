"""Encoding and reshaping (G1-G10) and feature-preparation switches.

Category levels of a one-hot encoding are fitted state: the distinct values, at most ``max_levels`` per column (each
becomes a column of the result, so there must be an exact bound), applied as literal comparisons. Label codes have
no such bound: they are a table that is joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.quality import dense_row_numbers
from riskframe.operators.stats import agg_row


class TooManyLevelsError(ValueError):
    pass


def fit_levels(df: DataFrame, cols: Sequence[str], max_levels: int = 1000) -> dict[str, list]:
    """Sorted distinct non-null values per column, at most ``max_levels`` of each; more are an error, since each
    level becomes a column.

    One pass: a column per row of (position, value, ...) with only its own value set, distinct, and at most one row
    over the bound fetched. The count is exact, so the same table always passes or always fails.
    """
    cols = list(cols)
    pairs = F.array(*[F.struct(F.lit(i).alias("at"), *[(F.col(f"`{c}`") if i == j else F.lit(None)).cast(t).alias(f"v{j}")
                                                      for j, (c, t) in enumerate((x, dict(df.dtypes)[x]) for x in cols)])
                      for i in range(len(cols))])
    distinct = df.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    rows = distinct.limit(len(cols) * (max_levels + 1) + 1).collect()
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        if r[f"v{r['at']}"] is not None:
            out[cols[r["at"]]].append(r[f"v{r['at']}"])
    too_many = [c for c in cols if len(out[c]) > max_levels]
    if too_many:
        raise TooManyLevelsError(f"more than {max_levels} levels in {too_many}")
    return {c: sorted(v) for c, v in out.items()}


def level_name(prefix: str, value, float_names: bool = False) -> str:
    if float_names and isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{prefix}_{float(value)}"
    return f"{prefix}_{value}"


def one_hot(df: DataFrame, cols: Sequence[str], levels: Mapping[str, list] | None = None, drop_first: bool = False,
            prefix: Mapping[str, str] | str | None = None, float_names: bool = False,
            max_levels: int = 1000) -> tuple[DataFrame, dict[str, list]]:
    """One 0/1 column per level named ``<prefix>_<level>``; NULL -> all zeros; source dropped.

    ``levels`` fitted elsewhere (e.g. on a reference table, G3) are applied as given; levels absent from the
    input still produce (all-zero) columns, so the output schema depends only on the fitted state.
    """
    lv = dict(levels) if levels is not None else fit_levels(df, cols, max_levels)
    new = {}
    for c in cols:
        p = prefix.get(c, c) if isinstance(prefix, Mapping) else (f"{prefix}{c}" if prefix else c)
        use = lv[c][1:] if drop_first else lv[c]
        for v in use:
            new[level_name(p, v, float_names)] = F.when(F.col(c) == F.lit(v), F.lit(1)).otherwise(F.lit(0))
    return df.withColumns(new).drop(*cols), lv


def label_encode(df: DataFrame, col: str, codes: DataFrame | None = None,
                 out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sorted distinct values -> 0..n-1; NULL and values absent from fitted ``codes`` (level, code) get NULL.

    Any number of levels: the codes are a table numbered by a distributed sort, and a left join applies them (AQE
    broadcasts a small one and splits a hot level's partition)."""
    if codes is None:
        codes = dense_row_numbers(df.select(F.col(col).alias("level")).filter(F.col("level").isNotNull()).distinct(),
                                  "level", "code")
    joined = df.join(codes, df[col] == codes["level"], "left").drop("level")
    name = out or col
    rest = [c for c in df.columns if c != name]
    return joined.select(*rest, F.col("code").cast("int").alias(name)), codes


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var_name: str = "variable",
         value_name: str = "value") -> DataFrame:
    """Wide -> long (narrow ``Expand``, no shuffle)."""
    return df.unpivot(list(ids), list(values), var_name, value_name)


def append_columns(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """Column-wise append of same-row features - a projection, never a join."""
    return df.withColumns(dict(cols))


def sort_desc(df: DataFrame, col: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Descending sort with an explicit tie-break (range-partitioned distributed sort)."""
    return df.orderBy(F.desc(col), *tiebreak)


def pivot_wide(long_df: DataFrame, index: str, columns: str, value: str, values: Sequence | None = None) -> DataFrame:
    """Transpose a small long result into a wide view (``groupBy.pivot`` with known values)."""
    g = long_df.groupBy(index)
    return (g.pivot(columns, list(values)) if values is not None else g.pivot(columns)).agg(F.first(value))


def feature_target(df: DataFrame, features: Sequence[str], target: str, vector: bool = False,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Feature / target split; ``vector=True`` assembles a Spark ML ``features`` vector."""
    out = df.select(*keep, *features, F.col(target).cast("double").alias("label"))
    if vector:
        from pyspark.ml.feature import VectorAssembler
        out = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(out)
    return out


def binary_target(col: str, level) -> Column:
    """One one-hot level used as a binary target."""
    return (F.col(col) == F.lit(level)).cast("double")


# ---- N-series ------------------------------------------------------------------------------------------------
def bin_numeric(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bins (0..bins-1) from one min/max aggregate; the last bin is closed."""
    s = agg_row(df, {f"{k}__{c}": f(F.col(c).cast("double")) for c in cols for k, f in (("lo", F.min), ("hi", F.max))})
    out = {}
    for c in cols:
        lo, hi = s[f"lo__{c}"], s[f"hi__{c}"]
        if lo is None:
            out[f"{c}_bin"] = F.lit(None).cast("long")
            continue
        if hi == lo:
            out[f"{c}_bin"] = F.when(F.col(c).isNotNull(), F.lit(0).cast("long"))
            continue
        raw = F.floor((F.col(c).cast("double") - F.lit(lo)) / F.lit((hi - lo) / bins)).cast("long")
        out[f"{c}_bin"] = F.least(raw, F.lit(bins - 1).cast("long"))
    return df.withColumns(out)


def low_variance_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> list[str]:
    """Columns whose sample variance is <= threshold (one aggregate)."""
    s = agg_row(df, {c: F.var_samp(F.col(c).cast("double")) for c in cols})
    return [c for c in cols if s[c] is None or s[c] <= threshold]


def drop_low_variance(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> DataFrame:
    return df.drop(*low_variance_columns(df, cols, threshold))


def collinear_drops(corr_long: list[tuple[str, str, float]], target_corr: Mapping[str, float],
                    threshold: float = 0.9) -> list[str]:
    """For each pair with |r| > threshold, drop the member less correlated with the target (driver-side
    over the k x k matrix, which is bounded by the column count, not the rows)."""
    drop: set[str] = set()
    for a, b, r in sorted(corr_long):
        if a >= b or r is None or a in drop or b in drop:
            continue
        if abs(r) > threshold:
            ta, tb = abs(target_corr.get(a) or 0.0), abs(target_corr.get(b) or 0.0)
            drop.add(b if ta >= tb else a)
    return sorted(drop)


def with_roles(df: DataFrame, categorical: Sequence[str] = (), numeric: Sequence[str] = ()) -> DataFrame:
    """Declared roles stored in the column metadata."""
    out = {c: F.col(c).alias(c, metadata={"role": "categorical"}) for c in categorical}
    out.update({c: F.col(c).alias(c, metadata={"role": "numeric"}) for c in numeric})
    return df.withColumns(out)
