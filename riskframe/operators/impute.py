"""Imputation (F1-F8) as statistics-then-apply steps.

Each imputer exposes ``stat_exprs()`` (aggregate expressions) and ``apply(df, stats)`` (a narrow projection with
the statistics inlined as literals). A pipeline can merge the ``stat_exprs`` of several imputers into a single
aggregate so the data is scanned once for all of them; ``fit_apply`` is the one-step convenience.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.stats import agg_row, lit_or_null


def _k(*parts) -> str:
    return "__".join(str(p) for p in parts)


class _Imputer:
    def stat_exprs(self) -> dict[str, Column]:
        raise NotImplementedError

    def apply(self, df: DataFrame, stats: dict) -> DataFrame:
        raise NotImplementedError

    def more_stats(self, df: DataFrame) -> dict:
        """Statistics that are no single aggregate; most imputers have none."""
        return {}

    def fit_apply(self, df: DataFrame) -> tuple[DataFrame, dict]:
        stats = agg_row(df, self.stat_exprs()) | self.more_stats(df)
        return self.apply(df, stats), stats


def modes(df: DataFrame, cols: Sequence[str], kind: str = "double") -> dict:
    """The most frequent value of each column, the smallest on ties: counts by column and value, then one row a column."""
    wide = df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c in cols])
    counts = (wide.unpivot([], [f"`{c}`" for c in cols], "feature", "value").where("value IS NOT NULL")
              .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best")).collect()
    return {r["feature"]: r["best"]["value"] for r in best}


@dataclass
class MeanFill(_Imputer):
    """F1 (NULL -> mean), F2 (0 -> mean, the mean includes the zeros), F3 (both, one mean)."""

    columns: Sequence[str]
    nulls: bool = True
    zeros: bool = False

    def stat_exprs(self):
        return {_k("mean", c): F.avg(c) for c in self.columns}

    def apply(self, df, stats):
        out = {}
        for c in self.columns:
            m = lit_or_null(stats[_k("mean", c)])
            col = F.col(c)
            if self.zeros:
                col = F.when(col == F.lit(0), m).otherwise(col)
            if self.nulls:
                col = F.coalesce(col, m)
            out[c] = col
        return df.withColumns(out)


@dataclass
class GroupMeanFill(_Imputer):
    """NULL and 0 -> mean of the row's group; rows whose group is NULL (or not listed) are left untouched.

    With the group values known (gender 1 and 2 in the reference) the per-group means are conditional
    averages inside the same global aggregate as the other statistics: no groupBy, no join.
    """

    columns: Sequence[str]
    group_col: str = "PatientGender"
    groups: Sequence[int] = (1, 2)

    def stat_exprs(self):
        g = F.col(self.group_col)
        return {_k("gmean", c, v): F.avg(F.when(g == F.lit(v), F.col(c))) for c in self.columns for v in self.groups}

    def apply(self, df, stats):
        g = F.col(self.group_col)
        out = {}
        for c in self.columns:
            col = F.col(c)
            missing = col.isNull() | (col == F.lit(0))
            expr = col
            for v in reversed(list(self.groups)):
                expr = F.when((g == F.lit(v)) & missing, lit_or_null(stats[_k("gmean", c, v)])).otherwise(expr)
            out[c] = expr
        return df.withColumns(out)


def group_mean_fill_any(df: DataFrame, columns: Sequence[str], group_col: str) -> DataFrame:
    """F4 for an open set of groups: NULL and 0 -> mean of the row's group, by an equi-join with the table of group
    means, whose broadcast AQE decides from its measured size. Rows without a group, and rows of a group without a
    mean (all its values are NULL), stay as they are."""
    stats = df.filter(F.col(group_col).isNotNull()).groupBy(group_col).agg(
        *[F.avg(c).alias(_k("gmean", c)) for c in columns])
    joined = df.join(stats, group_col, "left")
    out = {}
    for c in columns:
        mean = F.col(_k("gmean", c))
        missing = F.col(c).isNull() | (F.col(c) == 0)
        out[c] = F.when(missing & mean.isNotNull(), mean).otherwise(F.col(c))
    return joined.withColumns(out).select(*df.columns)


@dataclass
class ModeFill(_Imputer):
    """NULL -> most frequent value, the smallest value on ties. The values are counted by group, so a column with
    many distinct values needs no buffer that holds them all."""

    columns: Sequence[str]

    def stat_exprs(self):
        return {}

    def more_stats(self, df):
        kinds = dict(df.dtypes)
        text = [c for c in self.columns if kinds[c] in ("string", "date", "timestamp", "boolean")]
        found = {_k("mode", c): None for c in self.columns}
        for cols, kind in (([c for c in self.columns if c not in text], "double"), (text, "string")):
            if cols:
                found |= {_k("mode", c): v for c, v in modes(df, cols, kind).items()}
        return found

    def apply(self, df, stats):
        types = dict(df.dtypes)
        return df.withColumns({c: F.coalesce(F.col(c), lit_or_null(stats[_k("mode", c)], types[c]))
                               for c in self.columns})


@dataclass
class ZeroFill(_Imputer):
    """NULL -> 0 (no statistics)."""

    columns: Sequence[str]

    def stat_exprs(self):
        return {}

    def apply(self, df, stats=None):
        return df.fillna(0, subset=list(self.columns))


@dataclass
class TwoStepMeanFill(_Imputer):
    """zeros -> mean1 (over non-null values, zeros included), then NULLs -> mean2 recomputed after the first
    step. mean2 = (sum + n_zero * mean1) / n_nonnull, so one aggregate of (sum, n_nonnull, n_zero) gives both."""

    column: str
    value: Column | None = None   # an expression to impute (e.g. the BMI computed on the fly)

    def _v(self) -> Column:
        return self.value if self.value is not None else F.col(self.column)

    def stat_exprs(self):
        v = self._v()
        return {_k("sum", self.column): F.sum(v), _k("n", self.column): F.count(v),
                _k("nzero", self.column): F.sum(F.when(v == F.lit(0), 1).otherwise(0))}

    @staticmethod
    def means(stats: dict, column: str) -> tuple[float | None, float | None]:
        s, n, z = stats[_k("sum", column)], stats[_k("n", column)], stats[_k("nzero", column)] or 0
        if not n:
            return None, None
        m1 = s / n
        return m1, (s + z * m1) / n

    def apply(self, df, stats):
        m1, m2 = self.means(stats, self.column)
        v = self._v()
        filled = F.coalesce(F.when(v == F.lit(0), lit_or_null(m1)).otherwise(v), lit_or_null(m2))
        return df.withColumn(self.column, filled)


def fit_apply_all(df: DataFrame, imputers: Sequence[_Imputer]) -> tuple[DataFrame, dict]:
    """Apply several imputers whose statistics do not depend on each other, with one aggregate pass (and one more for
    modes, which are counted by value)."""
    exprs = {}
    for imp in imputers:
        exprs.update(imp.stat_exprs())
    stats = agg_row(df, exprs)
    for imp in imputers:
        stats |= imp.more_stats(df)
    for imp in imputers:
        df = imp.apply(df, stats)
    return df, stats
