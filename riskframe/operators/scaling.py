"""Scaling (I1-I6): statistics from one aggregate, persisted as a tiny table, applied as literals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.stats import agg_row


@dataclass
class ScalerModel:
    """Fitted scaling statistics: per column (center, scale). Persisted as a small Parquet table."""

    kind: str
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (center, scale) in self.stats.items():
            if c in df.columns:
                out[c] = (F.col(c).cast("double") - F.lit(center)) / F.lit(scale)
        return df.withColumns(out)

    def inverse(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        """Back to original units."""
        out = {}
        for c, (center, scale) in self.stats.items():
            if c in df.columns and (cols is None or c in cols):
                out[c] = F.col(c) * F.lit(scale) + F.lit(center)
        return df.withColumns(out)

    def inverse_column(self, c: str, source: str | None = None):
        center, scale = self.stats[c]
        return F.col(source or c) * F.lit(scale) + F.lit(center)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.kind, c, a, b) for c, (a, b) in self.stats.items()],
                                     "kind string, feature string, center double, scale double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ScalerModel":
        rows = spark.read.parquet(path).collect()
        return cls(rows[0]["kind"] if rows else "standard", {r["feature"]: (r["center"], r["scale"]) for r in rows})


def fit_standard(df: DataFrame, cols: Sequence[str], population: bool = True) -> ScalerModel:
    """Z-score with the population std (sklearn / Keras); a zero std scales by 1."""
    sd = F.stddev_pop if population else F.stddev_samp
    s = agg_row(df, {f"{k}__{c}": f(F.col(c).cast("double")) for c in cols for k, f in (("m", F.avg), ("s", sd))})
    stats = {}
    for c in cols:
        m, v = s[f"m__{c}"], s[f"s__{c}"]
        stats[c] = (m if m is not None else 0.0, v if v else 1.0)
    return ScalerModel("standard", stats)


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> ScalerModel:
    """(x - min) / (max - min); a constant column maps to 0 (sklearn), not 0.5."""
    s = agg_row(df, {f"{k}__{c}": f(F.col(c).cast("double")) for c in cols for k, f in (("lo", F.min), ("hi", F.max))})
    stats = {}
    for c in cols:
        lo, hi = s[f"lo__{c}"], s[f"hi__{c}"]
        lo = lo if lo is not None else 0.0
        rng = (hi - lo) if hi is not None and hi != lo else 1.0
        stats[c] = (lo, rng)
    return ScalerModel("minmax", stats)


def scale(df: DataFrame, cols: Sequence[str], kind: str = "standard", fit_on: DataFrame | None = None,
          refit: bool = False, model: ScalerModel | None = None) -> tuple[DataFrame, ScalerModel]:
    """I1/I2/I4/I5/I6 entry point: ``model`` given -> transform only (I5); ``refit`` -> fit on this batch (I6);
    ``fit_on`` -> fit on that frame (e.g. the training split) and apply here."""
    if model is not None and not refit:
        return model.transform(df), model
    src = fit_on if fit_on is not None else df
    m = fit_standard(src, cols) if kind == "standard" else fit_minmax(src, cols)
    return m.transform(df), m
