"""Composite preparation jobs: P7 (model preparation chain), P8 (fracture-type consolidation + hold-out),
P9 (second-fracture proxy dataset), P10 (feature-analysis report)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import rules, scalar
from riskframe.operators import encode, profile, quality, sampling, scaling
from riskframe.session import materialize

FRACTURE_TYPES = ("ankle", "clavicle", "elbow", "femur", "wrist", "tibfib")
# regression preparation: categorical features one-hot encoded with the first level dropped (fixed list)
REG_CATEGORICAL = ("parentbreak", "alcohol", "ptunsteady", "wasfractdue2fall", "ptfall", "clavicle", "shoulder",
                   "elbow", "femur", "wrist", "tibfib")


def model_prep(clean: DataFrame, scale_cols: Sequence[str] = ("PatientAge", "bmi"), fit_scope: str = "all",
               test_pct: int = 20, seed: int = 42, categorical: Sequence[str] = REG_CATEGORICAL,
               levels: dict | None = None) -> tuple[DataFrame, dict]:
    """Missing report (E5) -> dropna (B6) -> 3-sigma height then weight (B9) -> drop ankle fractures
    -> one-hot, first level dropped (G2) -> interaction terms on the unscaled inputs (D16) -> z-score (I1) ->
    hash split (H1). ``fit_scope='all'`` scales with statistics of all rows (reference parity, S13);
    ``'train'`` fits them on the training split only."""
    report = {"missing": profile.missing_report(clean)}
    df, report["dropna"] = quality.dropna_with_report(clean)
    df, report["sigma"] = quality.sigma_filter(df, ["bmdtest_height", "bmdtest_weight"])
    df = quality.drop_where(df, F.col("ankle") == 1).drop("ankle")
    df, report["levels"] = encode.one_hot(df, list(categorical), levels=levels, drop_first=True,
                                          prefix="pt_response_", float_names=True)
    inter = {"Age*Gender": F.col("PatientAge") * F.col("PatientGender"),
             "Age*bmi": F.col("PatientAge") * F.col("bmi"),
             "Gender*bmi": F.col("PatientGender") * F.col("bmi")}
    df = encode.append_columns(df, inter)
    df = sampling.with_split(df, "PatientId", test_pct, seed)
    df = materialize(df, "model-prep")
    fit_on = df if fit_scope == "all" else df.filter(F.col("split") == "train")
    scaler = scaling.fit_standard(fit_on, list(scale_cols))
    report["scaler"] = scaler
    return scaler.transform(df), report


def fracture_consolidation(clean: DataFrame, fraction: float = 0.9, seed: int = 786,
                           ids: Sequence[str] = ("PatientId",)) -> DataFrame:
    """Dropna -> 3-sigma -> melt the six fracture columns -> keep each patient's highest ``fractured`` row
    (ties by fracture name) -> 90 % modelling sample + the complement as unseen data (tagged ``part``)."""
    df = clean.dropna()
    df, _ = quality.sigma_filter(df, ["bmdtest_height", "bmdtest_weight"])
    keep = [c for c in df.columns if c not in FRACTURE_TYPES]
    long = encode.melt(df, keep, list(FRACTURE_TYPES), "fracture_type", "fractured")
    best = quality.keep_max_per_key(long, "PatientId", "fractured", "fracture_type")
    return best.withColumn("part", F.when(sampling.in_fraction("PatientId", fraction, seed), "data").otherwise("unseen"))


# fixed column contract of the proxy-variable input
PROXY_COLUMNS = ("PatientAge", "PatientGender", "obreak_frac_count", "whereliv", "ptunsteady", "oralster",
                 "obreak_hip", "parentbreak", "alcohol", "ptfall", "wtcurr_lbs", "smoke", "marital", "arthritis",
                 "diabetes", "education")


def proxy_dataset(df: DataFrame, first: str = "obreak_date", second: str = "datebone") -> DataFrame:
    """Days between the two fracture dates (D11), second fracture within two years (D12, missing -> False),
    date columns dropped (B2), contract columns selected (B1), fracture count NULL -> 0 (F6)."""
    days = rules.abs_days_between(first, second)
    out = df.withColumn("second_IFR", rules.within_days(days))
    out = quality.drop_columns(out, [first, second])
    out = quality.select_strict(out, ["PatientId", *PROXY_COLUMNS, "second_IFR"])
    return out.fillna(0, subset=["obreak_frac_count"])


def feature_report(clean: DataFrame, features: Sequence[str], target: str = "bmdtest_tscore_fn",
                   group: str = "PatientGender") -> dict[str, DataFrame]:
    """P10: the report sections as tables (describe, correlation, profile overall / by group, correlation with
    the target, category shares, histograms, box statistics, binned scatter)."""
    feats = list(features)
    return {
        "describe": profile.describe(clean, feats),
        "correlation": profile.correlation_matrix(clean, feats),
        "profile": profile.profile(clean, feats, stage="post"),
        "profile_by_group": profile.profile(clean, feats, group=group, stage="post"),
        "target_correlation": profile.correlation_with(clean, target, [c for c in feats if c != target]),
        "gender_share": profile.category_share(clean, group),
        "age_histogram": profile.histogram(clean, "PatientAge", 40),
        "bmi_histogram_by_gender": profile.auto_histogram_by_group(clean, "bmi", group),
        "box_weight": profile.box_stats(clean, "bmdtest_weight"),
        "scatter_age_tscore": profile.binned_scatter(clean, "PatientAge", target, 20),
    }


def report_long(sections: dict[str, DataFrame]) -> DataFrame:
    """All sections of a report as one long table (section, row as JSON) for a single sink."""
    parts = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
                       .alias("row")) for name, df in sections.items()]
    return reduce(DataFrame.unionByName, parts)


__all__ = ["model_prep", "fracture_consolidation", "proxy_dataset", "feature_report", "report_long", "scalar"]
