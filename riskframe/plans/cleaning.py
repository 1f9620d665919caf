"""Composite cleaning jobs P1-P6: one function per reference variant, driven by a ``CleaningSpec``.

Shape of every cleaner at scale:
  scan (pruned to the spec's columns) -> dedupe (one shuffle on the id, skew-safe) -> unit repair (narrow)
  -> [materialise once into the shared checkpoint folder]
  -> ONE aggregate pass for all statistics that do not depend on each other (means, per-gender means, modes)
  -> narrow projection with the statistics as literals
  -> (only if a statistic depends on filled values, e.g. the BMI mean) one more aggregate pass
  -> narrow projection, rule labels, filter -> the cleaned table written once (downstream jobs scan it).
No step groups raw rows into a single task, and no statistic table is joined back: all are literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import rules, units
from riskframe.operators.impute import (GroupMeanFill, MeanFill, ModeFill, TwoStepMeanFill, ZeroFill,
                                        fit_apply_all)
from riskframe.operators.quality import dedupe_first, drop_label_value, select_strict
from riskframe.session import materialize, release
from riskframe.spec import CAROC, FRAX_DLL, FRAX_WEB, MAIN, OLD, RAW, CleaningSpec


def prepare(df: DataFrame, spec: CleaningSpec, suspicion: bool = False, stage: bool = True,
             extra: tuple[str, ...] = ()) -> DataFrame:
    """B1 + C1 + D2/D3(/D4) (+ materialise)."""
    df = select_strict(df, [spec.order_col, *spec.columns, *extra])
    df = dedupe_first(df, spec.id_col, spec.order_col)
    df = units.to_metric(df, spec.height_col, spec.weight_col, suspicion=suspicion)
    return materialize(df, f"clean-{spec.name}") if stage else df


def _finish(df: DataFrame, spec: CleaningSpec, extra: tuple[str, ...] = (), bmi: bool = True,
            stage: bool = True) -> DataFrame:
    """Select the output columns and write the cleaned table once (the job's product, as the reference's CSV).

    Every downstream job (profiles, splits, models) then starts from a plain Parquet scan with pushed-down
    filters and pruned columns, instead of re-planning and re-evaluating the whole imputation/rule expression
    chain for each of its passes."""
    cols = [*spec.columns, *extra] + (["bmi"] if bmi else [])
    out = df.select(*cols)
    if not stage:
        return out
    out = materialize(out, f"cleaned-{spec.name}")
    release(df, f"clean-{spec.name}")
    return out


def clean_raw(df: DataFrame, spec: CleaningSpec = RAW, stage: bool = True) -> DataFrame:
    """Pound-suspicion rule on; zeros of height/weight -> mean (zeros included), then NULLs -> mean of the
    result; other numeric NULLs -> mean; nominal -> mode; special -> 0. One statistics pass."""
    df = prepare(df, spec, suspicion=True, stage=stage)
    hw = (spec.height_col, spec.weight_col)
    others = [c for c in spec.numeric if c not in hw]
    df, _ = fit_apply_all(df, [TwoStepMeanFill(hw[0]), TwoStepMeanFill(hw[1]), MeanFill(others),
                               ModeFill(spec.nominal)])
    df = ZeroFill(spec.special).apply(df)
    return _finish(df, spec, bmi=False, stage=stage)


def _bmi_fill(df: DataFrame, spec: CleaningSpec) -> DataFrame:
    """D5 + F7 (second statistics pass: the BMI mean depends on the filled height and weight)."""
    df = df.withColumn("bmi", units.bmi(spec.height_col, spec.weight_col))
    df, _ = TwoStepMeanFill("bmi").fit_apply(df)
    return df


def clean_main(df: DataFrame, spec: CleaningSpec = MAIN, stage: bool = True) -> DataFrame:
    """Numeric NULL and 0 -> global mean; mode; zero; BMI with its two-step fill."""
    df = prepare(df, spec, stage=stage)
    df, _ = fit_apply_all(df, [MeanFill(spec.numeric, nulls=True, zeros=True), ModeFill(spec.nominal)])
    df = ZeroFill(spec.special).apply(df)
    return _finish(_bmi_fill(df, spec), spec, stage=stage)


def clean_old(df: DataFrame, spec: CleaningSpec = OLD, stage: bool = True) -> DataFrame:
    """height/weight zero -> mean then NULL -> mean; BMI computed and never filled; then the remaining
    numeric NULLs -> mean; mode; zero. One statistics pass."""
    df = prepare(df, spec, stage=stage)
    hw = (spec.height_col, spec.weight_col)
    others = [c for c in spec.numeric if c not in hw]
    df, _ = fit_apply_all(df, [TwoStepMeanFill(hw[0]), TwoStepMeanFill(hw[1]), MeanFill(others),
                               ModeFill(spec.nominal)])
    df = df.withColumn("bmi", units.bmi(spec.height_col, spec.weight_col))
    df = ZeroFill(spec.special).apply(df)
    return _finish(df, spec, stage=stage)


def _gender_clean(df: DataFrame, spec: CleaningSpec) -> DataFrame:
    """F4 (per-gender means, statistics before any fill) + F5 in one pass, F6, then D5 + F7."""
    df, _ = fit_apply_all(df, [GroupMeanFill(spec.numeric, spec.gender_col, (1, 2)), ModeFill(spec.nominal)])
    df = ZeroFill(spec.special).apply(df)
    return _bmi_fill(df, spec)


def clean_caroc(df: DataFrame, spec: CleaningSpec = CAROC, stage: bool = True) -> DataFrame:
    """Per-gender imputation, BMI, CAROC rule label where missing (D7-D9, F8), drop label 0."""
    df = _gender_clean(prepare(df, spec, stage=stage), spec)
    label = spec.targets[0]
    df = rules.fill_caroc_label(df, label)
    # write the labelled table, then filter the scan: the label filter becomes a Parquet pushed filter instead of
    # being pushed below the rule projections (where it would evaluate the whole rule chain a second time)
    return drop_label_value(_finish(df, spec, stage=stage), label, 0)


def clean_frax_web(df: DataFrame, spec: CleaningSpec = FRAX_WEB, stage: bool = True) -> DataFrame:
    """P5: as P4 without T-score and rule label; the FRAX band comes with the input."""
    df = _gender_clean(prepare(df, spec, stage=stage), spec)
    return _finish(df, spec, stage=stage)


FRAX_BAND_COLUMNS = {"Frax_No_BMD_RiskLevel": "CalcFraxNoBMD", "Frax_BMD_RiskLevel": "CalcFraxWithBMD"}


def clean_frax_dll(df: DataFrame, spec: CleaningSpec = FRAX_DLL, stage: bool = True) -> DataFrame:
    """D6 bands computed right after the select, before dedupe and imputation; then as P5."""
    df = select_strict(df, [spec.order_col, *spec.columns])
    df = df.withColumns({k: rules.frax_band(v) for k, v in FRAX_BAND_COLUMNS.items()})
    extra = tuple(FRAX_BAND_COLUMNS)
    df = prepare(df, spec, stage=stage, extra=extra)
    df = _gender_clean(df, spec)
    return _finish(df, spec, extra=extra, stage=stage)


CLEANERS = {"raw": clean_raw, "main": clean_main, "old": clean_old, "caroc": clean_caroc,
            "frax_web": clean_frax_web, "frax_dll": clean_frax_dll}


def with_frax_web_label(df: DataFrame) -> DataFrame:
    """Stand-in for the web export's ``FraxRiskLevel`` column: the band of the no-BMD percentage."""
    return df.withColumn("FraxRiskLevel", rules.frax_band("CalcFraxNoBMD"))


def label_counts_by_gender(clean: DataFrame, label: str = "bmdtest_10yr_caroc") -> DataFrame:
    """E9 on the cleaned CAROC table: rows per (gender, label) with the mean BMI and T-score per cell."""
    return (clean.groupBy("PatientGender", label)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.avg("bmi").alias("avg_bmi"),
                 F.avg("bmdtest_tscore_fn").alias("avg_tscore")))
