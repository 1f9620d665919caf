"""Rule-based risk bands: ordered predicates -> value, compiled into ``when`` chains (no UDFs)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import units


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class RuleSet:
    """Ordered (predicate, value) pairs with a default; the first true predicate wins (NULL counts as false)."""

    rules: tuple[tuple[Column, object], ...]
    default: object = None

    def to_column(self) -> Column:
        expr = None
        for pred, value in self.rules:
            v = value if isinstance(value, Column) else F.lit(value)
            expr = F.when(pred, v) if expr is None else expr.when(pred, v)
        d = self.default if isinstance(self.default, Column) else F.lit(self.default)
        return d if expr is None else expr.otherwise(d)


# ---- D6: FRAX percentage band -------------------------------------------------------------------------------
# Fixed values: < 10 Low, 10..20 (both ends) Moderate, > 20 High, missing -> empty string.
FRAX_LOW, FRAX_HIGH = 10.0, 20.0


def frax_band(pct) -> Column:
    p = _c(pct)
    return RuleSet(((p < F.lit(FRAX_LOW), "Low"), (p <= F.lit(FRAX_HIGH), "Moderate"),
                    (p > F.lit(FRAX_HIGH), "High")), default="").to_column()


# ---- D7-D9: CAROC 10-year risk ------------------------------------------------------------------------------
# Fixed values (T-score thresholds high/low by sex and age band; age test is ``age < bound``; the last entry is
# the open band that also takes a missing age).
CAROC_AGE_BOUNDS = (60, 65, 70, 75, 80, 85, None)
CAROC_FEMALE = ((-2.5, -3.8), (-2.3, -3.7), (-1.9, -3.5), (-1.7, -3.2), (-1.2, -2.9), (-0.5, -2.6), (0.1, -2.2))
CAROC_MALE = ((-2.5, -3.9), (-2.5, -3.7), (-2.4, -3.7), (-2.3, -3.7), (-2.3, -3.8), (-2.1, -3.8), (-2.0, -3.8))
CAROC_FEMALE_CODE = 1
CAROC_MODIFIER_FRACTURES = ("ankle", "clavicle", "elbow", "femur", "wrist", "shoulder", "tibfib")
CAROC_OVERRIDE = ("hip", "spine")


def age_band(age) -> Column:
    """1-based index of the age band (``age < bound``); a missing age falls into the open last band."""
    a = _c(age)
    expr = None
    for i, bound in enumerate(CAROC_AGE_BOUNDS[:-1], start=1):
        cond = a < F.lit(float(bound))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(len(CAROC_AGE_BOUNDS)))


def _threshold(band: Column, female: Column, which: int) -> Column:
    fem = F.array(*[F.lit(p[which]) for p in CAROC_FEMALE])
    male = F.array(*[F.lit(p[which]) for p in CAROC_MALE])
    return F.element_at(F.when(female, fem).otherwise(male), band)


def caroc_thresholds(age="PatientAge", gender="PatientGender") -> tuple[Column, Column]:
    """(high, low) T-score thresholds: a table lookup by sex and age band (each input referenced once)."""
    band = age_band(age)
    female = F.coalesce(_c(gender) == F.lit(CAROC_FEMALE_CODE), F.lit(False))
    return _threshold(band, female, 0), _threshold(band, female, 1)


def _base_from(t: Column, high: Column, low: Column) -> Column:
    return F.when(t > high, F.lit(0)).when(t > low, F.lit(1)).when(t <= low, F.lit(2))


def _risk_from(base: Column) -> Column:
    """D8 + D9: one level up (below 2) for a risk factor, 2 for a hip or spine fracture."""
    factor = (F.col("oralster") == 1) | (F.col("obreak") > 1)
    for c in CAROC_MODIFIER_FRACTURES:
        factor = factor | (F.col(c) == 1)
    bump = F.coalesce(factor & (base < 2), F.lit(False)).cast("int")
    override = F.coalesce((F.col(CAROC_OVERRIDE[0]) == 1) | (F.col(CAROC_OVERRIDE[1]) == 1), F.lit(False))
    return F.when(override, F.lit(2)).otherwise(base + bump)


def caroc_base(tscore="bmdtest_tscore_fn", age="PatientAge", gender="PatientGender") -> Column:
    """0 above the high threshold, 1 above the low one, 2 at or below it, NULL for a missing T-score."""
    high, low = caroc_thresholds(age, gender)
    return _base_from(_c(tscore), high, low)


def caroc_risk(tscore="bmdtest_tscore_fn", age="PatientAge", gender="PatientGender") -> Column:
    """D7 + D8 (one level up for a risk factor) + D9 (hip or spine fracture -> 2), as one expression."""
    return _risk_from(caroc_base(tscore, age, gender))


def with_caroc_risk(df, out: str = "caroc_risk", tscore="bmdtest_tscore_fn", age="PatientAge",
                    gender="PatientGender"):
    """D7-D9 as staged projections: thresholds, then the base band, then modifier/override. Each stage refers to
    the previous one by column, so the generated code stays linear in the rule size (a single nested expression
    repeats the threshold and base sub-expressions and overflows the 64 KB method limit of whole-stage codegen)."""
    df = df.withColumns({"__caroc_band": age_band(age),
                         "__caroc_female": F.coalesce(_c(gender) == F.lit(CAROC_FEMALE_CODE), F.lit(False))})
    band, female = F.col("__caroc_band"), F.col("__caroc_female")
    df = df.withColumns({"__caroc_high": _threshold(band, female, 0), "__caroc_low": _threshold(band, female, 1)})
    df = df.withColumn("__caroc_base", _base_from(_c(tscore), F.col("__caroc_high"), F.col("__caroc_low")))
    df = df.withColumn(out, _risk_from(F.col("__caroc_base")))
    return df.drop("__caroc_band", "__caroc_female", "__caroc_high", "__caroc_low", "__caroc_base")


def fill_caroc_label(df, label: str = "bmdtest_10yr_caroc"):
    """F8: the rule fills the label only where it is missing."""
    df = with_caroc_risk(df, "__caroc_risk")
    return df.withColumn(label, F.coalesce(F.col(label), F.col("__caroc_risk")).cast("int")).drop("__caroc_risk")


# ---- D11/D12: second fracture within two years --------------------------------------------------------------
SECOND_FRACTURE_DAYS = 730


def abs_days_between(a, b) -> Column:
    """Whole days of |a - b|, floored, by seconds (datediff would ignore the time of day)."""
    secs = F.abs(F.timestamp_diff("SECOND", _c(b), _c(a)))
    return F.floor(secs / F.lit(86400)).cast("long")


def within_days(days, limit: int = SECOND_FRACTURE_DAYS) -> Column:
    """A missing day count gives False, not NULL."""
    return F.coalesce(_c(days) <= F.lit(limit), F.lit(False))


def _d(x) -> str:
    return f"{float(x)!r}D"


def _sql_definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, result type, SQL), from the same tables as the column expressions."""
    inches = f"(h > {_d(units.INCH_RANGE[0])} AND h < {_d(units.INCH_RANGE[1])})"
    pounds = f"w * {_d(units.LB_TO_KG)}"
    bands = []
    for lo, hi, limit in units.SUSPICION_BANDS:
        test = [f"w >= {_d(limit)} + {_d(units.SUSPICION_BUFFER)}"]
        test += [f"h > {_d(lo)}"] if lo is not None else []
        test += [f"h <= {_d(hi)}"] if hi is not None else []
        bands.append(f"WHEN {' AND '.join(test)} THEN {pounds}")

    def threshold(which: int) -> str:
        def by_age(table):
            cases = [f"WHEN age < {_d(b)} THEN {_d(v[which])}" for b, v in zip(CAROC_AGE_BOUNDS[:-1], table)]
            return f"CASE {' '.join(cases)} ELSE {_d(table[-1][which])} END"
        return f"CASE WHEN gender = {CAROC_FEMALE_CODE} THEN {by_age(CAROC_FEMALE)} ELSE {by_age(CAROC_MALE)} END"

    factors = " OR ".join(["oralster = 1", "obreak > 1", *(f"{c} = 1" for c in CAROC_MODIFIER_FRACTURES)])
    flags = ", ".join(f"{c} INT" for c in ("oralster", "obreak", *CAROC_MODIFIER_FRACTURES, *CAROC_OVERRIDE))
    override = " OR ".join(f"{c} = 1" for c in CAROC_OVERRIDE)
    return {
        "rf_lbs_to_kg": ("w DOUBLE", "DOUBLE", pounds),
        "rf_height_cm": ("h DOUBLE", "DOUBLE",
                         f"CASE WHEN h > {_d(units.METRE_RANGE[0])} AND h < {_d(units.METRE_RANGE[1])} THEN h * 100D "
                         f"WHEN {inches} THEN h * {_d(units.INCH_TO_CM)} WHEN h > {_d(units.CM_LOWER)} THEN h ELSE 0D END"),
        "rf_weight_kg": ("h DOUBLE, w DOUBLE", "DOUBLE", f"CASE WHEN {inches} THEN {pounds} ELSE w END"),
        "rf_weight_kg_suspicion": ("h DOUBLE, w DOUBLE", "DOUBLE",
                                   f"CASE WHEN {inches} THEN {pounds} {' '.join(bands)} ELSE w END"),
        "rf_bmi": ("h DOUBLE, w DOUBLE", "DOUBLE", "try_divide(w, power(h / 100D, 2D))"),
        "rf_frax_band": ("p DOUBLE", "STRING", f"CASE WHEN p < {_d(FRAX_LOW)} THEN 'Low' WHEN p <= {_d(FRAX_HIGH)} "
                                               f"THEN 'Moderate' WHEN p > {_d(FRAX_HIGH)} THEN 'High' ELSE '' END"),
        "rf_caroc_base": ("t DOUBLE, age DOUBLE, gender INT", "INT",
                          f"CASE WHEN t > {threshold(0)} THEN 0 WHEN t > {threshold(1)} THEN 1 "
                          f"WHEN t <= {threshold(1)} THEN 2 END"),
        "rf_caroc_risk": (f"base INT, {flags}", "INT",
                          f"CASE WHEN {override} THEN 2 WHEN ({factors}) AND base < 2 THEN base + 1 ELSE base END"),
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Expose the rules D1-D9 to SQL as temporary SQL functions (no Python UDF involved); returns their names."""
    definitions = _sql_definitions()
    for name, (parameters, kind, body) in definitions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return sorted(definitions)
