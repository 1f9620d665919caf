"""DuckDB oracle SQL for the registered queries (same names as ``catalog.queries``).

Each statement restates the operator independently in SQL (window dedupe, explicit CASE chains, scalar
subqueries for statistics) over the same ``patients`` CTE.
"""

from __future__ import annotations

from catalog.sqlparts import (bmi_fill_parts, caroc_sql, cte, frax_sql, gender_fill_parts, mode_sql, prepared_sql,
                              rd, round_cols)
from riskframe.spec import CAROC, FRAX_DLL, FRAX_WEB, MAIN, OLD, RAW

from catalog.common import ORACLES


def _out(spec, bmi=True, extra=()):
    return [*spec.columns, *extra] + (["bmi"] if bmi else [])


def _dbl(spec, bmi=True):
    return [c for c in spec.numeric] + (["bmi"] if bmi else [])


def _final(spec, src, bmi=True, extra=(), more_dbl=()):
    cols = _out(spec, bmi, extra)
    dbl = set(_dbl(spec, bmi)) | set(more_dbl)
    sel = ", ".join(f"{rd(c)} AS {c}" if c in dbl else c for c in cols)
    return f"SELECT {sel} FROM {src}"


# ---- P4 CAROC ----------------------------------------------------------------------------------------------
_CAROC = cte(*prepared_sql(CAROC), *gender_fill_parts(CAROC),
             f"lab AS (SELECT filled.* REPLACE (CAST(coalesce(bmdtest_10yr_caroc, {caroc_sql()}) AS INT) "
             f"AS bmdtest_10yr_caroc) FROM filled)",
             "caroc AS (SELECT * FROM lab WHERE bmdtest_10yr_caroc IS DISTINCT FROM 0)")

ORACLES["p4_caroc_clean"] = _CAROC + _final(CAROC, "caroc")
ORACLES["p4_caroc_label_counts"] = _CAROC + """
SELECT PatientGender, bmdtest_10yr_caroc, count(*) AS n, """ + rd("avg(bmi)") + """ AS avg_bmi,
       """ + rd("avg(bmdtest_tscore_fn)") + """ AS avg_tscore
FROM caroc GROUP BY PatientGender, bmdtest_10yr_caroc"""


# ---- P1 raw ------------------------------------------------------------------------------------------------
def _two_step_and_modes(spec, src: str, out: str) -> list[str]:
    """height/weight: zero -> mean (zeros incl.), NULL -> mean after that; others NULL -> mean; nominal mode."""
    others = [c for c in spec.numeric if c not in ("bmdtest_height", "bmdtest_weight")]
    s1 = ", ".join(f"avg({c}) AS m1_{c}" for c in ("bmdtest_height", "bmdtest_weight"))
    z = ", ".join(f"CASE WHEN {c} = 0 THEN m1_{c} ELSE {c} END AS {c}" for c in ("bmdtest_height", "bmdtest_weight"))
    s2 = ", ".join([f"avg({c}) AS m2_{c}" for c in ("bmdtest_height", "bmdtest_weight")] +
                   [f"avg({c}) AS m2_{c}" for c in others])
    f = ", ".join([f"coalesce({c}, m2_{c}) AS {c}" for c in (*("bmdtest_height", "bmdtest_weight"), *others)] +
                  [f"coalesce({c}, {mode_sql(c, src)}) AS {c}" for c in spec.nominal] +
                  [f"coalesce({c}, 0) AS {c}" for c in spec.special])
    return [f"{out}_s1 AS (SELECT {s1} FROM {src})",
            f"{out}_z AS (SELECT {src}.* REPLACE ({z}) FROM {src}, {out}_s1)",
            f"{out}_s2 AS (SELECT {s2} FROM {out}_z)",
            f"{out} AS (SELECT {out}_z.* REPLACE ({f}) FROM {out}_z, {out}_s2)"]


ORACLES["p1_raw_clean"] = cte(*prepared_sql(RAW, suspicion=True), *_two_step_and_modes(RAW, "metric", "rawc")) + \
    _final(RAW, "rawc", bmi=False)

ORACLES["p3_old_clean"] = cte(*prepared_sql(OLD), *_two_step_and_modes(OLD, "metric", "oldf"),
                              "oldc AS (SELECT *, CASE WHEN bmdtest_height = 0 THEN NULL ELSE bmdtest_weight / "
                              "pow(bmdtest_height / CAST(100 AS DOUBLE), CAST(2 AS DOUBLE)) END AS bmi FROM oldf)") + \
    _final(OLD, "oldc")


# ---- P2 main -----------------------------------------------------------------------------------------------
def _main_parts():
    st = ", ".join(f"avg({c}) AS m_{c}" for c in MAIN.numeric)
    f = ", ".join([f"CASE WHEN {c} IS NULL OR {c} = 0 THEN m_{c} ELSE {c} END AS {c}" for c in MAIN.numeric] +
                  [f"coalesce({c}, {mode_sql(c, 'metric')}) AS {c}" for c in MAIN.nominal] +
                  [f"coalesce({c}, 0) AS {c}" for c in MAIN.special])
    return [f"mst AS (SELECT {st} FROM metric)", f"mf AS (SELECT metric.* REPLACE ({f}) FROM metric, mst)",
            *bmi_fill_parts("mf", "mainc")]


ORACLES["p2_main_clean"] = cte(*prepared_sql(MAIN), *_main_parts()) + _final(MAIN, "mainc")

# ---- P5 / P6 FRAX ------------------------------------------------------------------------------------------
ORACLES["p5_frax_web_clean"] = cte(
    f"pw AS (SELECT *, {frax_sql('CalcFraxNoBMD')} AS FraxRiskLevel FROM patients)",
    *prepared_sql(FRAX_WEB, src="pw"), *gender_fill_parts(FRAX_WEB)) + _final(FRAX_WEB, "filled")

_BANDS = ("Frax_No_BMD_RiskLevel", "Frax_BMD_RiskLevel")
ORACLES["p6_frax_dll_clean"] = cte(
    f"pb AS (SELECT *, {frax_sql('CalcFraxNoBMD')} AS Frax_No_BMD_RiskLevel, "
    f"{frax_sql('CalcFraxWithBMD')} AS Frax_BMD_RiskLevel FROM patients)",
    *prepared_sql(FRAX_DLL, src="pb", extra=", Frax_No_BMD_RiskLevel, Frax_BMD_RiskLevel"),
    *gender_fill_parts(FRAX_DLL)) + _final(FRAX_DLL, "filled", extra=_BANDS, more_dbl=FRAX_DLL.targets)
