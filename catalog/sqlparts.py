"""Building blocks for the DuckDB oracle SQL (independent re-statements of each operator in plain SQL).

All decimal literals are cast to DOUBLE so both engines compare in binary floating point.
"""

from __future__ import annotations

from riskframe.fixtures import patients_cte_sql
from riskframe.spec import CleaningSpec


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def cte(*parts: str) -> str:
    """The patients CTE followed by more named CTEs: ``cte("a AS (...)", "b AS (...)")``."""
    body = patients_cte_sql().rstrip()
    for p in parts:
        body += ",\n" + p
    return body + "\n"


def mode_sql(col: str, src: str) -> str:
    return f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)"


def height_sql(h: str = "bmdtest_height") -> str:
    return (f"CASE WHEN {h} > {d(1)} AND {h} < {d(2.2)} THEN {h} * {d(100)} "
            f"WHEN {h} > {d(50)} AND {h} < {d(84)} THEN {h} * {d(2.54)} "
            f"WHEN {h} > {d(125)} THEN {h} ELSE {d(0)} END")


def imperial_sql(h: str = "bmdtest_height") -> str:
    return f"coalesce(NOT ({h} > {d(1)} AND {h} < {d(2.2)}) AND {h} > {d(50)} AND {h} < {d(84)}, false)"


LB = d(0.45359237)

# band table restated for the oracle: (lower exclusive, upper inclusive, limit)
_BANDS = [(None, 152.4, 56.7), (152.4, 154.9, 56.7), (152.4, 157.5, 59.0), (157.5, 160.0, 61.2),
          (160.0, 162.6, 63.5), (162.6, 165.1, 65.8), (165.1, 167.6, 68.0), (167.6, 170.2, 70.3),
          (170.2, 172.7, 72.6), (172.7, 175.3, 74.8), (175.3, 177.8, 77.1), (177.8, 180.3, 79.4),
          (180.3, 182.9, 81.6), (182.9, 185.4, 83.9), (185.4, 188.0, 86.2), (188.0, 190.5, 88.5),
          (190.5, None, 90.7)]


def suspicion_sql(h: str, w: str) -> str:
    parts = []
    for lo, hi, lim in _BANDS:
        cond = [f"{w} >= {d(lim)} + {d(30)}"]
        if lo is not None:
            cond.insert(0, f"{h} > {d(lo)}")
        if hi is not None:
            cond.insert(0, f"{h} <= {d(hi)}")
        parts.append(f"WHEN {' AND '.join(cond)} THEN {w} * {LB}")
    return "CASE " + " ".join(parts) + f" ELSE {w} END"


def weight_sql(h: str = "bmdtest_height", w: str = "bmdtest_weight", suspicion: bool = False) -> str:
    metric = suspicion_sql(h, w) if suspicion else w
    return f"CASE WHEN {imperial_sql(h)} THEN {w} * {LB} ELSE {metric} END"


def bmi_sql(h: str = "bmdtest_height", w: str = "bmdtest_weight") -> str:
    return f"CASE WHEN {h} = 0 THEN NULL ELSE {w} / pow({h} / {d(100)}, {d(2)}) END"


def frax_sql(p: str) -> str:
    return (f"CASE WHEN {p} < {d(10)} THEN 'Low' WHEN {p} <= {d(20)} THEN 'Moderate' "
            f"WHEN {p} > {d(20)} THEN 'High' ELSE '' END")


_F = [(60, -2.5, -3.8), (65, -2.3, -3.7), (70, -1.9, -3.5), (75, -1.7, -3.2), (80, -1.2, -2.9), (85, -0.5, -2.6),
      (None, 0.1, -2.2)]
_M = [(60, -2.5, -3.9), (65, -2.5, -3.7), (70, -2.4, -3.7), (75, -2.3, -3.7), (80, -2.3, -3.8), (85, -2.1, -3.8),
      (None, -2.0, -3.8)]


def _thr(table, i: int, age: str) -> str:
    s = "CASE"
    for bound, hi, lo in table:
        v = (hi, lo)[i]
        s += f" WHEN {age} < {d(bound)} THEN {d(v)}" if bound is not None else f" ELSE {d(v)} END"
    return s


def caroc_sql(t="bmdtest_tscore_fn", age="PatientAge", g="PatientGender") -> str:
    fem = f"coalesce({g} = 1, false)"
    high = f"(CASE WHEN {fem} THEN {_thr(_F, 0, age)} ELSE {_thr(_M, 0, age)} END)"
    low = f"(CASE WHEN {fem} THEN {_thr(_F, 1, age)} ELSE {_thr(_M, 1, age)} END)"
    base = f"(CASE WHEN {t} > {high} THEN 0 WHEN {t} > {low} THEN 1 WHEN {t} <= {low} THEN 2 END)"
    factor = ("(oralster = 1 OR obreak > 1 OR ankle = 1 OR clavicle = 1 OR elbow = 1 OR femur = 1 OR wrist = 1 "
              "OR shoulder = 1 OR tibfib = 1)")
    bumped = f"(CASE WHEN coalesce({factor} AND {base} < 2, false) THEN {base} + 1 ELSE {base} END)"
    return f"(CASE WHEN coalesce(hip = 1 OR spine = 1, false) THEN 2 ELSE {bumped} END)"


def prepared_sql(spec: CleaningSpec, src: str = "patients", suspicion: bool = False, extra: str = "") -> list[str]:
    """sel -> dedup -> metric CTE parts."""
    cols = ", ".join(["row_seq", *spec.columns])
    return [
        f"sel AS (SELECT {cols}{extra} FROM {src})",
        "dedup AS (SELECT * FROM sel QUALIFY row_number() OVER (PARTITION BY PatientId ORDER BY row_seq) = 1)",
        f"metric AS (SELECT * REPLACE ({height_sql()} AS bmdtest_height, "
        f"{weight_sql(suspicion=suspicion)} AS bmdtest_weight) FROM dedup)",
    ]


def gender_fill_parts(spec: CleaningSpec, src: str = "metric") -> list[str]:
    """F4 + F5 + F6 + D5 + F7 on ``src``; ends in CTE ``filled``."""
    stats = []
    for c in spec.numeric:
        for g in (1, 2):
            stats.append(f"avg(CASE WHEN PatientGender = {g} THEN {c} END) AS m_{c}_{g}")
    num = []
    for c in spec.numeric:
        num.append(f"CASE WHEN PatientGender = 1 AND ({c} IS NULL OR {c} = 0) THEN st.m_{c}_1 "
                   f"WHEN PatientGender = 2 AND ({c} IS NULL OR {c} = 0) THEN st.m_{c}_2 ELSE {c} END AS {c}")
    nom = [f"coalesce({c}, {mode_sql(c, src)}) AS {c}" for c in spec.nominal]
    sp = [f"coalesce({c}, 0) AS {c}" for c in spec.special]
    return [
        f"st AS (SELECT {', '.join(stats)} FROM {src})",
        f"g1 AS (SELECT {src}.* REPLACE ({', '.join(num + nom + sp)}) FROM {src}, st)",
        *bmi_fill_parts("g1", "filled"),
    ]


def bmi_fill_parts(src: str, out: str) -> list[str]:
    return [
        f"{out}_b AS (SELECT *, {bmi_sql()} AS bmi FROM {src})",
        f"{out}_m1 AS (SELECT avg(bmi) AS m1 FROM {out}_b)",
        f"{out}_z AS (SELECT {out}_b.* REPLACE (CASE WHEN bmi = 0 THEN m1 ELSE bmi END AS bmi) FROM {out}_b, {out}_m1)",
        f"{out}_m2 AS (SELECT avg(bmi) AS m2 FROM {out}_z)",
        f"{out} AS (SELECT {out}_z.* REPLACE (coalesce(bmi, m2) AS bmi) FROM {out}_z, {out}_m2)",
    ]


def rd(x: str) -> str:
    """6-decimal rounding identical to the Spark side: round(x * 1e6) / 1e6, -0.0 -> 0.0."""
    s = f"round(({x}) * CAST(1000000 AS DOUBLE))"
    return f"(CASE WHEN {s} = 0 THEN CAST(0 AS DOUBLE) ELSE {s} / CAST(1000000 AS DOUBLE) END)"


def round_cols(cols: list[str]) -> str:
    return ", ".join(f"{rd(c)} AS {c}" for c in cols)
