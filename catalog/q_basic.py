"""B (projections / filters), C (dedupe / row identity), D (scalar rules), F (imputation) queries + oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import q, rnd
from catalog.sqlparts import (LB, bmi_sql, caroc_sql, cte, d, frax_sql, height_sql, mode_sql, prepared_sql, rd,
                              weight_sql)
from riskframe.fixtures import patients, read_table
from riskframe.functions import rules, scalar, units
from riskframe.operators import impute, quality
from riskframe.plans.cleaning import clean_caroc, prepare
from riskframe.spec import CAROC

P = cte()
CAROC_COLS = ", ".join(["row_seq", *CAROC.columns])


def _sel_sql(cols, src="patients", where=""):
    return P + f"SELECT {cols} FROM {src} {where}"


# ---- B ---------------------------------------------------------------------------------------------------------
@q("b1_select_strict", P + f"SELECT {', '.join(rd(c) + ' AS ' + c if c in CAROC.numeric else c for c in ['row_seq', *CAROC.columns])} FROM patients")
def b1_select_strict(spark, sf):
    return rnd(quality.select_strict(patients(spark, sf), ["row_seq", *CAROC.columns]))


_B2_KEEP = ["row_seq", "PatientId", "PatientGender", "CalcFraxWithBMD", "CalcFraxNoBMD", "obreak_frac_count",
            "obreak_hip"]


@q("b2_drop_columns", P + f"SELECT row_seq, PatientId, PatientGender, {rd('CalcFraxWithBMD')} AS CalcFraxWithBMD, "
                          "obreak_hip FROM patients")
def b2_drop_columns(spark, sf):
    return rnd(quality.drop_columns(patients(spark, sf).select(*_B2_KEEP), ["CalcFraxNoBMD", "obreak_frac_count"]))


_RENAME = {"PatientAge": "age", "PatientGender": "sex", "bmdtest_weight": "weight", "bmdtest_height": "height"}


@q("b3_rename_columns", P + f"SELECT row_seq, {rd('PatientAge')} AS age, PatientGender AS sex, "
                            f"{rd('bmdtest_weight')} AS weight, {rd('bmdtest_height')} AS height FROM patients")
def b3_rename_columns(spark, sf):
    df = patients(spark, sf).select("row_seq", *_RENAME)
    return rnd(quality.rename_columns(df, _RENAME))


@q("b4_cohort_filter", P + f"SELECT row_seq, PatientId, {rd('PatientAge')} AS PatientAge, wrist FROM patients "
                           "WHERE wrist = 1")
def b4_cohort_filter(spark, sf):
    return rnd(quality.cohort_filter(patients(spark, sf), "wrist", 1).select("row_seq", "PatientId", "PatientAge",
                                                                               "wrist"))


@q("b5_drop_predicate", P + "SELECT row_seq, ankle FROM patients WHERE NOT coalesce(ankle = 1, false)")
def b5_drop_predicate(spark, sf):
    return quality.drop_where(patients(spark, sf), F.col("ankle") == 1).select("row_seq", "ankle")


@q("b6_dropna_report", P + f"SELECT count(*) AS rows_before, "
                           f"count(*) FILTER (WHERE {' OR '.join(c + ' IS NULL' for c in CAROC.columns)}) AS rows_removed, "
                           f"count(*) FILTER (WHERE NOT ({' OR '.join(c + ' IS NULL' for c in CAROC.columns)})) AS rows_after "
                           "FROM patients")
def b6_dropna_report(spark, sf):
    _, rep = quality.dropna_with_report(patients(spark, sf).select(*CAROC.columns))
    return spark.createDataFrame([(rep["rows_before"], rep["rows_removed"], rep["rows_after"])],
                                 "rows_before long, rows_removed long, rows_after long")


_B7_SRC = ("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN '' "
           "ELSE CAST(o_custkey AS VARCHAR) END AS cust_txt, "
           "CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE CAST(o_orderkey % 1000 AS VARCHAR) END AS code_txt "
           "FROM orders")


@q("b7_numeric_coercion", f"SELECT o_orderkey, TRY_CAST(cust_txt AS DOUBLE) AS cust_txt, "
                          f"TRY_CAST(code_txt AS DOUBLE) AS code_txt FROM ({_B7_SRC}) s "
                          "WHERE TRY_CAST(cust_txt AS DOUBLE) IS NOT NULL AND TRY_CAST(code_txt AS DOUBLE) IS NOT NULL")
def b7_numeric_coercion(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    src = o.select(k, F.when(k % 9 == 0, "n/a").when(k % 11 == 0, "").otherwise(F.col("o_custkey").cast("string"))
                   .alias("cust_txt"),
                   F.when(k % 13 == 0, "unknown").otherwise((k % 1000).cast("string")).alias("code_txt"))
    return quality.coerce_and_dropna(src, ["cust_txt", "code_txt"])


@q("b8_drop_label_zero", P + "SELECT row_seq, bmdtest_10yr_caroc FROM patients "
                             "WHERE bmdtest_10yr_caroc IS DISTINCT FROM 0")
def b8_drop_label_zero(spark, sf):
    return quality.drop_label_value(patients(spark, sf), "bmdtest_10yr_caroc", 0).select("row_seq",
                                                                                          "bmdtest_10yr_caroc")


def _caroc_sql_cte():
    from catalog.oracles import _CAROC
    return _CAROC


def _sigma_sql():
    base = _caroc_sql_cte()
    return base + f""", s1 AS (SELECT avg(bmdtest_height) AS m, stddev_samp(bmdtest_height) AS s FROM caroc),
f1 AS (SELECT caroc.* FROM caroc, s1 WHERE bmdtest_height > m - 3 * s AND bmdtest_height < m + 3 * s),
s2 AS (SELECT avg(bmdtest_weight) AS m, stddev_samp(bmdtest_weight) AS s FROM f1),
f2 AS (SELECT f1.* FROM f1, s2 WHERE bmdtest_weight > m - 3 * s AND bmdtest_weight < m + 3 * s)
SELECT PatientId, {rd('bmdtest_height')} AS bmdtest_height, {rd('bmdtest_weight')} AS bmdtest_weight FROM f2"""


@q("b9_sigma_filter", _sigma_sql())
def b9_sigma_filter(spark, sf):
    out, _ = quality.sigma_filter(clean_caroc(patients(spark, sf)), ["bmdtest_height", "bmdtest_weight"])
    return rnd(out.select("PatientId", "bmdtest_height", "bmdtest_weight"))


# fixed 14-column scoring contract of the batch scorer (names as produced by our one-hot)
SCORING_FEATURES = ["PatientAge", "PatientGender", "bmdtest_weight", "bmdtest_height", "parentbreak_0", "parentbreak_1",
                    "alcohol_0", "alcohol_1", "obreak_0", "obreak_1", "obreak_2", "arthritis_1", "diabetes_1",
                    "smoke_1"]


def _b10_sql():
    cols = []
    for f in SCORING_FEATURES:
        if f in ("PatientAge", "bmdtest_weight", "bmdtest_height"):
            cols.append(f"{rd(f)} AS {f}")
        elif f == "PatientGender":
            cols.append(f)
        else:
            c, v = f.rsplit("_", 1)
            cols.append(f"CASE WHEN {c} = {v} THEN 1 ELSE 0 END AS {f}")
    return P + "SELECT PatientId, " + ", ".join(cols) + " FROM patients"


@q("b10_backfill_columns", _b10_sql())
def b10_backfill_columns(spark, sf):
    from riskframe.operators.encode import one_hot
    batch = patients(spark, sf)
    enc, _ = one_hot(batch.select("PatientId", "PatientAge", "PatientGender", "bmdtest_weight", "bmdtest_height",
                                  "parentbreak", "alcohol", "obreak", "arthritis", "diabetes", "smoke"),
                     ["parentbreak", "alcohol", "obreak", "arthritis", "diabetes", "smoke"])
    out = quality.backfill_columns(enc, SCORING_FEATURES, fill=0, keep=["PatientId"])
    return rnd(out.withColumns({c: F.col(c).cast("int") for c in SCORING_FEATURES if "_" in c
                                and not c.startswith("Patient") and not c.startswith("bmdtest")}))


@q("b11_first_n", P + f"SELECT row_seq, PatientId, {rd('PatientAge')} AS PatientAge FROM patients "
                      "ORDER BY row_seq LIMIT 11")
def b11_first_n(spark, sf):
    return rnd(quality.first_n(patients(spark, sf), 11).select("row_seq", "PatientId", "PatientAge"))


@q("b12_blank_to_null", "SELECT o_orderkey, CASE WHEN trim(p) = '' THEN NULL ELSE p END AS p FROM "
                        "(SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '   ' WHEN o_orderkey % 7 = 0 THEN '' "
                        "ELSE o_orderpriority END AS p FROM orders) s")
def b12_blank_to_null(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    src = o.select(k, F.when(k % 9 == 0, "   ").when(k % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("p"))
    return quality.blank_strings_to_null(src)


_PROB = "least(greatest((-bmdtest_tscore_fn - CAST(1 AS DOUBLE)) / CAST(3 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))"


def rule_probability():
    """Deterministic rule predictor used by the metric queries: P(high risk) from the T-score, clipped to [0,1]."""
    return F.least(F.greatest((-F.col("bmdtest_tscore_fn") - F.lit(1.0)) / F.lit(3.0), F.lit(0.0)), F.lit(1.0))


@q("b13_probability_threshold", P + f"SELECT row_seq, CASE WHEN bmdtest_tscore_fn IS NOT NULL THEN {_PROB} > CAST(0.5 AS DOUBLE) END "
                                    "AS high FROM patients")
def b13_probability_threshold(spark, sf):
    """A row without a T-score has no probability, so the predicate is NULL there."""
    p = F.when(F.col("bmdtest_tscore_fn").isNotNull(), rule_probability())
    return patients(spark, sf).select("row_seq", quality.above_threshold(p, 0.5).alias("high"))


# ---- C ---------------------------------------------------------------------------------------------------------
@q("c1_dedupe_first", P + f"SELECT PatientId, row_seq, {rd('PatientAge')} AS PatientAge FROM patients "
                          "QUALIFY row_number() OVER (PARTITION BY PatientId ORDER BY row_seq) = 1")
def c1_dedupe_first(spark, sf):
    return rnd(quality.dedupe_first(patients(spark, sf)).select("PatientId", "row_seq", "PatientAge"))


_FRACTURES = ["ankle", "clavicle", "elbow", "femur", "wrist", "tibfib"]


@q("c2_keep_max_fractured", P + ", m AS (" + " UNION ALL ".join(
    f"SELECT PatientId, row_seq, '{c}' AS fracture_type, {c} AS fractured FROM patients" for c in _FRACTURES) +
   ") SELECT PatientId, row_seq, fracture_type, fractured FROM m QUALIFY row_number() OVER "
   "(PARTITION BY PatientId, row_seq ORDER BY fractured DESC NULLS LAST, fracture_type) = 1")
def c2_keep_max_fractured(spark, sf):
    from riskframe.operators.encode import melt
    m = melt(patients(spark, sf).select("PatientId", "row_seq", *_FRACTURES), ["PatientId", "row_seq"], _FRACTURES,
             "fracture_type", "fractured")
    m = m.withColumn("pid_seq", F.struct("PatientId", "row_seq"))
    return quality.keep_max_per_key(m, "pid_seq", "fractured", "fracture_type").drop("pid_seq")


@q("c3_dense_row_numbers", P + ", dd AS (SELECT PatientId FROM patients GROUP BY PatientId) "
                               "SELECT PatientId, row_number() OVER (ORDER BY PatientId NULLS FIRST) - 1 AS row_id FROM dd")
def c3_dense_row_numbers(spark, sf):
    ids = patients(spark, sf).select("PatientId").distinct()
    return quality.dense_row_numbers(ids, "PatientId", "row_id").select("PatientId", "row_id")


# ---- D ---------------------------------------------------------------------------------------------------------
@q("d1_lbs_to_kg", P + f"SELECT row_seq, {rd('wtcurr_lbs * ' + LB)} AS weight_kg FROM patients")
def d1_lbs_to_kg(spark, sf):
    return rnd(patients(spark, sf).select("row_seq", units.lbs_to_kg("wtcurr_lbs").alias("weight_kg")))


@q("d2_d3_metric_units", P + f"SELECT row_seq, {rd(height_sql())} AS height_cm, {rd(weight_sql())} AS weight_kg, "
                             f"{rd('bmdtest_height')} AS raw_height FROM patients")
def d2_d3_metric_units(spark, sf):
    p = patients(spark, sf)
    return rnd(p.select("row_seq", units.height_to_cm("bmdtest_height").alias("height_cm"),
                        units.weight_to_kg("bmdtest_height", "bmdtest_weight").alias("weight_kg"),
                        F.col("bmdtest_height").alias("raw_height")))


@q("d4_pound_suspicion", P + f"SELECT row_seq, {rd(weight_sql(suspicion=True))} AS weight_kg FROM patients")
def d4_pound_suspicion(spark, sf):
    p = patients(spark, sf)
    return rnd(p.select("row_seq", units.weight_to_kg_with_suspicion("bmdtest_height", "bmdtest_weight")
                        .alias("weight_kg")))


@q("d5_bmi", cte(*prepared_sql(CAROC)) + f"SELECT row_seq, {rd(bmi_sql())} AS bmi FROM metric")
def d5_bmi(spark, sf):
    m = prepare(patients(spark, sf), CAROC, stage=False)
    return rnd(m.select("row_seq", units.bmi("bmdtest_height", "bmdtest_weight").alias("bmi")))


@q("d6_frax_band", P + f"SELECT row_seq, {frax_sql('CalcFraxNoBMD')} AS no_bmd_band, "
                       f"{frax_sql('CalcFraxWithBMD')} AS bmd_band FROM patients")
def d6_frax_band(spark, sf):
    p = patients(spark, sf)
    return p.select("row_seq", rules.frax_band("CalcFraxNoBMD").alias("no_bmd_band"),
                    rules.frax_band("CalcFraxWithBMD").alias("bmd_band"))


def _caroc_base_sql():
    s = caroc_sql()
    # the base rule alone = the full rule with the modifier / override switched off is not separable in SQL
    # text, so restate it
    from catalog.sqlparts import _F, _M, _thr
    fem = "coalesce(PatientGender = 1, false)"
    high = f"(CASE WHEN {fem} THEN {_thr(_F, 0, 'PatientAge')} ELSE {_thr(_M, 0, 'PatientAge')} END)"
    low = f"(CASE WHEN {fem} THEN {_thr(_F, 1, 'PatientAge')} ELSE {_thr(_M, 1, 'PatientAge')} END)"
    base = (f"(CASE WHEN bmdtest_tscore_fn > {high} THEN 0 WHEN bmdtest_tscore_fn > {low} THEN 1 "
            f"WHEN bmdtest_tscore_fn <= {low} THEN 2 END)")
    return base, s


@q("d7_d9_caroc_rule", P + "SELECT row_seq, CAST({0} AS INT) AS base_risk, CAST({1} AS INT) AS risk FROM patients"
   .format(*_caroc_base_sql()))
def d7_d9_caroc_rule(spark, sf):
    p = patients(spark, sf)
    return p.select("row_seq", rules.caroc_base().cast("int").alias("base_risk"),
                    rules.caroc_risk().cast("int").alias("risk"))


@q("d1_d9_sql_functions", P + "SELECT row_seq, {lbs} AS kg, {h} AS height_cm, {w} AS weight_kg, {ws} AS weight_kg_suspicion, "
   "{b} AS bmi, {f} AS band, CAST({base} AS INT) AS base_risk, CAST({risk} AS INT) AS risk FROM patients".format(
       lbs=rd("wtcurr_lbs * " + LB), h=rd(height_sql()), w=rd(weight_sql()), ws=rd(weight_sql(suspicion=True)),
       b=rd(bmi_sql()), f=frax_sql("CalcFraxNoBMD"), base=_caroc_base_sql()[0], risk=_caroc_base_sql()[1]))
def d1_d9_sql_functions(spark, sf):
    """The rules as SQL functions, called from a SQL statement."""
    rules.register_sql_functions(spark)
    flags = ", ".join(["oralster", "obreak", *rules.CAROC_MODIFIER_FRACTURES, *rules.CAROC_OVERRIDE])
    return rnd(spark.sql(f"""
        SELECT row_seq, rf_lbs_to_kg(wtcurr_lbs) AS kg, rf_height_cm(bmdtest_height) AS height_cm,
               rf_weight_kg(bmdtest_height, bmdtest_weight) AS weight_kg,
               rf_weight_kg_suspicion(bmdtest_height, bmdtest_weight) AS weight_kg_suspicion,
               rf_bmi(bmdtest_height, bmdtest_weight) AS bmi, rf_frax_band(CalcFraxNoBMD) AS band, base_risk,
               rf_caroc_risk(base_risk, {flags}) AS risk
        FROM (SELECT *, rf_caroc_base(bmdtest_tscore_fn, PatientAge, PatientGender) AS base_risk FROM {{patients}})
        """, patients=patients(spark, sf)))


@q("d10_parse_timestamp", "SELECT o_orderkey, TRY_CAST(s AS TIMESTAMP) AS parsed FROM (SELECT o_orderkey, "
                          "CASE WHEN o_orderkey % 13 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') "
                          "END AS s FROM orders) t")
def d10_parse_timestamp(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    s = F.when(k % 13 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select(k, scalar.parse_timestamp(s).cast("timestamp_ntz").alias("parsed"))


_DAYS = "CAST(floor(abs(epoch(obreak_date) - epoch(datebone)) / 86400) AS BIGINT)"


@q("d11_d12_second_fracture", P + f"SELECT row_seq, {_DAYS} AS days_between, "
                                  f"coalesce({_DAYS} <= 730, false) AS second_IFR FROM patients")
def d11_d12_second_fracture(spark, sf):
    p = patients(spark, sf)
    days = rules.abs_days_between("obreak_date", "datebone")
    return p.select("row_seq", days.alias("days_between"), rules.within_days(days).alias("second_IFR"))


@q("d13_sqrt_abs", P + f"SELECT row_seq, {rd('sqrt(abs(bmdtest_tscore_fn))')} AS root FROM patients")
def d13_sqrt_abs(spark, sf):
    return rnd(patients(spark, sf).select("row_seq", scalar.sqrt_abs("bmdtest_tscore_fn").alias("root")))


_NAMES = ["none", "one", "several"]


@q("d14_class_name", P + "SELECT row_seq, CASE obreak WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'several' "
                         "END AS obreak_name FROM patients")
def d14_class_name(spark, sf):
    return patients(spark, sf).select("row_seq", scalar.class_name("obreak", _NAMES).alias("obreak_name"))


@q("d15_code_label", P + "SELECT row_seq, CASE PatientGender WHEN 1 THEN 'red' WHEN 2 THEN 'blue' END AS colour "
                         "FROM patients")
def d15_code_label(spark, sf):
    return patients(spark, sf).select("row_seq", scalar.code_label("PatientGender", {1: "red", 2: "blue"})
                                      .alias("colour"))


def _inter_sql():
    from catalog.oracles import _CAROC
    return _CAROC + (f"SELECT PatientId, {rd('PatientAge * PatientGender')} AS \"Age*Gender\", "
                     f"{rd('PatientAge * bmi')} AS \"Age*bmi\", {rd('PatientGender * bmi')} AS \"Gender*bmi\" "
                     "FROM caroc")


@q("d16_interactions", _inter_sql())
def d16_interactions(spark, sf):
    c = clean_caroc(patients(spark, sf)).select("PatientId", F.col("PatientAge").alias("Age"),
                                                F.col("PatientGender").alias("Gender"), "bmi")
    return rnd(c.select("PatientId", *[e.alias(n) for n, e in scalar.interactions(["Age", "Gender", "bmi"]).items()]))


_RULE_T = ("(CAST(-1.5 AS DOUBLE) - CAST(0.04 AS DOUBLE) * (PatientAge - CAST(60 AS DOUBLE)) "
           "+ CAST(0.01 AS DOUBLE) * (bmi - CAST(25 AS DOUBLE)))")


def rule_tscore():
    """Deterministic rule predictor of the T-score (age and BMI), used by the regression metric queries."""
    return (F.lit(-1.5) - F.lit(0.04) * (F.col("PatientAge") - F.lit(60.0)) + F.lit(0.01) * (F.col("bmi") - F.lit(25.0)))


@q("d17_residual", _caroc_sql_cte() + f"SELECT PatientId, {rd(_RULE_T + ' - bmdtest_tscore_fn')} AS residual FROM caroc")
def d17_residual(spark, sf):
    c = clean_caroc(patients(spark, sf))
    return rnd(c.select("PatientId", scalar.residual(rule_tscore(), "bmdtest_tscore_fn").alias("residual")))


@q("d18_percent", P + f"SELECT row_seq, {rd(_PROB + ' * CAST(100 AS DOUBLE)')} AS pct FROM patients")
def d18_percent(spark, sf):
    return rnd(patients(spark, sf).select("row_seq", scalar.to_percent(rule_probability()).alias("pct")))


# ---- F ---------------------------------------------------------------------------------------------------------
_NUM = list(CAROC.numeric)


@q("f1_fill_mean", P + f", s AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in _NUM)} FROM patients) "
                       f"SELECT row_seq, {', '.join(rd(f'coalesce({c}, m_{c})') + f' AS {c}' for c in _NUM)} "
                       "FROM patients, s")
def f1_fill_mean(spark, sf):
    df, _ = impute.MeanFill(_NUM).fit_apply(patients(spark, sf).select("row_seq", *_NUM))
    return rnd(df)


_M = cte(*prepared_sql(CAROC))


@q("f2_zero_to_mean", _M + ", s AS (SELECT avg(bmdtest_height) AS m FROM metric) "
                      f"SELECT row_seq, {rd('CASE WHEN bmdtest_height = 0 THEN m ELSE bmdtest_height END')} "
                      "AS bmdtest_height FROM metric, s")
def f2_zero_to_mean(spark, sf):
    m = prepare(patients(spark, sf), CAROC, stage=False).select("row_seq", "bmdtest_height")
    df, _ = impute.MeanFill(["bmdtest_height"], nulls=False, zeros=True).fit_apply(m)
    return rnd(df)


@q("f3_null_zero_mean", _M + f", s AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in _NUM)} FROM metric) "
                        f"SELECT row_seq, {', '.join(rd(f'CASE WHEN {c} IS NULL OR {c} = 0 THEN m_{c} ELSE {c} END') + f' AS {c}' for c in _NUM)} "
                        "FROM metric, s")
def f3_null_zero_mean(spark, sf):
    m = prepare(patients(spark, sf), CAROC, stage=False).select("row_seq", *_NUM)
    df, _ = impute.MeanFill(_NUM, nulls=True, zeros=True).fit_apply(m)
    return rnd(df)


def _f4_sql():
    st = ", ".join(f"avg(CASE WHEN PatientGender = {g} THEN {c} END) AS m_{c}_{g}" for c in _NUM for g in (1, 2))
    f = ", ".join(rd(f"CASE WHEN PatientGender = 1 AND ({c} IS NULL OR {c} = 0) THEN m_{c}_1 "
                     f"WHEN PatientGender = 2 AND ({c} IS NULL OR {c} = 0) THEN m_{c}_2 ELSE {c} END") + f" AS {c}"
                  for c in _NUM)
    return _M + f", s AS (SELECT {st} FROM metric) SELECT row_seq, PatientGender, {f} FROM metric, s"


@q("f4_gender_mean_fill", _f4_sql())
def f4_gender_mean_fill(spark, sf):
    m = prepare(patients(spark, sf), CAROC, stage=False).select("row_seq", "PatientGender", *_NUM)
    df, _ = impute.GroupMeanFill(_NUM, "PatientGender", (1, 2)).fit_apply(m)
    return rnd(df)


@q("t3_group_stat_lookup", _M + ", s AS (SELECT PatientGender AS g, avg(bmdtest_weight) AS m FROM metric "
                           "WHERE PatientGender IS NOT NULL GROUP BY PatientGender) "
                           f"SELECT row_seq, PatientGender, {rd('CASE WHEN (bmdtest_weight IS NULL OR bmdtest_weight = 0) AND s.m IS NOT NULL THEN s.m ELSE bmdtest_weight END')} "
                           "AS bmdtest_weight FROM metric LEFT JOIN s ON metric.PatientGender = s.g")
def t3_group_stat_lookup(spark, sf):
    """The table of group statistics joined to the rows; rows without a group stay as they are."""
    m = prepare(patients(spark, sf), CAROC, stage=False).select("row_seq", "PatientGender", "bmdtest_weight")
    return rnd(impute.group_mean_fill_any(m, ["bmdtest_weight"], "PatientGender"))


_NOM = list(CAROC.nominal)


_F5 = ", ".join(f"coalesce({c}, {mode_sql(c, 'patients')}) AS {c}" for c in _NOM)


@q("f5_mode_fill", P + f"SELECT row_seq, {_F5} FROM patients")
def f5_mode_fill(spark, sf):
    df, _ = impute.ModeFill(_NOM).fit_apply(patients(spark, sf).select("row_seq", *_NOM))
    return df


_SP = list(CAROC.special)


@q("f6_zero_fill", P + f"SELECT row_seq, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _SP)} FROM patients")
def f6_zero_fill(spark, sf):
    return impute.ZeroFill(_SP).apply(patients(spark, sf).select("row_seq", *_SP))


@q("f7_bmi_two_step", _M + f", b AS (SELECT row_seq, {bmi_sql()} AS bmi FROM metric), "
                      "m1 AS (SELECT avg(bmi) AS m1 FROM b), "
                      "z AS (SELECT row_seq, CASE WHEN bmi = 0 THEN m1 ELSE bmi END AS bmi FROM b, m1), "
                      "m2 AS (SELECT avg(bmi) AS m2 FROM z) "
                      f"SELECT row_seq, {rd('coalesce(bmi, m2)')} AS bmi FROM z, m2")
def f7_bmi_two_step(spark, sf):
    m = prepare(patients(spark, sf), CAROC, stage=False)
    b = m.select("row_seq", units.bmi("bmdtest_height", "bmdtest_weight").alias("bmi"))
    df, _ = impute.TwoStepMeanFill("bmi").fit_apply(b)
    return rnd(df)


@q("f8_label_fill", P + f"SELECT row_seq, CAST(coalesce(bmdtest_10yr_caroc, {caroc_sql()}) AS INT) AS "
                        "bmdtest_10yr_caroc FROM patients")
def f8_label_fill(spark, sf):
    return rules.fill_caroc_label(patients(spark, sf)).select("row_seq", "bmdtest_10yr_caroc")


__all__ = ["rule_probability", "rule_tscore", "SCORING_FEATURES", "d"]
