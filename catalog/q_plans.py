"""Composite jobs P7-P12, P14 and the H6 rebalancing query."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import q, rnd
from catalog.sqlparts import rd
from riskframe.fixtures import patients
from riskframe.operators import sampling, smote
from riskframe.plans import modelprep, training
from riskframe.plans.cleaning import clean_caroc
from riskframe.session import release


def _caroc():
    from catalog.oracles import _CAROC
    return _CAROC


def _hb(seed, buckets=100, col="PatientId"):
    return f"(('0x' || substr(md5(coalesce(CAST({col} AS VARCHAR), '') || ':' || '{seed}'), 1, 8))::BIGINT % {buckets})"


P9_COLS = ["PatientId", *modelprep.PROXY_COLUMNS]


def _p9_sql():
    from catalog.sqlparts import cte
    days = "CAST(floor(abs(epoch(obreak_date) - epoch(datebone)) / 86400) AS BIGINT)"
    sel = ", ".join(f"{rd(c)} AS {c}" if c in ("PatientAge", "wtcurr_lbs") else
                    ("coalesce(obreak_frac_count, 0) AS obreak_frac_count" if c == "obreak_frac_count" else c)
                    for c in P9_COLS)
    return cte() + f"SELECT {sel}, coalesce({days} <= 730, false) AS second_IFR FROM patients"


@q("p9_proxy_dataset", _p9_sql())
def p9_proxy_dataset(spark, sf):
    return rnd(modelprep.proxy_dataset(patients(spark, sf)))


_P8_ALL = None


def _p8_sql():
    from riskframe.spec import CAROC
    cols = [c for c in ["row_seq", *CAROC.columns, "bmi"]]
    nonfr = [c for c in [*CAROC.columns, "bmi"] if c not in modelprep.FRACTURE_TYPES]
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in [*CAROC.columns, "bmi"])
    melt = " UNION ALL ".join(f"SELECT PatientId, '{t}' AS fracture_type, {t} AS fractured FROM f2"
                              for t in modelprep.FRACTURE_TYPES)
    return _caroc() + f""", d0 AS (SELECT * FROM caroc WHERE {notnull}),
s1 AS (SELECT avg(bmdtest_height) AS m, stddev_samp(bmdtest_height) AS s FROM d0),
f1 AS (SELECT d0.* FROM d0, s1 WHERE bmdtest_height > m - 3 * s AND bmdtest_height < m + 3 * s),
s2 AS (SELECT avg(bmdtest_weight) AS m, stddev_samp(bmdtest_weight) AS s FROM f1),
f2 AS (SELECT f1.* FROM f1, s2 WHERE bmdtest_weight > m - 3 * s AND bmdtest_weight < m + 3 * s),
ml AS ({melt}),
best AS (SELECT * FROM ml QUALIFY row_number() OVER (PARTITION BY PatientId ORDER BY fractured DESC NULLS LAST, fracture_type) = 1)
SELECT PatientId, fracture_type, fractured, CASE WHEN {_hb(786, 10000)} < 9000 THEN 'data' ELSE 'unseen' END AS part FROM best"""


@q("p8_fracture_consolidation", _p8_sql())
def p8_fracture_consolidation(spark, sf):
    out = modelprep.fracture_consolidation(clean_caroc(patients(spark, sf)))
    return out.select("PatientId", "fracture_type", "fractured", "part")


def _p7_sql():
    from riskframe.spec import CAROC
    cat = list(modelprep.REG_CATEGORICAL)
    levels = {c: [0, 1] for c in cat}
    levels["ptunsteady"] = [0, 1, 2]
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in [*CAROC.columns, "bmi"])
    keep = [c for c in [*CAROC.columns, "bmi"] if c not in cat and c != "ankle"]
    dbl = {"bmdtest_height", "bmdtest_weight", "bmdtest_tscore_fn"}
    sel = []
    for c in keep:
        if c == "PatientAge":
            sel.append(f"{rd('(PatientAge - ma) / (CASE WHEN sa = 0 THEN 1 ELSE sa END)')} AS PatientAge")
        elif c == "bmi":
            sel.append(f"{rd('(bmi - mb) / (CASE WHEN sb = 0 THEN 1 ELSE sb END)')} AS bmi")
        elif c in dbl:
            sel.append(f"{rd(c)} AS {c}")
        else:
            sel.append(c)
    for c in cat:
        for v in levels[c][1:]:
            sel.append(f'CASE WHEN {c} = {v} THEN 1 ELSE 0 END AS "pt_response_{c}_{float(v)}"')
    sel += [f"{rd('PatientAge * PatientGender')} AS \"Age*Gender\"", f"{rd('PatientAge * bmi')} AS \"Age*bmi\"",
            f"{rd('PatientGender * bmi')} AS \"Gender*bmi\"",
            f"CASE WHEN {_hb(42)} < 20 THEN 'test' ELSE 'train' END AS split"]
    return _caroc() + f""", d0 AS (SELECT * FROM caroc WHERE {notnull}),
s1 AS (SELECT avg(bmdtest_height) AS m, stddev_samp(bmdtest_height) AS s FROM d0),
f1 AS (SELECT d0.* FROM d0, s1 WHERE bmdtest_height > m - 3 * s AND bmdtest_height < m + 3 * s),
s2 AS (SELECT avg(bmdtest_weight) AS m, stddev_samp(bmdtest_weight) AS s FROM f1),
f2 AS (SELECT f1.* FROM f1, s2 WHERE bmdtest_weight > m - 3 * s AND bmdtest_weight < m + 3 * s),
f3 AS (SELECT * FROM f2 WHERE NOT coalesce(ankle = 1, false)),
zs AS (SELECT avg(PatientAge) AS ma, stddev_pop(PatientAge) AS sa, avg(bmi) AS mb, stddev_pop(bmi) AS sb FROM f3)
SELECT {', '.join(sel)} FROM f3, zs"""


@q("p7_model_prep", _p7_sql())
def p7_model_prep(spark, sf):
    prepared, _ = modelprep.model_prep(clean_caroc(patients(spark, sf)))
    return rnd(prepared)


@q("p10_feature_report")
def p10_feature_report(spark, sf):
    clean = clean_caroc(patients(spark, sf))
    feats = ["PatientAge", "bmdtest_height", "bmdtest_weight", "bmdtest_tscore_fn", "bmi", "parentbreak", "alcohol"]
    return modelprep.report_long(modelprep.feature_report(clean, feats))


_P10_FEATURES = ["PatientAge", "bmdtest_height", "bmdtest_weight", "bmdtest_tscore_fn", "bmi", "parentbreak", "alcohol"]


def _p10_sql():
    from catalog.q_profile import _auto_hist_sql
    from catalog.common import ORACLES
    k = len(_P10_FEATURES)
    sizes = {"describe": k, "correlation": k * k, "profile": k, "target_correlation": k - 1, "age_histogram": 40,
             "box_weight": 1, "profile_by_group": f"{k} * (SELECT count(*) FROM (SELECT DISTINCT PatientGender FROM caroc))",
             "gender_share": "(SELECT count(*) FROM (SELECT DISTINCT PatientGender FROM caroc))",
             "bmi_histogram_by_gender": f"(SELECT count(*) FROM ({_auto_hist_sql()}))",
             "scatter_age_tscore": f"(SELECT count(*) FROM ({ORACLES['e18_binned_scatter']}))"}
    return _caroc() + " UNION ALL ".join(f"SELECT '{s}' AS section, CAST({n} AS BIGINT) AS rows" for s, n in sizes.items())


@q("p10_report_sections", _p10_sql())
def p10_report_sections(spark, sf):
    """P10: the report's sections and how many rows each has (their values are the E queries')."""
    sections = modelprep.feature_report(clean_caroc(patients(spark, sf)), _P10_FEATURES)
    return modelprep.report_long(sections).groupBy("section").agg(F.count(F.lit(1)).alias("rows"))


@q("p11_classification_pipeline")
def p11_classification_pipeline(spark, sf):
    clean = clean_caroc(patients(spark, sf))
    feats = ["PatientAge", "PatientGender", "bmi", "alcohol", "smoke", "arthritis", "diabetes"]
    return training.classification_pipeline(clean, feats)


@q("p12_regression_pipeline")
def p12_regression_pipeline(spark, sf):
    clean = clean_caroc(patients(spark, sf))
    prepared, _ = modelprep.model_prep(clean)
    release(clean, "cleaned-caroc")
    feats = ["PatientAge", "PatientGender", "bmi", "Age*Gender", "Age*bmi", "Gender*bmi",
             "pt_response_parentbreak_1.0", "pt_response_alcohol_1.0"]
    return training.regression_pipeline(prepared, feats, own=True)


@q("p14_batch_scoring")
def p14_batch_scoring(spark, sf):
    from catalog.q_io import m1_batch_scoring
    return m1_batch_scoring(spark, sf).groupBy("risk").agg(F.count(F.lit(1)).alias("n"))


def _h6_sql():
    from catalog.oracles import _CAROC
    return _CAROC + f""", t AS (SELECT * FROM caroc WHERE bmdtest_10yr_caroc IS NOT NULL AND PatientAge IS NOT NULL
  AND bmi IS NOT NULL AND {_hb(2)} >= 20),
n AS (SELECT bmdtest_10yr_caroc, count(*) AS real, min(PatientAge) AS lo, max(PatientAge) AS hi FROM t GROUP BY 1)
SELECT bmdtest_10yr_caroc, (SELECT max(real) FROM n) AS rows, (SELECT max(real) FROM n) - real AS synthetic,
  {rd('lo')} AS min_age, {rd('hi')} AS max_age, true AS in_range FROM n"""


def _h6_train(spark, sf):
    c = clean_caroc(patients(spark, sf)).filter(F.col("bmdtest_10yr_caroc").isNotNull())
    return sampling.hash_split(c.dropna(subset=["PatientAge", "bmi"]), "PatientId", 20, seed=2)[0]


_H6_NOMINAL = ["PatientGender", "alcohol", "smoke"]


def _h6_near_sql():
    differ = " + ".join(f"CAST(a.{c} IS DISTINCT FROM b.{c} AS INT)" for c in _H6_NOMINAL)
    return _h6_sql().rpartition("SELECT bmdtest_10yr_caroc, (SELECT max(real)")[0].rstrip() + f""",
g AS (SELECT bmdtest_10yr_caroc AS label, (stddev_pop(PatientAge) + stddev_pop(bmi)) / 2 AS gap, count(*) AS real FROM t GROUP BY 1),
m AS (SELECT t.*, row_number() OVER () AS place, gap FROM t JOIN g ON bmdtest_10yr_caroc = label WHERE real < (SELECT max(real) FROM g)),
d AS (SELECT a.bmdtest_10yr_caroc AS label, a.place, a.PatientId, sqrt(pow(a.PatientAge - b.PatientAge, 2) + pow(a.bmi - b.bmi, 2)
      + ({differ}) * a.gap * a.gap) AS distance FROM m a JOIN m b ON a.bmdtest_10yr_caroc = b.bmdtest_10yr_caroc AND a.place <> b.place)
SELECT label, PatientId, rank, {rd('distance')} AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY label, place ORDER BY distance) AS rank FROM d) WHERE rank <= 5"""


@q("h6_nearest_neighbours", _h6_near_sql())
def h6_nearest_neighbours(spark, sf):
    """The distances of every minority row to its 5 nearest rows of the class, over numeric and nominal features."""
    rows = smote.class_rows(_h6_train(spark, sf), "bmdtest_10yr_caroc", "PatientId", ["PatientAge", "bmi"], _H6_NOMINAL)
    near = smote.class_neighbours(rows, ["PatientAge", "bmi"], _H6_NOMINAL, k=5)
    named = rows.select(F.col("__class").alias("group"), F.col("__at").alias("id"), "PatientId")
    return rnd(near.join(named, ["group", "id"]).select(F.col("group").alias("label"), "PatientId",
                                                        F.col("rank").cast("long").alias("rank"), F.sqrt("far").alias("distance")))


@q("h6_smote_nc", _h6_sql())
def h6_smote_nc(spark, sf):
    """Classes after SMOTE-NC on the training split: parity is exact, and synthetic values stay within the range of
    their class's own."""
    out = smote.smote_nc(_h6_train(spark, sf), "bmdtest_10yr_caroc", "PatientId", ["PatientAge", "bmi"], _H6_NOMINAL)
    made = F.col("synthetic") > 0
    per = out.groupBy("bmdtest_10yr_caroc").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(made.cast("long")).alias("synthetic"),
        F.min("PatientAge").alias("min_age"), F.max("PatientAge").alias("max_age"),
        F.min(F.when(~made, F.col("PatientAge"))).alias("lo"), F.max(F.when(~made, F.col("PatientAge"))).alias("hi"))
    return rnd(per.withColumn("in_range", (F.col("min_age") >= F.col("lo")) & (F.col("max_age") <= F.col("hi")))
               .drop("lo", "hi"))
