"""K (evaluation) queries + oracles, scored with deterministic rule predictors so SQL can restate them exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import q, rnd
from catalog.q_basic import _PROB, _RULE_T, rule_probability, rule_tscore
from catalog.sqlparts import rd
from riskframe.fixtures import patients
from riskframe.functions import rules
from riskframe.operators import evaluate, profile
from riskframe.plans.cleaning import clean_caroc


def _caroc():
    from catalog.oracles import _CAROC
    return _CAROC


def _base_sql():
    from catalog.q_basic import _caroc_base_sql
    return _caroc_base_sql()[0]


def scored(spark, sf):
    """The cleaned CAROC table with rule predictions: T-score, high-risk probability, base risk class."""
    c = clean_caroc(patients(spark, sf))
    return c.select("PatientId", "PatientGender", "bmdtest_tscore_fn", "bmdtest_10yr_caroc",
                    rule_tscore().alias("pred_tscore"), rule_probability().alias("p_high"),
                    rules.caroc_base().alias("pred_class"),
                    (F.col("bmdtest_10yr_caroc") == 2).cast("double").alias("y_high"))


def _scored_sql():
    return _caroc() + (f", sc AS (SELECT PatientId, PatientGender, bmdtest_tscore_fn, bmdtest_10yr_caroc, "
                       f"{_RULE_T} AS pred_tscore, {_PROB} AS p_high, {_base_sql()} AS pred_class, "
                       "CAST(bmdtest_10yr_caroc = 2 AS DOUBLE) AS y_high FROM caroc)\n")


@q("k1_k3_regression_metrics", _scored_sql() + "SELECT count(*) AS n, "
   f"{rd('sqrt(avg(pow(pred_tscore - bmdtest_tscore_fn, 2)))')} AS rmse, "
   f"{rd('avg(abs(pred_tscore - bmdtest_tscore_fn))')} AS mae, "
   f"{rd('1 - sum(pow(pred_tscore - bmdtest_tscore_fn, 2)) / (var_pop(bmdtest_tscore_fn) * count(bmdtest_tscore_fn))')} AS r2 "
   "FROM sc")
def k1_k3_regression_metrics(spark, sf):
    return rnd(evaluate.regression_metrics(scored(spark, sf), "bmdtest_tscore_fn", "pred_tscore"))


@q("k4_confusion_matrix", _scored_sql() + """, cls AS (SELECT DISTINCT c FROM (SELECT bmdtest_10yr_caroc AS c FROM sc
  UNION ALL SELECT pred_class FROM sc) WHERE c IS NOT NULL),
cnt AS (SELECT bmdtest_10yr_caroc AS label, pred_class AS prediction, count(*) AS n FROM sc
  WHERE bmdtest_10yr_caroc IS NOT NULL AND pred_class IS NOT NULL GROUP BY 1, 2)
SELECT a.c AS label, b.c AS prediction, coalesce(n, 0) AS count FROM cls a CROSS JOIN cls b
LEFT JOIN cnt ON cnt.label = a.c AND cnt.prediction = b.c""")
def k4_confusion_matrix(spark, sf):
    s = scored(spark, sf).withColumn("pred_class", F.col("pred_class").cast("int"))
    return evaluate.confusion_matrix(s, "bmdtest_10yr_caroc", "pred_class")


@q("k5_classification_report", _scored_sql() + f""", v AS (SELECT bmdtest_10yr_caroc AS l, pred_class AS p FROM sc
  WHERE bmdtest_10yr_caroc IS NOT NULL AND pred_class IS NOT NULL),
a AS (SELECT l AS class, count(*) AS support, count(*) FILTER (WHERE l = p) AS tp FROM v GROUP BY l),
pr AS (SELECT p AS class, count(*) AS predicted FROM v GROUP BY p),
j AS (SELECT coalesce(a.class, pr.class) AS class, coalesce(tp, 0) AS tp, support, predicted FROM a FULL OUTER JOIN pr ON a.class = pr.class),
m AS (SELECT class, CAST(tp AS DOUBLE) / predicted AS precision, CAST(tp AS DOUBLE) / support AS recall, support FROM j)
SELECT class, {rd('precision')} AS precision, {rd('recall')} AS recall,
  {rd('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END')} AS f1,
  coalesce(support, 0) AS support FROM m""")
def k5_classification_report(spark, sf):
    s = scored(spark, sf).withColumn("pred_class", F.col("pred_class").cast("int"))
    s = s.filter(F.col("bmdtest_10yr_caroc").isNotNull() & F.col("pred_class").isNotNull())
    return rnd(evaluate.classification_report(s, "bmdtest_10yr_caroc", "pred_class"))


_LL = ("-(y_high * ln(least(greatest(p_high, 1e-7), 1 - 1e-7)) + (1 - y_high) * "
       "ln(1 - least(greatest(p_high, 1e-7), 1 - 1e-7)))")


@q("k6_binary_metrics", _scored_sql() + f""", b AS (SELECT y_high, p_high, p_high > 0.5 AS yhat FROM sc WHERE y_high IS NOT NULL),
t AS (SELECT count(*) FILTER (WHERE yhat AND y_high = 1) AS tp, count(*) FILTER (WHERE yhat AND y_high <> 1) AS fp,
  count(*) FILTER (WHERE NOT yhat AND y_high <> 1) AS tn, count(*) FILTER (WHERE NOT yhat AND y_high = 1) AS fn,
  avg({_LL}) AS log_loss FROM b)
SELECT tp, fp, tn, fn, {rd('CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn)')} AS accuracy,
  {rd('CAST(tp AS DOUBLE) / (tp + fp)')} AS precision, {rd('CAST(tp AS DOUBLE) / (tp + fn)')} AS recall,
  {rd('log_loss')} AS log_loss FROM t""")
def k6_binary_metrics(spark, sf):
    s = scored(spark, sf).filter(F.col("y_high").isNotNull())
    return rnd(evaluate.binary_metrics(s, "y_high", "p_high"))


def _roc_sql(tail):
    return _scored_sql() + """, g AS (SELECT p_high AS score, sum(CASE WHEN y_high = 1 THEN 1.0 ELSE 0.0 END) AS tp,
  sum(CASE WHEN y_high = 1 THEN 0.0 ELSE 1.0 END) AS fp FROM sc WHERE y_high IS NOT NULL AND p_high IS NOT NULL AND coalesce(PatientId, 1) % 5 <> 0 GROUP BY p_high),
c AS (SELECT score, tp, fp, sum(tp) OVER (ORDER BY score DESC) AS cum_tp, sum(fp) OVER (ORDER BY score DESC) AS cum_fp FROM g),
tot AS (SELECT sum(tp) AS P, sum(fp) AS N FROM g)
""" + tail


def _partly_labelled(df):
    """A fifth of the rows without a label: they take no part in the curves."""
    return df.withColumn("y_high", F.when(F.coalesce("PatientId", F.lit(1)) % 5 != 0, F.col("y_high")))


@q("k7_roc_curve", _roc_sql(f"SELECT {rd('score')} AS threshold, {rd('cum_fp / N')} AS fpr, {rd('cum_tp / P')} AS tpr FROM c, tot"))
def k7_roc_curve(spark, sf):
    return rnd(evaluate.roc_curve(_partly_labelled(scored(spark, sf)), "y_high", "p_high"))


@q("k7_k8_curve_areas", _roc_sql(f"""SELECT {rd('sum(fp / N * (cum_tp + cum_tp - tp) / (2 * P))')} AS roc_auc,
  {rd('sum(tp / P * (cum_tp / (cum_tp + cum_fp) + coalesce((cum_tp - tp) / nullif(cum_tp - tp + cum_fp - fp, 0), cum_tp / (cum_tp + cum_fp))) / 2)')} AS pr_auc
FROM c, tot"""))
def k7_k8_curve_areas(spark, sf):
    return rnd(evaluate.curve_areas(_partly_labelled(scored(spark, sf)), "y_high", "p_high"))


@q("k9_predicted_counts", _scored_sql() + "SELECT pred_class AS prediction, count(*) AS count FROM sc GROUP BY pred_class")
def k9_predicted_counts(spark, sf):
    return evaluate.predicted_counts(scored(spark, sf), "pred_class")


@q("k10_error_histogram", _scored_sql() + f""", r AS (SELECT pred_tscore - bmdtest_tscore_fn AS residual FROM sc),
mm AS (SELECT min(residual) AS lo, max(residual) AS hi FROM r),
bb AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((residual - lo) / ((hi - lo) / CAST(25 AS DOUBLE))) AS BIGINT), 24) END AS bin
       FROM r, mm WHERE residual IS NOT NULL),
cnt AS (SELECT bin, count(*) AS count FROM bb GROUP BY bin),
edges AS (SELECT range AS bin, lo + range * ((hi - lo) / 25) AS lower, lo + (range + 1) * ((hi - lo) / 25) AS upper FROM mm, range(25))
SELECT edges.bin, {rd('lower')} AS lower, {rd('upper')} AS upper, coalesce(cnt.count, 0) AS count
FROM edges LEFT JOIN cnt ON edges.bin = cnt.bin""")
def k10_error_histogram(spark, sf):
    r = evaluate.residuals(scored(spark, sf), "bmdtest_tscore_fn", "pred_tscore")
    return rnd(profile.histogram(r, "residual", 25))


@q("k19_probability_vs_tscore", _scored_sql() + f""", mm AS (SELECT min(bmdtest_tscore_fn) AS lo, max(bmdtest_tscore_fn) AS hi FROM sc)
SELECT PatientGender, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((bmdtest_tscore_fn - lo) / ((hi - lo) / CAST(20 AS DOUBLE))) AS BIGINT), 19) END AS tscore_bin,
  count(*) AS n, {rd('avg(p_high) * 100')} AS avg_pct
FROM sc, mm WHERE bmdtest_tscore_fn IS NOT NULL GROUP BY 1, 2""")
def k19_probability_vs_tscore(spark, sf):
    from riskframe.operators.stats import agg_row
    s = scored(spark, sf).filter(F.col("bmdtest_tscore_fn").isNotNull())
    mm = agg_row(s, {"lo": F.min("bmdtest_tscore_fn"), "hi": F.max("bmdtest_tscore_fn")})
    b = profile._bin_index(F.col("bmdtest_tscore_fn"), F.lit(mm["lo"]), F.lit(mm["hi"]), F.lit(20))
    return rnd(s.groupBy("PatientGender", b.alias("tscore_bin")).agg(
        F.count(F.lit(1)).alias("n"), (F.avg("p_high") * F.lit(100.0)).alias("avg_pct")))
