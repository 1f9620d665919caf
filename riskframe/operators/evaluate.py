"""Evaluation metrics (K1-K10, K19, K22) over prediction tables: conditional sums in single aggregates.

Curves (K7, K8) are first aggregated to DISTINCT scores (the only data whose size matters), then get running
totals from the distributed prefix sum in ``ordered``; areas are one more aggregate over that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.ordered import running_totals
from riskframe.operators.stats import agg_row


MAX_CLASSES = 300


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- regression (K1-K3, K10, E19) ----------------------------------------------------------------------------
def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """K1 RMSE, K2 R^2 (1 - SSE / (n var_pop)), K3 MAE from one aggregate; a constant label gives NULL R^2."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    err = p - y
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.sqrt(F.avg(err * err)).alias("rmse"),
                  F.avg(F.abs(err)).alias("mae"),
                  F.try_subtract(F.lit(1.0), F.try_divide(F.sum(err * err), F.var_pop(y) * F.count(y))).alias("r2"))


def residuals(df: DataFrame, label: str, prediction: str, keep: Sequence[str] = ()) -> DataFrame:
    """Residual pairs."""
    return df.select(*keep, F.col(label).alias("label"), F.col(prediction).alias("prediction"),
                     (F.col(prediction) - F.col(label)).alias("residual"))


# ---- classification (K4-K6, K9) -------------------------------------------------------------------------------
def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: Sequence | None = None) -> DataFrame:
    """K4: (label, prediction, count) for every class pair, zero cells included. The result has a row per pair, so
    the number of classes has an exact bound, ``MAX_CLASSES``; K5 has the same figures per class without one."""
    counts = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))
    if classes is None:
        vals = (df.select(F.explode(F.array(F.col(label), F.col(prediction))).alias("c"))
                .filter(F.col("c").isNotNull()).distinct().limit(MAX_CLASSES + 1).collect())
        if len(vals) > MAX_CLASSES:
            raise ValueError(f"a full confusion matrix has a cell per class pair; more than {MAX_CLASSES} classes")
        classes = sorted(r["c"] for r in vals)
    dtype = dict(counts.dtypes)["label"]
    grid = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes],
                                           f"label {dtype}, prediction {dtype}")
    return (grid.join(counts.filter(F.col("label").isNotNull() & F.col("prediction").isNotNull()),
                      ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce("count", F.lit(0).cast("long")).alias("count")))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """K5: per class precision, recall, F1 and support (from one grouped aggregate over the confusion cells)."""
    df = df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    cells = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    actual = cells.groupBy(F.col("l").alias("class")).agg(F.sum("n").alias("support"),
                                                          F.sum(F.when(F.col("l") == F.col("p"), F.col("n"))
                                                                .otherwise(0)).alias("tp"))
    predicted = cells.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    j = actual.join(predicted, "class", "full_outer").filter(F.col("class").isNotNull())
    tp = F.coalesce("tp", F.lit(0))
    prec = F.try_divide(tp.cast("double"), F.col("predicted").cast("double"))
    rec = F.try_divide(tp.cast("double"), F.col("support").cast("double"))
    return j.select("class", prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).alias("f1"),
                    F.coalesce("support", F.lit(0).cast("long")).alias("support"))


def binary_metrics(df: DataFrame, label: str, probability: str, threshold: float = 0.5, eps: float = 1e-7) -> DataFrame:
    """K6: TP/FP/TN/FN at a threshold, accuracy, precision, recall, log-loss (probabilities clipped to
    [eps, 1 - eps] as Keras does), from one aggregate."""
    y = F.col(label).cast("double")
    p = F.col(probability).cast("double")
    yhat = p > F.lit(threshold)
    pos = y == F.lit(1.0)
    pc = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    ll = -(y * F.log(pc) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - pc))
    agg = df.agg(F.sum((yhat & pos).cast("long")).alias("tp"), F.sum((yhat & ~pos).cast("long")).alias("fp"),
                 F.sum((~yhat & ~pos).cast("long")).alias("tn"), F.sum((~yhat & pos).cast("long")).alias("fn"),
                 F.avg(ll).alias("log_loss"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return agg.select("tp", "fp", "tn", "fn",
                      F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                      F.try_divide(tp, tp + fp).alias("precision"),
                      F.try_divide(tp, tp + fn).alias("recall"), "log_loss")


def predicted_counts(df: DataFrame, prediction: str) -> DataFrame:
    """K9."""
    return df.groupBy(F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("count"))


# ---- curves (K7, K8) -------------------------------------------------------------------------------------------
def score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score (descending): positives, negatives and their running totals. Rows without a label or a score
    count for neither."""
    y = F.col(label).cast("double")
    per = df.filter(F.col(score).isNotNull() & y.isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(y == 1.0, 1.0).otherwise(0.0)).alias("tp"),
        F.sum(F.when(y == 1.0, 0.0).otherwise(1.0)).alias("fp"))
    return running_totals(per, ["score"], ["tp", "fp"], ascending=False)


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """K7 points: (threshold, fpr, tpr) per distinct score, from the running totals."""
    t = score_table(df, label, score)
    tot = agg_row(t, {"P": F.sum("tp"), "N": F.sum("fp")})
    P, N = tot["P"] or 0.0, tot["N"] or 0.0
    return t.select(F.col("score").alias("threshold"),
                    F.try_divide(F.col("cum_fp"), F.lit(N)).alias("fpr"),
                    F.try_divide(F.col("cum_tp"), F.lit(P)).alias("tpr"))


def curve_areas(df: DataFrame, label: str, score: str) -> DataFrame:
    """K7 ROC-AUC and K8 PR-AUC (trapezoids; the PR curve starts at recall 0 with the first precision)."""
    t = score_table(df, label, score)
    tot = agg_row(t, {"P": F.sum("tp"), "N": F.sum("fp")})
    P, N = tot["P"] or 0.0, tot["N"] or 0.0
    prev_tp, prev_fp = F.col("cum_tp") - F.col("tp"), F.col("cum_fp") - F.col("fp")
    roc = F.try_divide(F.col("fp"), F.lit(N)) * (F.col("cum_tp") + prev_tp) / F.lit(2.0 * P) if P else F.lit(None)
    prec = F.try_divide(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp"))
    prev_prec = F.coalesce(F.try_divide(prev_tp, prev_tp + prev_fp), prec)
    pr = F.try_divide(F.col("tp"), F.lit(P)) * (prec + prev_prec) / F.lit(2.0)
    return t.agg(F.sum(roc).alias("roc_auc"), F.sum(pr).alias("pr_auc"))


# ---- cross-validated scores (K22) ----------------------------------------------------------------------------
def fold_scores(per_fold: DataFrame, metric: str) -> DataFrame:
    """Mean and (population) std of per-fold scores."""
    return per_fold.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"),
                        F.count(F.lit(1)).alias("folds"))
