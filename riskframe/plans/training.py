"""Composite train-evaluate-explain jobs: P11 (classification) and P12 (regression).

Both start from the cleaned table, prepare it once (materialised), and report a long metrics table
(stage, model, metric, value) instead of plots; fitted models are saved to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators import attribution, evaluate, explain, gram as G, models as M, sampling, scaling
from riskframe.session import materialize, release, scratch_path
from riskframe.sources import io


def _metrics_rows(stage: str, model: str, row: dict) -> list[tuple]:
    return [(stage, model, k, None if v is None else float(v)) for k, v in row.items()]


def _frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "stage string, model string, metric string, value double")


def classification_pipeline(clean: DataFrame, features: Sequence[str], label_col: str = "bmdtest_10yr_caroc",
                            positive=2, n_iter: int = 10, folds: int = 10, seed: int = 6,
                            rebalance: bool = True, repeats: int = explain.REPEATS) -> DataFrame:
    """Binary target (G10) -> scale (I1) -> train/validation/test (H2) -> SMOTE-NC on train (H6) ->
    random search on the validation split (J14, as in the reference) -> refit on train (J7) -> test metrics
    (K4-K9) -> exact attributions of the forest (K17) -> permutation importance (K16) -> save (A7)."""
    spark = clean.sparkSession
    feats = list(features)
    df = clean.withColumn("label", (F.col(label_col) == positive).cast("double")).dropna(subset=[*feats, "label"])
    df = sampling.three_way_split(df, "PatientId")
    df = sampling.kfold(df, "PatientId", folds, seed=0)
    df = materialize(df, "p11")
    scaler = scaling.fit_standard(df.filter(F.col("split") == "train"), ["PatientAge", "bmi"])
    df = scaler.transform(df)
    train = df.filter(F.col("split") == "train")
    if rebalance:
        from riskframe.operators.smote import smote_nc
        train = smote_nc(train, "label", "PatientId", numeric=["PatientAge", "bmi"],
                         nominal=[c for c in feats if c not in ("PatientAge", "bmi")])
        # the forest reads its rows in several passes, and each would make the synthetic ones anew; its draws go by
        # partition, so these stay as they are
        train = materialize(train.select("label", *feats), columnar=False)
    val = M.assemble(feats).transform(df.filter(F.col("split") == "validation"))
    rf = M.random_forest_classifier(trees=20)
    maps = M.random_param_maps(rf, {"maxDepth": [4, 6, 8], "numTrees": [10, 20, 30]}, n_iter, seed)
    cvm = M.cross_validate(rf, maps, M.auc_evaluator(), val, "fold")
    best = maps[max(range(len(maps)), key=lambda i: cvm.avgMetrics[i])]
    model = M.pipeline(feats, rf.copy(best)).fit(train)
    path = io.save_model(model, scratch_path(spark, "p11-model"))
    pred = model.transform(df.filter(F.col("split") == "test")).withColumn("p1", vector_to_array("probability")[1])
    rows = _metrics_rows("test", "random_forest", evaluate.binary_metrics(pred, "label", "p1").first().asDict())
    rows += _metrics_rows("test", "random_forest", evaluate.curve_areas(pred, "label", "p1").first().asDict())
    for r in evaluate.confusion_matrix(pred, "label", "prediction", [0.0, 1.0]).collect():
        rows.append(("test", "random_forest", f"confusion_{int(r['label'])}_{int(r['prediction'])}", float(r["count"])))
    for r in evaluate.classification_report(pred, "label", "prediction").collect():
        rows += _metrics_rows("test", "random_forest", {f"{k}_{int(r['class'])}": r[k] for k in ("precision", "recall", "f1", "support")})
    for r in evaluate.predicted_counts(pred, "prediction").collect():
        rows.append(("test", "random_forest", f"predicted_{int(r['prediction'])}", float(r["count"])))
    test = df.filter(F.col("split") == "test").select("PatientId", "label", *feats)
    trees = attribution.from_model(model.stages[-1])
    phi = attribution.tree_attributions(test, feats, trees)
    for r in attribution.summary(phi, feats).collect():
        rows.append(("explain", "random_forest", f"mean_abs_phi_{r['feature']}", r["mean_abs_phi"]))
    pi = explain.permutation_importance(test, "PatientId", feats, "label",
                                        lambda d: model.transform(d).withColumn("prediction",
                                                                                vector_to_array("probability")[1]),
                                        repeats=repeats, order_hash="xxhash64", same=explain.Trees(trees))
    for r in pi.groupBy("feature").agg(F.avg("increase").alias("v")).collect():
        rows.append(("explain", "random_forest", f"perm_increase_{r['feature']}", r["v"]))
    rows.append(("train", "random_forest", "rows_after_rebalance", float(train.count())))
    rows.append(("model", "random_forest", "saved", 1.0 if path else 0.0))
    return _frame(spark, rows)


def regression_pipeline(prepared: DataFrame, features: Sequence[str], label: str = "bmdtest_tscore_fn",
                        trials: int = 500, repeats: int = explain.REPEATS, own: bool = False) -> DataFrame:
    """Per-fold Gram matrices in one pass -> seeded search of the ridge penalty (J15) -> the linear
    family (J1-J4) on the training split -> test RMSE / MAE / R^2 (K1-K3) -> forest and boosting (J5, J6) from
    Spark ML -> learning and validation curves and feature elimination (K11-K13) -> Cook's distance summary (K14) ->
    coefficients and importances (K15) -> permutation importance (K16) -> attributions of the forest (K17, K18) ->
    error histogram (K10) -> test rows with predictions, written (K21). With ``own`` the written table of ``prepared``
    is removed as soon as this job has its own."""
    spark = prepared.sparkSession
    # Spark ML resolves input columns as (nested) paths: give dotted one-hot names plain aliases
    safe = {c: c.replace(".", "_") for c in prepared.columns if "." in c}
    prepared = prepared.withColumnsRenamed(safe)
    feats = [safe.get(c, c) for c in features]
    complete = F.lit(True)
    for c in [*feats, label]:
        complete = complete & F.col(f"`{c}`").isNotNull()
    df = sampling.kfold(prepared.filter(complete), "PatientId", 10, 0)
    df = materialize(df.withColumn("label", F.col(label).cast("double")), "p12")
    if own:
        release(prepared, "model-prep")
    train, test = df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")
    search = M.random_search_ridge(train, feats, "label", "fold", trials=trials)
    s_train = G.gram(train, feats, "label")[None]
    rows = [("search", "ridge", "best_alpha", search[0]["params"]["alpha"]),
            ("search", "ridge", "best_cv_rmse", search[0]["mean_rmse"])]
    fits = {"ols": M.ols(s_train, feats), "ridge": M.ridge(s_train, feats, search[0]["params"]["alpha"]),
            "bayesian_ridge": M.bayesian_ridge(s_train, feats), "omp": M.omp(s_train, feats, 3)}
    for name, fit in fits.items():
        pred = test.withColumn("prediction", fit.predict_expr())
        rows += _metrics_rows("test", name, evaluate.regression_metrics(pred, "label", "prediction").first().asDict())
    for name, est in (("random_forest", M.random_forest_regressor(trees=20)), ("gbt", M.gbt_regressor(iters=20))):
        model = M.pipeline(feats, est).fit(train)
        pred = model.transform(test)
        rows += _metrics_rows("test", name, evaluate.regression_metrics(pred, "label", "prediction").first().asDict())
        rows += [("importance", name, r["feature"], r["value"]) for r in M.feature_importances(model, feats, spark).collect()]
        if name == "random_forest":
            forest = attribution.from_model(model.stages[-1])
    for name, fit in fits.items():
        rows += [("coefficient", name, f, float(v)) for f, v in zip(feats, fit.coef)]
    rows += _curves(train, test, feats)
    shown = test.select("PatientId", "label", *[F.col(f"`{c}`") for c in feats])
    pi = explain.permutation_importance_many(shown, "PatientId", feats, "label",
                                             {name: fit.predict_expr() for name, fit in fits.items()}, repeats=repeats)
    for r in pi.groupBy("model", "feature").agg(F.avg("increase").alias("v")).collect():
        rows.append(("permutation", r["model"], r["feature"], r["v"]))
    phi = materialize(attribution.tree_attributions(test.withColumn("__all", F.lit(0)), feats, forest, ["PatientId", "__all"]), "p12-phi")
    rows += [("attribution", "random_forest", r["feature"], r["mean_abs_phi"]) for r in attribution.summary(phi, feats).collect()]
    for r in attribution.waterfalls(phi, feats, "PatientId", "__all").collect():
        rows.append(("waterfall", "random_forest", f"{r['PatientId']}:{r['rank']}:{r['feature']}", r["phi"]))
    from riskframe.operators.stats import agg_row
    ck = agg_row(M.cooks_distance(train, feats), {"max": F.max("cooks_distance"), "n_over_4_n": F.sum(
        (F.col("cooks_distance") > F.lit(4.0 / max(s_train["n"], 1.0))).cast("long"))})
    rows += _metrics_rows("diagnostics", "ols", ck)
    hist = evaluate.residuals(test.withColumn("prediction", fits["ols"].predict_expr()), "label", "prediction")
    from riskframe.operators.profile import histogram
    for r in histogram(hist, "residual", 25).collect():
        rows.append(("residual_histogram", "ols", f"bin_{r['bin']:02d}", float(r["count"])))
    evaluate.residuals(test.withColumn("prediction", fits["ols"].predict_expr()), "label", "prediction", ["PatientId", *feats]) \
        .write.parquet(scratch_path(spark, "p12-predictions"))
    return _frame(spark, rows)


def _curves(train: DataFrame, test: DataFrame, feats: Sequence[str]) -> list[tuple]:
    """K11 (R^2 on test by training share), K12 (R^2 over the folds by the Bayesian ridge's alpha_1) and K13 (RMSE over
    the folds by number of features), all from grouped Gram passes."""
    tenth = train.withColumn("decile", (sampling.hash_unit("PatientId", 9) % 10).cast("int"))
    per, on = G.gram(tenth, feats, "label", group="decile"), G.gram(test, feats, "label")[None]
    rows = []
    for upto in (1, 2, 5, 8, 10):
        fit = M.ols(G.combine([per[str(d)] for d in range(upto) if str(d) in per]), feats)
        total = on["yty"] - on["sy"] ** 2 / on["n"]
        rows.append(("learning_curve", "ols", f"r2_at_{10 * upto}_percent", 1.0 - M.sse_on(on, fit) / total if total > 0 else None))
    for r in M.cv_linear(train, feats, "label", "fold", [("bayesian_ridge", {"alpha_1": a}) for a in VALIDATION_POINTS]):
        rows.append(("validation_curve", "bayesian_ridge", f"r2_at_alpha_1_{r['params']['alpha_1']:.4f}", r["mean_r2"]))
    for r in M.rfe_linear(train, feats, "label", "fold"):
        rows.append(("feature_elimination", "ols", f"rmse_with_{r['n_features']}", r["cv_rmse"]))
    return rows


#: K12's 50 values of alpha_1 from 0 to 3.
VALIDATION_POINTS = [3.0 * i / 49 for i in range(50)]


__all__ = ["classification_pipeline", "regression_pipeline", "math"]
