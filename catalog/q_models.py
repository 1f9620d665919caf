"""J (models and selection) and K11-K22 (model evaluation) queries. Model outputs are rows-only checks except
where a closed form exists (1-feature OLS, Cook's distance, per-fold rule scores)."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.common import q, rnd
from catalog.q_basic import _RULE_T, rule_tscore
from catalog.sqlparts import rd
from riskframe.fixtures import patients
from riskframe.functions import rules
from riskframe.operators import boosting, comparison, evaluate, gram as G, models as M, networks, sampling, scaling
from riskframe.plans.cleaning import clean_caroc, clean_frax_dll
from riskframe.plans.training import VALIDATION_POINTS
from riskframe.session import materialize
from riskframe.spec import COHORTS


def _caroc():
    from catalog.oracles import _CAROC
    return _CAROC


# fixed feature list of the T-score regressors (age, sex, BMI and their pairwise interactions)
REG_FEATURES = ["PatientAge", "PatientGender", "bmi", "Age*Gender", "Age*bmi", "Gender*bmi", "parentbreak", "alcohol",
                "smoke", "arthritis", "diabetes", "oralster"]
CLS_FEATURES = ["PatientAge", "PatientGender", "bmi", "alcohol", "smoke", "arthritis", "diabetes"]


def training_frame(spark, sf, folds: int = 10):
    """Cleaned CAROC table + interaction terms + a deterministic fold and split column."""
    c = clean_caroc(patients(spark, sf))
    c = c.withColumns({"Age*Gender": F.col("PatientAge") * F.col("PatientGender"),
                       "Age*bmi": F.col("PatientAge") * F.col("bmi"),
                       "Gender*bmi": F.col("PatientGender") * F.col("bmi"),
                       "label": F.col("bmdtest_tscore_fn"),
                       "high": (F.col("bmdtest_10yr_caroc") == 2).cast("double")})
    c = c.dropna(subset=["label", *REG_FEATURES])
    c = sampling.kfold(c, "PatientId", folds, seed=0)
    # iterative learners scan their input many times: cut the lineage once, in the shared checkpoint folder
    # rows sorted inside each partition: the forests' per-partition bootstrap then sees a fixed row order, so a
    # seeded fit is reproducible (shuffle fetch order is not)
    return materialize(sampling.with_split(c, "PatientId", 20, seed=2).sortWithinPartitions("PatientId"),
                       "training-frame")


def _vec(df, feats):
    return M.assemble(feats).transform(df)


# ---- J1-J4 linear family ----------------------------------------------------------------------------------------
@q("j1_linear_regression", _caroc() + f"SELECT '(intercept)' AS feature, {rd('regr_intercept(bmdtest_tscore_fn, PatientAge)')} AS coefficient FROM caroc "
                                      f"UNION ALL SELECT 'PatientAge', {rd('regr_slope(bmdtest_tscore_fn, PatientAge)')} FROM caroc")
def j1_linear_regression(spark, sf):
    """J1 with Spark ML (normal equations) on one feature, which has a closed-form SQL oracle."""
    c = clean_caroc(patients(spark, sf)).filter(F.col("bmdtest_tscore_fn").isNotNull() & F.col("PatientAge").isNotNull())
    model = M.linear_regression("bmdtest_tscore_fn").fit(_vec(c, ["PatientAge"]))
    rows = [("(intercept)", float(model.intercept)), ("PatientAge", float(model.coefficients[0]))]
    return rnd(spark.createDataFrame(rows, "feature string, coefficient double"))


def _gram_fit(spark, sf, name, **params):
    t = training_frame(spark, sf)
    s = G.gram(t, REG_FEATURES, "label")[None]
    return M.fit_linear(name, s, REG_FEATURES, **params).coefficients(spark)


@q("j1_ols_gram")
def j1_ols_gram(spark, sf):
    return _gram_fit(spark, sf, "ols")


@q("j2_ridge")
def j2_ridge(spark, sf):
    return _gram_fit(spark, sf, "ridge", alpha=10.0)


@q("j3_bayesian_ridge")
def j3_bayesian_ridge(spark, sf):
    return _gram_fit(spark, sf, "bayesian_ridge")


@q("j4_orthogonal_matching_pursuit")
def j4_orthogonal_matching_pursuit(spark, sf):
    return _gram_fit(spark, sf, "omp", n_nonzero=3)


# ---- J5-J7 trees ---------------------------------------------------------------------------------------------------
def _test_predictions(model, test, keep=("PatientId", "label")):
    return model.transform(test).select(*keep, "prediction")


@q("j5_random_forest_regressor")
def j5_random_forest_regressor(spark, sf):
    t = training_frame(spark, sf)
    train, test = t.filter(F.col("split") == "train"), t.filter(F.col("split") == "test")
    model = M.pipeline(REG_FEATURES, M.random_forest_regressor(trees=30, depth=6)).fit(train)
    return evaluate.regression_metrics(_test_predictions(model, test), "label", "prediction")


@q("j6_gbt_early_stopping")
def j6_gbt_early_stopping(spark, sf):
    t = training_frame(spark, sf).withColumn("is_val", F.col("fold") == 0)
    train, test = t.filter(F.col("split") == "train"), t.filter(F.col("split") == "test")
    model = M.pipeline(REG_FEATURES, M.gbt_regressor(iters=40, validation_col="is_val")).fit(train)
    return evaluate.regression_metrics(_test_predictions(model, test), "label", "prediction")


@q("j7_random_forest_classifier")
def j7_random_forest_classifier(spark, sf):
    """Binary CAROC high-risk classifier; hold-out predicted-class counts and AUC."""
    t = training_frame(spark, sf).filter(F.col("high").isNotNull())
    train, test = t.filter(F.col("split") == "train"), t.filter(F.col("split") == "test")
    model = M.pipeline(CLS_FEATURES, M.random_forest_classifier(label="high", trees=30)).fit(train)
    pred = model.transform(test).withColumn("p1", vector_to_array("probability")[1])
    areas = evaluate.curve_areas(pred, "high", "p1").collect()[0]
    return evaluate.predicted_counts(pred, "prediction").withColumns(
        {"roc_auc": F.lit(areas["roc_auc"]), "pr_auc": F.lit(areas["pr_auc"])})


FRAX_FEATURES = ["PatientAge", "PatientGender", "bmi", "parentbreak", "alcohol", "oralster", "smoke", "arthritis",
                 "diabetes", "obreak"]


@q("j7_frax_band_classifier")
def j7_frax_band_classifier(spark, sf):
    """3-class FRAX band (Low / Moderate / High) from the FRAX cleaner; 20 % hold-out predictions by class."""
    from pyspark.ml.feature import IndexToString, StringIndexer
    f = clean_frax_dll(patients(spark, sf)).filter(F.col("Frax_No_BMD_RiskLevel") != "")
    f = sampling.with_split(f, "PatientId", 20, seed=2)
    idx = StringIndexer(inputCol="Frax_No_BMD_RiskLevel", outputCol="label", stringOrderType="alphabetAsc")
    pipe = M.Pipeline(stages=[idx, M.assemble(FRAX_FEATURES), M.random_forest_classifier(trees=30)])
    model = pipe.fit(f.filter(F.col("split") == "train"))
    labels = model.stages[0].labels
    pred = model.transform(f.filter(F.col("split") == "test"))
    pred = IndexToString(inputCol="prediction", outputCol="predicted_band", labels=labels).transform(pred)
    return pred.groupBy("predicted_band").agg(F.count(F.lit(1)).alias("n"))


@q("j8_kernel_svc")
def j8_kernel_svc(spark, sf):
    t = training_frame(spark, sf).filter(F.col("high").isNotNull())
    t, _ = scaling.scale(t, ["PatientAge", "bmi"], "standard")
    train, test = t.filter(F.col("split") == "train"), t.filter(F.col("split") == "test")
    svc = M.KernelSVC(CLS_FEATURES, n_components=32, gamma=0.5).fit(train, "high")
    return evaluate.curve_areas(svc.transform(test), "high", "probability_1")


@q("j9_mlp_classifier")
def j9_mlp_classifier(spark, sf):
    t = training_frame(spark, sf).filter(F.col("high").isNotNull())
    t, _ = scaling.scale(t, ["PatientAge", "bmi"], "standard")
    train, test = t.filter(F.col("split") == "train"), t.filter(F.col("split") == "test")
    model = M.pipeline(CLS_FEATURES, M.mlp_classifier(len(CLS_FEATURES), (100, 100, 50), label="high", iters=30)).fit(train)
    pred = model.transform(test).withColumn("p1", vector_to_array("probability")[1])
    return evaluate.binary_metrics(pred, "high", "p1")


@q("j11_mlp_32_16_normalised")
def j11_mlp_32_16_normalised(spark, sf):
    """I4 (every feature normalised) then a 32-16 network; K6 metrics on the hold-out."""
    t = training_frame(spark, sf).filter(F.col("high").isNotNull())
    train0 = t.filter(F.col("split") == "train")
    scaler = scaling.fit_standard(train0, CLS_FEATURES)
    train, test = scaler.transform(train0), scaler.transform(t.filter(F.col("split") == "test"))
    model = M.pipeline(CLS_FEATURES, M.mlp_classifier(len(CLS_FEATURES), (32, 16), label="high", iters=50)).fit(train)
    pred = model.transform(test).withColumn("p1", vector_to_array("probability")[1])
    return evaluate.binary_metrics(pred, "high", "p1")


@q("j11_dropout_network")
def j11_dropout_network(spark, sf):
    """J11 as the reference has it: a 32-16 network with dropout 0.5 before the output, on normalised inputs, by plain
    gradient steps; K6 metrics on the hold-out."""
    _, test, net = _dropout_network(spark, sf)
    return evaluate.binary_metrics(test.withColumn("p1", net.predict_expr()), "high", "p1")


def _dropout_network(spark, sf):
    t = training_frame(spark, sf).filter(F.col("high").isNotNull())
    scaler = scaling.fit_standard(t.filter(F.col("split") == "train"), CLS_FEATURES)
    t = scaler.transform(t).withColumn("held", F.col("fold") < 2)
    train, test = t.filter(F.col("split") == "train"), t.filter(F.col("split") == "test")
    spec = networks.Spec((32, 16), "bce", dropout=(0.0, 0.5), optimiser="sgd", rate=0.3)
    return train, test, networks.train(train, CLS_FEATURES, "high", {"32-16": spec}, epochs=K20_EPOCHS, steps=4, validation="held")["32-16"]


#: Epochs of the registered queries: the reference's 100 and 1000, and for J13 fewer than its 1000.
K20_EPOCHS, J12_EPOCHS, J13_EPOCHS = 100, 1000, 15
_DROPOUTS = {"": 0.0, "_dropout20": 0.2, "_dropout50": 0.5}


@q("k20_epoch_metrics")
def k20_epoch_metrics(spark, sf):
    """Loss, counts, precision, recall and areas of J11's network after every epoch, on training and validation rows."""
    return networks.history_frame(spark, {"32-16": _dropout_network(spark, sf)[2]})


# ---- J13 cohort grid -------------------------------------------------------------------------------------------
@q("j13_cohort_grid")
def j13_cohort_grid(spark, sf):
    """Every cohort with its own feature list, 75/25: the linear family from one pass of sums, and the two-layer
    networks plain and with dropout 0.2 and 0.5, on normalised features; hold-out RMSE."""
    t = sampling.with_split(training_frame(spark, sf), "PatientId", 25, seed=40)
    rows = []
    for cohort in COHORTS:
        c = t if cohort.filter_col is None else t.filter(F.col(cohort.filter_col) == cohort.filter_value)
        feats = list(cohort.features)
        c = materialize(c.select("PatientId", "label", "split", *[F.col(f).cast("double").alias(f) for f in feats]).dropna(),
                        f"cohort-{cohort.name}")
        c = scaling.fit_standard(c, feats).transform(c)
        train, test = c.filter(F.col("split") == "train"), c.filter(F.col("split") == "test")
        fit_on, score_on = (G.gram(x, feats, "label")[None] for x in (train, test))
        for name, params in (("ols", {}), ("ridge", {"alpha": 10.0}), ("bayesian_ridge", {})):
            fit = M.fit_linear(name, fit_on, feats, **params)
            rows.append((cohort.name, name, int(score_on["n"]),
                         math.sqrt(max(M.sse_on(score_on, fit), 0.0) / score_on["n"])))
        nets = networks.train(train, feats, "label", {f"network{n}": networks.Spec(dropout=d) for n, d in _DROPOUTS.items()},
                              epochs=J13_EPOCHS, steps=2)
        for name, net in nets.items():
            rmse = evaluate.regression_metrics(test.withColumn("prediction", net.predict_expr()), "label",
                                               "prediction").first()["rmse"]
            rows.append((cohort.name, name, int(score_on["n"]), rmse))
    return spark.createDataFrame(rows, "cohort string, model string, n long, test_rmse double")


# ---- J14-J18 selection --------------------------------------------------------------------------------------------
@q("j14_random_search_cv")
def j14_random_search_cv(spark, sf, draws: int = 10, folds: int = 10):
    """Seeded random draws of forest parameters, 10 draws x 10 hash folds, fitted on the validation split as in the
    reference."""
    t = sampling.three_way_split(training_frame(spark, sf, folds=folds).filter(F.col("high").isNotNull()), "PatientId")
    t = materialize(M.assemble(CLS_FEATURES).transform(t.filter(F.col("split") == "validation")), "validation")
    rf = M.random_forest_classifier(label="high", trees=20)
    maps = M.random_param_maps(rf, {"maxDepth": [3, 5, 8], "numTrees": [10, 20, 50], "minInstancesPerNode": [1, 5]}, draws, 6)
    cvm = M.cross_validate(rf, maps, M.auc_evaluator("high"), t, "fold")
    rows = [(str({p.name: v for p, v in m.items()}), float(a)) for m, a in zip(maps, cvm.avgMetrics)]
    return spark.createDataFrame(rows, "params string, mean_auc double")


@q("j15_bayes_search_ridge")
def j15_bayes_search_ridge(spark, sf):
    """500 seeded trials x 10 folds of ridge from one pass of per-fold Gram matrices: every trial, best first."""
    res = M.random_search_ridge(training_frame(spark, sf), REG_FEATURES, "label", "fold", trials=500)
    return spark.createDataFrame([(r["params"]["alpha"], r["mean_rmse"], r["std_rmse"]) for r in res],
                                 "alpha double, mean_rmse double, std_rmse double")


@q("j15_bayes_search_bayesian_ridge")
def j15_bayes_search_bayesian_ridge(spark, sf):
    """500 seeded draws of the four Gamma priors x 10 folds, from the same single pass: every trial, best first."""
    res = M.random_search_bayesian_ridge(training_frame(spark, sf), REG_FEATURES, "label", "fold")
    names = ("alpha_1", "alpha_2", "lambda_1", "lambda_2")
    return spark.createDataFrame([(*(r["params"][n] for n in names), r["mean_rmse"], r["std_rmse"]) for r in res],
                                 ", ".join(f"{n} double" for n in names) + ", mean_rmse double, std_rmse double")


@q("j16_grid_search")
def j16_grid_search(spark, sf):
    t = M.assemble(REG_FEATURES).transform(training_frame(spark, sf))
    gbt = M.gbt_regressor(iters=20)
    tvs = M.grid_search(gbt, {"maxDepth": [3, 5], "stepSize": [0.05, 0.1]}, M.rmse_evaluator(), t)
    return spark.createDataFrame([(float(v),) for v in tvs.validationMetrics], "validation_rmse double")


#: The reference's grid with a twenty-fifth of its iterations (100 to 300) and about as much of its patience (10 to 160).
_SMALL_GRID = {**boosting.GRID, "iterations": (4, 6, 8, 12), "early_stopping_rounds": (1, 2, 3, 6, 12)}


@q("j16_boosting_grid")
def j16_boosting_grid(spark, sf):
    """All 4 x 2 x 4 x 4 x 5 points of the grid from 32 candidates that grow in step, one job per level of their trees."""
    t = training_frame(spark, sf).withColumn("held", F.col("fold") < 2)
    return boosting.grid_search(t, REG_FEATURES, "label", "held", _SMALL_GRID)


@q("j6_histogram_boosting")
def j6_histogram_boosting(spark, sf):
    """Boosting with an L2 leaf penalty and early stopping on a validation fold; metrics on the hold-out."""
    t = training_frame(spark, sf).withColumn("held", F.col("fold") == 0)
    train, test = t.filter(F.col("split") == "train"), t.filter(F.col("split") == "test")
    model = boosting.fit(train, REG_FEATURES, "label", "held", [(0.3, 4, 1.0)], iterations=30, patience=5)[0]
    best = model.stopped(30, 5)[1]
    return evaluate.regression_metrics(test.withColumn("prediction", model.predict_expr(best)), "label", "prediction")


@q("j17_leaderboard")
def j17_leaderboard(spark, sf):
    """Cross-validated RMSE, 10 folds each, of the linear family (one Gram pass) and of a random forest (Spark CV),
    sorted, top 3."""
    t = training_frame(spark, sf)
    res = M.cv_linear(t, REG_FEATURES, "label", "fold",
                      [("ols", {}), ("ridge", {"alpha": 1.0}), ("bayesian_ridge", {}), ("omp", {"n_nonzero": 3})])
    rows = [(r["model"], r["mean_rmse"], r["std_rmse"]) for r in res]
    t10 = M.assemble(REG_FEATURES).transform(t)
    rf = M.random_forest_regressor(trees=20, depth=6)
    cvm = M.cross_validate(rf, [{}], M.rmse_evaluator(), t10, "fold")
    rows.append(("random_forest", float(cvm.avgMetrics[0]), float(cvm.stdMetrics[0])))
    board = spark.createDataFrame(rows, "model string, mean_rmse double, std_rmse double")
    return board.orderBy("mean_rmse", "model").limit(3)


_BOARD = {"ols": ("ols", {}), "ridge": ("ridge", {"alpha": 1.0}), "lasso": ("lasso", {"alpha": 0.01}), "elastic_net": ("elastic_net", {"alpha": 0.01}),
          "least_angle": ("least_angle", {}), "bayesian_ridge": ("bayesian_ridge", {}), "omp": ("omp", {"n_nonzero": 3})}


@q("j17_full_leaderboard")
def j17_full_leaderboard(spark, sf):
    """RMSE, MAE and R^2 over 10 folds of the linear, sparse and robust models (Gram passes) and of forest, boosting and
    a single tree (fitted per fold), best first."""
    from pyspark.ml.regression import DecisionTreeRegressor
    trees = {"random_forest": M.random_forest_regressor(trees=20, depth=6), "boosting": M.gbt_regressor(iters=10),
             "tree": DecisionTreeRegressor(featuresCol="features", labelCol="label", maxDepth=5)}
    return comparison.leaderboard(training_frame(spark, sf), REG_FEATURES, "label", "fold", _BOARD, trees)


@q("j18_top_models")
def j18_top_models(spark, sf):
    """The three best linear models of the comparison and OMP: 100 draws each over 10 folds, then refitted on all rows."""
    t = training_frame(spark, sf)
    board = comparison.leaderboard(t, REG_FEATURES, "label", "fold", _BOARD, robust=False).limit(3).collect()
    kinds = list(dict.fromkeys([*(r["model"] for r in board), "omp"]))
    rows = [(kind, str(params), score, f, float(b)) for kind, (params, score, fit) in
            comparison.tune_and_finalise(t, REG_FEATURES, "label", "fold", kinds).items()
            for f, b in [*zip(REG_FEATURES, fit.coef), ("(intercept)", fit.intercept)]]
    return spark.createDataFrame(rows, "model string, params string, cv_rmse double, feature string, coefficient double")


@q("j18_tune_and_refit")
def j18_tune_and_refit(spark, sf):
    """Ridge penalty chosen by 10-fold CV (one Gram pass), then refit on all rows (finalize)."""
    t = training_frame(spark, sf)
    best = M.random_search_ridge(t, REG_FEATURES, "label", "fold", trials=100)[0]
    full = G.gram(t, REG_FEATURES, "label")[None]
    return M.ridge(full, REG_FEATURES, best["params"]["alpha"]).coefficients(spark)


# ---- K11-K22 ------------------------------------------------------------------------------------------------------
@q("k11_learning_curve")
def k11_learning_curve(spark, sf):
    """Nested training fractions (hash deciles of the train split) from ONE grouped Gram pass; R^2 on test."""
    t = training_frame(spark, sf)
    train = t.filter(F.col("split") == "train").withColumn("decile", (sampling.hash_unit("PatientId", 9) % 10)
                                                           .cast("int"))
    per = G.gram(train, REG_FEATURES, "label", group="decile")
    test = G.gram(t.filter(F.col("split") == "test"), REG_FEATURES, "label")[None]
    rows = []
    for upto in (1, 2, 5, 8, 10):
        s = G.combine([per[str(d)] for d in range(upto) if str(d) in per])
        fit = M.ols(s, REG_FEATURES)
        sst = test["yty"] - test["sy"] ** 2 / test["n"]
        rows.append((upto / 10.0, int(s["n"]), 1.0 - M.sse_on(test, fit) / sst))
    return spark.createDataFrame(rows, "fraction double, n_train long, test_r2 double")


@q("k12_validation_curve")
def k12_validation_curve(spark, sf):
    """R^2 over 10 folds against the Bayesian ridge's alpha_1 (50 points from 0 to 3)."""
    cands = [("bayesian_ridge", {"alpha_1": a}) for a in VALIDATION_POINTS]
    res = M.cv_linear(training_frame(spark, sf), REG_FEATURES, "label", "fold", cands)
    return spark.createDataFrame([(r["params"]["alpha_1"], r["mean_r2"], r["std_r2"]) for r in res],
                                 "alpha_1 double, mean_r2 double, std_r2 double")


@q("k13_recursive_feature_elimination")
def k13_recursive_feature_elimination(spark, sf):
    res = M.rfe_linear(training_frame(spark, sf), REG_FEATURES, "label", "fold")
    return spark.createDataFrame([(r["n_features"], ",".join(r["features"]), r["cv_rmse"]) for r in res],
                                 "n_features int, features string, cv_rmse double")


def _cooks_sql():
    return _caroc() + f""", d AS (SELECT PatientId, PatientAge AS x, bmdtest_tscore_fn AS y FROM caroc
  WHERE PatientAge IS NOT NULL AND bmdtest_tscore_fn IS NOT NULL),
s AS (SELECT count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d),
r AS (SELECT PatientId, y - (a + b * x) AS e, 1.0 / n + pow(x - mx, 2) / sxx AS h, n FROM d, s),
s2 AS (SELECT sum(e * e) / (max(n) - 2) AS mse FROM r)
SELECT PatientId, {rd('h')} AS leverage, {rd('e * e * h / (2 * mse * pow(1 - h, 2))')} AS cooks_distance FROM r, s2"""


@q("k14_cooks_distance", _cooks_sql())
def k14_cooks_distance(spark, sf):
    """Leverage x'(X'X)^-1 x as a column expression with the inverse Gram matrix inlined (p x p, p = 2)."""
    c = clean_caroc(patients(spark, sf)).filter(F.col("PatientAge").isNotNull() & F.col("bmdtest_tscore_fn").isNotNull())
    return rnd(M.cooks_distance(c, ["PatientAge"], "bmdtest_tscore_fn").select("PatientId", "leverage", "cooks_distance"))


@q("k15_feature_importances")
def k15_feature_importances(spark, sf):
    t = training_frame(spark, sf).filter(F.col("high").isNotNull())
    model = M.pipeline(CLS_FEATURES, M.random_forest_classifier(label="high", trees=20)).fit(t)
    return M.feature_importances(model, CLS_FEATURES, spark)


@q("k20_epoch_history")
def k20_epoch_history(spark, sf):
    t = training_frame(spark, sf).filter(F.col("high").isNotNull())
    model = M.pipeline(CLS_FEATURES, M.logistic(label="high")).fit(t)
    return M.objective_history(model, spark)


@q("k21_export_predictions")
def k21_export_predictions(spark, sf):
    """Scale (fitted on train), fit, predict the test split, report features back in original units."""
    t = training_frame(spark, sf)
    train0, test0 = t.filter(F.col("split") == "train"), t.filter(F.col("split") == "test")
    scaler = scaling.fit_standard(train0, ["PatientAge", "bmi"])
    model = M.pipeline(REG_FEATURES, M.linear_regression()).fit(scaler.transform(train0))
    pred = model.transform(scaler.transform(test0))
    return scaler.inverse(pred.select("PatientId", "PatientAge", "bmi", "label", "prediction"))


@q("k22_cv_scores", _caroc() + f""", f AS (SELECT CAST(('0x' || substr(md5(coalesce(CAST(PatientId AS VARCHAR), '') || ':0'), 1, 8))::BIGINT % 10 AS INT) AS fold,
  pow({_RULE_T} - bmdtest_tscore_fn, 2) AS se FROM caroc WHERE bmdtest_tscore_fn IS NOT NULL),
pf AS (SELECT fold, sqrt(avg(se)) AS rmse FROM f GROUP BY fold)
SELECT {rd('avg(rmse)')} AS mean, {rd('stddev_pop(rmse)')} AS std, count(*) AS folds FROM pf""")
def k22_cv_scores(spark, sf):
    """Per-fold RMSE of the rule predictor on the 10 hash folds, then mean and std."""
    c = sampling.kfold(clean_caroc(patients(spark, sf)).filter(F.col("bmdtest_tscore_fn").isNotNull()),
                       "PatientId", 10, 0)
    err = F.pow(rule_tscore() - F.col("bmdtest_tscore_fn"), 2)
    per = c.groupBy("fold").agg(F.sqrt(F.avg(err)).alias("rmse"))
    return rnd(evaluate.fold_scores(per, "rmse"))


# ---- J10 / J12 / N2 ------------------------------------------------------------------------------------------------
@q("j10_stacking")
def j10_stacking(spark, sf):
    """Kernel SVC + forest + network bases, 5-fold out-of-fold probabilities, logistic meta-model; hold-out K6
    metrics."""
    t = training_frame(spark, sf, folds=5).filter(F.col("high").isNotNull())
    t, _ = scaling.scale(t, ["PatientAge", "bmi"], "standard")
    train, test = t.filter(F.col("split") == "train"), t.filter(F.col("split") == "test")
    stack = M.fit_stacking(train, CLS_FEATURES, "high", "fold",
                           {"svc": M.KernelSVC(CLS_FEATURES, n_components=32),
                            "rf": M.random_forest_classifier(label="label", trees=20, depth=6),
                            "mlp": M.mlp_classifier(len(CLS_FEATURES), (32, 16), label="label", iters=30)})
    pred = stack.transform(test).withColumn("p1", vector_to_array("probability")[1])
    return evaluate.binary_metrics(pred, "high", "p1")


@q("j12_mlp_regression_variants")
def j12_mlp_regression_variants(spark, sf):
    """Networks trained in step: plain, L1, L2, dropout, MAE loss and other layers, on standardised inputs; test RMSE and
    the training loss of the first and the last epoch."""
    t = training_frame(spark, sf)
    feats = ["PatientAge", "PatientGender", "bmi", "parentbreak", "alcohol", "smoke", "arthritis", "diabetes"]
    train0, test0 = t.filter(F.col("split") == "train"), t.filter(F.col("split") == "test")
    sc = scaling.fit_standard(train0, feats)
    train, test = sc.transform(train0), sc.transform(test0)
    variants = {"plain": {}, "l1": {"l1": 1e-3}, "l2": {"l2": 1e-3}, "dropout": {"dropout": 0.2},
                "mae": {"loss": "mae"}, "32-16": {"hidden": (32, 16)}, "wide": {"hidden": (500,)}, "narrow": {"hidden": (2,)}}
    nets = networks.train(train, feats, "label", {n: networks.Spec(**kw) for n, kw in variants.items()}, epochs=J12_EPOCHS, steps=4)
    rows = []
    for name, m in nets.items():
        rmse = evaluate.regression_metrics(test.withColumn("prediction", m.predict_expr()), "label",
                                           "prediction").first()["rmse"]
        rows.append((name, float(rmse), *(m.history[i]["train"]["loss"] for i in (0, -1))))
    return spark.createDataFrame(rows, "variant string, test_rmse double, first_round_loss double, "
                                       "last_round_loss double")


@q("n2_boruta_selection")
def n2_boruta_selection(spark, sf):
    t = training_frame(spark, sf)
    res = M.boruta(t, ["PatientAge", "PatientGender", "bmi", "parentbreak", "alcohol", "smoke"], "label",
                   "PatientId")
    return spark.createDataFrame(res, "feature string, hits int, decision string")
