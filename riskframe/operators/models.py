"""Model training and selection (J1-J18) on Spark ML, plus closed-form linear models on one-pass Gram matrices.

Tree, boosting, MLP and logistic models are Spark ML estimators (distributed fitting). The linear family (OLS,
ridge, Bayesian ridge, OMP) and everything built on it (per-fold CV of many candidates, RFE, Cook's distance)
reads the data ONCE: ``gram.gram`` returns X'X, X'y per fold; every candidate model and fold is then a k x k
solve on the driver, with no further Spark job.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators import gram as G


def assemble(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip")


def pipeline(features: Sequence[str], estimator) -> Pipeline:
    """encode/assemble -> estimator as one Spark ML Pipeline (saved and loaded as a unit, A7)."""
    return Pipeline(stages=[assemble(features), estimator])


# ---- Spark ML estimators ----------------------------------------------------------------------------------------
def linear_regression(label: str = "label", elastic_net: float = 0.0, reg: float = 0.0) -> LinearRegression:
    """J1 (reg=0, normal equations); the L1/L2 controls of J12 use elastic_net 1/0."""
    return LinearRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=elastic_net,
                            solver="normal" if elastic_net == 0 else "auto", standardization=False)


def random_forest_regressor(label: str = "label", trees: int = 50, depth: int = 6, seed: int = 6,
                            subset: str = "auto") -> RandomForestRegressor:
    """J5."""
    return RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed,
                                 featureSubsetStrategy=subset)


def gbt_regressor(label: str = "label", iters: int = 50, step: float = 0.1, depth: int = 4, seed: int = 0,
                  validation_col: str | None = None) -> GBTRegressor:
    """Gradient boosting with early stopping on a validation indicator column."""
    g = GBTRegressor(featuresCol="features", labelCol=label, maxIter=iters, stepSize=step, maxDepth=depth, seed=seed)
    if validation_col:
        g = g.setValidationIndicatorCol(validation_col)
        g.set(g.validationTol, 0.01)
    return g


def random_forest_classifier(label: str = "label", trees: int = 50, depth: int = 8, seed: int = 6) -> RandomForestClassifier:
    """J7."""
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)


def mlp_classifier(n_features: int, hidden: Sequence[int] = (100, 100, 50), classes: int = 2, label: str = "label",
                   iters: int = 100, seed: int = 1) -> MultilayerPerceptronClassifier:
    """J9 (100-100-50) / J11 (32-16)."""
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol=label,
                                          layers=[n_features, *hidden, classes], maxIter=iters, seed=seed)


def logistic(label: str = "label", features: str = "features", reg: float = 0.0) -> LogisticRegression:
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=reg, maxIter=100)


# ---- J8: RBF kernel SVC re-aimed as random Fourier features + linear SVM + logistic calibration ------------------
def random_fourier_features(features: Sequence[str], n_components: int = 64, gamma: float = 0.5,
                            seed: int = 0) -> dict[str, Column]:
    """z_m(x) = sqrt(2/D) cos(w_m . x + b_m), w ~ N(0, 2 gamma I), b ~ U(0, 2 pi) (Rahimi & Recht 2007): plain
    column expressions, so the kernel map stays inside whole-stage codegen."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_components, len(features)))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
    scale = math.sqrt(2.0 / n_components)
    out = {}
    for m in range(n_components):
        dot = F.lit(float(b[m]))
        for j, c in enumerate(features):
            dot = dot + F.lit(float(w[m, j])) * F.col(c).cast("double")
        out[f"rff_{m}"] = F.lit(scale) * F.cos(dot)
    return out


@dataclass
class KernelSVC:
    """Fit on a DataFrame with ``features`` columns and a 0/1 ``label``; ``transform`` adds ``probability_1``."""

    features: Sequence[str]
    n_components: int = 64
    gamma: float = 0.5
    c: float = 1.0
    seed: int = 0
    svm: object = None
    calib: object = None

    def _map(self, df: DataFrame) -> DataFrame:
        rff = random_fourier_features(self.features, self.n_components, self.gamma, self.seed)
        return VectorAssembler(inputCols=list(rff), outputCol="rff").transform(df.withColumns(rff)).drop(*rff)

    def fit(self, df: DataFrame, label: str = "label") -> "KernelSVC":
        mapped = self._map(df)
        # the summed-loss penalty 1/2 |w|^2 + C sum(loss) as a mean loss: 1 / (C n)
        self.svm = LinearSVC(featuresCol="rff", labelCol=label, regParam=1.0 / (self.c * max(mapped.count(), 1)),
                             maxIter=50).fit(mapped)
        margin = self._margin(self.svm.transform(mapped))
        self.calib = Pipeline(stages=[VectorAssembler(inputCols=["margin"], outputCol="mfeat"),
                                      LogisticRegression(featuresCol="mfeat", labelCol=label)]).fit(margin)
        return self

    @staticmethod
    def _margin(scored: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        return scored.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction")

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        m = self._margin(self.svm.transform(self._map(df)))
        out = self.calib.transform(m)
        return (out.withColumn("probability_1", vector_to_array("probability")[1])
                .drop("rff", "mfeat", "rawPrediction", "probability", "margin"))


# ---- closed-form linear models on Gram matrices -------------------------------------------------------------------
@dataclass
class LinearFit:
    features: list[str]
    coef: np.ndarray
    intercept: float
    info: dict = field(default_factory=dict)

    def predict_expr(self) -> Column:
        e = F.lit(float(self.intercept))
        for c, b in zip(self.features, self.coef):
            e = e + F.lit(float(b)) * F.col(f"`{c}`").cast("double")
        return e

    def coefficients(self, spark) -> DataFrame:
        rows = [(c, float(b)) for c, b in zip(self.features, self.coef)] + [("(intercept)", float(self.intercept))]
        return spark.createDataFrame(rows, "feature string, coefficient double")


def ols(s: dict, features: Sequence[str]) -> LinearFit:
    """J1 on sufficient statistics (least squares with intercept; pseudo-inverse for rank deficiency)."""
    sxx, sxy, _, mx, my = G.centred(s)
    b = np.linalg.pinv(sxx) @ sxy
    return LinearFit(list(features), b, float(my - mx @ b))


def ridge(s: dict, features: Sequence[str], alpha: float = 1.0) -> LinearFit:
    """(Sxx + alpha I) b = Sxy on centred statistics (the intercept is not penalised)."""
    sxx, sxy, _, mx, my = G.centred(s)
    b = np.linalg.solve(sxx + alpha * np.eye(len(sxy)), sxy)
    return LinearFit(list(features), b, float(my - mx @ b), {"alpha": alpha})


def bayesian_ridge(s: dict, features: Sequence[str], alpha_1: float = 1e-6, alpha_2: float = 1e-6,
                   lambda_1: float = 1e-6, lambda_2: float = 1e-6, n_iter: int = 300, tol: float = 1e-3) -> LinearFit:
    """Evidence maximisation (MacKay 1992) for the noise precision alpha and weight precision lambda,
    with the Gamma hyper-priors; one eigendecomposition of the centred X'X, then only k-sized updates."""
    sxx, sxy, syy, mx, my = G.centred(s)
    n = s["n"]
    eig, v = np.linalg.eigh(sxx)
    eig = np.clip(eig, 0.0, None)
    var_y = syy / n if n else 1.0
    alpha = 1.0 / (var_y + 1e-12)
    lam = 1.0
    vty = v.T @ sxy
    coef = np.zeros(len(sxy))
    for it in range(n_iter):
        coef_new = v @ (vty / (eig + lam / alpha))
        sse = syy - 2.0 * coef_new @ sxy + coef_new @ sxx @ coef_new
        gamma = float(np.sum(alpha * eig / (lam + alpha * eig)))
        lam = (gamma + 2.0 * lambda_1) / (float(coef_new @ coef_new) + 2.0 * lambda_2)
        alpha = (n - gamma + 2.0 * alpha_1) / (max(sse, 0.0) + 2.0 * alpha_2)
        if it > 0 and np.sum(np.abs(coef_new - coef)) < tol:
            coef = coef_new
            break
        coef = coef_new
    coef = v @ (vty / (eig + lam / alpha))
    return LinearFit(list(features), coef, float(my - mx @ coef), {"alpha": alpha, "lambda": lam, "iterations": it + 1})


def omp(s: dict, features: Sequence[str], n_nonzero: int | None = None) -> LinearFit:
    """Orthogonal matching pursuit on the Gram matrix - greedy selection of the feature most correlated with
    the current residual, then least squares on the selected set."""
    sxx, sxy, _, mx, my = G.centred(s)
    k = len(sxy)
    n_nonzero = n_nonzero or max(int(0.1 * k), 1)
    chosen: list[int] = []
    coef = np.zeros(k)
    for _ in range(n_nonzero):
        resid_corr = sxy - sxx[:, chosen] @ coef[chosen] if chosen else sxy.copy()
        resid_corr[chosen] = 0.0
        j = int(np.argmax(np.abs(resid_corr)))
        if abs(resid_corr[j]) < 1e-12:
            break
        chosen.append(j)
        sub = np.linalg.pinv(sxx[np.ix_(chosen, chosen)]) @ sxy[chosen]
        coef = np.zeros(k)
        coef[chosen] = sub
    return LinearFit(list(features), coef, float(my - mx @ coef), {"selected": [features[i] for i in chosen]})


def sse_on(s: dict, fit: LinearFit) -> float:
    """Sum of squared errors of ``fit`` on data summarised by ``s`` (no data pass)."""
    b = np.asarray(fit.coef)
    c = fit.intercept + float(b @ s["x0"]) - s["y0"]
    return float(s["yty"] - 2 * (b @ s["xty"]) - 2 * c * s["sy"] + b @ s["xtx"] @ b + 2 * c * (b @ s["sx"])
                 + c * c * s["n"])


def cv_linear(df: DataFrame, features: Sequence[str], label: str, fold_col: str,
              candidates: Sequence[tuple[str, dict]]) -> list[dict]:
    """J15 / K22 for the linear family: per-fold Gram matrices in ONE pass, then every candidate x fold is
    evaluated from sums: train = total - fold, test = fold. Returns per candidate the fold RMSEs."""
    per = G.gram(df, features, label, group=fold_col)
    folds = sorted(per)
    total = G.combine([per[f] for f in folds])
    trains = {f: G.minus(total, per[f]) for f in folds}
    out = []
    for name, params in candidates:
        rmses, r2s = [], []
        for f in folds:
            test = per[f]
            fit = fit_linear(name, trains[f], features, **params)
            sse = max(sse_on(test, fit), 0.0)
            rmses.append(math.sqrt(sse / test["n"]))
            sst = test["yty"] - test["sy"] ** 2 / test["n"]
            r2s.append(1.0 - sse / sst if sst > 0 else float("nan"))
        out.append({"model": name, "params": params, "fold_rmse": rmses,
                    "mean_rmse": float(np.mean(rmses)), "std_rmse": float(np.std(rmses)),
                    "mean_r2": float(np.nanmean(r2s)), "std_r2": float(np.nanstd(r2s))})
    return out


def fit_linear(name: str, s: dict, features: Sequence[str], **params) -> LinearFit:
    if name == "ols":
        return ols(s, features)
    if name == "ridge":
        return ridge(s, features, **params)
    if name == "bayesian_ridge":
        return bayesian_ridge(s, features, **params)
    if name == "omp":
        return omp(s, features, **params)
    raise ValueError(name)


def random_search_ridge(df: DataFrame, features: Sequence[str], label: str, fold_col: str, trials: int = 500,
                        seed: int = 123) -> list[dict]:
    """J15 re-aimed: seeded random search of the ridge penalty (log-uniform) - 500 trials x k folds cost one
    data pass in total."""
    rng = random.Random(seed)
    cands = [("ridge", {"alpha": 10 ** rng.uniform(-4, 3)}) for _ in range(trials)]
    return sorted(cv_linear(df, features, label, fold_col, cands), key=lambda r: r["mean_rmse"])


def random_search_bayesian_ridge(df: DataFrame, features: Sequence[str], label: str, fold_col: str, trials: int = 500,
                                 seed: int = 123) -> list[dict]:
    """J15 over the four Gamma priors of the Bayesian ridge (log-uniform), from the same per-fold sums."""
    rng = random.Random(seed)
    priors = ("alpha_1", "alpha_2", "lambda_1", "lambda_2")
    cands = [("bayesian_ridge", {p: 10 ** rng.uniform(-10, 1) for p in priors}) for _ in range(trials)]
    return sorted(cv_linear(df, features, label, fold_col, cands), key=lambda r: r["mean_rmse"])


def cooks_distance(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Leverage, residual and Cook's distance of every row for the least-squares fit, from one pass of sums. The
    inverse of the centred cross products (p x p) is inlined; a row's own part is a column expression."""
    s = G.gram(df, features, label)[None]
    sxx, _, _, mx, _ = G.centred(s)
    inv, fit = np.linalg.pinv(sxx), ols(s, features)
    p, n = len(features) + 1, s["n"]
    xs = [F.col(f"`{c}`").cast("double") - F.lit(float(m)) for c, m in zip(features, mx)]
    leverage = F.lit(1.0 / n)
    for i, a in enumerate(xs):
        for j, b in enumerate(xs):
            leverage = leverage + F.lit(float(inv[i, j])) * a * b
    mse = max(sse_on(s, fit), 0.0) / max(n - p, 1.0)
    out = df.withColumns({"leverage": leverage, "residual": F.col(f"`{label}`").cast("double") - fit.predict_expr()})
    h, e = F.col("leverage"), F.col("residual")
    return out.withColumn("cooks_distance", e * e * h / (F.lit(p * mse) * F.pow(F.lit(1.0) - h, 2)))


def rfe_linear(df: DataFrame, features: Sequence[str], label: str, fold_col: str) -> list[dict]:
    """Recursive feature elimination with CV for OLS, from the per-fold Gram matrices (one pass): drop the
    feature with the smallest |standardised coefficient| each round and record the CV RMSE."""
    per = G.gram(df, features, label, group=fold_col)
    folds = sorted(per)
    total = G.combine([per[f] for f in folds])
    active = list(range(len(features)))
    out = []
    while active:
        sub = [features[i] for i in active]

        def restrict(s):
            idx = np.array(active)
            return {"xtx": s["xtx"][np.ix_(idx, idx)], "xty": s["xty"][idx], "yty": s["yty"], "n": s["n"],
                    "sx": s["sx"][idx], "sy": s["sy"], "x0": s["x0"][idx], "y0": s["y0"]}

        rm = []
        for f in folds:
            test = restrict(per[f])
            train = restrict(G.minus(total, per[f]))
            rm.append(math.sqrt(max(sse_on(test, ols(train, sub)), 0.0) / test["n"]))
        full = ols(restrict(total), sub)
        sxx, _, _, _, _ = G.centred(restrict(total))
        sd = np.sqrt(np.clip(np.diag(sxx) / total["n"], 1e-300, None))
        out.append({"n_features": len(active), "features": sub, "cv_rmse": float(np.mean(rm))})
        if len(active) == 1:
            break
        weakest = int(np.argmin(np.abs(full.coef) * sd))
        active.pop(weakest)
    return out


# ---- Spark ML model selection -----------------------------------------------------------------------------------
def random_param_maps(estimator, space: dict, n_iter: int, seed: int) -> list[dict]:
    """Seeded random draws from a discrete search space -> Spark ML param maps."""
    rng = random.Random(seed)
    maps = []
    for _ in range(n_iter):
        maps.append({getattr(estimator, k): rng.choice(v) for k, v in space.items()})
    return maps


def _read_by(estimator, df: DataFrame, *others: str) -> DataFrame:
    """The columns an estimator and its evaluation read: the selection keeps its splits in memory, and a split of all
    the table's columns is many times larger. A pipeline's columns are not known, so it keeps them all."""
    used = {estimator.getOrDefault(p) for p in estimator.params
            if p.name.endswith("Col") and p.name not in ("predictionCol", "rawPredictionCol", "probabilityCol", "leafCol")
            and estimator.isDefined(p)} | set(others)
    return df if isinstance(estimator, Pipeline) else df.select(*[c for c in df.columns if c in used])


def cross_validate(estimator, param_maps, evaluator, df: DataFrame, fold_col: str, parallelism: int = 4):
    """CrossValidator over a fold column (deterministic hash folds)."""
    df = _read_by(estimator, df, fold_col, evaluator.getLabelCol())
    folds = df.agg(F.max(fold_col)).head()[0] + 1
    # draws may repeat: equal parameters and seeds are one candidate, fitted once and reported for every draw
    keys = [tuple(sorted((p.parent, p.name, repr(v)) for p, v in m.items())) for m in param_maps]
    places = list(dict.fromkeys(keys))
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=[param_maps[keys.index(k)] for k in places],
                        evaluator=evaluator, foldCol=fold_col, numFolds=folds, parallelism=parallelism,
                        collectSubModels=False)
    found = cv.fit(df)
    at = [places.index(k) for k in keys]
    found.avgMetrics, found.stdMetrics = ([m[i] for i in at] for m in (found.avgMetrics, found.stdMetrics))
    return found


def grid_search(estimator, grid: dict, evaluator, df: DataFrame, train_ratio: float = 0.8, seed: int = 0,
                parallelism: int = 4):
    """Exhaustive grid with a train/validation split."""
    df = _read_by(estimator, df, evaluator.getLabelCol())
    b = ParamGridBuilder()
    for k, v in grid.items():
        b = b.addGrid(getattr(estimator, k), v)
    return TrainValidationSplit(estimator=estimator, estimatorParamMaps=b.build(), evaluator=evaluator,
                                trainRatio=train_ratio, seed=seed, parallelism=parallelism).fit(df)


def rmse_evaluator(label: str = "label") -> RegressionEvaluator:
    return RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="rmse")


def auc_evaluator(label: str = "label") -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", metricName="areaUnderROC")


def feature_importances(model, features: Sequence[str], spark) -> DataFrame:
    """Coefficients of linear models or impurity importances of tree models as a table."""
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(stage, "featureImportances"):
        vals = stage.featureImportances.toArray().tolist()
        kind = "importance"
    else:
        vals = stage.coefficients.toArray().tolist()
        kind = "coefficient"
    return spark.createDataFrame([(f, kind, float(v)) for f, v in zip(features, vals)],
                                 "feature string, kind string, value double")


def objective_history(model, spark) -> DataFrame:
    """Per-iteration training loss of an iterative Spark ML model."""
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    hist = list(stage.summary.objectiveHistory)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(hist)], "iteration int, loss double")


# ---- J10: stacking with out-of-fold predictions ------------------------------------------------------------------
def _fitted(est, data: DataFrame, name: str, label: str = "label"):
    """Fit a base (a probabilistic Spark ML classifier or a ``KernelSVC``) and return a function that adds its
    probability of class 1 as ``p_<name>``."""
    from pyspark.ml.functions import vector_to_array
    out = f"p_{name}"
    if isinstance(est, KernelSVC):
        svc = replace(est, svm=None, calib=None).fit(data, label)
        return lambda df: svc.transform(df).withColumnRenamed("probability_1", out).drop("prediction")
    own = est.copy({est.labelCol: label})
    own.setPredictionCol(f"{name}_pred").setRawPredictionCol(f"{name}_raw").setProbabilityCol(f"{name}_prob")
    model = own.fit(data)
    return lambda df: model.transform(df).withColumn(out, vector_to_array(f"{name}_prob")[1]).drop(
        f"{name}_pred", f"{name}_raw", f"{name}_prob")


@dataclass
class StackingModel:
    bases: dict
    meta: object
    features: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        out = assemble(self.features).transform(df)
        for score in self.bases.values():
            out = score(out)
        meta_in = VectorAssembler(inputCols=[f"p_{n}" for n in self.bases], outputCol="meta_features")
        return self.meta.transform(meta_in.transform(out.drop("features")))


def fit_stacking(df: DataFrame, features: Sequence[str], label: str, fold_col: str, bases: dict) -> StackingModel:
    """Per fold, every base model is fitted on the other folds and scores the held-out fold; the
    out-of-fold probabilities (one union over folds, all bases in one pass per fold) train a logistic
    meta-model; the bases are then refitted on all rows."""
    from functools import reduce
    feats = list(features)
    data = assemble(feats).transform(df.withColumn("label", F.col(label).cast("double")))
    parts = []
    for f in range(data.agg(F.max(fold_col)).head()[0] + 1):
        train, held = data.filter(F.col(fold_col) != f), data.filter(F.col(fold_col) == f)
        for n, e in bases.items():
            held = _fitted(e, train, n)(held)
        parts.append(held.select("label", *[f"p_{n}" for n in bases]))
    meta_in = VectorAssembler(inputCols=[f"p_{n}" for n in bases], outputCol="meta_features").transform(
        reduce(DataFrame.unionByName, parts))
    meta = LogisticRegression(featuresCol="meta_features", labelCol="label").fit(meta_in)
    return StackingModel({n: _fitted(e, data, n) for n, e in bases.items()}, meta, feats)


# ---- N2: Boruta-style shadow-feature selection --------------------------------------------------------------
def boruta(df: DataFrame, features: Sequence[str], label: str, id_col: str, rounds: int = 10, trees: int = 20,
           seed: int = 0, alpha: float = 0.05) -> list[tuple[str, int, str]]:
    """Each round adds a shadow copy of every feature, permuted by a seeded hash-order shift inside hash
    buckets (no global shuffle), fits a random forest, and counts a hit for each feature whose impurity
    importance beats the best shadow. A two-sided binomial test over the rounds confirms or rejects."""
    from math import comb

    from pyspark.sql import Window

    from riskframe.operators.explain import bucket_count, bucket_of
    from riskframe.session import materialize
    feats = list(features)
    base = df.withColumn("__bucket", bucket_of(id_col, bucket_count(df.count())))
    hits = {f: 0 for f in feats}
    for rnd in range(rounds):
        shadows = {}
        for i, f in enumerate(feats):
            order = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(f), F.lit(str(rnd)), F.lit(str(seed))))
            w = Window.partitionBy("__bucket").orderBy(order, F.col(id_col))
            here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            shadows[f"shadow_{i}"] = F.coalesce(F.lead(F.col(f"`{f}`")).over(w), F.first(F.col(f"`{f}`")).over(here))
        data = materialize(base.withColumns({name: expr.cast("double") for name, expr in shadows.items()}), "shadows")
        cols = [*feats, *shadows]
        model = pipeline(cols, RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees,
                                                     seed=seed + rnd)).fit(data)
        imp = model.stages[-1].featureImportances.toArray()
        best_shadow = max(imp[len(feats):]) if len(imp) > len(feats) else 0.0
        for i, f in enumerate(feats):
            hits[f] += int(imp[i] > best_shadow)
    out = []
    for f in feats:
        h = hits[f]
        p_hi = sum(comb(rounds, j) for j in range(h, rounds + 1)) / 2 ** rounds
        p_lo = sum(comb(rounds, j) for j in range(0, h + 1)) / 2 ** rounds
        decision = "confirmed" if p_hi < alpha else ("rejected" if p_lo < alpha else "tentative")
        out.append((f, h, decision))
    return out
