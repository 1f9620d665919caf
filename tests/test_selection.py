"""Model selection: what is fitted and what is read."""

import pytest
from pyspark.ml.tuning import CrossValidator, TrainValidationSplit
from pyspark.sql import functions as F

from riskframe import session
from riskframe.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    h = lambda s, m: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(m))
    df = spark.range(0, 240, 1, 2).select(F.when(F.col("id") % 50 != 7, F.col("id")).alias("id"), h("a", 100).cast("double").alias("a"),
                                          h("b", 3).cast("double").alias("b"), h("f", 3).cast("int").alias("fold"), F.lit("unused").alias("other"))
    df = df.withColumn("y", ((F.col("a") + 20 * F.col("b") + F.col("id") % 5) > 70).cast("double")).fillna({"y": 0.0})
    return M.assemble(["a", "b"]).transform(session.materialize(df.unionByName(df.limit(20)), "selection"))


def _recorded(monkeypatch, kind):
    seen = []

    class Recorder(kind):
        def fit(self, df):
            seen.append((len(self.getEstimatorParamMaps()), set(df.columns), self.getParallelism()))
            return super().fit(df)
    monkeypatch.setattr(M, kind.__name__, Recorder)
    return seen


def test_equal_draws_are_fitted_once_on_the_columns_they_read(monkeypatch, rows):
    rf = M.random_forest_classifier(label="y", trees=3, depth=3)
    maps = [{rf.maxDepth: d, rf.numTrees: t} for d, t in ((2, 3), (3, 2), (2, 3), (2, 3))]
    plain = CrossValidator(estimator=rf, estimatorParamMaps=maps, evaluator=M.auc_evaluator("y"), foldCol="fold", numFolds=3).fit(rows)
    seen = _recorded(monkeypatch, CrossValidator)
    got = M.cross_validate(rf, maps, M.auc_evaluator("y"), rows, "fold")
    assert [s[:2] for s in seen] == [(2, {"features", "y", "fold"})]
    assert got.avgMetrics == pytest.approx(plain.avgMetrics, abs=1e-12) and got.stdMetrics == pytest.approx(plain.stdMetrics, abs=1e-12)
    assert got.bestModel.getNumTrees == plain.bestModel.getNumTrees


def test_grid_points_are_fitted_at_once_on_the_columns_they_read(monkeypatch, rows):
    gbt = M.gbt_regressor(label="y", iters=2)
    plain = TrainValidationSplit(estimator=gbt, estimatorParamMaps=[{gbt.maxDepth: d} for d in (1, 2)], evaluator=M.rmse_evaluator("y"),
                                 trainRatio=0.8, seed=0).fit(rows)
    seen = _recorded(monkeypatch, TrainValidationSplit)
    got = M.grid_search(gbt, {"maxDepth": [1, 2]}, M.rmse_evaluator("y"), rows)
    assert seen == [(2, {"features", "y"}, 4)]
    assert got.validationMetrics == pytest.approx(plain.validationMetrics, abs=1e-12)
