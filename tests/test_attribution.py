"""Shapley values of trees against all subsets, of models against their own predictions, and sampled ones."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from riskframe.operators import attribution as A

FEATURES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 4))
    rows = [(i, *map(float, r), "uvwxy"[int(rng.integers(5))]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, k string")
    df = StringIndexer(inputCol="k", outputCol="e", stringOrderType="alphabetAsc").fit(df).transform(df)
    y = F.col("a") * F.col("b") + F.when(F.col("e").isin(1, 3), 2.0).otherwise(0.0) + F.abs("c")
    df = df.withColumn("label", y).withColumn("high", (y > 1).cast("double")).repartition(3)
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df).cache()


def known_value(tree, x, known):
    """Expectation of a tree with only some features known: others follow the training rows."""
    def walk(node):
        if tree.feature[node] < 0:
            return tree.value[node]
        l, r = tree.left[node], tree.right[node]
        if tree.feature[node] in known:
            return walk(l if tree.goes_left(node, x[None])[0] else r)
        return (walk(l) * tree.cover[l] + walk(r) * tree.cover[r]) / tree.cover[node]
    return walk(0)


def brute(ensemble, x):
    out, m = np.zeros(len(x)), len(x)
    for w, t in zip(ensemble.weights, ensemble.trees):
        value = {s: known_value(t, x, s) for k in range(m + 1) for s in map(frozenset, combinations(range(m), k))}
        for i in range(m):
            for s, v in value.items():
                if i not in s:
                    out[i] += w * factorial(len(s)) * factorial(m - 1 - len(s)) / factorial(m) * (value[s | {i}] - v)
    return out


MODELS = {
    "forest": lambda: (RandomForestRegressor(numTrees=4, maxDepth=5, seed=1), lambda d: F.col("prediction")),
    "tree": lambda: (DecisionTreeRegressor(maxDepth=7, seed=1), lambda d: F.col("prediction")),
    "boosting": lambda: (GBTRegressor(maxIter=4, maxDepth=3, seed=1), lambda d: F.col("prediction")),
    "classes": lambda: (RandomForestClassifier(labelCol="high", numTrees=3, maxDepth=4, seed=1), lambda d: vector_to_array("probability")[1]),
    "boosted classes": lambda: (GBTClassifier(labelCol="high", maxIter=3, maxDepth=3, seed=1), lambda d: vector_to_array("rawPrediction")[1]),
}


@pytest.mark.parametrize("name", MODELS)
def test_values_add_up_and_equal_all_subsets(data, name):
    estimator, explained = MODELS[name]()
    model = estimator.fit(data)
    ensemble = A.from_model(model)
    got = {r.id: r for r in A.tree_attributions(data, FEATURES, ensemble, ["id"]).collect()}
    want = {r.id: r for r in model.transform(data).withColumn("want", explained(data)).collect()}
    factor = 2.0 if name == "boosted classes" and abs(want[0].want - 2 * got[0].prediction) < 1e-9 else 1.0
    for i, r in got.items():
        assert r.prediction * factor == pytest.approx(want[i].want, abs=1e-9)
        assert sum(r.phi) == pytest.approx(r.prediction - r.base, abs=1e-9)
    for i in range(0, 600, 97):
        assert got[i].phi == pytest.approx(brute(ensemble, np.array([want[i][f] for f in FEATURES])).tolist(), abs=1e-9)


def test_stump_missing_values_and_empty(spark):
    leaf = A.Tree(*(np.array([v]) for v in (-1, np.nan, -1, -1, 5.0, 2.5)))
    df = spark.createDataFrame([(1, None, float("nan"))], "id int, a double, b double")
    got = A.tree_attributions(df, ["a", "b"], A.Ensemble([leaf], [1.0]), ["id"]).head()
    assert (got.prediction, got.base, got.phi) == (2.5, 2.5, [0.0, 0.0])
    split = A.Tree(np.array([0, -1, -1]), np.array([1.0, 0, 0]), np.array([1, -1, -1]), np.array([2, -1, -1]),
                   np.array([10.0, 4.0, 6.0]), np.array([0, 1.0, 2.0]))
    got = A.tree_attributions(df, ["a", "b"], A.Ensemble([split], [1.0]), ["id"]).head()
    assert got.prediction == 2.0 and got.phi == pytest.approx([0.4, 0.0])
    assert A.tree_attributions(df.limit(0), ["a", "b"], A.Ensemble([split], [1.0]), ["id"]).count() == 0


def test_sampled_values_of_a_linear_rule_are_exact_and_of_any_rule_add_up(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    back = df.where("id < 8").select("a", "b", "c")
    linear = lambda d: d.withColumn("prediction", 2 * F.col("a") - 3 * F.col("b") + 1)
    means = back.agg(*[F.avg(c).alias(c) for c in "abc"]).head()
    for parts in (1, 5):
        for r in A.sampled_attributions(df.repartition(parts), "id", ["a", "b", "c"], linear, back, draws=16).collect():
            x = rows[r.id]
            assert r.phi == pytest.approx([2 * (x[1] - means.a), -3 * (x[2] - means.b), 0.0], abs=1e-9)
    other = lambda d: d.withColumn("prediction", F.col("a") * F.col("b") + F.abs("c"))
    for r in A.sampled_attributions(df, "id", ["a", "b", "c"], other, back, draws=5).collect():
        x = rows[r.id]
        assert r.prediction == pytest.approx(x[1] * x[2] + abs(x[3])) and sum(r.phi) == pytest.approx(r.prediction - r.base)


def test_summary_and_waterfalls(spark):
    df = spark.createDataFrame([(i, i % 2, 1.0, [float(i), -2.0]) for i in range(30)], "id int, g int, base double, phi array<double>")
    assert {r.feature: r.mean_abs_phi for r in A.summary(df, ["p", "q"]).collect()} == {"p": 14.5, "q": 2.0}
    w = A.waterfalls(df, ["p", "q"], "id", "g").collect()
    assert len(w) == 44 and {r["rank"] for r in w} == {1, 2}
    five = sorted((r for r in w if r.id == 5), key=lambda r: r["rank"])
    assert [(r.feature, r["from"], r.to) for r in five] == [("p", 1.0, 6.0), ("q", 6.0, 4.0)]
    assert A.long_attributions(df, ["p", "q"], ["id"]).count() == 60


def test_pattern_values_are_computed_once(data, monkeypatch):
    """The values of a leaf's patterns don't depend on the rows, so later batches only look them up; paths with more
    features than are tabled give the same values."""
    model = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=3, maxDepth=5, seed=1).fit(data)
    x = np.array([[r[f] for f in FEATURES] for r in data.limit(200).collect()], float)
    ensemble, calls, plain = A.from_model(model), [], A._product_values
    monkeypatch.setattr(A, "_product_values", lambda one, zero: calls.append(1) or plain(one, zero))
    first = ensemble.attributions(x)
    made = len(calls)
    assert made and np.array_equal(ensemble.attributions(x), first) and len(calls) == made
    monkeypatch.setattr(A, "MOST_TABLED", 1)
    np.testing.assert_allclose(A.from_model(model).attributions(x), first, rtol=0, atol=1e-12)
    np.testing.assert_allclose(first.sum(axis=1), ensemble.predict(x) - ensemble.base, rtol=0, atol=1e-9)
