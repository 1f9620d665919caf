"""Permutation importance: copies made per bucket against the window they stand for, areas by cells against pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import explain

LONG = "a feature's name of more than thirty-two bytes"


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), None if i % 7 == 0 else float(rng.integers(0, 5)), float(rng.normal()), i % 3)
            for i in range(400)]
    rows += [(None, 1.5, 2.0, 0.5, 1)]
    return spark.createDataFrame(rows, ["id", "x.1", LONG, "y", "kind"]).cache()


def _key(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("order_hash", ["md5", "xxhash64"])
def test_copies_equal_the_window(frame, order_hash, monkeypatch):
    feats = ["x.1", LONG]
    got = explain.permuted_copies(frame, "id", feats, 3, seed=5, buckets=4, order_hash=order_hash)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()  # copies are not sorted
    monkeypatch.setattr(explain, "MOST_IN_MEMORY", 0)
    want = explain.permuted_copies(frame, "id", feats, 3, seed=5, buckets=4, order_hash=order_hash)
    assert got.columns == want.columns
    assert got.count() == 401 * 2 * 3 and _key(got.collect()) == _key(want.collect())


def test_large_buckets_are_sorted_by_the_window(frame, monkeypatch):
    want = _key(explain.permuted_copies(frame, "id", ["x.1"], 2, buckets=4).collect())
    sizes = [r["count"] for r in frame.groupBy(explain.bucket_of("id", 4)).count().collect()]
    monkeypatch.setattr(explain, "MOST_IN_MEMORY", sorted(sizes)[-2])
    assert _key(explain.permuted_copies(frame, "id", ["x.1"], 2, buckets=4).collect()) == want


def test_area_by_cells(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(rng.integers(0, 30)), int(rng.random() < 0.4)) for g in ("a", "b") for _ in range(300)]
    rows += [("one class", 1.0, 1), ("a", None, 1), ("a", 2.0, None)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    for cuts in ([], [4.0, 5.0, 20.5]):
        got = {r["g"]: r["metric"] for r in explain._group_auc(df, ["g"], "y", "s", cuts).collect()}
        for g in ("a", "b"):
            one, none = ([s for k, s, y in rows if k == g and y == t and s is not None] for t in (1, 0))
            pairs = [(p > n) + (p == n) / 2 for p in one for n in none]
            assert got[g] == pytest.approx(sum(pairs) / len(pairs), abs=1e-12)
        assert got["one class"] is None


def test_area_deals_the_rows_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("s"), (F.col("id") % 2).alias("y"))
    plan = explain._group_auc(df, ["g"], "y", "s", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2      # the rows, and a row per cell
    assert "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with repeated and missing ids, missing and not-a-number values and labels."""
    rng = np.random.default_rng(5)
    rows = [(None if i == 11 else i // 2 if i < 60 else i, None if i % 31 == 4 else float(rng.integers(0, 6)),
             float("nan") if i % 29 == 3 else float(rng.normal()), float(rng.integers(0, 2)), None if i % 37 == 5 else float(rng.normal() + i % 2)) for i in range(500)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").cache()


@pytest.mark.parametrize("most", [1 << 15, 120, 0])      # all buckets in memory, some, none
def test_trees_score_copies_where_they_are_made(odd, monkeypatch, most):
    from riskframe.operators import attribution, models as M
    feats = ["a", "b", "c"]
    full = odd.dropna().withColumn("high", (F.col("y") > 0.3).cast("double"))
    forests = [(M.random_forest_regressor("y", trees=4, depth=5), "y", lambda m: lambda d: m.transform(d)),
               (M.random_forest_classifier("high", trees=4, depth=4), "high",
                lambda m: lambda d: m.transform(d).withColumn("prediction", F.get(vector_to_array("probability"), F.lit(1))))]
    for estimator, label, scoring in forests:
        model = M.pipeline(feats, estimator).fit(full)
        df = odd.withColumn("high", (F.col("y") > 0.3).cast("double"))
        monkeypatch.setattr(explain, "MOST_IN_MEMORY", 1 << 15)
        want = explain.permutation_importance(df, "id", feats, label, scoring(model), 3, buckets=4, order_hash="xxhash64").collect()
        monkeypatch.setattr(explain, "MOST_IN_MEMORY", most)
        monkeypatch.setattr(explain, "_donor_copies", None)      # no copy leaves its task
        got = explain.permutation_importance(df, "id", feats, label, scoring(model), 3, buckets=4, order_hash="xxhash64",
                                             same=explain.Trees(attribution.from_model(model.stages[-1]))).collect()
        monkeypatch.undo()
        pairs = {(r.feature, r.repeat): r.importance for r in got}
        assert len(got) == len(want) == 9 and [pairs[r.feature, r.repeat] for r in want] == pytest.approx([r.importance for r in want], abs=1e-12)


def test_predictions_for_any_value_of_a_feature(spark):
    from riskframe.operators import attribution
    rng = np.random.default_rng(2)
    node = [np.array(v) for v in ([0, 1, 0, -1, -1, -1, -1], [0.5, 2.0, 0.8, 0, 0, 0, 0], [1, 3, 5, -1, -1, -1, -1], [2, 4, 6, -1, -1, -1, -1])]
    trees = [attribution.Tree(*node, np.ones(7), rng.normal(size=7)) for _ in range(2)]
    trees.append(attribution.Tree(*[np.array([v]) for v in (-1, 0.0, -1, -1, 1.0, 7.0)]))
    model, x = attribution.Ensemble(trees, [0.5, 2.0, 1.0]), rng.normal(size=(50, 2))
    for f in (0, 1):
        cuts, table = model.swapped(x, f, [t.predict(x) for t in trees])
        for v in (-9.0, 0.5, 0.6, 0.8, 0.9, 2.0, 2.1):
            other = x.copy()
            other[:, f] = v
            assert np.allclose(table[np.searchsorted(cuts, v)], model.predict(other), atol=1e-12)


def test_orders_equal_the_whole_keys():
    from hashlib import md5
    ids = [None, b"", b"7", b"a" * 30, b"b" * 60] + [str(i).encode() for i in [*range(5, 400), 77, 77, 10 ** 7]]
    starts = [b"" if i is None else i + b":" for i in ids]
    for n in (len(ids), 4):      # with and without an id that is longer than a block
        keys = explain._md5_keys(pa.array([i for i in ids if i is None or n > 4 or len(i) < 50], pa.binary()), 3)
        held = [s for s in starts if n > 4 or len(s) < 50]
        for feature, repeat in (("age", 0), ("x" * 12, 49)):
            assert list(keys(feature, repeat)) == sorted(range(len(held)), key=lambda i: (md5(held[i] + f"{feature}:{repeat}:3".encode()).digest(), i))
    near = np.array([5, 4, 3, 4, 2 ** 63 + 1, 2 ** 63, 5], "u8")
    assert list(explain._order(near)) == [2, 1, 3, 0, 6, 5, 4]


@pytest.mark.parametrize("most", [1 << 15, 120, 0])
def test_rules_share_their_copies(odd, monkeypatch, most):
    rules = {"one": explain.Rule(("a", "b"), (-0.04, 0.3), (3.0, 0.5), -1.5), "two": explain.Rule(("a", "b"), (1.0, 2.0), (0.0, 0.0))}
    df, feats = odd.where("b is null or not isnan(b)"), ["a", "b"]
    want = {(n, r.feature, r.repeat): r.importance for n, rule in rules.items() for r in explain.permutation_importance(
        df, "id", feats, "y", lambda d, rule=rule: d.withColumn("prediction", rule.expr()), 3, buckets=4).collect()}
    calls, keys = [], explain._split_large
    monkeypatch.setattr(explain, "MOST_IN_MEMORY", most)
    monkeypatch.setattr(explain, "_split_large", lambda *a: (calls.append(1), keys(*a))[1])
    got = {(r.model, r.feature, r.repeat): r.importance for r in explain.permutation_importance_many(
        df, "id", feats, "y", rules, 3, buckets=4, order_hash="md5").collect()}
    assert len(calls) == 1 and len(want) == 12 and got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(("most", "rows_per_cell", "factor"), [(1 << 15, 1 << 16, None), (120, 64, None), (0, 64, None), (1 << 15, 64, -3.0), (120, 64, -3.0)])
def test_areas_of_copies_scored_where_they_are_made(odd, monkeypatch, most, rows_per_cell, factor):
    rule = explain.Rule(("a", "b"), (0.4, 1.0), (3.0, 0.5), -1.5, factor)
    df = odd.withColumn("high", F.when(F.col("y").isNotNull(), (F.col("y") > 0.3).cast("int")))
    args = (df, "id", ["a", "b"], "high", lambda d: d.withColumn("prediction", rule.expr()), 3)
    want = {(r.feature, r.repeat): r.importance for r in explain.permutation_importance(*args, buckets=4, scorer="roc_auc").collect()}
    for name, value in (("MOST_IN_MEMORY", most), ("ROWS_PER_CELL", rows_per_cell), ("SCORES_PER_CELL", rows_per_cell)):
        monkeypatch.setattr(explain, name, value)
    monkeypatch.setattr(explain, "_score_cuts", lambda scored, score, rows: [] if rows_per_cell > 64 else [-4.0, -2.0, -1.5, 0.0, 3.0])
    monkeypatch.setattr(explain, "_donor_copies", None)
    got = {(r.feature, r.repeat): r.importance for r in explain.permutation_importance(*args, buckets=4, scorer="roc_auc", same=rule).collect()}
    assert len(want) == 6 and got == pytest.approx(want, abs=1e-12)
