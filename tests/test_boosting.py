"""Boosting on cells against the same boosting on rows in plain numpy."""

import numpy as np
import pytest

from riskframe.operators import boosting as B


def plain(x, y, held, edges, rate, depth, l2, iterations, bins):
    """Symmetric trees on rows: levels chosen by full search over features and bins."""
    b = np.column_stack([B._binned(x[:, i], e) for i, e in enumerate(edges)])
    f = np.full(len(y), y[~held].mean())
    trees, history = [], []
    for _ in range(iterations + 1):
        history.append(tuple(np.sqrt(((y - f)[m] ** 2).mean()) for m in (~held, held)))
        splits = []
        for _ in range(depth):
            node, best = B._leaf(splits, b[~held]), None
            r = (y - f)[~held]
            for i in range(x.shape[1]):
                for k in range(bins - 1):
                    side = b[~held, i] > k
                    if side.all() or not side.any():
                        continue
                    code = node * 2 + side
                    n, g = np.bincount(code, minlength=2 ** (len(splits) + 1)), np.bincount(code, r, 2 ** (len(splits) + 1))
                    gain = (g ** 2 / np.maximum(n + l2, 1e-300)).sum()
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, i, k)
            splits.append(best[1:])
        code = B._leaf(splits, b[~held])
        n, g = np.bincount(code, minlength=2 ** depth), np.bincount(code, (y - f)[~held], 2 ** depth)
        values = rate * g / np.maximum(n + l2, 1e-300)
        trees.append((splits, values))
        f = f + values[B._leaf(splits, b)]
    return trees[:-1], history


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=900), rng.integers(0, 3, 900), rng.exponential(size=900)])
    y = x[:, 0] ** 2 + x[:, 1] * (x[:, 2] > 1) + rng.normal(size=900) * 0.1
    x[::50, 0] = np.nan
    held = rng.random(900) < 0.25
    rows = [(None if np.isnan(a) else float(a), int(b), float(c), float(t), bool(h)) for (a, b, c), t, h in zip(x, y, held)]
    return x, y, held, spark.createDataFrame(rows + [(1.0, 1, 1.0, None, False)], "a double, b int, c double, y double, held boolean").repartition(4)


def test_equals_boosting_on_rows_and_predicts(frame, monkeypatch):
    monkeypatch.setattr(B, "KEEP", 2)
    x, y, held, df = frame
    points = [(0.3, 2, 0.5), (0.1, 3, 3.0)]
    models = B.fit(df, ["a", "b", "c"], "y", "held", points, iterations=5, bins=8)
    for m in models:
        trees, history = plain(x, y, held, m.edges, m.rate, m.depth, m.l2, 5, 8)
        assert [t[0] for t in m.trees] == [t[0] for t in trees]
        assert all(np.allclose(a[1], b[1]) for a, b in zip(m.trees, trees)) and np.allclose(m.history, history)
    got = df.where("y is not null and held").withColumn("p", models[0].predict_expr()).collect()
    assert np.sqrt(np.mean([(r.y - r.p) ** 2 for r in got])) == pytest.approx(models[0].history[-1][1])


def test_partitions_do_not_matter_much_and_empty_input(frame, spark):
    *_, df = frame
    a, b = (B.fit(df.repartition(n), ["a", "b", "c"], "y", "held", [(0.2, 3, 1.0)], 3, bins=8)[0] for n in (1, 9))
    assert [t[0] for t in a.trees] == [t[0] for t in b.trees] and np.allclose(a.history, b.history)
    assert B.fit(df.where("y > 1e9"), ["a"], "y", "held", [(0.1, 2, 1.0)], 2)[0].trees == []


def test_grid_reads_iterations_and_stopping_off_the_curves(frame):
    *_, df = frame
    grid = {"iterations": (1, 3), "learning_rate": (0.1, 1.0), "depth": (1, 2), "l2_leaf_reg": (0.5,), "early_stopping_rounds": (1, 2)}
    rows = B.grid_search(df, ["a", "b", "c"], "y", "held", grid, bins=8).collect()
    assert len(rows) == 16 and all(r.run <= r.iterations and r.best_iteration <= r.run for r in rows)
    assert [r.validation_rmse for r in rows] == sorted(r.validation_rmse for r in rows)


def test_early_stopping():
    m = B.Boosted(0.1, 2, 1.0, [], [], 0.0, history=[(0, v) for v in (9, 5, 4, 4.5, 4.2, 3, 3.5, 3.6, 3.7)])
    assert m.stopped(8, 2) == (4, 2, 4) and m.stopped(8, 3) == (8, 5, 3) and m.stopped(1, 3) == (1, 1, 5)
