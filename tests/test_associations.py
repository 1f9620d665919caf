"""Associations and top values: missing values, constants, groups, empty tables, against numpy."""

import numpy as np
import pytest

from riskframe.operators import associations as S

SCHEMA = "g int, u string, v int, x double, y double"


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def entropy(values):
    _, n = np.unique(values, return_counts=True)
    return -(n / n.sum() * np.log(n / n.sum())).sum()


def test_against_numpy_with_missing_values(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(2)) if rng.random() > 0.1 else None, str(rng.choice(list("abc"))) if rng.random() > 0.2 else None,
             int(rng.integers(4)) if rng.random() > 0.1 else None, float(rng.normal() + 1e6) if rng.random() > 0.1 else None,
             float("nan") if rng.random() < 0.1 else float(rng.normal())) for _ in range(500)]
    for parts in (1, 7):
        got = {(r.g, r.feature_a, r.feature_b): (r.value, r.n) for r in S.associations(table(spark, rows, parts), ["u", "v"], ["x", "y"], "g").collect()}
        assert len(got) == 3 * 12
        for g in (0, 1, None):
            own = [r for r in rows if r[0] == g]
            uv = [(r[1], r[2]) for r in own if r[1] is not None and r[2] is not None]
            u, v, both = [a for a, _ in uv], [b for _, b in uv], [f"{a}{b}" for a, b in uv]
            assert got[g, "u", "v"] == (pytest.approx((entropy(u) - entropy(both) + entropy(v)) / entropy(u)), len(uv))
            assert got[g, "v", "u"][0] == pytest.approx((entropy(v) - entropy(both) + entropy(u)) / entropy(v))
            vx = [(r[2], r[3]) for r in own if r[2] is not None and r[3] is not None]
            x = np.array([b for _, b in vx])
            per = [x[[a == k for a, _ in vx]] for k in {a for a, _ in vx}]
            ratio = np.sqrt(sum(len(p) * (p.mean() - x.mean()) ** 2 for p in per) / ((x - x.mean()) ** 2).sum())
            assert got[g, "v", "x"] == (pytest.approx(ratio), len(vx)) == got[g, "x", "v"]
            xy = np.array([(r[3], r[4]) for r in own if r[3] is not None and not np.isnan(r[4])])
            assert got[g, "x", "y"] == (pytest.approx(np.corrcoef(xy.T)[0, 1]), len(xy))


def test_constants_single_columns_and_no_rows(spark):
    rows = [(1, "a", i % 2, 5.0, float(i)) for i in range(10)]
    got = {(r.feature_a, r.feature_b): r.value for r in S.associations(table(spark, rows), ["u", "v"], ["x", "y"]).collect()}
    assert got["u", "v"] == 1.0 and got["v", "u"] == 0.0 and got["v", "x"] == 0.0 and got["x", "y"] is None
    assert S.associations(table(spark, []), ["u"], ["x"]).count() == 0
    assert S.associations(table(spark, rows), ["u"], []).columns == ["feature_a", "feature_b", "measure", "value", "n"]
    with pytest.raises(ValueError, match="listed once"):
        S.associations(table(spark, rows), ["u", "x"], ["x"])


def test_top_values_break_ties_by_text(spark):
    rows = [(None, t, None, None, None) for t in "bbaacd"] + [(1, "b", 3, None, None), (1, None, 3, None, None)]
    got = [(r.g, r.feature, r["rank"], r.value, r["count"]) for r in S.top_values(table(spark, rows), ["u", "v"], 2, "g").collect()]
    assert sorted(got, key=repr) == sorted([(None, "u", 1, "a", 2), (None, "u", 2, "b", 2), (1, "u", 1, "b", 1), (1, "v", 1, "3", 2)], key=repr)
