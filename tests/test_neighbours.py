"""Exact nearest neighbours against all pairs, and independence of the partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import neighbours

SCHEMA = "group int, id long, x array<double>, nominal array<string>, gap double"


def brute(rows, k):
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        ids = np.array([r[1] for r in own])
        x = np.array([r[2] for r in own], float).reshape(len(own), -1)
        names = np.array([r[3] for r in own], object).reshape(len(own), -1)
        for s in range(0, len(own), 500):
            far = neighbours.distances(x[s:s + 500], names[s:s + 500], x, names, own[0][4])
            far[np.arange(len(far)), np.arange(s, s + len(far))] = np.inf
            order = np.argsort(far, axis=1, kind="stable")[:, :k]
            for i, near in enumerate(order):
                out[g, int(ids[s + i])] = [(float(far[i, j]), int(ids[j])) for j in near if np.isfinite(far[i, j])]
    return {key: v for key, v in out.items() if v}


def found(df, width, nominal, k=5, **given):
    got = {}
    for r in sorted(neighbours.k_nearest(df, width, nominal, k, **given).collect(), key=lambda r: r["rank"]):
        got.setdefault((r["group"], r["id"]), []).append((r.far, r.other))
    return got


@pytest.mark.parametrize(("width", "nominal", "n"), [(2, 1, 10_000), (8, 0, 10_000)])
def test_equals_all_pairs_on_large_groups(spark, width, nominal, n):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(n, width)) * rng.choice([0.1, 1, 5], (n, 1))
    rows = [(1, i, x[i].tolist(), [str(rng.integers(3)) for _ in range(nominal)], 0.7) for i in range(n)]
    assert found(spark.createDataFrame(rows, SCHEMA), width, nominal) == brute(rows, 5)


def test_ties_copies_groups_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FAN", 3)
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(3)), i, [float(rng.integers(4)), float(rng.integers(4))], [str(rng.integers(2)), "a"], 1.0)
            for i in range(600)]
    rows += [(7, i, [1.0, 1.0], ["b", "c"], 0.0) for i in range(300)] + [(8, 5, [0.0, 0.0], ["", ""], 0.0)]
    rows += [(9, i, [float(i), 0.0], ["", ""], 0.5) for i in range(4)]
    want = brute(rows, 5)
    for parts in (1, 4, 16):
        assert found(spark.createDataFrame(rows, SCHEMA).repartition(parts), 2, 2, block=20) == want
    assert (8, 5) not in want and len(want[9, 0]) == 3


def test_no_numbers_no_rows_and_one_heavy_point(spark):
    assert found(spark.createDataFrame([], SCHEMA), 2, 1) == {}
    rows = [(1, i, [], [str(i % 3)], 2.0) for i in range(90)]
    assert found(spark.createDataFrame(rows, SCHEMA), 0, 1, block=16) == brute(rows, 5)
    rows = [(1, i, [0.0 if i % 2 else float(i)], [], 0.0) for i in range(400)]
    assert found(spark.createDataFrame(rows, SCHEMA), 1, 0, block=32) == brute(rows, 5)


def test_far_boxes_are_not_compared(spark):
    """Two clouds far apart: no pair of blocks joins them."""
    rows = [(1, i, [i / 1000 + 1000 * (i % 2), 0.0], [], 0.0) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = df.withColumn("node", F.col("id") % 2 * 20 + F.floor(F.col("id") / 100)).groupBy("group", "node").agg(
        F.lit(1.0).alias("radius"), F.first("gap").alias("gap"), *neighbours._box(2, 0))
    pairs = {(r.a, r.b) for r in neighbours._pairs(blocks, 2, 0).collect()}
    assert pairs and all((a < 20) == (b < 20) for a, b in pairs)
