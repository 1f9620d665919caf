"""Tests of what one task of the neighbour search does (no Spark)."""

import numpy as np
import pyarrow as pa

from riskframe.operators import neighbours


def _table(rows, asks):
    x, names = zip(*rows)
    n = len(rows)
    return pa.table({"group": pa.array(["g"] * n), "asks": pa.array([i < asks for i in range(n)]), "id": pa.array(range(n), pa.int64()),
                     "x": pa.array(x, pa.list_(pa.float64())), "nominal": pa.array(names, pa.list_(pa.string())),
                     "gap": pa.array([2.0] * n), "radius": pa.array([float("inf")] * n)})


def test_nominal_values_are_codes_and_distances_those_of_the_texts():
    rng = np.random.default_rng(4)
    rows = [(rng.integers(0, 9, 2).astype(float).tolist(), [str(v) for v in rng.choice(["", "=a", "=b"], 2)]) for _ in range(400)]
    table, asks, k = _table(rows, 300), 300, 5  # 300 asking rows are more than a slice
    held = neighbours._held(table, 2, 2)
    assert held["names"].dtype.kind == "i"
    texts = np.array([n for _, n in rows], object)
    far = np.array([[((held["x"][i] - held["x"][j]) ** 2).sum() + 4.0 * (texts[i] != texts[j]).sum() for j in range(asks, 400)]
                    for i in range(asks)])
    assert (neighbours.distances(held["x"][:asks], held["names"][:asks], held["x"][asks:], held["names"][asks:], 2.0) == far).all()
    found = neighbours._across(k, 2, 2)(table).to_pylist()
    want = [(i, far[i, j], asks + j) for i in range(asks) for j in sorted(range(400 - asks), key=lambda j: (far[i, j], j))[:k]]
    assert [(r["id"], r["far"], r["other"]) for r in found] == want


def test_few_candidates_and_many_give_the_same_nearest():
    rng = np.random.default_rng(5)
    far, ids = rng.integers(0, 40, (30, 200)).astype(float), np.arange(200)
    few = np.where(far <= np.sort(far, axis=1)[:, 4:5], far, np.inf)
    for a, b in zip(neighbours._nearest(far, ids, 5), neighbours._nearest(few, ids, 5)):
        assert (a == b).all()
