import math
import random

import numpy as np
import pytest

from riskframe.llm import hard_negatives as hn

SCHEMA = "uid string, vec_id long, embedding array<float>, label int, score double, block string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([("u", i, v, label, 0.5, "b") for i, v, label in rows], SCHEMA).repartition(parts, "vec_id")


def brute(rows, every=100, positives=5, negatives=5, low=80, high=100, scale=256):
    use = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows
           if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q, label) in enumerate(use):
        if i is None or i % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, p)), 1 << 63 if j is None else j, m) for b, (j, p, m) in enumerate(use) if b != a),
                        key=lambda t: t[:2])
        for s, j, _ in [t for t in scored if t[2] == label][:positives]:
            fits = [t for t in scored if t[2] != label and low * -s <= 100 * -t[0] <= high * -s][:negatives]
            out += [(i, None if j == 1 << 63 else j, k + 1, None if n == 1 << 63 else n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out, key=repr)


def mined(spark, rows, **given):
    return sorted((tuple(r) for r in hn.mine(frame(spark, rows), **given).collect()), key=repr)


@pytest.fixture
def small(monkeypatch):
    """Many blocks, chunks and parts on few rows."""
    for name, size in {"BLOCK": 64, "CHUNK": 8, "PART": 16, "SLICE": 3}.items():
        monkeypatch.setattr(hn, name, size)


def clustered(rng, n, d=6, centres=5):
    middle = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(centres)]
    out = []
    for i in range(n):
        c, far = rng.randrange(centres), rng.choice([0.1, 0.5, 3.0])
        out.append((i, [far * (x + rng.gauss(0, 0.2)) for x in middle[c]], rng.randrange(3)))
    return out


def test_equals_brute_force(spark, small):
    rows = clustered(random.Random(4), 400)
    got = mined(spark, rows, every=10)
    assert got == brute(rows, every=10) and len(got) > 100


def test_other_numbers_and_windows(spark, small):
    rows = clustered(random.Random(9), 200, d=3)
    assert mined(spark, rows, every=7, positives=2, negatives=3, low=33, high=95) == brute(rows, 7, 2, 3, 33, 95)


def test_ties_copies_and_zero_vectors(spark, small):
    rng = random.Random(8)
    rows = [(i, [1.0, 0.5], i % 2) for i in range(150)] + [(200 + i, [0.0, 0.0], i % 3) for i in range(40)]
    rows += [(300 + i, [rng.choice([-1.0, 1.0]), 0.0], i % 2) for i in range(60)] + [(400, [1.0, 0.5], 1)] * 3
    got = mined(spark, rows, every=50)
    assert got == brute(rows, every=50) and any(p == 0 for *_, p, _ in got)


def test_rows_that_take_no_part_null_ids_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], None), (2, None, 1), (3, [1.0, nan], 1), (4, [inf, 0.0], 1), (5, [None, 1.0], 1),
            (100, [], 1), (6, [1.0], 1), (7, [1.0, 1.9, 4.0], 2), (None, [1.0, 2.0], 2), (None, [1.0, 2.0], 1), (8, [], 2)]
    assert mined(spark, rows) == brute(rows)


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(0, [], 0), (100, [], 0), (2, [], 1)]) == brute([(0, [], 0), (100, [], 0), (2, [], 1)])
    assert hn.mine(frame(spark, [])).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_large_numbers_stay_exact_and_larger_ones_are_errors(spark):
    rows = [(100 * i, [float(2 ** 20 + i), float(3 * i)], i % 2) for i in range(12)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="beyond 32 bits"):
        mined(spark, [(0, [1e30], 0), (1, [1.0], 1)])


def test_score_bounds_hold():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(0, 80, (400, 4)))
    refs = hn.reference_directions(x[:100], 3)
    norm = np.linalg.norm(x, axis=1)
    angles = np.arccos(np.clip(x @ refs.T / norm[:, None], -1, 1)).astype(np.float32).astype(float)
    a, b = slice(0, 50), slice(50, 60)
    down, up = hn.score_interval(angles[a], norm[a], angles[b].min(0), angles[b].max(0), norm[b].min(), norm[b].max())
    scores = x[a] @ x[b].T
    assert (scores >= down[:, None]).all() and (scores <= up[:, None]).all()
    assert (up < norm[a] * norm[b].max()).any()


def test_windows_of_scores():
    s = np.array([0, 1, 7, 99, 100, 12345, 2 ** 61])
    low, high = hn.windows(s, 80, 100)
    assert [(-(-80 * int(x) // 100), int(x)) for x in s] == list(zip(low.tolist(), high.tolist()))


@pytest.mark.parametrize("same", [True, False])
def test_search_in_parts_and_slices(small, same):
    rng = np.random.default_rng(3)
    refs = hn.reference_directions(rng.normal(size=(50, 3)), 2)

    def made(n, first):
        q = np.floor(rng.normal(0, 40, (n, 3)))
        norm = np.linalg.norm(q, axis=1)
        uid = np.arange(first, first + n)
        return {"uid": uid, "id": uid // 2, "label": rng.integers(0, 2, n), "q": q.astype(np.int32), "norm": norm,
                "angles": np.arccos(np.clip(q @ refs.T / np.maximum(norm, 1e-9)[:, None], -1, 1))}
    a, b = made(10, 95), made(100, 0)
    low = rng.integers(-500, 2000, (10, 2))
    high = low + 3000
    got = hn.search(a, b, low, high, same, 4)
    want = []
    for i in range(10):
        for w in range(2):
            fits = [(-s, int(b["id"][j]), int(b["uid"][j])) for j, s in enumerate((b["q"] @ a["q"][i]).tolist())
                    if low[i, w] <= s <= high[i, w] and (b["label"][j] == a["label"][i]) == same and b["uid"][j] != a["uid"][i]]
            want += [[i, w, -s, d, u] for s, d, u in sorted(fits)[:4]]
    assert sorted(got.tolist()) == sorted(want) and want
