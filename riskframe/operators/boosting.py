"""Gradient boosting on binned data, many candidates at a time.

Features are cut into bins once, and rows that fall into the same bins of all features become one cell with its number
of rows and the sums of their labels; trees see nothing finer, so fitting on cells is fitting on rows. The trees are
symmetric: a level has one split for all its nodes, so a leaf is the bits of a few comparisons. All candidates grow in
step. A level is one Spark job for all of them: tasks add up the residuals of their cells by candidate, node, feature
and bin; per candidate and feature the sums meet in one group, which finds the best split; the driver receives a split
per candidate and feature. The sums of the last level's best split are the leaves' values, shrunk by the L2 penalty.
Errors on training and validation rows per iteration come along with the first level of the next one, so numbers of
iterations and early stopping are read off a candidate's curve and need no fit of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import materialize

BINS = 32
#: After so many trees the cells are written anew with their predictions so far.
KEEP = 10


@dataclass
class Boosted:
    """A fitted candidate. A tree is its splits (feature, last bin to the left) and its leaves' values, the bit of the
    first split highest; ``history`` has the RMSE of training and validation rows after 0, 1, 2, ... trees."""

    rate: float
    depth: int
    l2: float
    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list = field(default_factory=list)
    history: list = field(default_factory=list)

    def stopped(self, iterations: int, patience: int) -> tuple[int, int, float]:
        """(iterations run, best iteration, its validation RMSE) with at most ``iterations`` trees, ending when the
        best is ``patience`` trees ago."""
        best, at = np.inf, 0
        last = min(iterations, len(self.history) - 1)
        for i in range(1, last + 1):
            if self.history[i][1] < best:
                best, at = self.history[i][1], i
            elif i - at >= patience:
                return i, at, best
        return last, at, best

    def predict(self, bins: np.ndarray, trees: int | None = None) -> np.ndarray:
        return np.full(len(bins), self.base) + _sum_trees(self.trees[:trees], bins)

    def predict_expr(self, trees: int | None = None) -> Column:
        """The prediction as a column over the features' own values."""
        edges = self.edges

        @F.pandas_udf("double")
        def run(*cols: pd.Series) -> pd.Series:
            return pd.Series(self.predict(np.column_stack([_binned(c.to_numpy(dtype=float), e) for c, e in zip(cols, edges)]), trees))
        return run(*[F.col(f"`{c}`").cast("double") for c in self.features])


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin numbers; a missing value is in the first bin."""
    return np.where(np.isnan(x), 0, np.searchsorted(edges, x, "left")).astype(np.uint8)


def _leaf(splits: list, bins: np.ndarray) -> np.ndarray:
    at = np.zeros(len(bins), np.int64)
    for f, b in splits:
        at = at * 2 + (bins[:, f] > b)
    return at


def _sum_trees(trees: list, bins: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bins))
    for splits, values in trees:
        out += values[_leaf(splits, bins)]
    return out


def cells(df: DataFrame, features: Sequence[str], label: str, validation: str, bins: int = BINS) -> tuple[DataFrame, list[np.ndarray]]:
    """(cells, edges): (b array<int>, held, n, sy, syy), one row per combination of bins and side of the split."""
    if not 2 <= bins <= 256:
        raise ValueError("2 to 256 bins")
    x = [F.col(f"`{c}`").cast("double") for c in features]
    cuts = [i / bins for i in range(1, bins)]
    got = df.agg(*[F.percentile_approx(c, cuts, 5000).alias(f"q{i}") for i, c in enumerate(x)]).head()
    edges = [np.unique(np.array(q if q is not None else [], float)) for q in got]
    def place_of(c: Column, e: np.ndarray) -> Column:
        below = F.size(F.filter(F.array(*[F.lit(float(v)) for v in e]), lambda v: v < c)) if len(e) else F.lit(0)
        return F.when(c.isNull() | F.isnan(c), 0).otherwise(below)
    place = [place_of(c, e) for c, e in zip(x, edges)]
    y = F.col(f"`{label}`").cast("double")
    rows = df.where(y.isNotNull()).select(F.array(*place).cast("array<int>").alias("b"), F.coalesce(F.col(f"`{validation}`").cast("boolean"), F.lit(False)).alias("held"), y.alias("y"))
    return rows.groupBy("b", "held").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")), edges


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    b = batch.column("b").flatten().to_numpy().reshape(batch.num_rows, width).astype(np.uint8)
    state = batch.column("f").flatten().to_numpy().reshape(batch.num_rows, -1)
    return b, batch.column("held").to_numpy(zero_copy_only=False), *(batch.column(c).to_numpy() for c in ("n", "sy", "syy")), state


def _level(width: int, bins: int, since: list, growing: list, active: list, errors: bool):
    """Sums of one level over a task's cells: per active candidate and feature the rows and residuals by node and bin;
    with ``errors`` also each candidate's squared errors so far."""
    def run(batches):
        sums: dict = {}
        wrong = np.zeros((len(since), 2, 2))
        for batch in batches:
            b, held, n, sy, syy, state = _read(batch, width)
            train = ~held
            for c, trees in enumerate(since):
                f = state[:, c] + _sum_trees(trees, b)
                if errors:
                    e = syy - 2 * f * sy + n * f * f
                    wrong[c] += [[n[m].sum(), e[m].sum()] for m in (train, held)]
                if c not in active:
                    continue
                node = _leaf(growing[c], b[train])
                residual = (sy - n * f)[train]
                size = 2 ** len(growing[c]) * bins
                for i in range(width):
                    at = node * bins + b[train, i]
                    add = np.concatenate([np.bincount(at, n[train], size), np.bincount(at, residual, size)])
                    sums[c, i] = sums[c, i] + add if (c, i) in sums else add
        rows = [(c, i, v) for (c, i), v in sums.items()] + ([(c, -1, w.ravel()) for c, w in enumerate(wrong)] if errors else [])
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2].tobytes() for r in rows], pa.binary())], ["c", "i", "v"])
    return run


def _best(bins: int, l2: list):
    """The best split of one candidate by one feature: (gain, bin, sums of rows and residuals by node left and right).
    Sums of errors pass through."""
    def run(table: pa.Table) -> pa.Table:
        c, i = table.column("c")[0].as_py(), table.column("i")[0].as_py()
        parts = table.column("v").to_pylist()
        total = sum(np.frombuffer(v) for v in sorted(parts))
        gain, at, found = 0.0, -1, total
        if i >= 0:
            n, g = total.reshape(2, -1, bins)
            left_n, left_g = n.cumsum(1), g.cumsum(1)
            right_n, right_g = left_n[:, -1:] - left_n, left_g[:, -1:] - left_g
            score = ((left_g ** 2 / np.maximum(left_n + l2[c], 1e-300)) + right_g ** 2 / np.maximum(right_n + l2[c], 1e-300)).sum(0)
            score[(left_n.sum(0) == 0) | (right_n.sum(0) == 0)] = -np.inf
            at = int(score[:-1].argmax()) if bins > 1 else -1
            gain = float(score[at])
            found = np.concatenate([x[:, at] for x in (left_n, left_g, right_n, right_g)])
        return pa.table({"c": pa.array([c], pa.int32()), "i": pa.array([i], pa.int32()), "gain": pa.array([gain]),
                         "at": pa.array([at], pa.int32()), "v": pa.array([found.tobytes()], pa.binary())})
    return run


def fit(df: DataFrame, features: Sequence[str], label: str, validation: str, candidates: Sequence[tuple[float, int, float]],
        iterations: int = 300, patience: int | None = None, bins: int = BINS) -> list[Boosted]:
    """Fit every candidate (learning rate, depth, L2 penalty of the leaves) on the rows where ``validation`` is not true.

    A candidate ends after ``iterations`` trees, or when its validation error has not fallen for ``patience`` trees.
    Missing features go to a feature's first bin; rows without a label take no part; ties between splits go to the
    earlier feature and the smaller bin. Without training rows the trees stay empty.
    """
    feats = list(features)
    data, edges = cells(df, feats, label, validation, bins)
    data = materialize(data, "boosting-cells")
    start = data.where("not held").agg(F.sum("sy") / F.sum("n")).head()[0]
    models = [Boosted(rate, depth, l2, feats, edges, float(start or 0.0)) for rate, depth, l2 in candidates]
    if start is None or not feats:
        return models
    count, l2 = len(models), [m.l2 for m in models]
    data = materialize(data.withColumn("f", F.array(*[F.lit(float(start))] * count)), "boosting-state")
    since: list[list] = [[] for _ in models]
    ended: set[int] = set()
    for turn in range(iterations + 1):
        growing: list[list] = [[] for _ in models]
        leaves: dict[int, tuple] = {}
        for level in range(max(m.depth for m in models)):
            last = turn == iterations
            active = [] if last else [c for c, m in enumerate(models) if c not in ended and level < m.depth and len(growing[c]) == level]
            if not active and level:
                break
            found = (data.mapInArrow(_level(len(feats), bins, since, growing, active, level == 0), "c int, i int, v binary")
                     .groupBy("c", "i").applyInArrow(_best(bins, l2), "c int, i int, gain double, at int, v binary").collect())
            if level == 0:
                for r in (r for r in found if r.i < 0 and r.c not in ended):
                    (n, e), (held_n, held_e) = np.frombuffer(r.v).reshape(2, 2)
                    models[r.c].history.append(tuple(float(np.sqrt(max(x, 0.0) / k)) if k else float("nan") for x, k in ((e, n), (held_e, held_n))))
                if last:
                    return models
                if patience is not None:
                    ended |= {c for c, m in enumerate(models) if m.stopped(turn, patience)[0] < turn or (
                        turn and turn - m.stopped(turn, patience)[1] >= patience)}
                    if len(ended) == count:
                        return models
                    active = [c for c in active if c not in ended]
            for c in active:
                options = sorted((r for r in found if r.c == c and r.i >= 0 and np.isfinite(r.gain)), key=lambda r: (-r.gain, r.i))
                if options:
                    growing[c].append((options[0].i, options[0].at))
                    leaves[c] = tuple(np.frombuffer(options[0].v).reshape(4, -1))
        for c, m in enumerate(models):
            if c in ended or c not in leaves:
                continue
            left_n, left_g, right_n, right_g = leaves[c]
            n, g = np.stack([left_n, right_n], 1).ravel(), np.stack([left_g, right_g], 1).ravel()
            tree = (growing[c], m.rate * np.divide(g, n + m.l2, out=np.zeros_like(g), where=n + m.l2 > 0))
            m.trees.append(tree)
            since[c].append(tree)
        if max(map(len, since)) >= KEEP:
            data = materialize(data.mapInArrow(_moved_on(len(feats), since), data.schema), "boosting-state")
            since = [[] for _ in models]
    return models


def _moved_on(width: int, since: list):
    def run(batches):
        for batch in batches:
            b, *_, state = _read(batch, width)
            f = np.column_stack([state[:, c] + _sum_trees(t, b) for c, t in enumerate(since)])
            at = batch.schema.get_field_index("f")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1]), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([lists if i == at else batch.column(i) for i in range(batch.num_columns)], batch.schema.names)
    return run


# The reference's grid: fixed values.
GRID = {"iterations": (100, 150, 200, 300), "learning_rate": (0.03, 0.1), "depth": (2, 4, 6, 8),
        "l2_leaf_reg": (0.2, 0.5, 1.0, 3.0), "early_stopping_rounds": (10, 20, 40, 80, 160)}


def grid_search(df: DataFrame, features: Sequence[str], label: str, validation: str, grid: dict = GRID, bins: int = BINS) -> DataFrame:
    """Every point of the grid with its validation RMSE, best first. Learning rate, depth and penalty are fitted
    together; iterations and early stopping are read off their curves."""
    points = list(product(grid["learning_rate"], grid["depth"], grid["l2_leaf_reg"]))
    models = fit(df, features, label, validation, points, max(grid["iterations"]), max(grid["early_stopping_rounds"]), bins)
    rows = [(its, m.rate, m.depth, m.l2, rounds, *m.stopped(its, rounds)) for m in models
            for its, rounds in product(grid["iterations"], grid["early_stopping_rounds"])]
    names = "iterations int, learning_rate double, depth int, l2_leaf_reg double, early_stopping_rounds int, run int, best_iteration int, validation_rmse double"
    return df.sparkSession.createDataFrame(rows, names).orderBy("validation_rmse", "learning_rate", "depth", "l2_leaf_reg", "iterations", "early_stopping_rounds")
