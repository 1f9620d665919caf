"""Attributions of non-linear models (K17 / K18): exact for trees, sampled for any other predictor.

A tree ensemble is a set of node arrays. Along the path to a leaf a feature either lets a row through (1 or 0) or, where
it is not known, a share of the training rows (its cover). The value of a set of known features is then a product over
the path, and a feature's Shapley value a sum over the leaves, with the other features of the path as a polynomial
whose k-th coefficient counts the sets of k known ones. Rows of an Arrow batch that pass the same splits of a leaf's path share one
evaluation, so a leaf costs its distinct patterns and one look-up per row. The values of a row sum to its prediction
less the expected one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.session import scratch_path


@dataclass
class Tree:
    """Node arrays with the root first: split feature (-1 for a leaf), threshold (a row goes left if its value is not
    larger), categories that go left instead, children, cover (training rows) and the value of a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray
    categories: dict[int, np.ndarray] = field(default_factory=dict)

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        """Of the rows ``x`` those that pass the split to the left; a missing value goes right, as in Spark's models."""
        v = x[:, self.feature[node]]
        return np.isin(v, self.categories[node]) if node in self.categories else v <= self.threshold[node]

    def paths(self):
        """For every leaf its value, and per feature of its path the splits (node, left) and the share of training
        rows that they let through."""
        stack = [(0, [])]
        while stack:
            node, splits = stack.pop()
            if self.feature[node] < 0:
                known: dict[int, tuple[list, float]] = {}
                for at, to_left in splits:
                    child = self.left[at] if to_left else self.right[at]
                    through, share = known.get(int(self.feature[at]), ([], 1.0))
                    known[int(self.feature[at])] = (through + [(at, to_left)], share * self.cover[child] / self.cover[at])
                yield float(self.value[node]), known
                continue
            stack.append((int(self.left[node]), splits + [(node, True)]))
            stack.append((int(self.right[node]), splits + [(node, False)]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (self.feature[at] >= 0).any():
            for node in np.unique(at[self.feature[at] >= 0]):
                here = np.flatnonzero(at == node)
                at[here] = np.where(self.goes_left(node, x[here]), self.left[node], self.right[node])
        return self.value[at]


@dataclass
class Ensemble:
    """A weighted sum of trees."""

    trees: list[Tree]
    weights: list[float]
    _known: list | None = field(default=None, repr=False, compare=False)

    @property
    def base(self) -> float:
        """The expected prediction over the trees' training rows."""
        return sum(w * value * float(np.prod([s for _, s in known.values()])) for w, t in zip(self.weights, self.trees)
                   for value, known in t.paths())

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum((w * t.predict(x) for w, t in zip(self.weights, self.trees)), np.zeros(len(x)))

    def swapped(self, x: np.ndarray, feature: int, own: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Predictions of the rows ``x`` for any value of one feature: the thresholds it is compared with, in order, and
        a row for each gap between them (a value's gap is the number of thresholds below it) with a column for each of
        ``x``. ``own`` are the trees' predictions of ``x``. A row goes down a tree once, on both sides of splits by the
        feature; splits by categories have no order, so they are an error."""
        uses = [(t.feature == feature).any() for t in self.trees]
        cuts = np.unique(np.concatenate([np.zeros(0), *(t.threshold[t.feature == feature] for t, u in zip(self.trees, uses) if u)]))
        steps = np.zeros((len(cuts) + 2, len(x)))
        for w, t, p, u in zip(self.weights, self.trees, own, uses):
            if not u:
                steps[0] += w * p
                continue
            if t.categories:
                raise ValueError("splits by categories")
            stack = [(0, np.arange(len(x)), 0, len(cuts) + 1)]
            while stack:
                node, rows, low, high = stack.pop()
                if low >= high or not len(rows):
                    continue
                split = t.feature[node]
                if split < 0:
                    steps[low, rows] += w * t.value[node]
                    steps[high, rows] -= w * t.value[node]
                elif split == feature:
                    cut = int(np.searchsorted(cuts, t.threshold[node])) + 1
                    stack += [(t.left[node], rows, low, min(high, cut)), (t.right[node], rows, max(low, cut), high)]
                else:
                    left = x[rows, split] <= t.threshold[node]
                    stack += [(t.left[node], rows[left], low, high), (t.right[node], rows[~left], low, high)]
        return cuts, np.cumsum(steps[:-1], axis=0)

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley values, one row and column for each of ``x``."""
        out = np.zeros(x.shape[::-1])
        for tree, leaves in zip(self.trees, self._leaves()):
            passes: dict[int, np.ndarray] = {}
            for amount, known, share, table in leaves:
                code = np.zeros(len(x), np.int64)
                for i, splits in enumerate(known.values()):
                    through = np.ones(len(x), bool)
                    for node, to_left in splits:
                        if node not in passes:
                            passes[node] = tree.goes_left(node, x)
                        through &= passes[node] == to_left
                    code |= through.astype(np.int64) << i
                if table is None:
                    code, at = np.unique(code, return_inverse=True)
                    values = (amount * _product_values(_bits(code, len(known)), share)).T
                else:
                    at, values = code, table
                for column, value in zip(known, values):
                    out[column] += value[at]
        return out.T

    def _leaves(self) -> list:
        """Per tree its leaves with a split: value, splits per feature, shares, and the values of all patterns of what
        lets a row through, where these are few. They are the same for every batch, so they are computed once."""
        if self._known is None:
            self._known = []
            for w, tree in zip(self.weights, self.trees):
                leaves = []
                for value, known in tree.paths():
                    if not known or value == 0:
                        continue
                    share = np.array([s for _, s in known.values()])
                    table = None
                    if len(known) <= MOST_TABLED:
                        table = (w * value * _product_values(_bits(np.arange(1 << len(known)), len(known)), share)).T.copy()
                    leaves.append((w * value, {f: splits for f, (splits, _) in known.items()}, share, table))
                self._known.append(leaves)
        return self._known


#: Features of a path whose patterns are all tabled; of longer paths only those that occur.
MOST_TABLED = 8


def _bits(codes: np.ndarray, width: int) -> np.ndarray:
    return ((codes[:, None] >> np.arange(width)) & 1).astype(float)


def _product_values(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Shapley values of the game whose value is the product of ``one`` over the known players and ``zero`` over the
    others, for each row of ``one``."""
    n, m = one.shape
    weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.empty((n, m))
    for i in range(m):
        sums = np.zeros((n, m))
        sums[:, 0] = 1
        for j in range(m):
            if j != i:
                sums[:, 1:] = sums[:, 1:] * zero[j] + sums[:, :-1] * one[:, j:j + 1]
                sums[:, 0] *= zero[j]
        out[:, i] = (one[:, i] - zero[i]) * (sums @ weight)
    return out


def from_model(model, positive: int = 1) -> Ensemble:
    """The trees of a fitted Spark forest, boosting or single-tree model. A regression explains the prediction, a
    forest of classes the probability of class ``positive``, boosted classes their margin. The nodes are read from the
    saved model: their number is bounded by its trees and depth."""
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "model-nodes")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    single = "treeID" not in data.columns
    nodes = data.select(F.lit(0).alias("tree"), F.struct(*data.columns).alias("n")) if single else data.toDF("tree", "n")
    rows: dict[int, list] = {}
    for r in nodes.collect():
        rows.setdefault(r["tree"], []).append(r["n"])
    boosted, classes = "GBT" in type(model).__name__, hasattr(model, "numClasses") and "GBT" not in type(model).__name__
    weights = list(model.treeWeights) if boosted else [1.0 / len(rows)] * len(rows)
    return Ensemble([_tree(sorted(rows[t], key=lambda n: n["id"]), classes, positive) for t in sorted(rows)], weights)


def _tree(nodes: list, classes: bool, positive: int) -> Tree:
    at = {n["id"]: i for i, n in enumerate(nodes)}
    split = [n["split"] if n["leftChild"] >= 0 else None for n in nodes]
    categories = {i: np.array(s["leftCategoriesOrThreshold"]) for i, s in enumerate(split) if s is not None and s["numCategories"] >= 0}

    def value(n) -> float:
        if not classes:
            return n["prediction"]
        total = sum(n["impurityStats"])
        return n["impurityStats"][positive] / total if total else 0.0
    return Tree(np.array([-1 if s is None else s["featureIndex"] for s in split]),
                np.array([np.nan if s is None or i in categories else s["leftCategoriesOrThreshold"][0] for i, s in enumerate(split)]),
                np.array([at.get(n["leftChild"], -1) for n in nodes]), np.array([at.get(n["rightChild"], -1) for n in nodes]),
                # bagged rows count as often as they were drawn
                np.array([sum(n["impurityStats"]) if classes else n["impurityStats"][0] for n in nodes], float),
                np.array([value(n) for n in nodes], float), categories)


def tree_attributions(df: DataFrame, features: Sequence[str], ensemble: Ensemble, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., prediction, base, phi): phi is an array in the order of ``features``. Missing values are passed on as
    NaN, which go right at every split."""
    base, width = ensemble.base, len(features)

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(f"__x{i}").to_numpy(zero_copy_only=False) for i in range(width)]) if batch.num_rows else np.zeros((0, width))
            phi = ensemble.attributions(x)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ensemble.predict(x)),
                                              pa.array(np.full(len(x), base)), values], [*names, "prediction", "base", "phi"])

    held = df.select(*[F.col(f"`{c}`") for c in keep],
                     *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"__x{i}") for i, c in enumerate(features)])
    names = list(keep)
    kinds = "".join(f"`{c}` {held.schema[c].dataType.simpleString()}, " for c in keep)
    return held.mapInArrow(run, kinds + "prediction double, base double, phi array<double>")


def sampled_attributions(df: DataFrame, id_col: str, features: Sequence[str], predict: Callable[[DataFrame], DataFrame],
                         background: DataFrame, draws: int = 32, seed: int = 0) -> DataFrame:
    """(id, base, prediction, phi) of any predictor by sampled orders of the features (``predict`` adds ``prediction``).

    In each draw a row's features replace those of a background row one by one in a random order; a feature's value is
    the mean change it makes. Draws hash the id, so they don't depend on the partitions, and the values of a row sum to
    its prediction less the mean one of its background rows. ``background`` is a fixed-size sample (H4), numbered
    and joined by number. The id must be unique.
    """
    feats = list(features)
    numbered = background.select(F.struct(*[F.col(f"`{f}`").cast("double").alias(f"b{i}") for i, f in enumerate(feats)]).alias("b"))
    number = Window.orderBy("b")
    numbered = numbered.limit(MOST_BACKGROUND).select((F.row_number().over(number) - 1).alias("at"), "b")
    size = numbered.count()
    if not size:
        raise ValueError("the background sample is empty")
    rows = df.select(F.col(id_col).alias("__id"), *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(feats)])
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    # the draws of a row go through the background in turn, from a place of its own
    drawn = drawn.withColumn("at", F.pmod(F.xxhash64("__id", F.lit(seed)) + F.col("draw"), F.lit(size)).cast("int")).join(numbered, "at")
    order = F.array_sort(F.array(*[F.struct(F.xxhash64("__id", "draw", F.lit(seed), F.lit(i)).alias("h"), F.lit(i).alias("i"))
                                   for i in range(len(feats))]))
    drawn = drawn.withColumn("order", F.transform(order, lambda o: o["i"]))
    steps = drawn.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(feats)))))
    mixed = [F.when(F.array_position("order", i) <= F.col("step"), F.col(f"x{i}")).otherwise(F.col("b")[f"b{i}"]).alias(f)
             for i, f in enumerate(feats)]
    scored = predict(steps.select("__id", "draw", "order", "step", *mixed))
    p, last = F.col("prediction"), len(feats)
    # a step's prediction counts for the feature that came in with it, and against the next one
    gains = F.array(*[F.when(F.get("order", F.col("step") - 1) == i, p).otherwise(F.lit(0.0))
                      - F.when(F.get("order", F.col("step")) == i, p).otherwise(F.lit(0.0)) for i in range(len(feats))])
    per = scored.select("__id", F.when(F.col("step") == 0, p).alias("low"), F.when(F.col("step") == last, p).alias("high"), gains.alias("g"))
    return per.groupBy(F.col("__id").alias(id_col)).agg(
        F.avg("low").alias("base"), F.avg("high").alias("prediction"),
        F.array(*[F.sum(F.get("g", F.lit(i))) / F.lit(float(draws)) for i in range(len(feats))]).alias("phi"))


#: Rows of a background sample.
MOST_BACKGROUND = 1000


def long_attributions(attributed: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., feature, phi): a row per feature."""
    pairs = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("phi").alias("phi"))
    return attributed.select(*[F.col(f"`{c}`") for c in keep], F.explode(pairs).alias("p")).select(
        *[F.col(f"`{c}`") for c in keep], F.col("p.feature").alias("feature"), F.col("p.phi").alias("phi"))


def summary(attributed: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute attribution per feature."""
    row = attributed.agg(*[F.avg(F.abs(F.get("phi", F.lit(i)))).alias(f"m{i}") for i in range(len(features))])
    pairs: list[Column] = [F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean_abs_phi")) for i, f in enumerate(features)]
    return row.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def waterfalls(attributed: DataFrame, features: Sequence[str], id_col: str, group: str, n: int = 11) -> DataFrame:
    """(id, group, feature, phi, rank, from, to) for the first n rows per group by id: the features by falling
    size, each step running from the expected prediction towards the row's own."""
    first = Window.partitionBy(group).orderBy(F.col(id_col).asc_nulls_first())
    rows = attributed.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= n)
    long = rows.select(id_col, group, "base", F.explode(F.arrays_zip(
        F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("phi").alias("phi"))).alias("p")).select(
        id_col, group, "base", F.col("p.feature").alias("feature"), F.col("p.phi").alias("phi"))
    size = Window.partitionBy(id_col, group).orderBy(F.desc(F.abs("phi")), "feature")
    to = F.col("base") + F.sum("phi").over(size.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return long.withColumns({"rank": F.row_number().over(size), "to": to}).select(
        id_col, group, "feature", "phi", "rank", (F.col("to") - F.col("phi")).alias("from"), "to")
