"""Toxicity by a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are its hashed byte n-grams (ASCII lower case, white space as one blank), present or not. Over a
bounded sample of labelled texts each n-gram gets the log ratio of its smoothed share among toxic and among other
texts; the n-grams that tell the classes apart best are kept, and a logistic regression is fitted to their ratios.
Scoring looks each n-gram of the whole text up in one small table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import fold, labelled_sample, written

SAMPLE = 16384
BITS = 20
SHORTEST, LONGEST = 3, 6
FEATURES = 4096
RIDGE = 3e-4
STEPS = 400
RATE = 0.05
THRESHOLD = 0.5
CHUNK = 1 << 20


def _chunks(raw: bytes):
    """The text in overlapping parts, so a very long one needs no more memory than a part."""
    text = b" " + b" ".join(raw.lower().split()) + b" "
    for at in range(0, max(1, len(text) - LONGEST + 1), CHUNK):
        yield np.frombuffer(text[at:at + CHUNK + LONGEST - 1], np.uint8).astype(np.uint32)


def buckets(letters: np.ndarray):
    """Hash buckets of the n-grams of a part, one array for each length."""
    h = letters
    for n in range(2, LONGEST + 1):
        if len(h) < 2:
            return
        h = h[:-1] * np.uint32(0x01000193) ^ letters[n - 1:] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(13)
        if n >= SHORTEST:
            yield h * np.uint32(0x85EBCA77) + np.uint32(n) >> np.uint32(32 - BITS)


def _counted(batches):
    """Sampled texts to (bucket, with, without): how many toxic and other texts have it, per batch."""
    for batch in batches:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for raw, label in zip(batch.column("raw").to_pylist(), batch.column("label").to_pylist()):
            has = np.zeros(1 << BITS, bool)
            for part in _chunks(raw):
                for b in buckets(part):
                    has[b] = True
            counts[int(label > 0)] += has
        seen = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[1][seen]), pa.array(counts[0][seen])],
                                         ["bucket", "toxic", "other"])


@dataclass
class Linear:
    """``place`` is a bucket's feature or -1; ``weight`` a feature's coefficient times its ratio."""

    place: np.ndarray
    weight: np.ndarray
    bias: float

    def present(self, raw: bytes) -> np.ndarray:
        has = np.zeros(len(self.weight) + 1, bool)
        for part in _chunks(raw):
            for b in buckets(part):
                has[self.place[b]] = True
        return np.flatnonzero(has[:-1])

    def score(self, raw: bytes) -> float:
        z = self.weight[self.present(raw)].sum() + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _features(model: Linear):
    def run(batches):
        for batch in batches:
            rows = [model.present(x).astype(np.uint16).tobytes() for x in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("uid"), batch.column("label"), pa.array(rows, pa.binary())],
                ["order", "uid", "label", "features"])
    return run


def regression(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, ridge: float = RIDGE,
               steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Logistic regression on the ratios of present features, by Adam on the whole sample."""
    at = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    value = ratio[at]
    theta = np.zeros(len(ratio) + 1)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    theta[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        z = np.bincount(row, value * theta[at], len(rows)) + theta[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels
        grad = np.r_[np.bincount(at, value * error[row], len(ratio)) / len(rows) + ridge * theta[:-1], error.mean()]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta -= rate * (first / (1 - 0.9 ** k)) / (np.sqrt(second / (1 - 0.99 ** k)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE, features: int = FEATURES,
        id_col: str = "doc_id", text_col: str = "text") -> Linear:
    """Fit on at most ``sample`` labelled ids outside the held-out fold; without labels of both kinds, a model that
    says the share of label 1 (0.5 without any)."""
    texts = written(labelled_sample(docs, labels, target, sample, id_col, text_col), "labelled-texts")
    n = {r["label"]: r["n"] for r in texts.groupBy(F.when(F.col("label") > 0, 1).otherwise(0).alias("label"))
         .agg(F.count("*").alias("n")).collect()}
    yes, no = n.get(1, 0), n.get(0, 0)
    nowhere = np.full(1 << BITS, -1, np.int16)
    if not yes or not no:
        return Linear(nowhere, np.zeros(0), 0.0 if not yes + no else 4.0 if yes else -4.0)
    counts = written(texts.mapInArrow(_counted, "bucket long, toxic long, other long").groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "gram-counts")
    total = counts.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).head()
    a, b = (F.col("toxic") + 0.5) / (yes + 1), (F.col("other") + 0.5) / (no + 1)
    share = (F.col("toxic") + F.col("other") + 1) / (yes + no + 2)
    ratio = F.log((F.col("toxic") + 1) / (total["toxic"] + (1 << BITS))) - F.log(
        (F.col("other") + 1) / (total["other"] + (1 << BITS)))
    best = counts.select("bucket", ratio.alias("ratio"), (F.abs(a - b) / F.sqrt(share * (1 - share) + 1e-3)).alias("by")
                         ).orderBy(F.desc("by"), "bucket").limit(features).collect()
    place, ratios = nowhere, np.array([r["ratio"] for r in best])
    place[[r["bucket"] for r in best]] = np.arange(len(best))
    model = Linear(place, np.zeros(len(best)), 0.0)
    rows = (texts.mapInArrow(_features(model), "order long, uid long, label int, features binary")
            .orderBy("order", "uid").limit(sample).collect())
    weight, model.bias = regression([np.frombuffer(r["features"], np.uint16).astype(np.int64) for r in rows],
                                    np.array([float(r["label"] > 0) for r in rows]), ratios)
    model.weight = weight * ratios
    return model


def score(model: Linear, text_col: str = "text") -> Column:
    """The model's chance of label 1 for the whole text. Null counts as empty, which scores by the bias alone."""
    @F.pandas_udf("double")
    def toxic(raw: pd.Series) -> pd.Series:
        return raw.map(model.score)
    return toxic(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def scored(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = THRESHOLD,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Repeated rows are scored each; an empty table
    gives an empty result."""
    model = fit(docs, labels, target, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == 0).alias("held_out"),
                       score(model, text_col).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
