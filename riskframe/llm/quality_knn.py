"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed byte trigrams and of a few marks of its make-up (length, how many of its words and lines
repeat). A bounded sample of labelled texts gives inverse document frequencies and, by the eigenvectors of its
term-by-term products, a latent space of few dimensions. The labelled vectors are sent to every task, which
compares each document with all of them in blocks of exact cosine products; the nearest vote with their label,
weighted by a power of their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import fold, fresh, labelled_sample, quoted

SAMPLE = 8192
TERMS = 2048
MARKS = 64
DIMENSIONS = 32
NEIGHBOURS = 7
POWER = 4
MARK_WEIGHT = 0.6
KEEP_FROM = 0.3
BLOCK = 256
#: Similarities that differ by less count as equal.
TIE = 1e-6
_PARTS = ("idf", "axes", "vectors", "labels")


def terms(raw: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams, then 0/1 marks, as unsigned 16-bit integers (larger counts stay there)."""
    out = np.zeros(TERMS + MARKS, np.uint16)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) > 2:
        h = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(21)
        out[:TERMS] = np.minimum(np.bincount(h, minlength=TERMS), 65535)
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[TERMS + min(15, n.bit_length())] = 1
    if n:
        again = sum(map(bytes.__eq__, words, words[1:])) / n
        out[TERMS + 16 + min(15, int(16 * len(set(words)) / n))] = 1
        out[TERMS + 32 + min(15, int(16 * len(set(lines)) / len(lines)))] = 1
        out[TERMS + 48 + min(15, int(16 * again))] = 1
    return out


@dataclass
class Neighbours:
    """Labelled vectors and how to place a text among them."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @staticmethod
    def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
        x = np.log1p(counts, dtype=np.float32) * idf
        x[:, :TERMS] /= np.linalg.norm(x[:, :TERMS], axis=1, keepdims=True) + 1e-9
        x[:, TERMS:] = (counts[:, TERMS:] > 0) * np.float32(MARK_WEIGHT)
        return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Neighbours:
        """The term-by-term products are summed and the vectors placed by blocks of rows, so that what is held beside
        the counts is a few matrices of terms by terms."""
        idf = np.log((1 + len(counts)) / (1 + sum(((counts[i:i + BLOCK] > 0).sum(0) for i in range(0, len(counts), BLOCK)),
                                                  np.zeros(counts.shape[1], np.int64)))).astype(np.float32)
        products = np.zeros((counts.shape[1],) * 2)
        for i in range(0, len(counts), BLOCK):
            x = cls.weighted(counts[i:i + BLOCK], idf)
            products += x.T @ x
        _, vectors = np.linalg.eigh(products)
        axes = np.ascontiguousarray(vectors[:, ::-1][:, :dimensions], np.float32)
        placed = [cls.unit(cls.weighted(counts[i:i + BLOCK], idf) @ axes) for i in range(0, len(counts), BLOCK)]
        return cls(idf, axes, np.concatenate([np.zeros((0, axes.shape[1]), np.float32), *placed]), labels.astype(np.float32))

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = self.unit(self.weighted(counts, self.idf) @ self.axes) @ self.vectors.T
        k = min(neighbours, len(self.labels))
        # all that are as near as the k-th vote, so that ties need no order
        least = np.partition(cosine, -k, axis=1)[:, -k] - TIE
        i, j = np.nonzero(cosine >= least[:, None])
        weight = np.maximum(cosine[i, j], 0) ** POWER
        total = np.bincount(i, weight, len(counts))
        vote = np.bincount(i, weight * self.labels[j], len(counts)) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 0, vote, self.labels.mean()), 0, 1).astype(np.float64)


def _counted(batches):
    for batch in batches:
        rows = [terms(x).tobytes() for x in batch.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("order"), batch.column("uid"), batch.column("label"), pa.array(rows, pa.binary())],
            ["order", "uid", "label", "terms"])


def _fitted(batches):
    """The model of one partition's counts, as one row."""
    labels, held = [], []
    for batch in batches:
        labels += batch.column("label").to_pylist()
        held += batch.column("terms").to_pylist()
    counts = np.frombuffer(b"".join(held), np.uint16).reshape(-1, TERMS + MARKS)
    del held
    if len(labels):
        model = Neighbours.fit(counts, np.array(labels, np.float32))
        parts = [x.astype(np.float32).tobytes() for x in (model.idf, model.axes, model.vectors, model.labels)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], list(_PARTS))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id",
        text_col: str = "text") -> Neighbours:
    """Fit on at most ``sample`` labelled texts outside the held-out fold (4 KB of counts each). The bounded sample
    meets in one task, which fits; the driver gets only the model, ``sample`` vectors of few dimensions."""
    rows = (labelled_sample(docs, labels, target, sample, id_col, text_col)
            .mapInArrow(_counted, "order long, uid long, label int, terms binary").orderBy("order", "uid").limit(sample)
            .mapInArrow(_fitted, ", ".join(f"{x} binary" for x in _PARTS)).collect())
    idf, axes, vectors, known = (np.frombuffer(rows[0][x] if rows else b"", np.float32) for x in _PARTS)
    return Neighbours(idf, axes.reshape(-1, DIMENSIONS), vectors.reshape(-1, DIMENSIONS), known)


def score(model: Neighbours, text_col: str = "text") -> Column:
    """The chance, by vote, that a text is of label 1. Null counts as the empty text, which has a score too."""
    @F.pandas_udf("double")
    def vote(raw: pd.Series) -> pd.Series:
        out = [model.scores(np.array([terms(x) for x in raw.iloc[i:i + BLOCK]])) for i in range(0, len(raw), BLOCK)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))
    return vote(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def scored(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = KEEP_FROM,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Repeated rows are scored each; an empty table
    gives an empty result, and without labels every score is 0.5. Neighbours as near as the last that counts all vote."""
    model = fit(docs, labels, target, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == 0).alias("held_out"),
                       score(model, text_col).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_FROM) -> DataFrame:
    """``docs`` without the rows scored below ``threshold``; all columns stay as they are."""
    model = fit(docs, labels)
    name = fresh(docs, "score")
    return docs.withColumn(name, score(model)).where(F.col(name) >= threshold).select(*map(quoted, docs.columns))
