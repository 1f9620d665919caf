"""One-pass sufficient statistics: pairwise moment matrices (correlation) and Gram matrices (linear models).

A k-column statistic over n rows needs O(k^2) numbers, not O(n): each partition reduces its rows to a k x k
block with vectorised numpy matrix products inside ``mapInPandas`` (Arrow batches), the blocks are summed by a
grouped aggregate on (i, j) - a k^2-row shuffle whatever n is - and the small result is solved on the driver.
Columns are centred by a global mean from one preceding aggregate so the sums stay numerically stable.

Built-in aggregates can express the same sums, but k^2 * 6 aggregate functions in one ``agg`` exceed the field
limit of whole-stage code generation and run interpreted; the matrix form stays vectorised.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.stats import agg_row

#: Entries of a group's statistics that are shifts, not sums.
SHIFTS = ("x0", "y0")
_MOMENT_SCHEMA = "i int, j int, n double, sa double, sb double, saa double, sbb double, sab double"


def _means(df: DataFrame, cols: Sequence[str]) -> list[float]:
    row = agg_row(df, {f"m{i}": F.avg(F.col(f"`{c}`").cast("double")) for i, c in enumerate(cols)})
    return [row[f"m{i}"] or 0.0 for i in range(len(cols))]


def pairwise_moments(df: DataFrame, cols: Sequence[str]) -> dict[tuple[int, int], tuple[float, ...]]:
    """For every ordered pair (i, j): over rows where both are non-null, (n, sum a, sum b, sum a^2, sum b^2,
    sum ab) of the centred columns."""
    cols = list(cols)
    k = len(cols)
    mu = np.array(_means(df, cols), dtype="float64")

    def part(batches):
        n = np.zeros((k, k))
        sa = np.zeros((k, k))
        saa = np.zeros((k, k))
        sab = np.zeros((k, k))
        seen = False
        for pdf in batches:
            if pdf.empty:
                continue
            seen = True
            x = pdf.to_numpy(dtype="float64", na_value=np.nan) - mu
            m = (~np.isnan(x)).astype("float64")
            xz = np.where(m > 0, x, 0.0)
            n += m.T @ m
            sa += xz.T @ m            # sa[i, j] = sum of x_i where x_j is present
            saa += (xz * xz).T @ m
            sab += xz.T @ xz
        if not seen:
            return
        ii, jj = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
        yield pd.DataFrame({"i": ii.ravel().astype("int32"), "j": jj.ravel().astype("int32"), "n": n.ravel(),
                            "sa": sa.ravel(), "sb": sa.T.ravel(), "saa": saa.ravel(), "sbb": saa.T.ravel(),
                            "sab": sab.ravel()})

    data = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = data.mapInPandas(part, _MOMENT_SCHEMA)
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    return {(r["i"], r["j"]): (r["n"], r["sa"], r["sb"], r["saa"], r["sbb"], r["sab"]) for r in sums.collect()}


def correlation_from_moments(m: tuple[float, ...]) -> float | None:
    n, sa, sb, saa, sbb, sab = m
    if not n or n < 2:
        return None
    va = saa - sa * sa / n
    vb = sbb - sb * sb / n
    if va <= 0 or vb <= 0:
        return None
    return (sab - sa * sb / n) / np.sqrt(va * vb)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> list[tuple[str, str, float | None]]:
    """Pairwise-complete Pearson for all ordered pairs; a constant column gives None."""
    cols = list(cols)
    mom = pairwise_moments(df, cols)
    return [(a, b, correlation_from_moments(mom[(i, j)])) for i, a in enumerate(cols) for j, b in enumerate(cols)]


# ---- Gram matrices for linear models ----------------------------------------------------------------------------
def gram(df: DataFrame, features: Sequence[str], label: str, group: str | None = None,
         weight: str | None = None) -> dict:
    """X'X, X'y, y'y, n (and sums) per group (e.g. CV fold) for rows with no NULL in features/label.

    Features and label are shifted by their global means (one aggregate) before anything is squared, so the sums
    keep their digits whatever the columns' offset. Returns {group_value: {"xtx": (p x p), "xty": (p,), "yty", "n",
    "sx": (p,), "sy", "x0": (p,), "y0"}}: sums of the shifted columns, and the shifts, which all groups share.
    """
    p = len(features)
    # safe positional names: mapInPandas resolves input columns by name, and feature names may contain dots
    cols = [F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    cols.append(F.col(f"`{label}`").cast("double").alias("y"))
    if group:
        cols.append(F.col(f"`{group}`").alias("g"))
    if weight:
        cols.append(F.col(f"`{weight}`").cast("double").alias("w"))
    data = df.select(*cols)
    complete = F.lit(True)
    for c in data.columns:
        complete = complete & F.col(c).isNotNull()
    data = data.filter(complete)
    shift = _means(data, [f"f{i}" for i in range(p)] + ["y"])
    data = data.select(*[(F.col(c) - F.lit(m)).alias(c) for c, m in zip([f"f{i}" for i in range(p)] + ["y"], shift)],
                       *(["g"] if group else []), *(["w"] if weight else []))
    feats = [f"f{i}" for i in range(p)]
    label, group, weight = "y", ("g" if group else None), ("w" if weight else None)

    def part(batches):
        acc: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            groups = pdf.groupby(group, sort=False) if group else [(None, pdf)]
            for g, sub in groups:
                x = sub[feats].to_numpy(dtype="float64")
                y = sub[label].to_numpy(dtype="float64")
                w = sub[weight].to_numpy(dtype="float64") if weight else np.ones(len(sub))
                a = acc.setdefault(g, [np.zeros((p, p)), np.zeros(p), 0.0, 0.0, np.zeros(p), 0.0])
                xw = x * w[:, None]
                a[0] += xw.T @ x
                a[1] += xw.T @ y
                a[2] += float((w * y * y).sum())
                a[3] += float(w.sum())
                a[4] += xw.sum(axis=0)
                a[5] += float((w * y).sum())
        rows = []
        for g, (xtx, xty, yty, n, sx, sy) in acc.items():
            rows.append({"g": None if g is None else str(g), "xtx": xtx.ravel().tolist(), "xty": xty.tolist(),
                         "yty": yty, "n": n, "sx": sx.tolist(), "sy": sy})
        if rows:
            yield pd.DataFrame(rows)

    schema = "g string, xtx array<double>, xty array<double>, yty double, n double, sx array<double>, sy double"
    parts = data.mapInPandas(part, schema)
    # element-wise sums of the (k^2-sized) partial arrays per group: explode with position, sum, regroup
    return {g: {**s, "x0": np.array(shift[:p]), "y0": shift[p]} for g, s in _sum_arrays(parts, p)}


def _sum_arrays(parts: DataFrame, p: int):
    """Sum the partial statistics per group with a grouped aggregate over exploded array positions."""
    flat = parts.select("g", F.posexplode(F.concat(F.col("xtx"), F.col("xty"), F.array(F.col("yty"), F.col("n")),
                                                   F.col("sx"), F.array(F.col("sy")))).alias("pos", "v"))
    sums = flat.groupBy("g", "pos").agg(F.sum("v").alias("v")).collect()
    by_g: dict = {}
    for r in sums:
        by_g.setdefault(r["g"], {})[r["pos"]] = r["v"]
    for g, d in by_g.items():
        vec = np.array([d[i] for i in range(len(d))])
        xtx = vec[:p * p].reshape(p, p)
        xty = vec[p * p:p * p + p]
        yty, n = vec[p * p + p], vec[p * p + p + 1]
        sx = vec[p * p + p + 2:p * p + 2 * p + 2]
        sy = vec[-1]
        yield g, {"xtx": xtx, "xty": xty, "yty": float(yty), "n": float(n), "sx": sx, "sy": float(sy)}


def combine(stats: Sequence[dict]) -> dict:
    """Sum several group statistics (e.g. all folds but one)."""
    return {k: v if k in SHIFTS else sum((s[k] for s in stats[1:]), v) for k, v in stats[0].items()}


def minus(total: dict, part: dict) -> dict:
    """The statistics of the rows of ``total`` that are not in ``part`` (e.g. all folds but one)."""
    return {k: v if k in SHIFTS else v - part[k] for k, v in total.items()}


def centred(s: dict) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float]:
    """Centred cross products (for a model with intercept): Sxx, Sxy, Syy, mean x, mean y."""
    n = s["n"]
    mx, my = s["sx"] / n, s["sy"] / n
    sxx = s["xtx"] - n * np.outer(mx, mx)
    sxy = s["xty"] - n * mx * my
    syy = s["yty"] - n * my * my
    return sxx, sxy, syy, mx + s["x0"], my + s["y0"]
