"""Hard negatives by angular triangles: rows of another label that score nearly as high as an anchor's positives.

1. Each vector becomes integers, with its norm and its angles to a few reference directions. Rows are ordered by label
   and nearest reference and dealt in blocks of equal size, so no label or group of equal vectors makes a larger one.
2. For a reference r, the angle between an anchor a and a row x lies between |ar - xr| and ar + xr (or 2 pi less it).
   The intervals of all references are intersected, their cosines multiplied by the norms: bounds of the score, made
   wider than any rounding. They decide first for chunks of anchors and blocks of rows, then in a task for an anchor
   and a part of a block, and last for a run of rows in the order of their angle; only what can reach a window of
   wanted scores is multiplied out, in exact integers.
3. A first pass finds each anchor's positives, with the running worst of its best rows as the window. A second one
   finds the negatives in the windows that the positives' scores give.

A pair of chunk and block is one group of bounded size. Only pairs that overlap are sent anything.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import with_uid, written

REFERENCES = 8
#: Rows that the references are chosen from. They only steer how much is skipped, never what is found.
REFERENCE_SAMPLE = 1024
#: Rows of a block, anchors of a chunk, rows and anchors that are multiplied at once.
BLOCK, CHUNK, PART, SLICE = 4096, 8192, 1024, 256
#: Radians by which angle intervals are widened (stored angles are 32-bit, cosines lose digits near 0 and pi).
SLACK = 1e-5
_LAST_ID = (1 << 63) - 1


def reference_directions(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors of the sample that lie far apart: each next one is the farthest from all chosen so far."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def integers(values: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale)


def _preparer(references: np.ndarray, dimensions: int, scale: float):
    def run(batches):
        for batch in batches:
            vectors = batch.column("vector")
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            x = np.zeros((len(vectors), dimensions))
            x[np.arange(dimensions) < lengths[:, None]] = integers(flat, scale)
            if len(x) and np.abs(x).max(initial=0) >= 1 << 31:
                raise ValueError("a component times the scale is beyond 32 bits")
            norm = np.sqrt((x * x).sum(1))
            cosine = (x @ references.T) / np.maximum(norm, 1e-300)[:, None]
            angles = np.where(norm[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), math.pi / 2).astype(np.float32)
            nearest = angles.argmin(1) if angles.shape[1] else np.zeros(len(x), np.int64)
            angle = angles[np.arange(len(x)), nearest] if angles.shape[1] else np.zeros(len(x), np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("id"), batch.column("label"),
                 pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()), pa.array(norm),
                 pa.array(list(angles), pa.list_(pa.float32())), pa.array(nearest.astype(np.int32)),
                 pa.array(angle, pa.float32())],
                ["uid", "id", "label", "q", "norm", "angles", "nearest", "angle"])
    return run


def in_blocks(df: DataFrame, order: list[str], size: int, number: str, name: str) -> DataFrame:
    """``df`` in a global order, written, with the running number of its block of ``size`` rows. What is collected is
    one count per partition."""
    ordered = written(df.repartitionByRange(*order).sortWithinPartitions(*order)
                      .withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33)
    counts = sorted(ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = np.cumsum([0] + [r.n for r in counts])
    table = df.sparkSession.createDataFrame([(r.part, int(s)) for r, s in zip(counts, starts)], "part long, start long")
    at = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)
    return (ordered.withColumn("part", part).join(F.broadcast(table), "part")
            .withColumn(number, F.floor(at / size).cast("long")).drop("part", "start", "place"))


def _summary(rows: DataFrame, key: str, references: int, prefix: str, *more: Column) -> DataFrame:
    """Per block or chunk: the least and largest label, norm and angle to each reference."""
    ends = [(f(c), f"{prefix}{end}_{x}") for end, f in (("lo", F.min), ("hi", F.max))
            for x, c in [("label", F.col("label")), ("norm", F.col("norm"))]
            + [(str(r), F.col("angles")[r]) for r in range(references)]]
    return rows.groupBy(key).agg(*(c.alias(n) for c, n in ends), *more)


def _score_bounds(references: int) -> tuple[Column, Column]:
    """Least and largest score that any anchor of a chunk (c_) and row of a block (b_) can have."""
    def of(name):
        return F.col(name).cast("double")
    low, high = F.lit(0.0), F.lit(math.pi)
    for r in range(references):
        low = F.greatest(low, of(f"c_lo_{r}") - of(f"b_hi_{r}"), of(f"b_lo_{r}") - of(f"c_hi_{r}"))
        high = F.least(high, of(f"c_hi_{r}") + of(f"b_hi_{r}"), 2 * math.pi - of(f"c_lo_{r}") - of(f"b_lo_{r}"))
    most, least = of("c_hi_norm") * of("b_hi_norm"), of("c_lo_norm") * of("b_lo_norm")
    up, down = F.cos(F.greatest(F.lit(0.0), low - SLACK)), F.cos(F.least(F.lit(math.pi), high + SLACK))
    return (F.when(down < 0, down * most).otherwise(down * least) - 1 - 1e-9 * most,
            F.when(up > 0, up * most).otherwise(up * least) + 1 + 1e-9 * most)


def _pairs(chunks: DataFrame, blocks: DataFrame, block_count: int, wanted: Column) -> DataFrame:
    """(chunk, block) of the chunks of the query set and the blocks whose bounds overlap."""
    return (chunks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(block_count - 1).cast("long"))))
            .join(blocks, "block").where(wanted).select("chunk", "block"))


def score_interval(ta: np.ndarray, na: np.ndarray, lo: np.ndarray, hi: np.ndarray, norm_lo: float, norm_hi: float):
    """Bounds of the scores of anchors (angles ``ta``, norms ``na``) with rows whose angles lie from ``lo`` to ``hi``."""
    if ta.shape[1]:
        least = np.maximum(np.maximum(ta - hi, lo - ta).max(1), 0)
        most = np.minimum(np.minimum(ta + hi, 2 * math.pi - ta - lo).min(1), math.pi)
    else:
        least, most = np.zeros(len(na)), np.full(len(na), math.pi)
    up, down = np.cos(np.maximum(least - SLACK, 0)), np.cos(np.minimum(most + SLACK, math.pi))
    wide = 1 + 1e-9 * na * norm_hi
    return (np.where(down < 0, down * norm_hi, down * norm_lo) * na - wide,
            np.where(up > 0, up * norm_hi, up * norm_lo) * na + wide)


def products(a: np.ndarray, x: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of integer rows, as long integers; ``largest`` bounds their size (Cauchy-Schwarz)."""
    if largest < 1 << 52:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if largest >= 1 << 62:
        raise ValueError("a score can be beyond 64 bits")
    return a.astype(np.int64) @ x.astype(np.int64).T


def _top(rows: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (anchor, window, score, id, uid) the first ``most`` of each anchor and window."""
    rows = rows[np.lexsort((rows[:, 4], rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    starts = np.flatnonzero(new)
    return rows[np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows)))) < most]


def search(anchors: dict, block: dict, low: np.ndarray, high: np.ndarray, same: bool, most: int) -> np.ndarray:
    """The first ``most`` rows of a block for each anchor and window: scores from ``low`` to ``high`` (one column per
    window), of the anchor's label or of any other. Rows of (anchor, window, score, id, uid)."""
    found = [np.zeros((0, 5), np.int64)]
    order = np.argsort(block["angles"].max(1) if block["angles"].shape[1] else block["norm"], kind="stable")
    parts = [order[i:i + PART] for i in range(0, len(order), PART)]
    for s in range(0, len(anchors["uid"]), SLICE):
        at = slice(s, s + SLICE)
        a = {k: v[at] for k, v in anchors.items()}
        lo, hi, held = low[at].copy(), high[at], np.zeros((0, 5), np.int64)
        bounds = []
        for p in parts:
            t, n = block["angles"][p], block["norm"][p]
            bounds.append(score_interval(a["angles"], a["norm"], t.min(0, initial=9), t.max(0, initial=0), n.min(), n.max()))
        for k in np.argsort([-up.max() for _, up in bounds]):
            p, (down, up) = parts[k], bounds[k]
            active = np.flatnonzero((up >= lo.min(1)) & (down <= hi.max(1)))
            p = p[_window(a, block, p, active, lo)]
            if not len(active) or not len(p):
                continue
            score = products(a["q"][active], block["q"][p], a["norm"].max() * block["norm"][p].max())
            right = (a["label"][active][:, None] == block["label"][p]) == same
            right &= a["uid"][active][:, None] != block["uid"][p]
            right &= (score >= lo[active].min(1)[:, None]) & (score <= hi[active].max(1)[:, None])
            if lo.shape[1] == 1 and len(p) > most:
                worst = np.where(right, score, np.iinfo(np.int64).min)
                right &= score >= np.partition(worst, -most, axis=1)[:, -most][:, None]
            i, j = np.nonzero(right)
            got, who = score[i, j], active[i]
            fits = (got[:, None] >= lo[who]) & (got[:, None] <= hi[who])
            c, w = np.nonzero(fits)
            new = np.stack([who[c], w, got[c], block["id"][p][j[c]], block["uid"][p][j[c]]], 1)
            held = _top(np.concatenate([held, new]), most)
            key, first, count = np.unique(held[:, 0] * lo.shape[1] + held[:, 1], return_index=True, return_counts=True)
            full = count == most
            rows, windows = np.divmod(key[full], lo.shape[1])
            lo[rows, windows] = np.maximum(lo[rows, windows], held[first[full] + most - 1, 2])
        held[:, 0] += s
        found.append(held)
    return np.concatenate(found)


def _window(a: dict, block: dict, part: np.ndarray, active: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which rows of a part can reach the least wanted score of an active anchor: the runs of rows, ordered by their
    angle to the reference along which they differ most, that lie within the anchor's widest useful angle."""
    t = block["angles"][part]
    if not len(active) or not t.shape[1]:
        return np.ones(len(part), bool)
    r = int(np.argmax(t.max(0) - t.min(0)))
    order = np.argsort(t[:, r], kind="stable")
    reach = a["norm"][active] * block["norm"][part].max()
    least = lo[active].min(1).astype(np.float64)
    useful = np.arccos(np.clip((least - 1 - 1e-9 * reach) / np.maximum(reach, 1e-300), -1, 1)) + SLACK
    useful[least <= 0] = 2 * math.pi
    line = t[order, r].astype(np.float64)
    starts = np.searchsorted(line, a["angles"][active, r] - useful, "left")
    ends = np.searchsorted(line, a["angles"][active, r] + useful, "right")
    marks = np.zeros(len(part) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    out = np.zeros(len(part), bool)
    out[order] = np.cumsum(marks[:-1]) > 0
    return out


def _arrays(table: pa.Table, references: int) -> dict[str, np.ndarray]:
    q = table.column("q").to_pylist()
    angles = table.column("angles").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return {"uid": table.column("uid").to_numpy(), "id": table.column("id").fill_null(_LAST_ID).to_numpy(),
            "label": table.column("label").to_numpy(), "norm": table.column("norm").to_numpy(),
            "q": np.frombuffer(b"".join(q), np.int32).reshape(len(q), -1),
            "angles": angles.astype(np.float64).reshape(len(q), references)}


def windows(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest integer from ``low`` to ``high`` percent of each score, without overflow."""
    whole, rest = np.divmod(scores, 100)
    return low * whole - (-low * rest) // 100, high * whole + (high * rest) // 100


def _searcher(references: int, same: bool, most: int, low: int = 0, high: int = 0):
    ends = np.iinfo(np.int64)

    def run(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy(zero_copy_only=False)
        anchors = _arrays(table.filter(pa.array(query)), references)
        block = _arrays(table.filter(pa.array(~query)), references)
        n = len(anchors["uid"])
        if same:
            lo, hi = np.full((n, 1), ends.min), np.full((n, 1), ends.max)
        else:
            given = table.filter(pa.array(query)).column("scores").to_pylist()
            width = max((len(g) for g in given), default=1)
            scores = np.full((n, width), -1, np.int64)
            for i, g in enumerate(given):
                scores[i, :len(g)] = g
            lo, hi = windows(scores, low, high)
            lo[scores < 0], hi[scores < 0] = ends.max, ends.min
        rows = search(anchors, block, lo, hi, same, most) if n and len(block["uid"]) else np.zeros((0, 5), np.int64)
        return pa.table({"anchor": anchors["uid"][rows[:, 0]], "window": rows[:, 1], "score": rows[:, 2],
                         "id": rows[:, 3], "uid": rows[:, 4]})
    return run


def _searched(pairs: DataFrame, rows: DataFrame, anchors: DataFrame, run) -> DataFrame:
    held = ["uid", "id", "label", "q", "norm", "angles"]
    both = (rows.join(pairs, "block").select("chunk", "block", F.lit(False).alias("query"), *held,
                                             F.lit(None).cast("array<long>").alias("scores"))
            .unionByName(anchors.join(pairs, "chunk")
                         .select("chunk", "block", F.lit(True).alias("query"), *held, "scores")))
    return both.groupBy("chunk", "block").applyInArrow(run, "anchor long, window long, score long, id long, uid long")


def _first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(uid, id, label, vector) of the rows that take part: a label, and a vector of finite numbers."""
    rows = with_uid(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                                   F.col(vector_col).cast("array<double>").alias("vector")))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``. A score is the inner product of ``floor(scale * x)``; an
    anchor's positives are its best other rows of the same label, and its negatives for a positive the best rows of
    other labels with ``low`` to ``high`` percent of the positive's score (none for a positive below zero). Ties go
    by the smaller id, then by place in the input; rows without an id come last among equals and are no anchors.

    Rows with a null label, a null vector or a null or non-finite component take no part. Repeated rows are rows of
    their own: of two equal anchors each is a positive of the other. Vectors of different lengths are compared on
    their common components; an empty vector scores 0 with all. An empty table, or one without anchors, gives an
    empty result. Scores beyond 64 bits are an error. Other columns are not read.
    """
    given = usable(vectors, id_col, vector_col, label_col)
    spark = vectors.sparkSession
    dimensions = given.agg(F.max(F.size("vector"))).head()[0] or 0
    chosen = given.orderBy(F.xxhash64("id"), "uid").limit(REFERENCE_SAMPLE).select("vector").collect()
    sample = np.zeros((len(chosen), dimensions))
    for i, r in enumerate(chosen):
        sample[i, :len(r.vector)] = integers(np.array(r.vector), scale)
    directions = reference_directions(sample)
    count = len(directions)
    prepared = given.mapInArrow(_preparer(directions, dimensions, scale),
                                "uid long, id long, label long, q binary, norm double, angles array<float>, "
                                "nearest int, angle float")
    order = ["label", "nearest", "angle", "uid"]
    rows = in_blocks(prepared, order, BLOCK, "block", "negatives-rows")
    anchors = in_blocks(rows.where(F.col("id") % every == 0).drop("block"), order, CHUNK, "chunk", "negatives-anchors")
    blocks = written(_summary(rows, "block", count, "b_"), "negatives-blocks")
    total = blocks.count()
    if not total:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    down, up = _score_bounds(count)

    same_label = (F.col("c_lo_label") <= F.col("b_hi_label")) & (F.col("b_lo_label") <= F.col("c_hi_label"))
    chunks = _summary(anchors, "chunk", count, "c_")
    found = _searched(_pairs(chunks, blocks, total, same_label), rows, anchors.withColumn("scores", F.lit(None).cast("array<long>")),
                      _searcher(count, True, positives))
    first = written(_first(found, ["anchor"], positives)
                    .select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive"),
                            F.col("score").alias("positive_score")), "negatives-positives")

    scores = first.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))),
                                                     lambda x: x["positive_score"]).alias("scores"))
    asked = anchors.join(scores.withColumnRenamed("anchor", "uid"), "uid")
    best = F.array_max("scores")
    least = F.array_min(F.filter("scores", lambda x: x >= 0))
    chunks = _summary(asked.where(best >= 0), "chunk", count, "c_", F.min(least).alias("least"), F.max(best).alias("best"))
    other_label = ~((F.col("c_lo_label") == F.col("b_hi_label")) & (F.col("b_lo_label") == F.col("c_hi_label")))
    overlap = (up >= F.col("least") * (low / 100) - 1) & (down <= F.col("best") * (high / 100) + 1)
    found = _searched(_pairs(chunks, blocks, total, other_label & overlap), rows, asked,
                      _searcher(count, False, negatives, low, high))
    last = _first(found, ["anchor", "window"], negatives).withColumn("place", (F.col("window") + 1).cast("int"))
    named = anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))

    def known(c):
        return F.when(F.col(c) != _LAST_ID, F.col(c))
    return (last.join(first, ["anchor", "place"]).join(named, "anchor")
            .select("anchor_id", known("positive").alias("positive_id"), "rank", known("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
