"""Exact k-nearest-neighbour self-join within groups, for mixed numeric and nominal features.

The distance is Euclidean over the numeric features plus a fixed squared gap for every nominal mismatch. No row is
compared with its whole group:

1. Rows are ordered by group, nominal values and a space-filling key of their numeric features (the interleaved
   bits of their quantile bins) and cut into blocks of a fixed size, so a dense region is many blocks.
2. Each block is searched by itself. That gives every row k neighbours and with them a radius beyond which nothing
   can be nearer.
3. Blocks, runs of blocks, runs of those and so on are boxes in a tree, with the largest radius in each. Pairs of
   boxes are followed from the top, and only a pair whose boxes are nearer than the radius is opened. A level is one
   join on the pair's parents.
4. Of the pairs of blocks that remain, rows whose own radius reaches the other box are compared with its rows, those of
   a run of ``FAN`` blocks at a time, and the k nearest of all found are kept.

Blocks and runs of them bound what one task holds; nothing is capped, so the result is that of comparing all pairs, whatever the
partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.quality import dense_row_numbers
from riskframe.session import materialize

BLOCK = 1024
#: Boxes joined into one at the next level of the tree.
FAN = 16
#: Bits of the space-filling key, shared by the features, and most bits of one feature.
KEY_BITS, FEATURE_BITS = 60, 8
#: Rows that are compared with a block at once.
SLICE = 256
#: Bounds are narrowed by this share, so that rounding never hides a neighbour.
CARE = 1e-9


def _bins(rows: DataFrame, width: int) -> np.ndarray:
    """Per feature the boundaries of about equally full bins."""
    bits = max(1, min(FEATURE_BITS, KEY_BITS // max(width, 1)))
    cuts = [i / 2 ** bits for i in range(1, 2 ** bits)]
    if not width:
        return np.zeros((0, len(cuts)))
    got = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), cuts, 2000).alias(f"q{i}") for i in range(width)]).head()
    return np.array([list(q) if q else [0.0] * len(cuts) for q in got], float)


def _keys(bins: np.ndarray):
    """A function of Arrow columns: the interleaved bits of each row's bins (features beyond the key's bits are left
    out of the order)."""
    used = bins[:KEY_BITS]
    bits = (bins.shape[1] + 1).bit_length() - 1

    def key(x: pa.Array) -> pa.Array:
        values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        places = [np.searchsorted(b, values[:, i], "right").astype(np.uint64) for i, b in enumerate(used)]
        out = np.zeros(len(x), np.uint64)
        for bit in range(bits - 1, -1, -1):
            for p in places:
                out = out << np.uint64(1) | p >> np.uint64(bit) & np.uint64(1)
        return pa.array(out.astype(np.int64))
    return F.arrow_udf(key, "long")


def _held(table: pa.Table, width: int, nominal: int) -> dict[str, np.ndarray]:
    n = table.num_rows
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, width)
    # one code per text, the same in every nominal feature: codes are only compared within this table
    names = table.column("nominal").combine_chunks().flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return {"x": x, "names": names.reshape(n, nominal), "id": table.column("id").to_numpy()}


def distances(ax: np.ndarray, an: np.ndarray, bx: np.ndarray, bn: np.ndarray, gap: float) -> np.ndarray:
    """Squared distances, summed feature by feature, so that they never depend on how rows are grouped."""
    out = np.zeros((len(ax), len(bx)))
    for i in range(ax.shape[1]):
        out += (ax[:, i, None] - bx[None, :, i]) ** 2
    differ = np.zeros_like(out)
    for j in range(an.shape[1]):
        differ += an[:, j, None] != bn[None, :, j]
    return out + differ * gap * gap


def _nearest(far: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, squared distances and ids of the k smallest per row (infinite ones are none); ties by the smaller id."""
    some = np.isfinite(far)
    if far.shape[1] > k and np.count_nonzero(some) > 4 * k * len(far):  # else all are few enough to sort
        some &= far <= np.partition(far, k - 1, axis=1)[:, k - 1:k]
    i, j = np.nonzero(some)
    order = np.lexsort((ids[j], far[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, i, "left")
    keep = np.arange(len(i)) - first < k
    return i[keep], far[i[keep], j[keep]], ids[j[keep]]


def _within(k: int, width: int, nominal: int):
    """A block searched by itself: its rows with their neighbours in it and their radius."""
    def run(table: pa.Table) -> pa.Table:
        h, gap = _held(table, width, nominal), float(table.column("gap")[0].as_py() or 0.0)
        found, sizes, radius = [], [], []
        for s in range(0, table.num_rows, SLICE):
            far = distances(h["x"][s:s + SLICE], h["names"][s:s + SLICE], h["x"], h["names"], gap)
            far[np.arange(len(far)), np.arange(s, s + len(far))] = np.inf
            i, d, ids = _nearest(far, h["id"], k)
            ends = np.searchsorted(i, np.arange(len(far) + 1))
            full = np.diff(ends) == k
            last = np.full(len(far), np.inf)
            last[full] = d[ends[1:][full] - 1]
            found.append((d, ids))
            sizes.append(np.diff(ends))
            radius.append(last)
        far, ids = (np.concatenate(x) for x in zip(*found))
        near = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int32)),
                                        pa.StructArray.from_arrays([pa.array(far), pa.array(ids)], ["far", "id"]))
        return table.append_column("near", near).append_column("radius", pa.array(np.concatenate(radius)))
    return run


def _across(k: int, width: int, nominal: int):
    """The rows of a run of blocks that reach another block, compared with its rows."""
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        held = _held(table, width, nominal)
        a, b = ({n: v[m] for n, v in held.items()} for m in (asks, ~asks))
        radius = table.column("radius").to_numpy()[asks]
        gap = float(table.column("gap")[0].as_py() or 0.0)
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for s in range(0, len(a["id"]) if len(b["id"]) else 0, SLICE):
            far = distances(a["x"][s:s + SLICE], a["names"][s:s + SLICE], b["x"], b["names"], gap)
            i, d, ids = _nearest(np.where(far <= radius[s:s + SLICE, None], far, np.inf), b["id"], k)
            found.append((a["id"][s + i], d, ids))
        row, far, ids = (np.concatenate(x) for x in zip(*found))
        group = table.column("group")[0].as_py()
        return pa.table({"group": pa.array([group] * len(row), table.schema.field("group").type), "id": row, "far": far, "other": ids})
    return run


def _box(width: int, nominal: int) -> list[Column]:
    return [F.array(*[f(F.get("x", F.lit(i))) for i in range(width)]).cast("array<double>").alias(n)
            for f, n in ((F.min, "lo"), (F.max, "hi"))] + [
        F.array(*[f(F.get("nominal", F.lit(j))) for j in range(nominal)]).cast("array<string>").alias(n)
        for f, n in ((F.min, "least"), (F.max, "most"))]


def _merged(width: int, nominal: int) -> list[Column]:
    return [F.array(*[f(F.get(n, F.lit(i))) for i in range(w)]).cast(t).alias(n)
            for f, n, w, t in ((F.min, "lo", width, "array<double>"), (F.max, "hi", width, "array<double>"),
                               (F.min, "least", nominal, "array<string>"), (F.max, "most", nominal, "array<string>"))]


def _apart(a: str, b: str, gap: Column, width: int, nominal: int) -> Column:
    """Least squared distance of two boxes whose columns end in ``a`` and ``b``."""
    at = lambda name, i: F.get(name, F.lit(i))
    total = F.lit(0.0)
    for i in range(width):
        space = F.greatest(F.lit(0.0), at("lo" + a, i) - at("hi" + b, i), at("lo" + b, i) - at("hi" + a, i))
        total = total + space * space
    for j in range(nominal):
        differ = (at("most" + a, j) < at("least" + b, j)) | (at("most" + b, j) < at("least" + a, j))
        total = total + differ.cast("double") * gap * gap
    return total * (1 - CARE)


def _pairs(blocks: DataFrame, width: int, nominal: int) -> DataFrame:
    """(group, a, b) of the blocks whose boxes lie within a's radius, a and b different, with b's box."""
    levels, top = [blocks], blocks.agg(F.max("node")).head()[0] or 0
    while top > 0:
        top //= FAN
        up = (levels[-1].withColumn("node", F.floor(F.col("node") / FAN).cast("long")).groupBy("group", "node")
              .agg(F.max("radius").alias("radius"), F.first("gap").alias("gap"), *_merged(width, nominal)))
        levels.append(materialize(up, "boxes"))
    box = ["lo", "hi", "least", "most"]
    pairs = levels[-1].select("group", F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        up = F.floor(F.col("node") / FAN).cast("long")
        left = level.select("group", up.alias("a"), F.col("node").alias("a_"), "radius", "gap", *[F.col(c).alias(c + "_a") for c in box])
        right = level.select("group", up.alias("b"), F.col("node").alias("b_"), *[F.col(c).alias(c + "_b") for c in box])
        pairs = (pairs.select("group", "a", "b").join(left, ["group", "a"]).join(right, ["group", "b"])
                 .where(_apart("_a", "_b", F.col("gap"), width, nominal) <= F.col("radius"))
                 .select("group", F.col("a_").alias("a"), F.col("b_").alias("b"), *[F.col(c + "_b") for c in box]))
    if len(levels) == 1:
        return pairs.join(blocks.select("group", F.col("node").alias("b"), *[F.col(c).alias(c + "_b") for c in box]),
                          ["group", "b"]).where("a <> b")
    return pairs.where("a <> b")


def k_nearest(rows: DataFrame, width: int, nominal: int, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(group, id, rank, far, other): for each row the k nearest other rows of its group, with squared distances.

    ``rows`` has group (never null), id (a long, unique in its group), x (an array of ``width`` numbers, none missing),
    nominal (an array of ``nominal`` strings, none missing) and gap (a mismatch's distance, one per group). Ties go to
    the smaller id. A group of at most k rows gives each row all others; a single row has no neighbours.
    """
    order = F.struct("group", "nominal", _keys(_bins(rows, width))(F.col("x")).alias("key"), "id")
    given = dense_row_numbers(rows.select("group", "id", "x", "nominal", "gap").withColumn("order", order), "order", "at")
    given = materialize(given.drop("order"), "neighbour-rows")
    firsts = given.groupBy("group").agg(F.min("at").alias("first"))
    given = given.join(firsts, "group").withColumn("node", F.floor((F.col("at") - F.col("first")) / block).cast("long"))
    given = given.select("group", "node", "id", "x", "nominal", "gap")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    own = materialize(given.groupBy("group", "node").applyInArrow(
        _within(k, width, nominal), fields + ", near array<struct<far: double, id: long>>, radius double"), "neighbour-blocks")
    blocks = materialize(own.groupBy("group", "node").agg(F.max("radius").alias("radius"), F.first("gap").alias("gap"),
                                                          *_box(width, nominal)), "boxes")
    pairs = materialize(_pairs(blocks, width, nominal), "block-pairs")

    point = {"lo_p": "x", "hi_p": "x", "least_p": "nominal", "most_p": "nominal"}
    run = F.floor(F.col("a") / FAN).cast("long").alias("a")  # a block's rows are sent once to a run of blocks that ask
    asking = (own.withColumn("a", F.col("node")).join(pairs, ["group", "a"])
              .withColumns({n: F.col(c) for n, c in point.items()})
              .where(_apart("_p", "_b", F.col("gap"), width, nominal) <= F.col("radius"))
              .select("group", run, "b", F.lit(True).alias("asks"), "id", "x", "nominal", "gap", "radius"))
    asked = (own.withColumn("b", F.col("node")).join(pairs.select("group", run, "b").distinct(), ["group", "b"])
             .select("group", "a", "b", F.lit(False).alias("asks"), "id", "x", "nominal", "gap", "radius"))
    kind = rows.schema["group"].dataType.simpleString()
    found = asking.unionByName(asked).groupBy("group", "a", "b").applyInArrow(
        _across(k, width, nominal), f"group {kind}, id long, far double, other long")
    seen = own.select("group", "id", F.explode("near").alias("n")).select("group", "id", F.col("n.far").alias("far"), F.col("n.id").alias("other"))
    best = Window.partitionBy("group", "id").orderBy("far", "other")
    return (seen.unionByName(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("group", "id", "rank", "far", "other"))
