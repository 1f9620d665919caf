"""Profiling (E1-E19): every statistic comes from one aggregate over the data; outputs are small long tables.

Long layout (feature, statistic...) instead of a transposed wide frame keeps the output schema fixed whatever
the number of profiled columns. Quantiles are exact (linear interpolation, like pandas), from a frequency table and a
distributed prefix sum; ``approx=True`` switches to a sketch whose memory does not grow with the number of distinct
values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.stats import agg_row
from riskframe.session import materialize


def _num(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    if cols:
        return list(cols)
    return [f.name for f in df.schema.fields if f.dataType.typeName() in
            ("double", "float", "integer", "long", "short", "byte")]


def _long(df: DataFrame, row: dict, cols: Sequence[str], stats: Sequence[str], types: dict | None = None) -> DataFrame:
    """Turn ``{stat__col: value}`` into rows (feature, stat1, stat2, ...) via a tiny local DataFrame."""
    spark = df.sparkSession
    recs = [tuple([c] + [row.get(f"{s}__{c}") for s in stats]) for c in cols]
    schema = "feature string, " + ", ".join(f"{s} {(types or {}).get(s, 'double')}" for s in stats)
    return spark.createDataFrame(recs, schema)


def quantile(c, p: float, approx: bool = False) -> Column:
    col = F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    return F.percentile_approx(col, p, 100000) if approx else F.percentile(col, F.lit(p))


def quantiles(c, ps, approx: bool = False) -> Column:
    """Several quantiles of one column from ONE aggregate buffer (array result)."""
    col = F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    arr = F.array(*[F.lit(float(p)) for p in ps])
    return F.percentile_approx(col, arr, 100000) if approx else F.percentile(col, arr)


# ---- E1-E5 --------------------------------------------------------------------------------------------------
def column_means(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean per column (NULLs skipped)."""
    cols = _num(df, cols)
    return _long(df, agg_row(df, {f"mean__{c}": F.avg(c) for c in cols}), cols, ["mean"])


def group_means(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Mean per group for all columns in one grouped aggregate (partial aggregation absorbs skew)."""
    return df.groupBy(group).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def column_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent value per column, smallest on ties."""
    from riskframe.operators.impute import modes
    return _long(df, {f"mode__{c}": v for c, v in modes(df, cols).items()}, cols, ["mode"])


def column_stddevs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Sample standard deviation per column."""
    cols = _num(df, cols)
    return _long(df, agg_row(df, {f"std__{c}": F.stddev_samp(c) for c in cols}), cols, ["std"])


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """E5: NULL total and percent per column (one aggregate), sorted by percent descending."""
    cols = list(cols or df.columns)
    exprs = {f"total__{c}": F.sum(F.col(c).isNull().cast("long")) for c in cols}
    exprs["rows__"] = F.count(F.lit(1))
    row = agg_row(df, exprs)
    n = row.pop("rows__")
    for c in cols:
        row[f"pct__{c}"] = (row[f"total__{c}"] or 0) * 100.0 / n if n else None
    out = _long(df, row, cols, ["total", "pct"], {"total": "long"})
    return out.orderBy(F.desc("pct"), "feature")


# ---- frequency tables: the shared basis of describe / profile -------------------------------------------------
def long_values(df: DataFrame, cols: Sequence[str], group: str | None = None) -> DataFrame:
    """(group, feature, value): one narrow unpivot."""
    keys = [group] if group else []
    wide = df.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return wide.unpivot(keys, list(cols), "feature", "value")


def frequency_table(df: DataFrame, cols: Sequence[str], group: str | None = None) -> DataFrame:
    """(group, feature, value, cnt): a partial/final hash aggregate over the unpivoted table, so its size is the
    number of distinct values per column and no row data is kept in any buffer. NULL values are counted as their own
    row (value NULL)."""
    keys = [group] if group else []
    return long_values(df, cols, group).groupBy(*keys, "feature", "value").agg(F.count(F.lit(1)).alias("cnt"))


def _moments(df: DataFrame, cols: Sequence[str], keys: list[str]) -> DataFrame:
    """count, missing, mean, std, min, max, skewness, kurtosis per (keys, feature): built-in aggregates of the
    unpivoted table in one scan; a task sends one row per feature and group."""
    v = F.col("value")
    varies = F.var_pop(v) > 0
    return long_values(df, cols, keys[0] if keys else None).groupBy(*keys, "feature").agg(
        F.count(v).alias("count"), F.sum(v.isNull().cast("long")).alias("missing"), F.avg(v).alias("mean"),
        F.when(F.count(v) > 1, F.stddev_samp(v)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.when(varies, F.skewness(v)).alias("skewness"), F.when(varies, F.kurtosis(v)).alias("kurtosis"))


def _moments_from_freq(freq: DataFrame) -> DataFrame:
    """count, missing, mean, std, min, max per feature from a frequency table; deviations are taken from the mean, as
    sums of squares alone would cancel."""
    v, n = F.col("value"), F.col("cnt")
    sums = freq.groupBy(F.col("feature").alias("f")).agg(
        F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).alias("count"), F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("missing"),
        F.try_divide(F.sum(v * n), F.sum(F.when(v.isNotNull(), n))).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    spread = freq.join(sums.select(F.col("f").alias("g"), "mean"), F.col("feature") == F.col("g")).groupBy("feature").agg(
        F.sum(F.pow(v - F.col("mean"), 2) * n).alias("squares"))
    std = F.when(F.col("count") > 1, F.sqrt(F.col("squares") / (F.col("count") - 1)))
    return sums.join(spread, F.col("f") == F.col("feature")).select("feature", "count", "missing", "mean", std.alias("std"), "min", "max")


def _quantiles_from_freq(freq: DataFrame, ps: Sequence[float],
                         totals: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles (pandas / ``percentile`` semantics) per feature from a frequency
    table: running counts in (feature, value) order, then the value whose count interval holds each needed rank. The
    running counts are a distributed prefix sum (range partitioning + per-partition offsets), so a feature's values
    are never one task's, however many there are."""
    from riskframe.operators.ordered import running_totals
    nn = freq.filter(F.col("value").isNotNull())
    if totals is None:
        totals = {r["feature"]: r["n"] for r in nn.groupBy("feature").agg(F.sum("cnt").alias("n")).collect()}
    feats = sorted(totals)
    offsets, run = {}, 0
    for f in feats:
        offsets[f] = run
        run += totals[f]
    fidx = F.lit(None).cast("int")
    off = F.lit(None).cast("double")
    for i, f in enumerate(feats):
        fidx = F.when(F.col("feature") == F.lit(f), F.lit(i)).otherwise(fidx)
        off = F.when(F.col("feature") == F.lit(f), F.lit(float(offsets[f]))).otherwise(off)
    cum = running_totals(nn.withColumn("fidx", fidx), ["fidx", "value"], ["cnt"])
    cum = cum.withColumn("within", F.col("cum_cnt") - off)
    need = {}
    for f in feats:
        n = totals[f]
        for p in ps:
            pos = p * (n - 1)
            need[(f, p)] = (pos, int(pos // 1), int(-(-pos // 1)))
    # each needed rank falls inside exactly one (value, cnt) row: [within - cnt, within); a literal map
    # feature -> ranks lets every row test its few candidate ranks locally (no join, no wide aggregate)
    ranks = {f: sorted({r for (g, _), (_, lo, hi) in need.items() if g == f for r in (lo, hi)}) for f in feats}
    rmap = F.create_map(*[x for f in feats for x in (F.lit(f), F.array(*[F.lit(float(r)) for r in ranks[f]]))])
    lo_edge = F.col("within") - F.col("cnt")
    hits = cum.select("feature", "value", F.explode(F.filter(F.element_at(rmap, F.col("feature")),
                                                             lambda r: (r >= lo_edge) & (r < F.col("within"))))
                      .alias("rank")).collect()
    at = {(h["feature"], int(h["rank"])): h["value"] for h in hits}
    row = {}
    for (f, p), (_, lo, hi) in need.items():
        row[f"lo|{f}|{p}"], row[f"hi|{f}|{p}"] = at.get((f, lo)), at.get((f, hi))
    out: dict[str, list[float | None]] = {}
    for f in feats:
        vals = []
        for p in ps:
            pos, lo, hi = need[(f, p)]
            a, b = row[f"lo|{f}|{p}"], row[f"hi|{f}|{p}"]
            vals.append(None if a is None else a + (pos - lo) * (b - a))
        out[f] = vals
    return out


# ---- E6 describe ---------------------------------------------------------------------------------------------
DESCRIBE_STATS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max", "missing")


def describe(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Count, mean, std, min, quartiles, max, missing fraction and dtype per column. One scan makes the frequency
    table, which is written; everything else is read off it, the exact quartiles by a distributed prefix sum.
    ``approx=True`` takes one aggregate of the rows and the quartiles from a sketch, without the frequency table."""
    cols = _num(df, cols)
    spark = df.sparkSession
    dtypes = dict(df.dtypes)
    freq = None if approx else materialize(frequency_table(df, cols), "frequencies")
    mom = {r["feature"]: r.asDict() for r in (_moments(df, cols, []) if approx else _moments_from_freq(freq)).collect()}
    if approx:
        row = agg_row(df, {c: quantiles(c, (0.25, 0.5, 0.75), True) for c in cols})
        qs = {c: list(row[c] or [None] * 3) for c in cols}
    else:
        qs = _quantiles_from_freq(freq, (0.25, 0.5, 0.75),
                                  {c: m["count"] for c, m in mom.items() if m["count"]})
    recs = []
    for c in cols:
        m = mom.get(c, {})
        n = (m.get("count") or 0) + (m.get("missing") or 0)
        q3 = qs.get(c, [None, None, None])
        recs.append((c, m.get("count", 0), m.get("mean"), m.get("std"), m.get("min"), q3[0], q3[1], q3[2],
                     m.get("max"), (m.get("missing") or 0) / n if n else None, dtypes[c]))
    return spark.createDataFrame(recs, "feature string, count long, mean double, std double, min double, p25 double, "
                                       "p50 double, p75 double, max double, missing double, dtype string")


# ---- E7 / E8 correlation ------------------------------------------------------------------------------------
def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The full pairwise-complete Pearson matrix in long form (feature_a, feature_b, corr); a zero-variance
    column gives NULL. One mean aggregate + one pass of per-partition moment matrices (see ``gram``)."""
    from riskframe.operators.gram import correlation_matrix as cm
    recs = [(a, b, None if r is None else float(r)) for a, b, r in cm(df, cols)]
    return df.sparkSession.createDataFrame(recs, "feature_a string, feature_b string, corr double")


def correlation_with(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Correlation of every feature with one target (same moment pass, k+1 columns)."""
    from riskframe.operators.gram import correlation_matrix as cm
    allc = [*cols, target]
    recs = [(a, None if r is None else float(r)) for a, b, r in cm(df, allc) if b == target and a != target]
    return df.sparkSession.createDataFrame(recs, "feature string, corr double")


# ---- E9 / E10 counts ----------------------------------------------------------------------------------------
def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value (NULL counted as its own value), most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)


def category_share(df: DataFrame, col: str) -> DataFrame:
    """Share of each category in percent, 1 decimal, of the number of rows."""
    total = df.count()
    pct = F.col("count") * F.lit(100.0) / F.lit(total)
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("pct", F.round(pct * F.lit(10.0), 0) / F.lit(10.0))


# ---- E11 / E12 / E18 histograms -----------------------------------------------------------------------------
def _bin_index(x: Column, lo: Column, hi: Column, nbins: Column) -> Column:
    """0-based equal-width bin; the last bin is closed on the right; a zero range puts everything in bin 0."""
    width = (hi - lo) / nbins.cast("double")
    raw = F.floor((x - lo) / width).cast("long")
    return F.when(hi == lo, F.lit(0).cast("long")).otherwise(F.least(raw, (nbins - 1).cast("long")))


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """Equal-width histogram with empty bins present: (bin, lower, upper, count)."""
    s = agg_row(df, {"lo": F.min(F.col(col).cast("double")), "hi": F.max(F.col(col).cast("double"))})
    spark = df.sparkSession
    if s["lo"] is None:
        return spark.createDataFrame([], "bin long, lower double, upper double, count long")
    lo, hi = F.lit(s["lo"]), F.lit(s["hi"])
    counts = (df.filter(F.col(col).isNotNull())
              .select(_bin_index(F.col(col).cast("double"), lo, hi, F.lit(bins)).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    width = (s["hi"] - s["lo"]) / bins
    edges = spark.range(bins).select(F.col("id").alias("bin"),
                                     (lo + F.col("id") * F.lit(width)).alias("lower"),
                                     (lo + (F.col("id") + 1) * F.lit(width)).alias("upper"))
    return (edges.join(F.broadcast(counts), "bin", "left")
            .select("bin", "lower", "upper", F.coalesce("count", F.lit(0).cast("long")).alias("count")))


def auto_histogram_by_group(df: DataFrame, col: str, group: str) -> DataFrame:
    """Per group, the bin count from one grouped aggregate (n, min, max) and its quartiles, then the histogram.

    The groups' figures are a table that is joined, so any number of groups will do: exact quartiles come from a
    prefix sum over (group, value) counts, ranked within the group by the groups' offsets."""
    from riskframe.operators.ordered import running_totals
    rows = df.select(F.col(group).alias("g"), F.col(col).cast("double").alias("x")).filter("g is not null and x is not null")
    freq = rows.groupBy("g", "x").agg(F.count(F.lit(1)).alias("cnt"))
    cum = running_totals(freq, ["g", "x"], ["cnt"])
    cum = materialize(cum.withColumn("upto", F.col("cum_cnt")), "group-ranks")
    figures = cum.groupBy("g").agg(F.sum("cnt").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                                   F.min(F.col("upto") - F.col("cnt")).alias("first"))
    ranked = cum.join(figures, "g")
    rank = lambda p, up: F.when(F.lit(up), F.ceil(F.lit(p) * (F.col("n") - 1))).otherwise(
        F.floor(F.lit(p) * (F.col("n") - 1)))
    at = lambda p, up: F.max(F.when((F.col("upto") - F.col("cnt") - F.col("first") <= rank(p, up))
                                    & (rank(p, up) < F.col("upto") - F.col("first")), F.col("x")))
    per = ranked.groupBy("g", "n", "lo", "hi").agg(
        at(0.25, False).alias("a25"), at(0.25, True).alias("b25"), at(0.75, False).alias("a75"), at(0.75, True).alias("b75"))
    part = lambda p: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
    q25 = F.col("a25") + part(0.25) * (F.col("b25") - F.col("a25"))
    q75 = F.col("a75") + part(0.75) * (F.col("b75") - F.col("a75"))
    span = F.col("hi") - F.col("lo")
    # numpy bins='auto': the smaller of the Sturges and the Freedman-Diaconis widths (the latter only if it is positive)
    sturges = span / (F.log2("n") + 1.0)
    narrow = 2.0 * (q75 - q25) * F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3.0))
    width = F.when(narrow > 0, F.least(narrow, sturges)).otherwise(sturges)
    bins = F.when(span == 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(span / width)))
    per = materialize(per.select("g", "lo", "hi", bins.cast("int").alias("nbins")), "group-bins")
    counts = rows.join(per, "g").select("g", _bin_index(F.col("x"), F.col("lo"), F.col("hi"), F.col("nbins")).alias("bin")
                                        ).groupBy("g", "bin").agg(F.count(F.lit(1)).alias("count"))
    step = (F.col("hi") - F.col("lo")) / F.col("nbins")
    edges = per.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nbins").cast("long") - 1))).select(
        "g", "bin", (F.col("lo") + F.col("bin") * step).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("upper"), "nbins")
    return edges.join(counts, ["g", "bin"], "left").select(
        F.col("g").alias(group), "bin", "lower", "upper", "nbins",
        F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def binned_scatter(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """2-D equal-width binned counts of (x, y) pairs; output size bounded by bins^2."""
    s = agg_row(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()),
                {"xlo": F.min(F.col(x).cast("double")), "xhi": F.max(F.col(x).cast("double")),
                 "ylo": F.min(F.col(y).cast("double")), "yhi": F.max(F.col(y).cast("double"))})
    xb = _bin_index(F.col(x).cast("double"), F.lit(s["xlo"]), F.lit(s["xhi"]), F.lit(bins))
    yb = _bin_index(F.col(y).cast("double"), F.lit(s["ylo"]), F.lit(s["yhi"]), F.lit(bins))
    return (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
            .select(xb.alias("x_bin"), yb.alias("y_bin"))
            .groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count")))


# ---- E13 box plot --------------------------------------------------------------------------------------------
def box_stats(df: DataFrame, col: str, all_cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme values inside the fences) and outlier count.

    If the feature has NULLs, rows with a NULL in any of ``all_cols`` are dropped first (reference behaviour).
    Two aggregates: quartiles, then whiskers/outliers with the fences inlined.
    """
    has_null = agg_row(df, {"n": F.sum(F.col(col).isNull().cast("long"))})["n"] or 0
    data = df.dropna("any", subset=list(all_cols or df.columns)) if has_null else df
    x = F.col(col).cast("double")
    if approx:
        q = agg_row(data, {"q1": quantile(col, 0.25, True), "q2": quantile(col, 0.5, True),
                           "q3": quantile(col, 0.75, True)})
    else:
        q1, q2, q3 = _quantiles_from_freq(frequency_table(data, [col]), (0.25, 0.5, 0.75)).get(col, [None] * 3)
        q = {"q1": q1, "q2": q2, "q3": q3}
    if q["q1"] is None:
        return df.sparkSession.createDataFrame([], "feature string, q1 double, median double, q3 double, iqr double, "
                                                   "whisker_low double, whisker_high double, outliers long")
    iqr = q["q3"] - q["q1"]
    lo_f, hi_f = q["q1"] - 1.5 * iqr, q["q3"] + 1.5 * iqr
    w = agg_row(data, {"wl": F.min(F.when(x >= F.lit(lo_f), x)), "wh": F.max(F.when(x <= F.lit(hi_f), x)),
                       "out": F.sum(((x < F.lit(lo_f)) | (x > F.lit(hi_f))).cast("long"))})
    return df.sparkSession.createDataFrame(
        [(col, q["q1"], q["q2"], q["q3"], iqr, w["wl"], w["wh"], int(w["out"] or 0))],
        "feature string, q1 double, median double, q3 double, iqr double, whisker_low double, whisker_high double, "
        "outliers long")


# ---- E14 / E15 profile ---------------------------------------------------------------------------------------
PROFILE_STATS = ("count", "missing", "distinct", "mean", "std", "min", "max", "skewness", "kurtosis", "top")


def profile(df: DataFrame, cols: Sequence[str] | None = None, group: str | None = None,
            stage: str | None = None) -> DataFrame:
    """E14 (and E15 with ``group``): per column count, missing, distinct, moments (population skewness and
    excess kurtosis), min/max and the most frequent value (the smallest on ties). The moments are one aggregate of the
    unpivoted table, distinct counts and modes one of its frequency table. ``stage`` tags the rows (e.g. 'pre' /
    'post' cleaning)."""
    cols = _num(df, cols)
    keys = [group] if group else []
    freq = frequency_table(df, cols, group)
    v = F.col("value")
    modes = freq.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("feature").alias("__feature")).agg(
        F.count(v).alias("distinct"),
        F.min(F.when(v.isNotNull(), F.struct((-F.col("cnt")).alias("n"), v.alias("v")))).getField("v").alias("top"))
    same = F.col("feature") == F.col("__feature")
    for k in keys:  # group keys may be NULL (rows without a gender)
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = _moments(df, cols, keys).join(modes, same).select(*keys, "feature", *PROFILE_STATS)
    if stage is not None:
        out = out.withColumn("stage", F.lit(stage))
    return out


# ---- E16 / E17 / E19 -----------------------------------------------------------------------------------------
def shape(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Rows, columns and (given the input) rows removed."""
    n = df.count()
    removed = before.count() - n if before is not None else None
    return df.sparkSession.createDataFrame([(n, len(df.columns), removed)], "rows long, columns int, removed long")


def dtypes_frame(df: DataFrame) -> DataFrame:
    """Column dtype listing."""
    return df.sparkSession.createDataFrame(df.dtypes, "feature string, dtype string")


def scatter_index(pred: DataFrame, label: str, prediction: str, train: DataFrame) -> float:
    """Rmse on ``pred`` divided by the mean label of ``train``."""
    rmse = agg_row(pred, {"r": F.sqrt(F.avg(F.pow(F.col(label) - F.col(prediction), 2)))})["r"]
    mean = agg_row(train, {"m": F.avg(label)})["m"]
    return rmse / mean if rmse is not None and mean else None
