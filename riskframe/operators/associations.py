"""Associations between columns of any kind, and the most frequent values of a column.

One contingency aggregate serves every pair: a row is dealt to a cell per pair of columns (the two values for nominal
columns, the one value for a nominal and a numeric column, nothing for two numeric ones), and a cell carries a count
and the sums of the numeric sides. Tasks combine cells before they are sent, so what moves is the number of distinct
cells and not of rows. All measures are then sums over cells:

- two nominal columns: Theil's uncertainty coefficient, the share of a's entropy that b explains (not symmetric)
- a nominal and a numeric column: the correlation ratio, the square root of the share of variance between categories
- two numeric columns: Pearson's correlation
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.stats import agg_row
from riskframe.session import materialize

UNCERTAINTY, RATIO, PEARSON = "uncertainty", "correlation_ratio", "pearson"


def _number(name: str) -> Column:
    """NaN is missing, as in the other profiles' inputs."""
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x), x)


def contingency(df: DataFrame, nominal: Sequence[str], numeric: Sequence[str], group: str | None = None) -> DataFrame:
    """(group, a, b, kind, va, vb, n, sx, sxx, sy, syy, sxy): the cells of all pairs, pairwise complete. Numeric sides
    are taken less their column's mean, which keeps the sums exact enough; x is the numeric side of a mixed pair."""
    means = agg_row(df, {c: F.avg(_number(c)) for c in numeric}) if numeric else {}
    centred = {c: _number(c) - F.lit(means[c] or 0.0) for c in numeric}
    text = {c: F.col(f"`{c}`").cast("string") for c in nominal}
    none, zero = F.lit(None).cast("string"), F.lit(0.0)

    def cell(a, b, kind, va, vb, x, y, there):
        return F.when(there, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(kind).alias("kind"), va.alias("va"),
                                      vb.alias("vb"), x.alias("x"), y.alias("y")))
    cells = [cell(a, b, UNCERTAINTY, text[a], text[b], zero, zero, text[a].isNotNull() & text[b].isNotNull())
             for a, b in combinations(nominal, 2)]
    cells += [cell(a, b, RATIO, text[a], none, centred[b], zero, text[a].isNotNull() & centred[b].isNotNull())
              for a in nominal for b in numeric]
    cells += [cell(a, b, PEARSON, none, none, centred[a], centred[b], centred[a].isNotNull() & centred[b].isNotNull())
              for a, b in combinations(numeric, 2)]
    keys = [F.col(f"`{group}`").alias("__group")] if group else [F.lit(None).cast("string").alias("__group")]
    long = df.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("c")).select("__group", "c.*")
    x, y = F.col("x"), F.col("y")
    return long.groupBy("__group", "a", "b", "kind", "va", "vb").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(y).alias("sy"),
        F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))


def _entropy_part(n: str = "n") -> Column:
    return F.col(n) * F.log(F.col(n).cast("double"))


def associations(df: DataFrame, nominal: Sequence[str], numeric: Sequence[str], group: str | None = None) -> DataFrame:
    """([group,] feature_a, feature_b, measure, value, n): a row for each ordered pair of different columns, n its rows
    without a missing value on either side.

    The uncertainty coefficient is of a given b, and 1 where a has one value only; the correlation ratio is 0 for a
    constant number; Pearson's correlation of a constant is NULL. A pair without a complete row is left out. Rows
    without a group form one of their own.
    """
    nominal, numeric = list(nominal), list(numeric)
    if len(set(nominal) | set(numeric)) < len(nominal) + len(numeric):
        raise ValueError("a column is either nominal or numeric, and listed once")
    keys = ["__group", "a", "b"]
    if len(nominal) + len(numeric) < 2:
        cells = df.sparkSession.createDataFrame([], "a string, b string, kind string, value double, n long")
        kind = df.schema[group].dataType.simpleString() if group else "string"
        found = cells.select(F.lit(None).cast(kind).alias("__group"), F.col("a").alias("feature_a"), F.col("b").alias("feature_b"),
                             F.col("kind").alias("measure"), "value", "n")
        return _shaped(found, group)
    cells = materialize(contingency(df, nominal, numeric, group), "contingency")
    two = cells.where(F.col("kind") == UNCERTAINTY)
    # sums of n log n over cells and over either side's values; entropies are differences of them
    parts = [two.groupBy(*keys).agg(F.sum(_entropy_part()).alias("both"), F.sum("n").alias("n"), F.lit(None).cast("double").alias("one"),
                                    F.lit(None).cast("double").alias("other"))]
    for side, name in (("va", "one"), ("vb", "other")):
        whole = two.groupBy(*keys, side).agg(F.sum("n").alias("n"))
        empty = {c: F.lit(None).cast(t).alias(c) for c, t in (("both", "double"), ("n", "long"), ("one", "double"), ("other", "double"))}
        parts.append(whole.groupBy(*keys).agg(F.sum(_entropy_part()).alias("s")).select(
            *keys, *[F.col("s").alias(name) if c == name else empty[c] for c in empty]))
    sums = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("both", "n", "one", "other")])
    log_n = F.log(F.col("n").cast("double"))
    own = {"a": log_n - F.col("one") / F.col("n"), "b": log_n - F.col("other") / F.col("n")}
    given = {"a": (F.col("other") - F.col("both")) / F.col("n"), "b": (F.col("one") - F.col("both")) / F.col("n")}
    tiny = F.lit(1e-12)
    explained = {s: F.when(own[s] <= tiny, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (own[s] - given[s]) / own[s])) for s in "ab"}
    out = [sums.select("__group", F.col(x).alias("feature_a"), F.col(y).alias("feature_b"), F.lit(UNCERTAINTY).alias("measure"),
                       explained[x].alias("value"), "n") for x, y in (("a", "b"), ("b", "a"))]

    mixed = cells.where(F.col("kind") == RATIO).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("sx").alias("s"), F.sum("sxx").alias("ss"), F.sum(F.col("sx") * F.col("sx") / F.col("n")).alias("between"))
    centre = F.col("s") * F.col("s") / F.col("n")
    total = F.col("ss") - centre
    share = F.when(total <= 1e-12 * F.col("ss"), F.lit(0.0)).otherwise(
        F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("between") - centre) / total))))
    pairs = cells.where(F.col("kind") == PEARSON)
    n = F.col("n").cast("double")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    r = F.when((vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy")), (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
    for table, measure, value in ((mixed, RATIO, share), (pairs, PEARSON, r)):
        out += [table.select("__group", F.col(x).alias("feature_a"), F.col(y).alias("feature_b"), F.lit(measure).alias("measure"),
                             value.alias("value"), "n") for x, y in (("a", "b"), ("b", "a"))]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return _shaped(found, group)


def _shaped(found: DataFrame, group: str | None) -> DataFrame:
    return found.withColumnRenamed("__group", group) if group else found.drop("__group")


def top_values(df: DataFrame, cols: Sequence[str], n: int = 5, group: str | None = None) -> DataFrame:
    """([group,] feature, rank, value, count, share): the n most frequent values of each column as text, the smaller
    text first on ties; share is of the rows that have a value."""
    keys = ["__group", "feature"]
    wide = df.select(F.col(f"`{group}`").alias("__group") if group else F.lit(None).cast("string").alias("__group"),
                     *[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    counts = (wide.unpivot(["__group"], [f"`{c}`" for c in cols], "feature", "value").where("value IS NOT NULL")
              .groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("count")))
    counts = materialize(counts, "value-counts")
    totals = counts.groupBy(F.col("__group").alias("g"), F.col("feature").alias("f")).agg(F.sum("count").alias("total"))
    best = Window.partitionBy(*keys).orderBy(F.desc("count"), "value")
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    same = F.col("__group").eqNullSafe(F.col("g")) & (F.col("feature") == F.col("f"))
    found = top.join(totals, same).select("__group", "feature", "rank", "value", "count",
                                          (F.col("count") / F.col("total").cast("double")).alias("share"))
    return _shaped(found, group)
