"""H6: SMOTE-NC oversampling of minority classes to parity, without an all-pairs neighbour search.

Neighbours are the exact k nearest rows of the class by the SMOTE-NC distance: Euclidean over the numeric features
plus, for every nominal mismatch, the square of the median of the class's numeric standard deviations
(``neighbours.k_nearest``, which searches blocks of rows and only the blocks within a row's reach).

The number of synthetic rows per seed row is exact: with deficit d and m rows of the class every row makes d // m
and the first d % m one more, so the class reaches parity exactly. Synthetic numeric values interpolate towards a
neighbour chosen by a hash; nominal values are the majority vote of the k neighbours (smallest value on ties).
Per-class figures are a joined table, neighbours an array per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.neighbours import k_nearest
from riskframe.operators.quality import dense_row_numbers
from riskframe.session import materialize


def _class_figures(df: DataFrame, label: str, numeric: Sequence[str]) -> DataFrame:
    """Per class with a deficit: rows, deficit, means of the numeric features, median of their deviations."""
    sizes = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("__class")).agg(
        F.count(F.lit(1)).alias("__n"),
        F.array(*[F.avg(F.col(c).cast("double")) for c in numeric]).alias("__means"),
        F.array_sort(F.array_compact(F.array(*[F.stddev_pop(F.col(c).cast("double")) for c in numeric]))).alias("__stds"))
    top = sizes.agg(F.max("__n")).head()[0] or 0
    middle = F.size("__stds") / 2
    median = (F.get("__stds", F.floor(middle - 0.5).cast("int")) + F.get("__stds", F.floor(middle).cast("int"))) / 2
    return sizes.withColumns({"__deficit": F.lit(top) - F.col("__n"), "__gap": F.coalesce(median, F.lit(0.0))}).filter(
        F.col("__deficit") > 0).drop("__stds")


def _unit(*parts: Column) -> Column:
    """A hash as a number from 0 to 1 (never 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 32)) / F.lit(float(1 << 32))


def class_rows(df: DataFrame, label: str, id_col: str, numeric: Sequence[str], nominal: Sequence[str] = ()) -> DataFrame:
    """The rows of the classes that need synthetic ones, numbered within their class (``__at``), with the numeric
    features (``__x``, a missing value counts as its class's mean) and the nominal ones as text (``__named``)."""
    cols = list(dict.fromkeys([id_col, label, *numeric, *nominal]))
    rows = df.select(*cols).join(_class_figures(df, label, numeric), F.col(label) == F.col("__class"))
    x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.get("__means", F.lit(i)), F.lit(0.0))
         for i, c in enumerate(numeric)]
    # a missing nominal value is a value of its own
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in nominal]
    rows = rows.withColumns({"__x": F.array(*x).cast("array<double>"), "__named": F.array(*named).cast("array<string>")})
    order = F.struct(F.col("__class"), F.col(id_col).alias("id"), F.xxhash64(*cols).alias("row"))
    rows = materialize(dense_row_numbers(rows.withColumn("__order", order), "__order", "__rn"), "smote-rows")
    firsts = rows.groupBy("__class").agg(F.min("__rn").alias("__first"))
    return rows.join(firsts, "__class").withColumn("__at", F.col("__rn") - F.col("__first")).drop("__order", "__first", "__rn")


def class_neighbours(rows: DataFrame, numeric: Sequence[str], nominal: Sequence[str] = (), k: int = 5) -> DataFrame:
    """(group, id, rank, far, other): the k nearest rows of its class for each row of ``class_rows``, by ``__at``."""
    given = rows.select(F.col("__class").alias("group"), F.col("__at").alias("id"), F.col("__x").alias("x"),
                        F.col("__named").alias("nominal"), F.col("__gap").alias("gap"))
    return k_nearest(given, len(numeric), len(nominal), k)


def smote_nc(df: DataFrame, label: str, id_col: str, numeric: Sequence[str], nominal: Sequence[str] = (),
             k: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with a column ``synthetic`` (0), and the synthetic rows (1, 2, ... per seed row). Rows without a label
    are kept and take no part. A missing numeric value counts as its class's mean; the only row of a class is its own
    neighbour."""
    numeric, nominal = list(numeric), list(nominal)
    rows = class_rows(df, label, id_col, numeric, nominal)
    features = [F.col("__x").alias("x"), *[F.col(c).alias(f"n{i}") for i, c in enumerate(nominal)]]
    to = rows.select(F.col("__class").alias("group"), F.col("__at").alias("other"), *features)
    near = (class_neighbours(rows, numeric, nominal, k).join(to, ["group", "other"])
            .groupBy(F.col("group").alias("__class"), F.col("id").alias("__at"))
            .agg(F.array_sort(F.collect_list(F.struct("rank", "x", *[f"n{i}" for i in range(len(nominal))]))).alias("__near")))
    itself = F.array(F.struct(F.lit(1).alias("rank"), *features))
    seen = rows.join(near, ["__class", "__at"], "left").withColumn("__near", F.coalesce("__near", itself))
    copies = F.floor(F.col("__deficit") / F.col("__n")) + (F.col("__at") < F.col("__deficit") % F.col("__n")).cast("long")
    made = seen.withColumn("__copies", copies).filter(F.col("__copies") > 0).withColumn(
        "synthetic", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    chance = lambda what: _unit(F.col(id_col), F.col("__at"), F.col("synthetic"), F.lit(seed), F.lit(what))
    chosen = F.get("__near", F.floor(chance("neighbour") * F.size("__near")).cast("int"))
    made = made.withColumns({"__to": chosen["x"], "__step": chance("step")})

    types = dict(df.dtypes)

    def mixed(i: int, c: str) -> Column:
        x = F.get("__x", F.lit(i)) + F.col("__step") * (F.get("__to", F.lit(i)) - F.get("__x", F.lit(i)))
        return (F.round(x) if types[c] in ("int", "bigint", "smallint", "tinyint") else x).cast(types[c]).alias(c)

    def voted(i: int, c: str) -> Column:
        votes = F.array_compact(F.transform("__near", lambda o: o[f"n{i}"]))
        counts = F.transform(F.array_distinct(votes), lambda v: F.struct(
            (-F.size(F.filter(votes, lambda u: u == v))).alias("n"), v.alias("v")))
        return F.get(F.sort_array(counts), F.lit(0))["v"].alias(c)

    synthetic = made.select(id_col, label, *[mixed(i, c) for i, c in enumerate(numeric)],
                            *[voted(i, c) for i, c in enumerate(nominal)], "synthetic")
    return df.withColumn("synthetic", F.lit(0)).unionByName(synthetic, allowMissingColumns=True)
