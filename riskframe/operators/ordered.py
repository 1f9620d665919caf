"""Order-dependent operators without a single-partition window.

``running_totals`` computes cumulative sums in a global order the way a distributed prefix sum does:
range-partition + local sort (Spark's distributed sort), one small aggregate of per-partition totals (one row per
partition) whose prefix gives each partition's offset, then a per-partition pass that adds the offset to the
local running sum. The per-partition pass is ``mapInPandas`` because a running sum that continues across Arrow
batches needs carried state - a window would either shuffle again or put everything in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.session import input_partitions, materialize


def running_totals(df: DataFrame, order_cols: Sequence[str], value_cols: Sequence[str], ascending: bool = True,
                   prefix: str = "cum_", num_partitions: int | None = None) -> DataFrame:
    """Add ``cum_<v>`` = sum of ``v`` over all rows up to and including this one in ``order_cols`` order.

    ``order_cols`` must identify rows uniquely (ties would make the running sum order-dependent).
    """
    n = num_partitions or input_partitions(df)
    keys = [F.col(c).asc() if ascending else F.col(c).desc() for c in order_cols]
    ranged = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys), columnar=False)
    ranged = ranged.withColumn("__pid", F.spark_partition_id())
    totals = {r["__pid"]: r for r in ranged.groupBy("__pid").agg(
        *[F.sum(F.col(v).cast("double")).alias(v) for v in value_cols]).collect()}
    offsets: dict[int, list[float]] = {}
    run = [0.0] * len(value_cols)
    for pid in sorted(totals):
        offsets[pid] = list(run)
        run = [a + (totals[pid][v] or 0.0) for a, v in zip(run, value_cols)]
    out_fields = [*ranged.schema.fields, *[T.StructField(prefix + v, T.DoubleType()) for v in value_cols]]
    schema = T.StructType(out_fields)
    vals = list(value_cols)

    def local(batches):
        carried = None
        for pdf in batches:
            if pdf.empty:
                continue
            if carried is None:
                carried = list(offsets.get(int(pdf["__pid"].iloc[0]), [0.0] * len(vals)))
            for i, v in enumerate(vals):
                cs = pd.to_numeric(pdf[v], errors="coerce").fillna(0.0).astype("float64").cumsum() + carried[i]
                pdf[prefix + v] = cs
                carried[i] = float(cs.iloc[-1])
            yield pdf

    return ranged.mapInPandas(local, schema).drop("__pid")
