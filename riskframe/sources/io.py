"""Scans and sinks (A1-A9): CSV with explicit schemas, multi-file globs, merged source families, CSV/Parquet
sinks, metric reports, fitted model persistence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.sources import contract


def _nan_to_null(df: DataFrame) -> DataFrame:
    """pandas reads 'NaN' as missing; Spark keeps NaN (which compares greater than everything): normalise."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    q = {c: F.col(f"`{c}`") for c in cols}
    return df.withColumns({c: F.when(F.isnan(q[c]), F.lit(None).cast("double")).otherwise(q[c]) for c in cols})


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, header: bool = True,
             with_row_seq: bool = False, with_source: bool = False) -> DataFrame:
    """CSV scan; blank fields are NULL. With an explicit schema (the contract) the columns are picked by the
    names in each file's header, whatever their order; a value that can't be read is NULL and every row stays
    (``contract.scan`` keeps such rows apart). Otherwise types are inferred per header. ``with_row_seq`` adds a
    file-order key, ``with_source`` the file."""
    paths = [path] if isinstance(path, str) else list(path)
    if schema is not None and header:
        return _nan_to_null(contract.scan(spark, paths, schema, keep_broken=True, with_row_seq=with_row_seq,
                                          with_source=with_source).rows)
    if header:
        groups = list(contract.file_headers(spark, paths).values()) or [paths]
    else:
        groups = [paths]
    r = spark.read.option("header", header).option("mode", "PERMISSIVE")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    parts = []
    for files in groups:
        df = _nan_to_null(r.csv(files))
        df = df.withColumn("source_file", F.col("_metadata.file_path")) if with_source else df
        parts.append(add_row_seq(df) if with_row_seq else df)
    return reduce(_stacked, parts)


def _stacked(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name, missing columns NULL. Where the inferred types differ, whole numbers become doubles beside
    doubles, and anything else text."""
    left, right = {f.name: f.dataType for f in a.schema}, {f.name: f.dataType for f in b.schema}
    for c in left.keys() & right.keys():
        if left[c] != right[c]:
            numbers = all(isinstance(t, T.NumericType) for t in (left[c], right[c]))
            whole = all(isinstance(t, (T.IntegerType, T.LongType)) for t in (left[c], right[c]))
            to = "long" if whole else "double" if numbers else "string"
            a, b = (d.withColumn(c, F.col(f"`{c}`").cast(to)) for d in (a, b))
    return a.unionByName(b, allowMissingColumns=True)


def add_row_seq(df: DataFrame) -> DataFrame:
    """A file-order key (file path, split offset, position) for order-dependent steps such as 'first row per id'.
    ``monotonically_increasing_id`` alone is not file order, because file splits are packed into partitions by
    size; within one split it does increase in file order."""
    return df.withColumn("row_seq", F.struct(F.col("_metadata.file_path").alias("file"),
                                             F.col("_metadata.file_block_start").alias("block"),
                                             F.monotonically_increasing_id().alias("pos")))


def read_csv_glob(spark: SparkSession, pattern: str | Sequence[str], schema=None) -> DataFrame:
    """A2: many files (a glob or a list), stacked by column name, with the source file of each row."""
    return read_csv(spark, pattern, schema, with_source=True)


def merge_sources(frames: Mapping[str, DataFrame], source_col: str = "source") -> DataFrame:
    """A3: union by name of differently shaped source families; missing columns are NULL; each row is tagged."""
    tagged = [df.withColumn(source_col, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def write_csv(df: DataFrame, path: str, index_col: str | None = None, single_file: bool = False) -> str:
    """A4 (no index) / A5 (with an explicit row index column, which must already exist in ``df``)."""
    out = df
    if index_col is not None:
        out = df.select(F.col(f"`{index_col}`"), *[F.col(f"`{c}`") for c in df.columns if c != index_col])
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_extracts(merged: DataFrame, base: str, source_col: str = "source") -> dict[str, str]:
    """The merged table, and in one more pass an extract per source family (a folder ``source=<name>`` each)."""
    merged.write.mode("overwrite").option("header", True).partitionBy(source_col).csv(f"{base}/by-source")
    return {"merged": write_csv(merged, f"{base}/merged"), "by_source": f"{base}/by-source"}


def append_metrics(spark: SparkSession, path: str, run: str, model: str, metrics: Mapping[str, float],
                   params: Mapping[str, float] = {}, coefficients: Mapping[str, float] = {}) -> None:
    """Report rows (run, model, kind, name, value) appended to a Parquet table: the metrics, and the model's
    parameters and coefficients where given."""
    rows = [(run, model, kind, k, float(v) if v is not None else None)
            for kind, values in (("metric", metrics), ("parameter", params), ("coefficient", coefficients))
            for k, v in values.items()]
    spark.createDataFrame(rows, "run string, model string, kind string, name string, value double") \
        .coalesce(1).write.mode("append").parquet(path)


def save_model(model: PipelineModel, path: str) -> str:
    """A7."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """A7."""
    return PipelineModel.load(path)
