"""CSV scans by column name against a contract, with the rows that break it kept apart.

Spark applies an explicit schema to a CSV file by position. Here every file's own header decides: files are grouped by
header, each group is scanned once with its header's names, and the contract's columns are picked by name. A column
that a file lacks is missing in its rows, columns beyond the contract are not kept, and the order of the columns or of
the files never matters. A row breaks the contract if it has another number of fields than its header, if a value can't
be read as the contract's type, or if a required value is missing; such rows go to the quarantine with their reasons.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a field holds where its value is missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
           "NULL", "NaN", "None", "n/a", "nan", "null")

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Bytes of a file's start in which its header line must end.
HEADER_BYTES = 1 << 20
_CORRUPT, _FILE = "__record", "__file"


@dataclass
class Scan:
    """``rows``: the contract's columns, then source_file if asked for. ``quarantine``: source_file, record, reasons.
    ``headers``: per group of files with one header their number and the contract's columns that are missing and extra."""

    rows: DataFrame
    quarantine: DataFrame
    headers: DataFrame


def _first_line(spark: SparkSession, path: str) -> str:
    """A file's first line, read by the file system that Spark reads it with."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(place)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        source = stream if codec is None else codec.createInputStream(stream)
        reader = spark._jvm.org.apache.hadoop.util.LineReader(source)
        line = spark._jvm.org.apache.hadoop.io.Text()
        reader.readLine(line, HEADER_BYTES, HEADER_BYTES)
        return line.toString()
    finally:
        stream.close()


def header_names(line: str, sep: str = ",") -> tuple[str, ...]:
    """Column names of a header line; a name that occurs again gets .1, .2 and so on, and an empty one its position."""
    import csv
    fields = next(csv.reader([line.lstrip("﻿").rstrip("\r\n")], delimiter=sep), [])
    seen: dict[str, int] = {}
    out: list[str] = []
    for i, name in enumerate(fields):
        name = name or f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return tuple(out)


def file_headers(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """Files by header. Of each file only the first line is read; files without any line are left out."""
    files = sorted(spark.read.option("recursiveFileLookup", True).text(list(paths)).inputFiles())
    with ThreadPoolExecutor(32) as pool:
        names = list(pool.map(lambda f: header_names(_first_line(spark, f), sep), files))
    out: dict[tuple[str, ...], list[str]] = {}
    for f, n in zip(files, names):
        if n:
            out.setdefault(n, []).append(f)
    return out


def _value(text: Column, kind: T.DataType) -> tuple[Column, Column]:
    """(value, whether a present text can't be read as it). Whole numbers may be written as 3.0 or 3e2, not as 3.5."""
    present = F.trim(text)
    if isinstance(kind, _WHOLE):
        number = present.try_cast("double")
        whole = number == F.floor(number)
        value = F.when(whole, F.coalesce(F.when(present.rlike(r"^[+-]?\d+$"), present.try_cast(kind)),
                                         number.cast("decimal(38,0)").try_cast(kind)))
        return value, text.isNotNull() & value.isNull()
    if isinstance(kind, T.StringType):
        return text, F.lit(False)
    value = present.try_cast(kind)
    return value, text.isNotNull() & value.isNull()


def _group(spark: SparkSession, header: Sequence[str], files: list[str], contract: T.StructType, required: Sequence[str],
           options: dict) -> DataFrame:
    taken = {c.lower() for c in header}
    corrupt, source = _CORRUPT, _FILE
    while corrupt.lower() in taken or source.lower() in taken:
        corrupt, source = corrupt + "_", source + "_"
    # fields are read under names of their own, since a file's names may differ in case only
    places = {c: f"c{i}" for i, c in enumerate(header)}
    schema = T.StructType([*(T.StructField(p, T.StringType()) for p in places.values()), T.StructField(corrupt, T.StringType())])
    raw = (spark.read.options(**options).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True)
           .option("columnNameOfCorruptRecord", corrupt).option("columnPruning", False).schema(schema).csv(files))
    raw = raw.select("*", F.col("_metadata.file_path").alias(source), F.col("_metadata.file_block_start").alias("__block"),
                     F.monotonically_increasing_id().alias("__pos"))
    reasons, values = [F.when(F.col(corrupt).isNotNull(), F.lit("fields"))], []
    for i, f in enumerate(contract.fields):
        if f.name not in places:
            values.append(F.lit(None).cast(f.dataType).alias(f"v{i}"))
            if f.name in required:
                reasons.append(F.lit(f"{f.name}: missing"))
            continue
        given = F.col(places[f.name])
        text = F.when(~F.trim(given).isin(*MISSING), given)
        value, unreadable = _value(text, f.dataType)
        values.append(value.alias(f"v{i}"))
        reasons.append(F.when(unreadable & F.col(corrupt).isNull(), F.lit(f"{f.name}: not {f.dataType.simpleString()}")))
        if f.name in required:
            reasons.append(F.when(text.isNull() & F.col(corrupt).isNull(), F.lit(f"{f.name}: missing")))
    record = F.coalesce(F.col(corrupt), F.to_csv(F.struct(*places.values())))
    return raw.select(*values, F.col(source).alias("source_file"), F.struct(F.col(source).alias("file"), F.col("__block").alias("block"),
                                                                           F.col("__pos").alias("pos")).alias("row_seq"),
                      record.alias("__text"), F.array_compact(F.array(*reasons)).alias("__reasons"))


def scan(spark: SparkSession, paths: str | Sequence[str], contract: T.StructType | str, required: Sequence[str] = (),
         keep_broken: bool = False, with_source: bool = False, with_row_seq: bool = False, sep: str = ",", **options) -> Scan:
    """Read CSV files, folders or globs against a contract (names and types; names match exactly).

    Blank fields and the usual markers in ``MISSING`` are NULL. A field that is there but can't be read as its type
    breaks the row. With ``keep_broken`` the rows that break the contract stay in ``rows`` as well, with NULL for what
    can't be read. ``with_row_seq`` adds the file-order key that order-dependent steps use.
    """
    kinds = T.StructType.fromDDL(contract) if isinstance(contract, str) else contract
    groups = file_headers(spark, [paths] if isinstance(paths, str) else list(paths), sep)
    names = [f.name for f in kinds.fields]
    options = {"sep": sep, **options}
    parts = [_group(spark, h, fs, kinds, required, options) for h, fs in groups.items()]
    if not parts:
        nothing = spark.createDataFrame([], kinds).toDF(*[f"v{i}" for i in range(len(names))]).withColumns({
            "source_file": F.lit(""), "row_seq": F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("pos")),
            "__text": F.lit(""), "__reasons": F.array().cast("array<string>")})
        parts = [nothing]
    # every scan numbers its own rows: the file and block in the key keep the groups apart
    both = reduce(lambda a, b: a.unionByName(b), parts)
    extra = ["source_file"] * with_source + ["row_seq"] * with_row_seq
    rows = (both if keep_broken else both.where(F.size("__reasons") == 0)).select(
        *[f"v{i}" for i in range(len(names))], *extra).toDF(*names, *extra)
    bad = both.where(F.size("__reasons") > 0).select("source_file", F.col("__text").alias("record"), F.col("__reasons").alias("reasons"))
    listed = [(",".join(h), len(fs), [c for c in names if c not in h], [c for c in h if c not in names]) for h, fs in groups.items()]
    headers = spark.createDataFrame(listed, "header string, files long, missing array<string>, extra array<string>")
    return Scan(rows, bad, headers)


def write_quarantine(found: Scan, path: str) -> DataFrame:
    """Append the rows that break the contract to a Parquet table, and return their number by reason (a row with two
    reasons counts for both)."""
    found.quarantine.write.mode("append").parquet(path)
    held = found.quarantine.sparkSession.read.schema(found.quarantine.schema).parquet(path)
    return held.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
