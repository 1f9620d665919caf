"""Helpers shared by the operators of this package.

Every operator reads an id column and a text column by name and carries nothing else, so other columns may have
any name. A row is identified by ``uid`` (its place in the input), never by its id, which may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import scratch_path, table_path

#: Rows whose remainder is this are held out of learning (op5, op8: 0; op2: 1).
FOLDS = 5


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "documents"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "labels"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "embeddings"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose uid is in ``gone``; all columns stay as they are."""
    uid = fresh(docs, "uid")
    rows = docs.withColumn(uid, F.monotonically_increasing_id())
    return rows.join(gone.select(F.col("uid").alias(uid)), uid, "left_anti").select(*map(quoted, docs.columns))


def fold(id_col) -> Column:
    """crc32 of the id's text, modulo ``FOLDS`` (a null id counts as the empty string)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def with_uid(df: DataFrame) -> DataFrame:
    """Add ``uid``, the row's place in its input split. It is the same each time the same files are scanned."""
    return df.withColumn("uid", F.monotonically_increasing_id())


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, raw): the text as UTF-8 bytes, empty for null, which Arrow hands to Python undecoded."""
    return with_uid(docs.select(F.col(id_col).alias("doc_id"),
                                F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw")))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: later passes scan the file, and a lost
    executor costs no more than the tasks it was running."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, most: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(order, uid, raw, label) of at most ``most`` labelled ids outside the held-out fold, the first by a hash of
    the id. Only ids and labels are ordered; the few chosen ids are then looked up in the documents. Null labels
    don't count; of differing labels of one id the smallest does."""
    chosen = (labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0))
              .groupBy(F.col(id_col).alias("doc_id")).agg(F.min(target).cast("int").alias("label"))
              .withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(most))
    return numbered(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("order", "uid", "raw", "label")
