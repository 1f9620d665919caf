"""Tests of the session helpers."""

import os

from pyspark.sql import functions as F

from riskframe import session


def test_a_large_narrow_table_is_many_tasks_when_read_back(spark):
    rows = 6 * session.ROWS_PER_FILE + 1
    got = session.materialize(spark.range(0, rows, 1, 1).select("id", F.lit(1).alias("x")))
    sizes = [r["n"] for r in got.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == rows and len(sizes) == 7 and max(sizes) <= session.ROWS_PER_FILE
    busy = got.groupBy(F.spark_partition_id().alias("p")).count().count()
    assert busy >= min(3, spark.sparkContext.defaultParallelism)


def test_a_small_table_keeps_its_files(spark):
    assert len(session.materialize(spark.range(0, 1000, 1, 2)).inputFiles()) == 2


def test_a_released_table_is_gone_and_others_stay(spark, tmp_path):
    kept, own = (session.materialize(spark.range(10), n) for n in ("kept", "own"))
    given = f"{tmp_path}/own-0123456789ab"
    spark.range(10).write.parquet(given)
    places = {f.rsplit("/", 1)[0].removeprefix("file://") for f in own.inputFiles()}
    for df in (kept, own.select((F.col("id") + 1).alias("x")), spark.read.parquet(given)):
        session.release(df, "own")
    assert kept.count() == 10 and spark.read.parquet(given).count() == 10
    assert not any(os.path.exists(p) for p in places)


def test_a_cleaner_leaves_one_written_table(spark):
    from riskframe.fixtures import patients
    from riskframe.plans.cleaning import clean_caroc
    base = session.ensure_checkpoint_dir(spark).removeprefix("file:") + "/riskframe"
    given = patients(spark, "/root/testdata/sf0.001")
    before = set(os.listdir(base))
    rows = clean_caroc(given)
    assert [n.rsplit("-", 1)[0] for n in set(os.listdir(base)) - before] == ["cleaned-caroc"]
    assert rows.count() and given.count()
