"""Statistics per micro-batch: batch and stream agree, and a batch that runs again writes nothing twice."""

import pytest
from pyspark.sql import functions as F

from riskframe.operators import scaling
from riskframe.streaming import scorer

SCHEMA = "id int, x double"


@pytest.fixture
def source(spark, tmp_path):
    folder = str(tmp_path / "in")
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).select(F.col("id").cast("int"), (F.col("id") * (part + 1.5)).alias("x")).coalesce(1).write.mode("append").parquet(folder)
    return folder


def expected(spark, source, refit, model):
    out = {}
    for part in range(3):
        rows = spark.read.schema(SCHEMA).parquet(source).where(F.col("id").between(part * 10, part * 10 + 9))
        out |= {r.id: r.x for r in scaling.scale(rows, ["x"], model=model, refit=refit)[0].collect()}
    return out


@pytest.mark.parametrize("refit", [True, False])
def test_batch_and_stream_agree(spark, source, tmp_path, refit):
    model = scaling.fit_standard(spark.read.schema(SCHEMA).parquet(source), ["x"])
    sink = str(tmp_path / "out")
    scorer.process_batches(spark, lambda b: scaling.scale(b, ["x"], model=model, refit=refit)[0], source, SCHEMA, sink, str(tmp_path / "ckpt"), files_per_batch=1)
    got = scorer.batch_results(spark, sink).collect()
    assert len(got) == 30 and {r.batch for r in got} == {0, 1, 2}
    assert {r.id: r.x for r in got} == pytest.approx(expected(spark, source, refit, model))


def test_a_batch_that_failed_or_runs_again_is_written_once(spark, source, tmp_path):
    sink, ckpt, runs = str(tmp_path / "out"), str(tmp_path / "ckpt"), []

    def step(batch):
        runs.append(batch.count())
        if len(runs) == 2:
            batch.write.mode("overwrite").parquet(f"{sink}/batch=1")  # half the work, then the driver is gone
            raise RuntimeError("lost")
        return batch
    with pytest.raises(Exception, match="lost"):
        scorer.process_batches(spark, step, source, SCHEMA, sink, ckpt, files_per_batch=1)
    scorer.process_batches(spark, step, source, SCHEMA, sink, ckpt, files_per_batch=1)
    assert len(runs) == 4 and sorted(r.id for r in scorer.batch_results(spark, sink).collect()) == list(range(30))
    scorer.process_batches(spark, step, source, SCHEMA, sink, ckpt, files_per_batch=1)
    assert len(runs) == 4
