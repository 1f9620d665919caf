"""M5: streaming scoring - the batch scoring plan under Structured Streaming.

Files dropped into a directory are read with the scoring contract schema (no inference on a stream), scored by
the same stateless plan as a batch (so no watermark or state store is needed), and appended to a Parquet sink.
The checkpoint location lives in the shared checkpoint folder, so a restarted query resumes exactly once from
the last committed batch after driver or executor loss.

``process_batches`` is for steps that need a batch as a whole, such as statistics fitted anew on every batch (I6).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.scoring import ScoringModel


def score_stream(spark: SparkSession, model: ScoringModel, source_dir: str, schema: T.StructType | str,
                 sink_dir: str, checkpoint_dir: str, fmt: str = "parquet", available_now: bool = True,
                 max_files_per_trigger: int = 100):
    """Start the streaming scorer; returns the ``StreamingQuery``. With ``available_now`` it processes what is
    there in bounded micro-batches and stops (batch-style backfill); otherwise it keeps polling."""
    stream = (spark.readStream.schema(schema).format(fmt)
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .option("header", True).load(source_dir))
    scored = model.score(stream)
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint_dir).option("path", sink_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def run_to_completion(spark: SparkSession, model: ScoringModel, source_dir: str, schema, sink_dir: str,
                      checkpoint_dir: str, fmt: str = "parquet") -> DataFrame:
    """Process everything currently in ``source_dir`` and return the sink as a batch DataFrame."""
    q = score_stream(spark, model, source_dir, schema, sink_dir, checkpoint_dir, fmt, available_now=True)
    q.awaitTermination()
    return spark.read.parquet(sink_dir)


def process_batches(spark: SparkSession, step: Callable[[DataFrame], DataFrame], source_dir: str, schema: T.StructType | str,
                    sink_dir: str, checkpoint_dir: str, fmt: str = "parquet", files_per_batch: int = 100):
    """Run ``step`` on every micro-batch of what is in ``source_dir`` and write its result to the sink; returns the
    finished query.

    A batch owns the folder ``batch=<id>`` of the sink and overwrites it. A batch that is run again after a failure has
    the same id and the same files, so nothing is written twice and no half-written batch stays.
    """
    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{sink_dir}/batch={number}")

    query = (spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(source_dir)
             .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def batch_results(spark: SparkSession, sink_dir: str) -> DataFrame:
    """All batches of a sink, each row with its ``batch``."""
    return spark.read.option("basePath", sink_dir).parquet(f"{sink_dir}/batch=*").withColumn("batch", F.col("batch").cast("long"))
