"""The rule grader as a Structured Streaming job over a directory of JSONL responses.

New response files are picked up incrementally; each micro-batch is graded by the
same broadcast rule join as the batch job (a stream-static join) and the running
scores per (rule set, model, suite) are kept in the streaming aggregation state.
The sink writes each complete result table to the shared folder through
``foreachBatch`` (idempotent overwrite per batch), and progress is checkpointed
there too, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import tables
from quire.operators.grading import grade
from quire.session import scratch_path
from quire.sources import literals as L

RESPONSE_SCHEMA = ("conv_id BIGINT, turn BIGINT, model STRING, prompt_id BIGINT, "
                   "test_ord INT, prompt STRING, text STRING")


def running_scores(responses: DataFrame, spark: SparkSession) -> DataFrame:
    g = grade(responses, L.tests_df(spark))
    return (g.groupBy("rule_set", "model", "suite")
            .agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"))
            .withColumn("score", F.round(F.lit(100.0) * F.col("passed") / F.col("total"), 6)))


def start_grader(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                 available_now: bool = True):
    stream = (spark.readStream.schema(RESPONSE_SCHEMA).option("maxFilesPerTrigger", 4)
              .json(source_dir))
    scores = running_scores(stream, spark)

    def sink(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_dir)

    w = (scores.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def stream_suite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the responses as JSONL files, grade them as a stream, read the final scores."""
    base = scratch_path(spark, "stream-grader")
    src = os.path.join(base, "responses")
    (tables.responses(spark, sf_dir)
     .write.mode("overwrite").json(src))
    q = start_grader(spark, src, os.path.join(base, "scores"), os.path.join(base, "checkpoint"))
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "scores"))
