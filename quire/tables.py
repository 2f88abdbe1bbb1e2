"""Input tables and the fixture views built on them.

Each loader selects only the columns its callers need so the Parquet scan's
``ReadSchema`` stays narrow.  The same view definitions appear as CTEs in the
DuckDB oracles (``quire.plans.oracles``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.literals import N_TESTS

# Fixture convention: the module of each vector's parameter path (vec_id % 8);
# the seven projections are linear, the norm is not.
TURN_SPACE = 1 << 32  # prompt_id = conv_id * TURN_SPACE + turn: no two turns share one
MODULES = ["q_proj", "k_proj", "v_proj", "o_proj", "up_proj", "gate_proj", "down_proj", "norm"]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*cols) if cols else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partitions a scan by its key where the caller's session asks for it
    (``spark.quire.spreadInputs``, off by default and on in local sessions built here).

    For small local files of one row group, which scan as one task however many cores there
    are. On a cluster leave it off and use ``spark.sql.files.maxPartitionBytes``: a shuffle of the whole
    text ahead of map-only work costs more than it gives.
    """
    if df.sparkSession.conf.get("spark.quire.spreadInputs", "false") != "true":
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as a prompt bank: (prompt_id, conv_id, turn, domain, prompt)."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return (c.where(F.col("role") == "user")
            .select((F.col("conv_id") * TURN_SPACE + F.col("turn")).alias("prompt_id"),
                    "conv_id", "turn",
                    F.concat(F.lit("d"), (F.col("conv_id") % 9).cast("string")).alias("domain"),
                    F.col("text").alias("prompt")))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns answering the user turn right before them.

    Turns are numbered consecutively per conversation, so "previous turn" is an
    equi-join on ``turn = user_turn + 1`` (skew-safe, no window per conversation).
    Each response is assigned to one of the 14 graded tests by ``test_ord``.
    """
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    a = c.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    u = (c.where(F.col("role") == "user")
         .select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt")))
    return (a.join(u, ["conv_id", "turn"], "inner")
            .select("conv_id", "turn",
                    F.when(F.col("conv_id") % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("model"),
                    (F.col("conv_id") * TURN_SPACE + F.col("turn") - 1).alias("prompt_id"),
                    F.pmod(F.expr("conv_id div 2 + turn div 2"), F.lit(N_TESTS))
                    .cast("int").alias("test_ord"),
                    "prompt", "text"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log read as a benchmark run log.

    Guard paths that the events never contain are injected deterministically:
    zero elapsed time, a missing/zero reported token count and a missing duration.
    """
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    tokens = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("run_id"),
        "ts",
        F.when(F.col("user_id") % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("model"),
        F.col("event_type").alias("suite"),
        tokens.alias("tokens"),
        F.when(F.col("event_id") % 97 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("elapsed"),
        F.when(F.col("event_id") % 89 == 0, F.lit(None).cast("int"))
         .when(F.col("event_id") % 89 == 1, F.lit(0)).otherwise(tokens).alias("eval_count"),
        F.when(F.col("event_id") % 83 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.round(F.col("value") * 1e9).cast("bigint")).alias("duration_ns"),
        (tokens >= 25).alias("passed"),
    )


def texts(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents", *(cols or ("doc_id", "text", "lang", "source"))),
                  "doc_id")


def needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark", "item_id", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the float array widened to DOUBLE once."""
    e = spread(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "vec_id")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parameter path per vector: layer = label, module from vec_id % 8."""
    v = vectors(spark, sf_dir)
    modules = F.array(*[F.lit(m) for m in MODULES])
    module = F.element_at(modules, (F.pmod(F.col("vec_id"), F.lit(8)) + 1).cast("int"))
    return v.select("vec_id", "v", "label",
                    F.concat(F.lit("model.layers."), F.col("label").cast("string"),
                             F.lit("."), module).alias("path"),
                    module.alias("module"))
