"""Long generations that can be stopped and go on.

The store is a folder of published waves (``quire.sources.publishing``): rows of (key, text, ..., error). What
a wave didn't publish never counts, so the waves alone say what is left: an item is finished by a row without
error, and dead after ``ATTEMPTS`` rows with one. A run asks the store for that by one anti-join, cuts the rest into
waves by a hash of the key, and publishes wave after wave; failed items come again in the next
round. A restart is the same call.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.inference import BACKENDS, MAX_TOKENS, Backend, echo_backend, generate, generation_plan
from quire.session import scratch_path
from quire.sources.publishing import committed, publish

ATTEMPTS = 3
WAVES = 4


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """All rows of the published waves; None where there is no wave yet."""
    folders = committed(spark, store)
    return spark.read.parquet(*folders) if folders else None


def progress(rows: DataFrame, key: list[str]) -> DataFrame:
    """``*key, ok, failures`` of the items that were tried."""
    return rows.groupBy(*key).agg(F.max(F.col("error").isNull()).alias("ok"), F.count("error").alias("failures"))


def pending(plan: DataFrame, rows: DataFrame | None, key: list[str], attempts: int = ATTEMPTS) -> DataFrame:
    """Items of the plan that are neither finished nor dead."""
    if rows is None:
        return plan
    closed = progress(rows, key).where(F.col("ok") | (F.col("failures") >= attempts)).select(*key)
    return plan.join(closed, key, "left_anti")


def run(plan: DataFrame, key: list[str], store: str, make_backend: Callable[[], Backend] = echo_backend,
        waves: int = WAVES, attempts: int = ATTEMPTS, max_tokens: int = MAX_TOKENS, stop_after: int | None = None) -> int:
    """Generates what is pending, wave by wave, and returns the number of waves published (at most
    ``stop_after``: a run that is stopped there goes on with the next call)."""
    spark = plan.sparkSession
    done = 0
    for _ in range(attempts):
        left = pending(plan, stored(spark, store), key, attempts)
        if left.isEmpty():
            break
        # the round's items are fixed before its first wave adds to the store
        path = scratch_path(spark, "pending")
        left.withColumn("wave", F.pmod(F.xxhash64(*key), F.lit(waves)).cast("int")).write.partitionBy("wave").parquet(path)
        items = spark.read.parquet(path)
        for wave in [r[0] for r in items.select("wave").distinct().orderBy("wave").collect()]:
            if stop_after is not None and done >= stop_after:
                return done
            answers = generate(items.where(F.col("wave") == wave).drop("wave"), make_backend, max_tokens)
            publish(spark, _new_wave(store), answers.write.parquet)
            done += 1
    return done


def _new_wave(store: str) -> str:
    """A new wave's folder."""
    return f"{store}/wave-{uuid.uuid4().hex[:12]}"


def results(spark: SparkSession, store: str, key: list[str]) -> DataFrame:
    """One row per item that was tried: its answer, or its last error, and its number of attempts."""
    rows = stored(spark, store)
    order = F.struct(F.col("error").isNull().alias("ok"), F.coalesce("error", F.lit("")).alias("error"))
    return rows.groupBy(*key).agg(F.max_by(F.struct("text", "tok_count", "error"), order).alias("r"), F.count("*").alias("attempts")).select(*key, "r.*", "attempts")


def dead_letters(spark: SparkSession, store: str, key: list[str], attempts: int = ATTEMPTS) -> DataFrame:
    """Items given up, with every distinct error they met."""
    rows = stored(spark, store)
    return (rows.groupBy(*key).agg(F.max(F.col("error").isNull()).alias("ok"), F.count("error").alias("failures"), F.array_sort(F.collect_set("error")).alias("errors"))
            .where(~F.col("ok") & (F.col("failures") >= attempts)).drop("ok"))


def resumed_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models over the whole plan; each run is stopped after its second wave and then goes on."""
    key = ["prompt_id", "temp_idx"]
    plan = generation_plan(spark, sf_dir)
    out = None
    for model, backend in BACKENDS.items():
        store = scratch_path(spark, f"generation-{model}")
        run(plan, key, store, backend, stop_after=2)
        run(plan, key, store, backend)
        part = results(spark, store, key).withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    return out
