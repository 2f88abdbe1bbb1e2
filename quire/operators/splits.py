"""Seeded shuffle, group-safe and ordered splits, progress counter, batch plan.

All orderings are exact global ranks computed with ``two_level_rank`` — never a
``row_number()`` over the whole table (which plans a single-partition exchange).
The split is decided per *prompt*; temperatures are fanned out afterwards with a
generator, so every temperature of a prompt lands on the same side by
construction and no join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.functions.ranges import PART, in_ranges
from quire.operators.ranking import seeded_order, split_label, two_level_rank
from quire.sources import literals as L


def seeded_shuffle(spark: SparkSession, sf_dir: str, seed: int = L.SHUFFLE_SEED) -> DataFrame:
    p = tables.prompts(spark, sf_dir).select("prompt_id")
    return seeded_order(p, "prompt_id", seed).select("prompt_id", "shuffle_key", "shuffle_rank")


def ranked_prompts(spark: SparkSession, sf_dir: str, ratio: float = L.TRAIN_RATIO,
                   seed: int = L.SHUFFLE_SEED) -> DataFrame:
    p = tables.prompts(spark, sf_dir).select("prompt_id", "prompt")
    r = seeded_order(p, "prompt_id", seed, total="n_prompts")
    return r.withColumn("split", split_label(F.col("shuffle_rank"), F.col("n_prompts"), ratio))


def _fan_out(df: DataFrame, spec: str) -> DataFrame:
    return (df.select("*", F.posexplode(F.split(F.lit(spec), ",")).alias("temp_idx", "_t"))
            .withColumn("temperature", F.col("_t").cast("double"))
            .withColumn("temp_idx", F.col("temp_idx").cast("int")).drop("_t"))


def group_split(spark: SparkSession, sf_dir: str, spec: str = L.DEFAULT_TEMPERATURES) -> DataFrame:
    r = ranked_prompts(spark, sf_dir)
    return _fan_out(r, spec).select("prompt_id", "temperature", "split")


def progress_index(spark: SparkSession, sf_dir: str, spec: str = L.DEFAULT_TEMPERATURES) -> DataFrame:
    """``[i/total]`` over the prompt-major plan (shuffled prompts × temperatures)."""
    n_t = len(spec.split(","))
    r = _fan_out(ranked_prompts(spark, sf_dir), spec)
    idx = (F.col("shuffle_rank") - 1) * n_t + F.col("temp_idx") + 1
    total = F.col("n_prompts") * n_t
    return r.select("prompt_id", "temperature", idx.cast("bigint").alias("idx"),
                    total.cast("bigint").alias("total"),
                    F.concat(F.lit("["), idx.cast("string"), F.lit("/"), total.cast("string"),
                             F.lit("]")).alias("label"))


def ordered_split(spark: SparkSession, sf_dir: str, ratio: float = L.TRAIN_RATIO) -> DataFrame:
    """Split in prompt order, no shuffle: the valid side is the tail."""
    p = tables.prompts(spark, sf_dir).select("prompt_id")
    r = two_level_rank(in_ranges(p, "prompt_id"), F.col(PART), [F.col("prompt_id")], name="rank", total="n_prompts")
    return r.select("prompt_id", "rank", split_label(F.col("rank"), F.col("n_prompts"), ratio)
                    .alias("split"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and prompts per side after concatenating the two sides."""
    plan = _fan_out(ranked_prompts(spark, sf_dir), L.DEFAULT_TEMPERATURES)
    both = (plan.where(F.col("split") == "train")
            .unionByName(plan.where(F.col("split") == "valid")))
    return (both.groupBy("split")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.col("temp_idx") == 0).alias("n_prompts")))


def _normalised(col):
    return F.lower(F.regexp_replace(T.py_strip(col), "[" + T.WS_BODY + "]+", " "))


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train/valid overlap by prompt id (must be 0) and by normalised prompt text.

    Each key is counted once per side (a partially aggregated group-by, so a hot text is one row
    per task); train rows of keys that the valid side has are the semi-join, the others the
    anti-join. No row and no text is joined.
    """
    r = ranked_prompts(spark, sf_dir).select("prompt_id", "split", F.md5(_normalised(F.col("prompt"))).alias("norm"))

    def on_both(key: str) -> DataFrame:
        """Train rows whose key is also on the valid side, and train rows in all."""
        sides = r.groupBy(key).agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "valid").alias("v"))
        return sides.agg(F.coalesce(F.sum(F.when(F.col("v") > 0, F.col("t"))), F.lit(0)).alias("hits"), F.coalesce(F.sum("t"), F.lit(0)).alias("all"))

    ids, texts = on_both("prompt_id"), on_both("norm")
    counts = texts.select(ids.select("hits").scalar().alias("same_prompt_id"), F.col("hits").alias("same_prompt_text"), (F.col("all") - F.col("hits")).alias("train_after_anti_join"))
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(c).alias("n"))
        for c in ("same_prompt_id", "same_prompt_text", "train_after_anti_join")])).alias("r")).select("r.*")


def batch_plan(spark: SparkSession, sf_dir: str, epochs: int = L.NUM_EPOCHS,
               max_steps: int | None = None) -> DataFrame:
    """Epoch × example schedule: reshuffled per epoch, micro-batches of 2, 8 per step, with log /
    eval / save flags every 5 / 25 / 25 steps; every example, unless ``max_steps`` ends it."""
    plan = _fan_out(ranked_prompts(spark, sf_dir), L.DEFAULT_TEMPERATURES).where(F.col("split") == "train")
    ex = plan.select("prompt_id", "temp_idx", F.concat(F.col("prompt_id").cast("string"), F.lit(":"), F.col("temp_idx").cast("string"))
                     .alias("example_id"))
    per_step = L.MICRO_BATCH * L.GRAD_ACCUMULATION
    ep = ex.select("prompt_id", "temp_idx", "example_id", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    r = seeded_order(ep, "example_id", name="rank", total="n_examples", partition=["epoch"],
                     seed_col=F.col("epoch") + F.lit(L.SHUFFLE_SEED))
    steps_per_epoch = F.ceil(F.col("n_examples") / F.lit(per_step))
    step = F.col("epoch") * steps_per_epoch + F.floor((F.col("rank") - 1) / per_step)
    out = r.select("epoch", "prompt_id", "temp_idx", "rank",
                   F.floor((F.col("rank") - 1) / L.MICRO_BATCH).cast("bigint").alias("micro_batch"),
                   step.cast("bigint").alias("global_step"))
    if max_steps is not None:
        out = out.where(F.col("global_step") < max_steps)
    return (out.withColumn("log_step", F.col("global_step") % L.LOGGING_STEPS == 0)
            .withColumn("eval_step", F.col("global_step") % L.EVAL_STEPS == 0)
            .withColumn("save_step", F.col("global_step") % L.SAVE_STEPS == 0))
