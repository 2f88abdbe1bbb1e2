"""Softmax, cross-entropy, temperature KL and the blended distillation loss.

Logits are array columns (the ``logits`` view: student = embedding × 10, class =
label; teacher = per-label mean vector × 10).  Row maths uses array functions;
log-sum-exp is a single ``aggregate`` pass with a running (max, sum) state, so
no lambda reads an outer array (which Spark would re-evaluate per element).
Losses are reduced per training batch of 8 rows: cross-entropy as a masked mean,
KL as ``batchmean`` (divided by rows, masked rows add 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import tables
from quire.sources import literals as L

SCALE = 10.0
IGNORE_INDEX = -100
BATCH_ROWS = L.MICRO_BATCH * L.GRAD_ACCUMULATION


def logsumexp(arr: Column, inv_t: float = 1.0) -> Column:
    """log Σ exp(x·inv_t), numerically stable, one pass."""
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def step(acc, x):
        y = x * F.lit(inv_t)
        m = F.greatest(acc["m"], y)
        return F.struct(m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(y - m)).alias("s"))

    return F.aggregate(arr, init, step, lambda acc: acc["m"] + F.log(acc["s"]))


def student_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.vectors(spark, sf_dir)
    return v.select("vec_id", "label",
                    F.when(F.col("vec_id") % 7 == 0, F.lit(IGNORE_INDEX)).otherwise(F.col("label"))
                    .alias("target"),
                    F.transform("v", lambda x: x * F.lit(SCALE)).alias("z"))


def teacher_logits(spark: SparkSession, sf_dir: str,
                   temperature: float = L.DISTILL_TEMPERATURE) -> DataFrame:
    """Per-label mean logits with their temperature softmax precomputed.

    One row per label (64 values each): element-wise mean via posexplode +
    partial aggregation, then re-assembled in position order.
    """
    v = tables.vectors(spark, sf_dir)
    cells = (v.select("label", F.posexplode("v").alias("pos", "x"))
             .groupBy("label", "pos").agg(F.avg("x").alias("m")))
    t = (cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"))
         .select("label", F.transform("c", lambda e: e["m"] * F.lit(SCALE)).alias("t")))
    t = t.withColumn("lse_t", logsumexp(F.col("t"), 1.0 / temperature))
    return t.select("label", "t", "lse_t",
                    F.transform("t", lambda x: x / F.lit(temperature)).alias("t_scaled"))


def _teacher_probs(df: DataFrame) -> DataFrame:
    # lse_t is a column of the joined row here; the probabilities are built once per row.
    return df.withColumn("p_t", F.zip_with("t_scaled", F.array_repeat("lse_t", F.size("t_scaled")),
                                           lambda a, b: F.exp(a - b)))


def kl_rows(df: DataFrame, temperature: float) -> Column:
    """KL(p_t ‖ p_s) on T-scaled logits × T²: Σ p_t·(t−z)/T − lse_t + lse_s."""
    cross = F.aggregate(F.arrays_zip("p_t", "t", "z"), F.lit(0.0),
                        lambda acc, e: acc + e["p_t"] * (e["t"] - e["z"]) / F.lit(temperature))
    kl = cross - F.col("lse_t") + logsumexp(F.col("z"), 1.0 / temperature)
    return kl * F.lit(temperature * temperature)


def ce(z: Column, target: Column, inv_t: float = 1.0) -> Column:
    """Cross-entropy of one row; NULL for an ignored target."""
    picked = F.element_at(z, (target + 1).cast("int")) * F.lit(inv_t)
    return F.when(target == IGNORE_INDEX, F.lit(None).cast("double")).otherwise(
        logsumexp(z, inv_t) - picked)


def softmax_rows(spark: SparkSession, sf_dir: str, temperature: float = L.DISTILL_TEMPERATURE) -> DataFrame:
    s = student_logits(spark, sf_dir)
    lse = logsumexp(F.col("z"))
    lse_t = logsumexp(F.col("z"), 1.0 / temperature)
    picked = F.element_at("z", (F.col("label") + 1).cast("int"))
    return s.select("vec_id", "label",
                    F.round(lse, 6).alias("logsumexp"),
                    F.round(F.exp(picked - lse), 6).alias("p_label"),
                    F.round(F.exp(F.array_max("z") - lse), 6).alias("p_max"),
                    F.round(F.exp(picked / F.lit(temperature) - lse_t), 6).alias("p_label_t"))


def ce_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked mean cross-entropy per batch of 8 rows (ignored targets excluded)."""
    s = student_logits(spark, sf_dir)
    rows = s.select(F.expr(f"vec_id div {BATCH_ROWS}").alias("batch_id"),
                    ce(F.col("z"), F.col("target")).alias("loss"))
    return (rows.groupBy("batch_id")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count("loss").alias("n_unmasked"),
                 F.round(F.avg("loss"), 6).alias("ce_mean")))


def kl_logits(spark: SparkSession, sf_dir: str,
              temperature: float = L.DISTILL_TEMPERATURE) -> DataFrame:
    """Temperature KL to the teacher, ``batchmean`` and per-token mean per batch."""
    s = student_logits(spark, sf_dir)
    t = teacher_logits(spark, sf_dir, temperature)
    j = _teacher_probs(s.join(F.broadcast(t), "label"))  # one row per label
    rows = j.select(F.expr(f"vec_id div {BATCH_ROWS}").alias("batch_id"), "target",
                    F.when(F.col("target") == IGNORE_INDEX, F.lit(0.0))
                    .otherwise(kl_rows(j, temperature)).alias("kl"))
    return (rows.groupBy("batch_id")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.col("target") != IGNORE_INDEX).alias("n_unmasked"),
                 F.round(F.sum("kl") / F.count(F.lit(1)), 6).alias("kl_batchmean"),
                 F.round(F.sum("kl") / F.nullif(F.count_if(F.col("target") != IGNORE_INDEX), F.lit(0)),
                         6).alias("kl_token_mean")))


def blended_loss(spark: SparkSession, sf_dir: str, temperature: float = L.DISTILL_TEMPERATURE,
                 alpha: float = L.DISTILL_ALPHA) -> DataFrame:
    """α·soft + (1−α)·CE per batch. With a teacher (two batches of three in the fixture) soft is
    KL×T² summed over the unmasked rows and divided by *all* rows of the batch (``batchmean``);
    without one it is CE(z/T)×T² averaged over the unmasked rows. CE is always the masked mean."""
    s = student_logits(spark, sf_dir)
    t = teacher_logits(spark, sf_dir, temperature)
    j = _teacher_probs(s.join(F.broadcast(t), "label"))  # one row per label
    batch = F.expr(f"vec_id div {BATCH_ROWS}")
    masked = F.col("target") == IGNORE_INDEX
    rows = j.select(batch.alias("batch_id"), (batch % 3 != 0).alias("has_teacher"),
                    ce(F.col("z"), F.col("target")).alias("ce"),
                    F.when(masked, F.lit(0.0)).otherwise(kl_rows(j, temperature)).alias("kl"),
                    (ce(F.col("z"), F.col("target"), 1.0 / temperature) * F.lit(temperature * temperature)).alias("soft_ce"))
    g = (rows.groupBy("batch_id", "has_teacher")
         .agg(F.count(F.lit(1)).alias("n_rows"), F.avg("ce").alias("ce"), F.sum("kl").alias("kl"), F.avg("soft_ce").alias("soft_ce"))
         .withColumn("soft", F.when(F.col("has_teacher"), F.col("kl") / F.col("n_rows")).otherwise(F.col("soft_ce"))))
    return g.select("batch_id", "has_teacher", "n_rows", F.round("ce", 6).alias("ce_mean"),
                    F.round("soft", 6).alias("soft_mean"),
                    F.round(F.lit(alpha) * F.col("soft") + F.lit(1 - alpha) * F.col("ce"), 6)
                    .alias("loss"))
