"""A student trained by gradient descent on the blended loss: α·T²·KL(teacher ‖ student at temperature T) + (1 − α)·CE.

The student is a logit over WIDTH hashed word shares and a bias; the teacher is the counting classifier over
many more features. Its weights are the only state of the loop, and of constant size: a step sends them to
the tasks, each task adds up the gradients of its rows in numpy, and Spark adds up the tasks' sums per
micro-batch. Gradients of a step's micro-batches are averaged (gradient accumulation), clipped, and
applied by Adam with decoupled weight decay, a warm-up and a cosine schedule.

An epoch deals its train rows to steps and micro-batches by a seeded hash of the id, so nothing is sorted; it
is written by step, so that a step reads its own rows only. After every epoch the valid side is scored, and the weights
of least valid loss are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import distill
from quire.session import scratch_path
from quire.sources import literals as L

WIDTH = distill.STUDENT_WIDTH
STEPS = 8            # optimiser steps of an epoch
WARMUP = 4
RATE = 0.5
DECAY, MAX_NORM, BETA1, BETA2, EPSILON = 0.01, 1.0, 0.9, 0.999, 1e-8


@dataclass
class State:
    """Weights (bias last) and Adam's two averages."""
    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    t: int = 0


def rate(t: int, total: int) -> float:
    """Linear warm-up, then half a cosine down to zero."""
    if t < WARMUP:
        return RATE * (t + 1) / WARMUP
    return RATE * 0.5 * (1 + math.cos(math.pi * (t - WARMUP) / max(1, total - WARMUP)))


def apply_gradient(s: State, g: np.ndarray, total: int) -> State:
    norm = float(np.sqrt(np.square(g).sum()))
    g = g * min(1.0, MAX_NORM / norm) if norm > 0 else g
    m, v = BETA1 * s.m + (1 - BETA1) * g, BETA2 * s.v + (1 - BETA2) * g * g
    step = (m / (1 - BETA1 ** (s.t + 1))) / (np.sqrt(v / (1 - BETA2 ** (s.t + 1))) + EPSILON)
    return State(s.w - rate(s.t, total) * (step + DECAY * s.w), m, v, s.t + 1)


def _sigmoid(u):
    return 1 / (1 + np.exp(-u))


def row_losses(u: np.ndarray, y: np.ndarray, teacher: np.ndarray, alpha: float, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's blended loss and its derivative by the student's logit ``u``."""
    p, q, one = _sigmoid(teacher / temperature), _sigmoid(u / temperature), _sigmoid(u)
    kl = p * (np.log(p) - np.log(q)) + (1 - p) * (np.log1p(-p) - np.log1p(-q))
    ce = np.logaddexp(0, np.where(y > 0, -u, u))
    return alpha * temperature ** 2 * kl + (1 - alpha) * ce, alpha * temperature * (q - p) + (1 - alpha) * (one - y)


def learning_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y, split, s (the teacher's log-odds), x (word shares by hashed feature, and 1 for the bias)."""
    ex = distill.stored_examples(spark, sf_dir)
    teacher = distill._fit_score(ex, F.col("y"), distill.TEACHER_WIDTH).select("doc_id", "y", "split", "s")
    cells = ex.where("tf > 0").groupBy("doc_id", F.pmod("h", F.lit(WIDTH)).alias("f")).agg(F.sum("tf").alias("tf"))
    shares = cells.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("f", "tf"))).alias("tfs"), F.sum("tf").alias("n"))
    x = F.expr(f"concat(transform(sequence(0, {WIDTH - 1}), f -> coalesce(try_divide(tfs[f], n), 0D)), array(1D))")
    return teacher.join(shares, "doc_id", "left").select("doc_id", "y", "split", "s", x.alias("x"))


def _slot(epoch: int):
    return F.pmod(T.md5_int(F.concat(F.lit(f"{L.SHUFFLE_SEED + epoch}:"), F.col("doc_id").cast("string"))), F.lit(STEPS * L.GRAD_ACCUMULATION))


def epoch_table(train: DataFrame, epoch: int) -> str:
    """Folder of the epoch's rows by step, each with its micro-batch."""
    path = scratch_path(train.sparkSession, f"student-epoch{epoch}")
    slot = _slot(epoch)
    train.select("y", "s", "x", F.floor(slot / L.GRAD_ACCUMULATION).alias("step"), F.pmod(slot, F.lit(L.GRAD_ACCUMULATION)).alias("micro")).write.partitionBy("step").parquet(path)
    return path


def gradient_sums(rows: DataFrame, w: np.ndarray, alpha: float, temperature: float) -> DataFrame:
    """micro, n, loss, g0 ... of ``rows (y, s, x, micro)``: sums over each micro-batch."""

    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
                loss, d = row_losses(x @ w, batch.column("y").to_numpy(), batch.column("s").to_numpy(), alpha, temperature)
                micro = batch.column("micro").to_numpy()
                for k in np.unique(micro):
                    at = micro == k
                    part = sums.setdefault(int(k), [0, 0.0, np.zeros(len(w))])
                    part[0] += int(at.sum())
                    part[1] += float(loss[at].sum())
                    part[2] += d[at] @ x[at]
        yield pa.RecordBatch.from_pydict({"micro": pa.array(list(sums), pa.int64()), "n": pa.array([s[0] for s in sums.values()], pa.int64()),
                                          "loss": pa.array([s[1] for s in sums.values()], pa.float64()), "g": pa.array([s[2] for s in sums.values()], pa.list_(pa.float64()))})

    parts = rows.select("y", "s", "x", "micro").mapInArrow(run, "micro long, n long, loss double, g array<double>")
    return parts.groupBy("micro").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), *[F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(len(w))])


def step_gradient(rows: DataFrame, w: np.ndarray, alpha: float, temperature: float) -> tuple[float, np.ndarray]:
    """Mean loss, and the mean of the micro-batches' mean gradients: one row per micro-batch comes back."""
    micro = gradient_sums(rows, w, alpha, temperature).collect()
    if not micro:
        return math.nan, np.zeros(len(w))
    grads = [np.array([r[f"g{j}"] for j in range(len(w))]) / r["n"] for r in sorted(micro, key=lambda r: r["micro"])]
    return sum(r["loss"] for r in micro) / sum(r["n"] for r in micro), np.mean(grads, axis=0)


def train(table: DataFrame, epochs: int = L.NUM_EPOCHS, alpha: float = L.DISTILL_ALPHA, temperature: float = L.DISTILL_TEMPERATURE) -> tuple[list[tuple], np.ndarray]:
    """(epoch, steps, train_loss, valid_loss) before the first and after every epoch, and the weights of least valid loss."""
    spark = table.sparkSession
    path = scratch_path(spark, "student-table")
    table.write.parquet(path)
    table = spark.read.parquet(path)
    valid = table.where("split = 'valid'").withColumn("micro", F.lit(0).cast("long"))
    rows = table.where("split = 'train'")
    state = State(*(np.zeros(WIDTH + 1) for _ in range(3)))
    log = [(0, 0, None, step_gradient(valid, state.w, alpha, temperature)[0])]
    best = state
    for epoch in range(epochs):
        whole = spark.read.schema("y double, s double, x array<double>, micro long, step long").parquet(epoch_table(rows, epoch))
        losses = []
        for step in range(STEPS):
            loss, g = step_gradient(whole.where(F.col("step") == step), state.w, alpha, temperature)
            state = apply_gradient(state, g, epochs * STEPS)
            losses.append(loss)
        score = step_gradient(valid, state.w, alpha, temperature)[0]
        if not score >= min(r[3] for r in log):
            best = state
        known = [x for x in losses if not math.isnan(x)]
        log.append((epoch + 1, state.t, sum(known) / len(known) if known else None, score))
    return log, best.w


def train_student(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses before the first and after each epoch, and which weights were kept."""
    log, _ = train(learning_table(spark, sf_dir))
    least = min(r[3] for r in log)
    rows = [(e, t, None if x is None else round(x, 6), None if math.isnan(v) else round(v, 6), v == least) for e, t, x, v in log]
    return spark.createDataFrame(rows, "epoch int, steps int, train_loss double, valid_loss double, kept boolean")


def student_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step's gradient, from weights of zero, by feature (the bias is feature WIDTH)."""
    rows = learning_table(spark, sf_dir).where("split = 'train'")
    slot = _slot(0)
    first = rows.withColumn("micro", F.pmod(slot, F.lit(L.GRAD_ACCUMULATION))).where(F.floor(slot / L.GRAD_ACCUMULATION) == 0)
    sums = gradient_sums(first, np.zeros(WIDTH + 1), L.DISTILL_ALPHA, L.DISTILL_TEMPERATURE)
    per = F.explode(F.array(*[F.struct(F.lit(j).alias("feature"), (F.col(f"g{j}") / F.col("n")).alias("g")) for j in range(WIDTH + 1)])).alias("p")
    return sums.select(per).groupBy("p.feature").agg(F.round(F.avg("p.g"), 9).alias("gradient"))
