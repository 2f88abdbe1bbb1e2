"""Low-rank factors of the quantisation residual, for vectors of any width.

A randomised range finder: a d x k basis is multiplied by the residuals and their transpose, in
turns, and made orthonormal. Each task adds up its share of the d x k product, Spark adds up the shares, and the
driver holds d x k cells; the d x d matrix of all residuals never exists. The right factor is the basis, turned
to the principal directions; the left factor has a row per vector, computed in the vector's own task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.quant import residuals
from quire.session import scratch_path

RANK, EXTRA, TURNS, SEED = 8, 8, 6, 42


def _matrix(batch) -> np.ndarray:
    return np.asarray(batch.column("r").flatten(), np.float64).reshape(batch.num_rows, -1)


def product_sum(res: DataFrame, basis: np.ndarray) -> np.ndarray:
    """RᵀR times ``basis`` for the residuals R of all rows."""
    shape = basis.shape

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                r = _matrix(batch)
                total += r.T @ (r @ basis)
        yield pa.RecordBatch.from_pydict({"cells": pa.array([total.ravel()], pa.list_(pa.float64()))})

    cells = res.select("r").mapInArrow(run, "cells array<double>").select(F.posexplode("cells").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(shape[0] * shape[1])
    for at, x in cells:
        out[at] = x
    return out.reshape(shape)


def right_factor(res: DataFrame, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """d x rank orthonormal directions, strongest first, and the squared residual each one captures."""
    d = res.select(F.max(F.size("r"))).first()[0] or 0
    k = min(d, rank + EXTRA)
    if not k:
        return np.zeros((d, 0)), np.zeros(0)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, k)))[0]
    for _ in range(TURNS):
        basis = np.linalg.qr(product_sum(res, basis))[0]
    small = basis.T @ product_sum(res, basis)
    w, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(w)[::-1][:min(rank, d)]
    return basis @ turn[:, order], w[order]


def left_factor(res: DataFrame, right: np.ndarray) -> DataFrame:
    """``vec_id, left``: the residual of each vector in the basis ``right``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "left": pa.array(list(_matrix(batch) @ right), pa.list_(pa.float64()))})

    return res.select("vec_id", "r").mapInArrow(run, "vec_id long, left array<double>")


def stored_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "residuals")
    residuals(spark, sf_dir).where("size(r) > 0").write.parquet(path)
    return spark.read.parquet(path)


def lowrank_factors(spark: SparkSession, sf_dir: str, rank: int = RANK) -> DataFrame:
    """Both factors as rows: side, row (vector id or coordinate), component, value. The correction of a vector is
    its left row times the right factor's transpose."""
    res = stored_residuals(spark, sf_dir)
    right, _ = right_factor(res, rank)
    left = left_factor(res, right).select(F.lit("left").alias("side"), F.col("vec_id").alias("row"), F.posexplode("left").alias("component", "value"))
    rows = [("right", i, j, float(x)) for i, line in enumerate(right) for j, x in enumerate(line)]
    return left.unionByName(spark.createDataFrame(rows, "side string, row long, component int, value double"))


def lowrank_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For no and for all directions: values, their squared sum, what stays after the correction, and how far the right
    factor is from orthonormal."""
    res = stored_residuals(spark, sf_dir)
    d = res.select(F.max(F.size("r"))).first()[0] or 0
    out = []
    for rank in sorted({0, d}):
        right, _ = right_factor(res, rank) if rank else (np.zeros((d, 0)), None)
        off = float(np.abs(right.T @ right - np.eye(right.shape[1])).max(initial=0.0))
        taken = left_factor(res, right).select(F.sum(F.aggregate("left", F.lit(0.0), lambda s, x: s + x * x)).alias("taken"))
        all_ = res.agg(F.sum(F.size("r")).alias("n_values"), F.sum(F.aggregate("r", F.lit(0.0), lambda s, x: s + x * x)).alias("trace"))
        row = all_.withColumn("taken", taken.scalar()).select(
            F.lit(rank).alias("rank"), "n_values", F.round("trace", 6).alias("trace"),
            F.round(F.greatest(F.col("trace") - F.col("taken"), F.lit(0.0)) / F.col("n_values"), 9).alias("mse"), F.lit(round(off, 6)).alias("off_orthonormal"))
        out.append(row)
    return out[0].unionByName(out[-1]) if len(out) > 1 else out[0]
