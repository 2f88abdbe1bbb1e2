"""Mixed-precision group quantisation of a vector table.

The precision policy is an ordered ``CASE`` over parameter paths; quantisation
is array maths per row (no shuffle); error and footprint are partial + final
hash aggregates over a constant fan-out (the 4 bit widths).  The low-rank
correction needs the residual Gram matrix (d × d): each task builds its partial
Gram with numpy (``mapInPandas``), Spark sums the d² cells, the driver takes
the eigenvectors of that constant-size matrix, and every row is corrected with
them as a literal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import tables
from quire.functions.arrays import let
from quire.sources import literals as L

LAYER_RE = r"(?:^|\.)layers\.(\d+)(?:\.|$)"
NF4_BLOCK = 64               # values of a block, which share a scale
NF4_DQ_BLOCK = 256           # scales are quantised again per 256 blocks
NF4_DQ_LEVELS = 127
TOPK = 10
LOWRANK_BITS = 3
RANKS = [0, 8, 16, 32, 64]


# ---------------------------------------------------------------- policy
def layer_number(path: Column) -> Column:
    return F.regexp_extract(path, LAYER_RE, 1).try_cast("int")


def precision_bits(path: Column, is_linear: Column, num_layers: Column) -> Column:
    """First matching rule wins; non-linear parameters are not quantised (NULL)."""
    layer = layer_number(path)
    first = layer.isNotNull() & (layer < L.POLICY_FIRST_N)
    last = layer.isNotNull() & (layer >= num_layers - L.POLICY_LAST_N)
    return (F.when(~is_linear, F.lit(None).cast("int"))
            .when(path.contains(L.POLICY_HIGH_ALWAYS[0]) | path.contains(L.POLICY_HIGH_ALWAYS[1]),
                  F.lit(L.POLICY_HIGH_BITS))
            .when(path.contains(L.POLICY_HIGH_EDGE) & (first | last), F.lit(L.POLICY_HIGH_BITS))
            .when(path.contains(L.POLICY_HIGH_LAST) & last, F.lit(L.POLICY_HIGH_BITS))
            .otherwise(F.lit(L.POLICY_BASE_BITS)))


def _policy(seg: DataFrame) -> DataFrame:
    """Bits and group size by path; the number of layers is that of the paths themselves."""
    linear = F.col("module") != "norm"
    layers = seg.select((F.max(layer_number(F.col("path"))) + 1).alias("n")).scalar()
    return (seg.withColumn("bits", precision_bits(F.col("path"), linear, layers))
            .withColumn("group_size", F.when(linear, F.lit(L.POLICY_GROUP_SIZE))))


def precision_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _policy(tables.segments(spark, sf_dir))
    return (seg.groupBy("path", "module", "bits", "group_size")
            .agg(F.count(F.lit(1)).alias("n_vectors"))
            .withColumn("layer", layer_number(F.col("path"))))


# ---------------------------------------------------------------- affine group quantisation
def quantize_groups(v: Column, bits: Column, group: int = L.POLICY_GROUP_SIZE) -> Column:
    """ARRAY<STRUCT<mn, scale, x, q>> per group of ``group`` values (b-bit affine)."""
    levels = (F.pow(F.lit(2.0), bits) - 1)
    n_groups = F.ceil(F.size(v) / F.lit(group)).cast("int")

    def per_row(s):
        groups = F.transform(F.sequence(F.lit(0), s["ng"] - 1),
                             lambda k: F.slice(s["v"], k * group + 1, group))
        stats = F.transform(groups, lambda a: F.struct(
            F.array_min(a).alias("mn"),
            ((F.array_max(a) - F.array_min(a)) / s["lv"]).alias("scale"), a.alias("x")))
        return F.transform(stats, lambda g: F.struct(
            g["mn"].alias("mn"), g["scale"].alias("scale"), g["x"].alias("x"),
            F.transform(g["x"], lambda x: F.when(g["scale"] > 0, F.least(F.greatest(
                F.round((x - g["mn"]) / g["scale"]), F.lit(0.0)), s["lv"])).otherwise(F.lit(0.0))
                .cast("int")).alias("q")))

    return let({"v": v, "lv": levels, "ng": n_groups}, per_row)


def group_errors(groups: Column) -> Column:
    """STRUCT<sse, maxabs, n> over all groups of a row."""
    per = F.transform(groups, lambda g: F.zip_with(
        g["x"], g["q"], lambda x, q: g["mn"] + q * g["scale"] - x))
    errs = F.flatten(per)
    return F.struct(F.aggregate(errs, F.lit(0.0), lambda a, e: a + e * e).alias("sse"),
                    F.array_max(F.transform(errs, lambda e: F.abs(e))).alias("maxabs"),
                    F.size(errs).alias("n"))


def code_checksum(groups: Column) -> Column:
    codes = F.flatten(F.transform(groups, lambda g: g["q"]))
    return F.aggregate(F.transform(codes, lambda q, i: q.cast("bigint") * (i + 1)),
                       F.lit(0).cast("bigint"), lambda a, b: a + b)


def _with_bits(v: DataFrame) -> DataFrame:
    return v.select("*", F.explode(F.array(*[F.lit(b) for b in L.QUANT_BITS])).alias("bits"))


def quantize_groupwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group of every vector at each width: scale, bias, codes (as hex, two digits a code) and error."""
    v = _with_bits(tables.vectors(spark, sf_dir))
    q = v.select("vec_id", "bits", F.posexplode(quantize_groups(F.col("v"), F.col("bits"))).alias("grp", "g"))
    err = F.zip_with("g.x", F.transform("g.q", lambda c: F.col("g.mn") + c * F.col("g.scale")), lambda x, y: y - x)
    codes = F.array_join(F.transform("g.q", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return q.select("vec_id", "bits", "grp", F.round("g.scale", 12).alias("scale"), F.round("g.mn", 12).alias("bias"), codes.alias("codes"),
                    F.round(F.aggregate(err, F.lit(0.0), lambda a, e: a + e * e), 12).alias("sse"))


def quant_error_by_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _with_bits(tables.vectors(spark, sf_dir))
    e = v.select("bits", group_errors(quantize_groups(F.col("v"), F.col("bits"))).alias("e"))
    return (e.groupBy("bits")
            .agg(F.sum("e.sse").alias("sse"), F.sum("e.n").alias("n_values"),
                 F.max("e.maxabs").alias("max_abs"))
            .select("bits", F.col("n_values").cast("bigint").alias("n_values"),
                    F.round(F.col("sse") / F.col("n_values"), 12).alias("mse"),
                    F.round("max_abs", 9).alias("max_abs")))


def quantize_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row at its policy's bit width; non-quantised rows stay exact."""
    seg = _policy(tables.segments(spark, sf_dir))
    e = seg.select("bits", F.when(F.col("bits").isNull(), F.struct(
        F.lit(0.0).alias("sse"), F.lit(0.0).alias("maxabs"), F.size("v").alias("n")))
        .otherwise(group_errors(quantize_groups(F.col("v"), F.col("bits")))).alias("e"))
    return (e.groupBy("bits")
            .agg(F.count(F.lit(1)).alias("n_vectors"), F.sum("e.sse").alias("sse"),
                 F.sum("e.n").alias("n_values"))
            .select("bits", "n_vectors",
                    F.round(F.col("sse") / F.col("n_values"), 12).alias("mse")))


# ---------------------------------------------------------------- NF4
def nf4_codes(v: Column) -> Column:
    """Index of the nearest NF4 code for x / absmax (ties to the lower code)."""
    mids = L.double_array(L.NF4_MIDPOINTS)
    absmax = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return let({"v": v, "am": absmax}, lambda s: F.transform(
        s["v"], lambda x: F.size(F.filter(mids, lambda m: m < F.when(
            s["am"] > 0, x / s["am"]).otherwise(F.lit(0.0))))))


def quantize_nf4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-bit normal-float codes per block of 64 values, then 8-bit quantisation of the
    block scales per group of 256 blocks (double quantisation).

    With codes c, values x and a scale s, a block's squared error is s²·Σc² − 2s·Σcx + Σx², so
    only those sums and the largest value of each block are shuffled, never the vectors."""
    codes = L.double_array(L.NF4_CODES)
    v = tables.vectors(spark, sf_dir)
    n_blocks = F.ceil(F.size("v") / F.lit(NF4_BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: F.slice("v", k * NF4_BLOCK + 1, NF4_BLOCK))
    b = v.select("vec_id", n_blocks.alias("n_blocks"), F.posexplode(blocks).alias("blk", "x"))
    b = b.select("vec_id", "n_blocks", "blk", "x", F.array_max(F.transform("x", lambda x: F.abs(x))).alias("absmax"),
                 F.transform(nf4_codes(F.col("x")), lambda i: F.element_at(codes, i + 1)).alias("c"))

    def total(pairs: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda a, y: a + y)

    b = b.select(F.expr(f"(vec_id * n_blocks + blk) div {NF4_DQ_BLOCK}").alias("dq_group"), "absmax", F.size("x").alias("n"),
                 total(F.zip_with("c", "c", lambda p, q: p * q)).alias("cc"), total(F.zip_with("c", "x", lambda p, q: p * q)).alias("cx"),
                 total(F.zip_with("x", "x", lambda p, q: p * q)).alias("xx"))
    grp = Window.partitionBy("dq_group")
    b = b.withColumn("mean_s", F.avg("absmax").over(grp))
    b = b.withColumn("amax2", F.max(F.abs(F.col("absmax") - F.col("mean_s"))).over(grp))
    step = F.col("amax2") / F.lit(float(NF4_DQ_LEVELS))
    b = b.withColumn("absmax_dq", F.when(F.col("amax2") > 0, F.col("mean_s") + F.round(
        (F.col("absmax") - F.col("mean_s")) / step) * step).otherwise(F.col("absmax")))

    def sse(scale: str) -> Column:
        s = F.col(scale)
        return s * s * F.col("cc") - 2 * s * F.col("cx") + F.col("xx")

    e = b.select("dq_group", sse("absmax").alias("sse"), sse("absmax_dq").alias("sse_dq"), "n")
    return (e.groupBy("dq_group")
            .agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("sse").alias("a"),
                 F.sum("sse_dq").alias("b"), F.sum("n").alias("n"))
            .select("dq_group", "n_blocks", F.round(F.col("a") / F.col("n"), 10).alias("mse_nf4"),
                    F.round(F.col("b") / F.col("n"), 10).alias("mse_nf4_dq")))


# ---------------------------------------------------------------- fidelity and footprint
def top_k_index(arr: Column, k: int = TOPK) -> Column:
    """Positions of the k largest values (ties → lower position)."""
    keyed = F.transform(arr, lambda x, i: F.struct((-x).alias("k"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["i"])


def topk_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall@10 of each row's top-10 coordinates (its top-10 'next tokens' when the
    row is read as logits) after quantisation, per bit width."""
    v = _with_bits(tables.vectors(spark, sf_dir))
    g = v.select("bits", "v", quantize_groups(F.col("v"), F.col("bits")).alias("g"))
    deq = F.flatten(F.transform("g", lambda gr: F.transform(gr["q"], lambda q: gr["mn"] + q * gr["scale"])))
    r = g.select("bits", F.size(F.array_intersect(top_k_index(F.col("v")), top_k_index(deq)))
                 .alias("hits"))
    return (r.groupBy("bits")
            .agg(F.count(F.lit(1)).alias("n_vectors"),
                 F.round(F.avg(F.col("hits") / F.lit(float(TOPK))), 6).alias("recall_at_10")))


def footprint_by_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of codes + per-group scale and bias (fp32) for uniform and mixed schemes."""
    seg = _policy(tables.segments(spark, sf_dir)).select(F.size("v").alias("d"), "bits")
    uni = seg.select("d", F.explode(F.array(*[F.lit(b) for b in L.QUANT_BITS])).alias("bits"))
    uni = uni.select(F.concat(F.lit("uniform_"), F.col("bits").cast("string")).alias("scheme"),
                     "bits", "d")
    mixed = seg.select(F.lit("mixed").alias("scheme"), "bits", "d")
    both = uni.unionByName(mixed)
    d = F.col("d")
    groups = F.ceil(d / F.lit(L.POLICY_GROUP_SIZE))
    size = F.when(F.col("bits").isNull(), d * 4).otherwise(
        F.ceil(d * F.col("bits") / F.lit(8.0)) + groups * 8)
    return (both.groupBy("scheme")
            .agg(F.count(F.lit(1)).alias("n_vectors"), F.sum(size).cast("bigint").alias("total_bytes"),
                 F.sum(d * 4).cast("bigint").alias("fp32_bytes"))
            .withColumn("ratio", F.round(F.col("total_bytes") / F.col("fp32_bytes"), 6)))


# ---------------------------------------------------------------- low-rank correction
def _partial_gram(batches):
    acc, n = None, 0
    for pdf in batches:
        if len(pdf) == 0:
            continue
        r = np.stack(pdf["r"].to_numpy())
        g = r.T @ r
        acc = g if acc is None else acc + g
        n += len(pdf)
    if acc is not None:
        yield pd.DataFrame({"cells": [acc.ravel()], "n": [n]})


def residuals(spark: SparkSession, sf_dir: str, bits: int = LOWRANK_BITS) -> DataFrame:
    v = tables.vectors(spark, sf_dir)
    g = v.select("vec_id", quantize_groups(F.col("v"), F.lit(bits)).alias("g"))
    r = F.flatten(F.transform("g", lambda gr: F.zip_with(gr["x"], gr["q"],
                                                         lambda x, q: x - (gr["mn"] + q * gr["scale"]))))
    return g.select("vec_id", r.alias("r"))


def _rank_errors(basis: np.ndarray, ranks: tuple[int, ...]):
    """Per batch: residual energy left after projecting on the first k directions."""
    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            r = np.stack(pdf["r"].to_numpy())
            c2 = np.square(r @ basis.T)                 # coefficients on the directions
            left = np.square(r).sum(axis=1, keepdims=True) - np.concatenate(
                [np.zeros((len(r), 1)), np.cumsum(c2, axis=1)], axis=1)
            left = np.maximum(left, 0.0)
            yield pd.DataFrame({"rank": list(ranks),
                                "sse": [float(left[:, k].sum()) for k in ranks],
                                "n": [int(r.size)] * len(ranks)})
    return run


def lowrank_correction(spark: SparkSession, sf_dir: str, ranks=tuple(RANKS)) -> DataFrame:
    """Error left after adding a rank-k correction of the 3-bit residual, per k.

    Pass 1: each task folds its rows into a partial d×d Gram matrix (numpy); Spark
    sums the d² cells; the driver takes the eigenvectors of that constant-size
    matrix.  Pass 2: each task projects its rows on the directions (numpy, one
    matrix product per Arrow batch) and emits per-rank partial sums that Spark
    aggregates.  No row ever leaves its partition.
    """
    res = residuals(spark, sf_dir).select("r")
    partial = res.mapInPandas(_partial_gram, "cells ARRAY<DOUBLE>, n BIGINT")
    cells = (partial.select(F.posexplode("cells").alias("pos", "c"))
             .groupBy("pos").agg(F.sum("c").alias("c")).orderBy("pos").collect())
    d = int(round(len(cells) ** 0.5))
    gram = np.array([row["c"] for row in cells]).reshape(d, d)
    w, vecs = np.linalg.eigh(gram)
    basis = vecs[:, np.argsort(w)[::-1]].T          # rows = principal directions
    if any(not 0 <= int(k) <= d for k in ranks):
        raise ValueError(f"ranks {ranks} must lie between 0 and the dimension {d}")
    ranks = tuple(int(k) for k in ranks)
    per = res.mapInPandas(_rank_errors(basis, ranks), "rank INT, sse DOUBLE, n BIGINT")
    return (per.groupBy("rank")
            .agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))
            .select("rank", F.round(F.col("sse") / F.col("n"), 9).alias("mse")))
