"""A shuffled order without sorting: a keyed permutation of row numbers.

A row's number in [0, n) goes through a Feistel network over the two parts of its bits; a result beyond n - 1 goes
through again (cycle walking), which keeps the map one-to-one on [0, n). An epoch's order is one such
expression with the epoch's key: rows are numbered once, and no epoch moves or sorts any of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ranges import PART, in_ranges
from quire.operators.ranking import two_level_rank
from quire.operators.splits import _fan_out, ranked_prompts
from quire.sources import literals as L

#: Passes of the round function (even), and its odd multipliers.
ROUNDS, MULTIPLY, SPREAD, STEP = 4, 40_503, 31_153, 7_919
#: Passes of the network at most: over half of all numbers are below n after each.
WALK = 96


def _once(x: str, key: str) -> str:
    """One pass of the network over ``x``, whose low ``b2`` bits are its right part and the ``b1`` above its left one."""
    mixed = f"(p.r + ({key}) * {STEP} + k) * {MULTIPLY}"
    mixed = f"(shiftright(({mixed} & 4294967295L) * {SPREAD}, 9) & (shiftleft(1L, if(k % 2 = 1, b1, b2)) - 1))"
    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('l', shiftright({x}, b2), 'r', {x} & (shiftleft(1L, b2) - 1)), "
            f"(p, k) -> named_struct('l', p.r, 'r', p.l ^ {mixed}), p -> shiftleft(p.l, b2) | p.r)")


def with_place(df: DataFrame, number: str, n: str, key: str, name: str = "place") -> DataFrame:
    """``df`` with the place in [0, n) of the row ``number`` in the order of ``key`` (all bigint columns; n below 2 ** 62)."""
    keep = df.columns
    bits = df.withColumn("bits", F.expr(f"greatest(2, length(bin(greatest({n} - 1, 1))))")).withColumn("b1", F.expr("int(bits div 2)")).withColumn("b2", F.expr("bits - b1"))
    # both parts change sides in a pass: after an even number of them, each is as wide as before
    walk = f"aggregate(sequence(1, {WALK}), {_once(number, key)}, (x, i) -> if(x < {n}, x, {_once('x', key)}))"
    return bits.withColumn(name, F.expr(walk)).select(*keep, name)


def permuted_batch_plan(spark: SparkSession, sf_dir: str, epochs: int = L.NUM_EPOCHS) -> DataFrame:
    """Every train example's place, micro-batch and step in each epoch; one numbering serves all epochs."""
    train = _fan_out(ranked_prompts(spark, sf_dir), L.DEFAULT_TEMPERATURES).where(F.col("split") == "train").select("prompt_id", "temp_idx")
    numbered = two_level_rank(in_ranges(train, "prompt_id", "temp_idx"), F.col(PART), [F.col("prompt_id"), F.col("temp_idx")], name="number", total="n")
    ep = numbered.select("prompt_id", "temp_idx", (F.col("number") - 1).alias("number"), "n", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    placed = with_place(ep.withColumn("key", F.col("epoch").cast("bigint") + L.SHUFFLE_SEED), "number", "n", "key")
    per_step = L.MICRO_BATCH * L.GRAD_ACCUMULATION
    return placed.select("epoch", "prompt_id", "temp_idx", "place", F.expr(f"place div {L.MICRO_BATCH}").alias("micro_batch"),
                         F.expr(f"epoch * bigint(ceil(n / {per_step})) + place div {per_step}").alias("global_step"))
