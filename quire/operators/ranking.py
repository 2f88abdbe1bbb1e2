"""Exact global ordering without a single-partition exchange.

``two_level_rank`` numbers rows 1..n in a total order in parallel: rows are put
into buckets that are monotone in the order (an md5 prefix or ranges
between quantiles), the (small, bounded) bucket-count table is prefix-summed, and the
local ``row_number`` inside each bucket is offset by it.  This is the building
block for the shuffle order, the splits, the progress counter, the batch plan
and the segmented lag (``segmented_lag``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import seeded_key
from quire.sources import literals as L


def bucket_count(spark: SparkSession, floor: int = 64, cap: int = 65536) -> int:
    """Buckets for the two-level schemes: ~16 per core of the running session.

    More buckets than tasks keep every bucket small enough for one task even when
    the data is large; the bucket table itself stays small enough to broadcast.
    """
    return max(floor, min(cap, 16 * spark.sparkContext.defaultParallelism))


def hex_digits(spark: SparkSession) -> int:
    """md5 prefix length giving at least ``bucket_count`` buckets (3 → 4096, 4 → 65536)."""
    return max(3, min(4, math.ceil(math.log(bucket_count(spark), 16))))


def hex_bucket(md5_col: Column, digits: int = 3) -> Column:
    return F.substring(md5_col, 1, digits)


def range_bucket(df: DataFrame, col: str, n: int | None = None) -> Column:
    """Monotone bucket of a numeric key between approximate quantiles of the keys that are there.

    Buckets follow the rows, not the key's range: an outlier or a gap doesn't push all rows into
    one. The boundaries are ``n`` numbers at most, from one mergeable sketch over all rows.
    """
    n = n or min(256, bucket_count(df.sparkSession))
    if n < 2:
        return F.lit(0)
    bounds = sorted(set(df.approxQuantile(col, [i / n for i in range(1, n)], 1.0 / (4 * n))))
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(float(b)) for b in bounds])
    return F.size(F.filter(arr, lambda b: b <= F.col(col).cast("double")))


def two_level_rank(df: DataFrame, bucket: Column, order: Sequence[Column],
                   partition: Sequence[str] = (), name: str = "rank",
                   total: str | None = None) -> DataFrame:
    """Append ``name`` = row_number() over (partition by ``partition`` order by ``order``).

    ``bucket`` must be non-decreasing along ``order`` within each partition.  The
    order must be total (end it with a unique id).  The bucket table has at most
    (#partitions x #buckets) rows, so it is broadcast.
    """
    part = list(partition)
    d = df.withColumn("_bkt", bucket)
    counts = d.groupBy(*part, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*part).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *part, "_bkt",
        F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*part)).alias("_tot"))
    local = Window.partitionBy(*part, "_bkt").orderBy(*order)
    ranked = d.withColumn("_loc", F.row_number().over(local))
    out = (ranked.join(F.broadcast(offsets), [*part, "_bkt"])
           .withColumn(name, (F.col("_off") + F.col("_loc")).cast("bigint")))
    if total:
        out = out.withColumn(total, F.col("_tot").cast("bigint"))
    return out.drop("_bkt", "_n", "_off", "_loc", "_tot")


def seeded_order(df: DataFrame, id_col: str, seed=L.SHUFFLE_SEED, name: str = "shuffle_rank",
                 total: str | None = None, partition: Sequence[str] = (),
                 seed_col: Column | None = None) -> DataFrame:
    """Seeded shuffle: order by md5('seed:id'), id as tie-break, numbered exactly."""
    key = (F.md5(F.concat(seed_col.cast("string"), F.lit(":"), F.col(id_col).cast("string")))
           if seed_col is not None else seeded_key(seed, F.col(id_col)))
    d = df.withColumn("shuffle_key", key)
    return two_level_rank(d, hex_bucket(F.col("shuffle_key"), hex_digits(df.sparkSession)),
                          [F.col("shuffle_key"), F.col(id_col)], partition, name, total)


def split_label(rank: Column, total: Column, ratio: float = L.TRAIN_RATIO) -> Column:
    """``idx < int(n * ratio)`` on the 0-based index, float arithmetic as in Python."""
    threshold = F.floor(total.cast("double") * F.lit(float(ratio)))
    return F.when((rank - 1) < threshold, F.lit("train")).otherwise(F.lit("valid"))


def segmented_lag(df: DataFrame, partition: Sequence[str], order: str, value: str,
                  bucket: Column, name: str) -> DataFrame:
    """``lag(value) over (partition by … order by order)`` that stays parallel on hot groups.

    The lag is taken inside (partition, bucket) sub-groups; the first row of each
    sub-group picks up the last value of the previous non-empty sub-group from a
    small per-bucket table.  ``order`` must be unique within a partition.
    """
    part = list(partition)
    d = df.withColumn("_bkt", bucket)
    w = Window.partitionBy(*part, "_bkt").orderBy(order)
    inner = d.withColumn("_lag", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = (d.groupBy(*part, "_bkt")
            .agg(F.max_by(F.col(value), F.col(order)).alias("_last")))
    prev = last.select(*part, "_bkt",
                       F.lag("_last").over(Window.partitionBy(*part).orderBy("_bkt")).alias("_prev"))
    out = inner.join(prev, [*part, "_bkt"], "left")
    return (out.withColumn(name, F.when(F.col("_first"), F.col("_prev")).otherwise(F.col("_lag")))
            .drop("_bkt", "_lag", "_first", "_prev"))
