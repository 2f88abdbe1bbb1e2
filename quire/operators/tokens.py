"""Token arrays: fixed-length windows with padding and label masks, shifted pairs.

Everything is array work on the row (``transform``/``zip_with``/``aggregate``),
so a document never leaves its partition and nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.functions.arrays import positional_sum
from quire.sources import literals as L

VOCAB = 50000
PAD_ID = 0          # pad = end token, so end labels are masked as well
IGNORE_INDEX = -100
PAIR_MOD = 1000003


def token_ids(text: Column, vocab: int = VOCAB) -> Column:
    return F.transform(T.words(text), lambda t: T.token_id(t, vocab))


def windows(ids: Column, n_kept: Column, max_length: int = L.MAX_LENGTH, mask_eos: bool = True):
    """Truncate / pad to ``max_length``; labels are ids with pad positions set to −100.

    Lambdas only touch their own element: an outer column inside a lambda would
    be re-evaluated per element.
    """
    kept = F.slice(ids, 1, max_length)
    pad = F.lit(max_length) - n_kept
    input_ids = F.concat(kept, F.array_repeat(F.lit(PAD_ID).cast("bigint"), pad))
    if mask_eos:
        labels = F.transform(input_ids, lambda x: F.when(x == PAD_ID, F.lit(IGNORE_INDEX)
                                                         .cast("bigint")).otherwise(x))
    else:
        labels = F.concat(kept, F.array_repeat(F.lit(IGNORE_INDEX).cast("bigint"), pad))
    attention = F.concat(F.array_repeat(F.lit(1), n_kept), F.array_repeat(F.lit(0), pad))
    return input_ids, labels, attention


def token_windows(spark: SparkSession, sf_dir: str, max_length: int = L.MAX_LENGTH) -> DataFrame:
    d = tables.texts(spark, sf_dir, "doc_id", "text")
    t = (d.select("doc_id", token_ids(F.col("text")).alias("ids"))
         .select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                 F.slice("ids", 1, max_length).alias("kept")))
    t = t.withColumn("n_kept", F.size("kept"))
    input_ids, labels, attention = windows(F.col("kept"), F.col("n_kept"), max_length)
    w = t.select("doc_id", "n_tokens", "n_kept", input_ids.alias("input_ids"),
                 labels.alias("labels"), attention.alias("attn"))
    return w.select(
        "doc_id", "n_tokens", F.col("n_kept").cast("bigint").alias("n_kept"),
        (F.col("n_tokens") > max_length).alias("truncated"),
        positional_sum(F.col("input_ids")).alias("id_checksum"),
        positional_sum(F.col("labels")).alias("label_checksum"),
        F.aggregate("attn", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_attended"))


def shifted_pairs(ids: Column) -> Column:
    """(x[:-1], x[1:]) zipped as one code per pair."""
    n = F.size(ids)
    prev = F.slice(ids, 1, F.greatest(n - 1, F.lit(0)))
    nxt = F.slice(ids, 2, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(prev, nxt, lambda a, b: F.pmod(a * 50021 + b, F.lit(PAIR_MOD)))


def next_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.texts(spark, sf_dir, "doc_id", "text")
    ids = d.select("doc_id", token_ids(F.col("text")).alias("ids"))
    p = ids.select("doc_id", shifted_pairs(F.col("ids")).alias("pairs"))
    return p.select("doc_id", F.size("pairs").cast("bigint").alias("n_pairs"),
                    positional_sum(F.col("pairs")).alias("pair_checksum"))
