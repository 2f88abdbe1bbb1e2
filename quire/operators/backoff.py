"""Interpolated Kneser-Ney model of three words, scored on held-out texts.

Every text is split into words once, and the words are written. Lower orders count continuations: in how many different
contexts a word (pair) was seen. The valid triples meet the model by equi-joins from the longest order down; a context
that was never seen hands all of its mass to the next shorter one, and an unknown word gets the uniform rest.

A triple takes ten times the disk of the word it adds, and each order shuffles it again. So the model is built in slices by a hash
of the middle word: both contexts of a triple and all their continuations lie in its slice, and a slice's shuffles go
before the next one starts. Only what order one needs, in how many contexts a word was seen, is added up over slices.

Sides are told apart by the seeded order of the ids (as in ``heldout_perplexity``); its cut is one key, so no
text is joined with its side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.operators.ranking import seeded_order
from quire.session import scratch_path, shuffles_dropped
from quire.sources import literals as L

DISCOUNT = 0.75
ORDERS = [1, 2, 3]
START = ""  # stands before the first words; no word is empty
#: Words of a slice in the mean, and slices at most: beyond, slices grow, and the disk stays the same multiple of the input.
SLICE_WORDS, MOST_SLICES = 2_000_000, 16
#: What the orders 2 and 3 need of a triple's contexts.
CONTEXT = ["c3", "n3", "t3", "c2", "n2", "t2"]


def train_side(ids: DataFrame) -> Column:
    """True for the ids (doc_id) among the first TRAIN_RATIO of the seeded order."""
    ranked = seeded_order(ids, "doc_id", name="rank", total="n")
    cut = ranked.where(F.col("rank") == F.floor(F.col("n").cast("double") * F.lit(L.TRAIN_RATIO))).agg(F.max(F.struct("shuffle_key", "doc_id"))).scalar()
    return F.coalesce(F.struct(T.seeded_key(L.SHUFFLE_SEED, F.col("doc_id")).alias("shuffle_key"), F.col("doc_id")) <= cut, F.lit(False))


def _words(docs: DataFrame, is_train: Column) -> DataFrame:
    """``train, toks`` of each text (doc_id, text)."""
    return docs.select(is_train.alias("train"), T.words(F.lower(F.col("text"))).alias("toks"))


def _count_triples(toks: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """``u, v, w, c, asked`` of the triples whose middle word falls into the part."""
    n = F.size("toks")
    padded = F.concat(F.array(F.lit(START), F.lit(START)), F.col("toks"))
    triples = F.arrays_zip(F.slice(padded, F.lit(1), n).alias("u"), F.slice(padded, F.lit(2), n).alias("v"), F.col("toks").alias("w"))
    rows = toks.select("train", F.explode_outer(triples).alias("t")).where(F.col("t").isNotNull()).select("train", "t.*")
    rows = rows.where("u IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL")  # as joins ask of some branches: they share one shuffle
    if parts > 1:
        rows = rows.where(_part_of("v", parts) == part)
    return rows.groupBy("u", "v", "w").agg(F.count_if("train").alias("c"), F.count_if(~F.col("train")).alias("asked"))


def _part_of(word: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(parts))


def triple_counts(docs: DataFrame, is_train: Column) -> DataFrame:
    """``u, v, w, c, asked``: how often each triple stands in train and in valid texts (doc_id, text)."""
    return _count_triples(_words(docs, is_train))


def _pairs(seen: DataFrame) -> DataFrame:
    """``v, w, c2``: before which pairs how many different words were seen."""
    return seen.groupBy("v", "w").agg(F.count_if(F.col("c") > 0).alias("c2"))


def _first_words(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("w").agg(F.count_if(F.col("c2") > 0).alias("c1"))


def _contexts(seen: DataFrame, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked (u, v, w, c3, ...)`` with the counts of its contexts of two words and of one."""
    ctx3 = seen.groupBy("u", "v").agg(F.sum("c").alias("n3"), F.count("*").alias("t3"))
    ctx2 = pairs.groupBy("v").agg(F.sum("c2").alias("n2"), F.count("*").alias("t2"))
    return asked.join(ctx3, ["u", "v"], "left").join(pairs, ["v", "w"], "left").join(ctx2, "v", "left")


def _interpolated(j: DataFrame, n1: Column, t1: Column) -> DataFrame:
    """``j`` (CONTEXT, c1) with p1, p2 and p3."""
    j = j.withColumns({"n1": n1, "t1": t1})
    lower = F.lit(1.0) / (F.coalesce("t1", F.lit(0)) + 1)
    for k in ORDERS:
        own = F.greatest(F.coalesce(f"c{k}", F.lit(0)) - DISCOUNT, F.lit(0.0)) / F.col(f"n{k}")
        rest = F.lit(DISCOUNT) * F.col(f"t{k}") / F.col(f"n{k}")
        j = j.withColumn(f"p{k}", F.when(F.col(f"n{k}") > 0, own + rest * lower).otherwise(lower))
        lower = F.col(f"p{k}")
    return j


def probabilities(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked (u, v, w, ...)`` with p1, p2 and p3 under the model of ``counts (u, v, w, c)``."""
    seen = counts.where("c > 0")
    pairs = _pairs(seen)
    words = _first_words(pairs)
    total = words.agg(F.sum("c1").alias("n1"), F.count("*").alias("t1"))  # one row
    known = asked.join(seen.select("u", "v", "w", F.col("c").alias("c3")), ["u", "v", "w"], "left")
    j = _interpolated(_contexts(seen, pairs, known).join(words, "w", "left"), total.select("n1").scalar(), total.select("t1").scalar())
    return j.select(*asked.columns, "p1", "p2", "p3")


def _slice(toks: DataFrame, part: int, parts: int) -> DataFrame:
    """One slice: each valid triple as ``w, asked`` with its CONTEXT, and each train word as ``w, c1``."""
    counts = _count_triples(toks, part, parts)
    # each branch asks for both counts, so that all share one shuffle of the triples
    seen, asked = counts.where("c > 0 AND asked >= 0"), counts.where("asked > 0 AND c >= 0")
    pairs = _pairs(seen)
    known = asked.select("u", "v", "w", "asked", F.nullif(F.col("c"), F.lit(0)).alias("c3"))
    rows = _contexts(seen, pairs, known).select("w", "asked", *CONTEXT)
    return rows.unionByName(_first_words(pairs), allowMissingColumns=True)


def _in_slices(toks: DataFrame) -> DataFrame:
    """All slices' rows, each slice written on its own."""
    spark, path = toks.sparkSession, scratch_path(toks.sparkSession, "triples")
    n = toks.agg(F.sum(F.size("toks"))).first()[0] or 0
    parts = max(1, min(MOST_SLICES, -(-n // SLICE_WORDS)))
    for part in range(parts):
        with shuffles_dropped(spark):
            _slice(toks, part, parts).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _losses(rows: DataFrame, n1: int | None, t1: int, part: int, parts: int) -> DataFrame:
    """``order, n, loss`` over the valid triples whose last word falls into the part."""
    own = rows.where(_part_of("w", parts) == part)
    words = own.where("c1 IS NOT NULL").groupBy("w").agg(F.sum("c1").alias("c1"))
    asked = own.where("asked IS NOT NULL").select("w", "asked", *CONTEXT).join(words, "w", "left")
    p = _interpolated(asked, F.lit(n1).cast("bigint"), F.lit(t1).cast("bigint"))
    losses = F.explode(F.array(*[F.struct(F.lit(k).alias("order"), (-F.col("asked") * F.log(f"p{k}")).alias("loss")) for k in ORDERS])).alias("l")
    return p.select("asked", losses).groupBy("l.order").agg(F.sum("asked").alias("n"), F.sum("l.loss").alias("loss"))


def backoff_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, mean loss and perplexity of the valid texts by the longest order used."""
    docs = tables.texts(spark, sf_dir, "doc_id", "text")
    path = scratch_path(spark, "words")
    with shuffles_dropped(spark):
        _words(docs, train_side(tables.table(spark, sf_dir, "documents", "doc_id"))).where(F.size("toks") > 0).write.option("compression", "zstd").parquet(path)
    rows = _in_slices(spark.read.parquet(path))
    with shuffles_dropped(spark):
        n1, t1 = rows.where("c1 IS NOT NULL").agg(F.sum("c1"), F.count_distinct("w")).first()
    parts = max(1, min(MOST_SLICES, -(-rows.where("asked IS NOT NULL").count() // SLICE_WORDS)))
    sums = scratch_path(spark, "losses")
    for part in range(parts):
        with shuffles_dropped(spark):
            _losses(rows, n1, t1, part, parts).write.mode("append").parquet(sums)
    g = spark.read.parquet(sums).groupBy("order").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    mean = F.col("loss") / F.col("n")
    return g.select("order", F.col("n").cast("bigint").alias("n_tokens"), F.round(mean, 6).alias("mean_loss"), F.round(F.exp(mean), 3).alias("perplexity"))
