"""Needle-in-a-haystack: haystack construction and needle search over documents.

Haystacks: one per (benchmark item, context size).  Filler sentences are drawn
with replacement by a seeded hash of the slot number (a broadcast join to the
10-row filler table), the word budget is a prefix sum, and the needle goes in at
the first slot whose preceding words reach half the budget.  Each group holds at
most ``target_words / min_filler_words + 2`` slots, so the per-group windows are
bounded by the context size, not by the data.

Needle search: all documents × all needles without a nested-loop ``contains``
join.  Needles of ≥ 3 tokens are anchored on a hash of their interior tokens
(which appear whole in any document containing the needle, even when the
needle starts or ends mid-word) and joined to the same shingle hashes of the
documents; shorter needles are anchored on their leading characters.  Every
candidate pair is verified with ``instr``, so hash collisions cannot add
false hits and no hit is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.functions.arrays import let
from quire.functions.maps import may_be_in
from quire.session import scratch_path
from quire.sources import literals as L

SHINGLE = 8        # interior tokens used as the anchor of a long needle
QGRAM = 4          # leading characters used as the anchor of a short needle
MAP_WORDS = 1 << 14   # longs of the map that tells a scan which documents hold a candidate
MIN_FILLER_WORDS = min(len(s.split()) for s in L.FILLER_SENTENCES)


# ---------------------------------------------------------------- haystacks
def _fillers(spark: SparkSession) -> DataFrame:
    f = L.filler_df(spark)
    return f.select("choice", "sentence", T.word_count(F.col("sentence")).alias("words"))


def filler_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots per (item, context size) with a seeded choice among the fillers.

    The (item, size) rows are hash-partitioned *before* the slots are generated:
    only these small rows shuffle, the expansion runs in parallel, and the
    per-haystack windows downstream reuse this partitioning (no second exchange).
    """
    items = tables.needles(spark, sf_dir)
    sizes = F.explode(F.array(*[F.lit(s) for s in L.CONTEXT_SIZES])).alias("target_tokens")
    g = items.select("item_id", F.col("text").alias("needle"),
                     T.word_count(F.col("text")).alias("needle_words"), sizes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = g.repartition(parts, "item_id", "target_tokens")
    n_slots = F.expr(f"CAST(target_tokens div 4 div {MIN_FILLER_WORDS} + 2 AS INT)")
    # The needle text rides only on slot 0 (which emits the needle row later),
    # not on every one of the up to target/8 slots.
    slots = F.transform(F.sequence(F.lit(0), n_slots - 1), lambda i: F.struct(
        i.alias("slot"), F.when(i == 0, F.col("needle")).alias("needle")))
    s = (g.select("item_id", "needle_words", "target_tokens", F.explode(slots).alias("sl"))
         .select("item_id", "needle_words", "target_tokens", "sl.needle", "sl.slot"))
    key = F.concat_ws(":", F.lit(str(L.SHUFFLE_SEED)), F.col("item_id").cast("string"),
                      F.col("target_tokens").cast("string"), F.col("slot").cast("string"))
    choice = F.pmod(T.md5_int(key), F.lit(len(L.FILLER_SENTENCES))).cast("int")
    return s.withColumn("choice", choice)


def filler_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = filler_draws(spark, sf_dir)
    return (d.groupBy("item_id", "target_tokens")
            .agg(F.count(F.lit(1)).alias("n_slots"),
                 F.sum(F.col("choice") * (F.col("slot") + 1)).cast("bigint").alias("choice_checksum"),
                 F.count_distinct("choice").alias("n_distinct")))


def haystack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_needle(filler_draws(spark, sf_dir).join(F.broadcast(_fillers(spark)), "choice"))


def place_needle(d: DataFrame) -> DataFrame:
    """Kept filler rows plus one needle row per haystack, with an ordering key ``pos``."""
    grp = ["item_id", "target_tokens"]
    order = Window.partitionBy(*grp).orderBy("slot")
    whole = Window.partitionBy(*grp)
    target = F.expr("target_tokens div 4")
    d = (d.withColumn("target_words", target)
         .withColumn("prior", F.coalesce(F.sum("words").over(
             order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")))
    half = F.expr("target_words div 2")
    d = d.withColumn("k", F.min(F.when((F.col("prior") >= half) & (F.col("prior") < F.col("target_words")),
                                       F.col("slot"))).over(whole))
    kept = F.when(F.col("k").isNotNull(),
                  (F.col("slot") <= F.col("k"))
                  | (F.col("prior") + F.col("needle_words") < F.col("target_words"))
                  ).otherwise(F.col("prior") < F.col("target_words"))
    d = d.where(kept).withColumn("n_kept", F.count(F.lit(1)).over(whole))
    needle_pos = F.when(F.col("k").isNotNull(), F.col("k")).otherwise(F.expr("n_kept div 2"))
    filler_row = F.struct(F.col("slot").cast("double").alias("pos"), F.col("sentence").alias("sentence"),
                          F.col("words").alias("words"), F.lit(False).alias("is_needle"))
    needle_row = F.struct((needle_pos.cast("double") - F.lit(0.5)).alias("pos"),
                          F.col("needle").alias("sentence"), F.col("needle_words").alias("words"),
                          F.lit(True).alias("is_needle"))
    # Slot 0 is always kept; it also emits the haystack's single needle row.
    rows = F.when(F.col("slot") == 0, F.array(filler_row, needle_row)).otherwise(F.array(filler_row))
    return d.select(*grp, "target_words", "needle_words", F.explode(rows).alias("r")).select(
        *grp, "target_words", "needle_words", "r.*")


def haystack_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = haystack_rows(spark, sf_dir)
    return (r.groupBy("item_id", "target_tokens")
            .agg(F.count_if(~F.col("is_needle")).alias("n_sentences"),
                 F.max(F.when(F.col("is_needle"), F.col("pos") + F.lit(0.5))).cast("bigint")
                 .alias("needle_pos"),
                 F.sum("words").cast("bigint").alias("actual_words"),
                 F.first("target_words").cast("bigint").alias("target_words")))


def haystack_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, target_tokens, needle, prompt, n_words): each haystack in order (at most a context's
    sentences), inside the question. Its word count is the sum of its parts' counts."""
    r = haystack_rows(spark, sf_dir)
    g = (r.groupBy("item_id", "target_tokens")
         .agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("parts"),
              F.max(F.when(F.col("is_needle"), F.col("sentence"))).alias("needle"),
              F.sum("words").cast("bigint").alias("n_words")))
    hay = F.array_join(F.transform("parts", lambda p: p["sentence"]), " ")
    return g.select("item_id", "target_tokens", "needle",
                    F.concat(F.lit(L.HAYSTACK_QUESTION_HEAD), hay, F.lit(L.HAYSTACK_QUESTION_TAIL)).alias("prompt"), "n_words")


def haystack_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered assembly of each haystack, wrapped in the question and chat template."""
    chat = T.chat_prompt(F.col("prompt"))
    return haystack_prompts(spark, sf_dir).select(
        "item_id", "target_tokens", F.md5(chat).alias("prompt_md5"), F.length(chat).cast("bigint").alias("n_chars"), "n_words")


# ---------------------------------------------------------------- needle search
def _windows(parts: Column, k: Column) -> Column:
    """Hash of every run of |k| parts; the sign of k tells tokens from characters."""
    n = F.abs(k)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - n + 1, F.lit(1))),
                       lambda i: F.xxhash64(k, F.slice(parts, i, n)))


def _anchors_of_text(toks: Column, text: Column, used: Column) -> Column:
    """Distinct hashes of a text's runs of the ``used`` lengths, built inside the row in one pass:
    only hashes leave it. Characters are split only where a needle needs them."""
    chars = F.when(F.exists(used, lambda k: k < 0), F.split(text, "")).otherwise(F.array().cast("array<string>"))
    return let({"t": toks, "x": chars, "u": used}, lambda s: F.array_distinct(F.flatten(F.transform(
        s["u"], lambda k: F.when(k > 0, _windows(s["t"], k)).otherwise(_windows(s["x"], k))))))


def _needle_anchors(needles: DataFrame) -> DataFrame:
    """(item_id, needle, k, h): the interior tokens of a needle of three or more (they stand whole in
    any text that contains it), else its leading characters (k negative). Empty needles have none."""
    t = needles.where(F.length("text") > 0).select("item_id", F.col("text").alias("needle"), T.words(F.col("text")).alias("toks"))
    n = F.size("toks")
    t = t.withColumn("k", F.when(n >= 3, F.least(F.lit(SHINGLE), n - 2)).otherwise(-F.least(F.lit(QGRAM), F.length("needle"))))
    parts = F.when(n >= 3, F.slice("toks", F.lit(2), F.abs("k"))).otherwise(F.slice(F.split("needle", ""), F.lit(1), F.abs("k")))
    return t.select("item_id", "needle", "k", F.xxhash64("k", parts).alias("h"))


def needle_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by all needles: anchors meet by an equi-join, candidates are verified.

    The candidates carry the needle, so they meet the documents by ``doc_id`` alone. They are written, and a map of their
    ids of fixed size goes to the scan: a text without a candidate (but for chance hits) is never shuffled."""
    docs = tables.texts(spark, sf_dir, "doc_id", "text")
    needles = _needle_anchors(tables.needles(spark, sf_dir))
    used = needles.agg(F.collect_set("k")).scalar()  # of SHINGLE + QGRAM possible lengths
    anchors = (docs.withColumn("used", used)
               .select("doc_id", F.explode_outer(_anchors_of_text(T.words(F.col("text")), F.col("text"), F.col("used"))).alias("h"))
               .where(F.col("h").isNotNull()))
    path = scratch_path(spark, "needle-candidates")
    anchors.join(needles, "h").select("doc_id", "item_id", "needle").distinct().write.parquet(path)
    found = spark.read.parquet(path)
    v = (docs.where(may_be_in(F.col("doc_id"), found.select("doc_id"), MAP_WORDS)).join(found, "doc_id")
         .select("item_id", "doc_id", F.instr(F.col("text"), F.col("needle")).cast("bigint").alias("pos"),
                 F.length("text").alias("len")))
    return (v.where(F.col("pos") > 0)
            .select("item_id", "doc_id", "pos",
                    F.round((F.col("pos") - 1) / F.col("len"), 6).alias("depth")))


def needle_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per needle: documents that contain it and whether it was found at all."""
    hits = needle_find(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    nd = tables.needles(spark, sf_dir).select("item_id", T.word_count(F.col("text")).alias("n_words"))
    return (nd.join(hits, "item_id", "left")
            .select("item_id", "n_words", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"),
                    (F.coalesce("n_docs", F.lit(0)) > 0).alias("found")))
