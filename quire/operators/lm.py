"""Count-based language models over the document corpus.

Training is aggregation (token / bigram counts, partially aggregated map-side, so
a very frequent token costs one row per map task), scoring is an equi-join of
aggregated counts (``J5``: pick the probability of the observed token), and
perplexity is a token-weighted mean.  Sums are rewritten algebraically where it
removes a join, e.g. Σ n·ln((n+1)/(N+V+1)) = Σ n·ln(n+1) − N·ln(N+V+1).
Windows only run over *aggregated* successor lists, whose size per context is
bounded by the vocabulary, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.functions.maps import may_be_in
from quire.operators.backoff import train_side
from quire.operators.ranking import seeded_order, split_label

TEMPERATURES = [0.2, 0.4, 0.6]
MAP_WORDS = 1 << 14   # longs of the map that tells a scan which ids may stand in several rows
TIE = 1e-12   # added before rounding: probabilities like 125/128 lie halfway between two results
MOST_SUCCESSORS = 1 << 17      # of a context, for one window
BUCKET_CHARS = 3               # leading characters that bucket a context's successors
TOP_P_NUM, TOP_P_DEN = 9, 10   # keep while prior mass < 0.9 (integer arithmetic)


def lm_tokens(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """(doc_id, lang, toks): lower-cased whitespace tokens per document."""
    d = tables.texts(spark, sf_dir, "doc_id", "lang", "text")
    if lang is not None:
        d = d.where(F.col("lang") == lang)
    return d.select("doc_id", "lang", T.words(F.lower(F.col("text"))).alias("toks"))


def explode_tokens(toks: DataFrame, *keep: str) -> DataFrame:
    """One row per token.

    ``explode_outer`` + a null filter instead of ``explode``: for a plain explode
    Catalyst infers ``size(tokens) > 0`` and pushes it below the exchanges, which
    evaluates the tokenising regex a second time (and before the input is spread).
    """
    return (toks.select(*keep, F.explode_outer("toks").alias("tok"))
            .where(F.col("tok").isNotNull()))


def unigram_counts(toks: DataFrame) -> DataFrame:
    return (explode_tokens(toks, "lang")
            .groupBy("lang", "tok").agg(F.count(F.lit(1)).alias("n")))


def bigram_counts(toks: DataFrame) -> DataFrame:
    n = F.size("toks")
    pairs = F.arrays_zip(F.slice("toks", 1, F.greatest(n - 1, F.lit(0))).alias("prev"),
                         F.slice("toks", 2, F.greatest(n - 1, F.lit(0))).alias("next"))
    return (toks.select("lang", F.explode_outer(pairs).alias("p")).where(F.col("p").isNotNull())
            .select("lang", F.col("p.prev").alias("ctx"), F.col("p.next").alias("tok"))
            .groupBy("lang", "ctx", "tok").agg(F.count(F.lit(1)).alias("c")))


def unigram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add-one unigram model scored on its own corpus: p = (n+1)/(N+V+1)."""
    counts = (explode_tokens(lm_tokens(spark, sf_dir))
              .groupBy("tok").agg(F.count(F.lit(1)).alias("n")))
    g = counts.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("V"),
                   F.sum(F.col("n") * F.log(F.col("n") + 1)).alias("S"))
    ppl = F.exp(F.log(F.col("N") + F.col("V") + 1) - F.col("S") / F.col("N"))
    return g.select(F.col("N").cast("bigint").alias("n_tokens"), F.col("V").alias("vocab"),
                    F.round(ppl, 6).alias("perplexity"))


def bigram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-language add-one bigram model p = (n+1)/(m+V), m = context count.

    One tokenisation and one explode: each token is paired with its successor
    (NULL at the last position), so a single aggregation yields the bigram counts,
    the context counts and the vocabulary.  The sum is rewritten as
    Σ n·ln(n+1) − Σ_ctx m·ln(m+V), which needs no join back to the bigrams.
    """
    toks = lm_tokens(spark, sf_dir)
    n = F.size("toks")
    pairs = F.arrays_zip(F.col("toks").alias("tok"),
                         F.slice("toks", 2, F.greatest(n - 1, F.lit(0))).alias("nxt"))
    grams = (toks.select("lang", F.explode_outer(pairs).alias("p")).where(F.col("p").isNotNull())
             .select("lang", "p.tok", "p.nxt"))
    counts = grams.groupBy("lang", "tok", "nxt").agg(F.count(F.lit(1)).alias("c"))
    has_next = F.col("nxt").isNotNull()
    per_tok = (counts.groupBy("lang", "tok")
               .agg(F.sum(F.when(has_next, F.col("c")).otherwise(F.lit(0))).alias("m"),
                    F.sum(F.when(has_next, F.col("c") * F.log(F.col("c") + 1))
                          .otherwise(F.lit(0.0))).alias("a")))
    vocab = per_tok.groupBy("lang").agg(F.count(F.lit(1)).alias("V"))
    g = (per_tok.join(vocab, "lang").groupBy("lang")
         .agg(F.sum("m").alias("N"), F.sum("a").alias("A"),
              F.sum(F.when(F.col("m") > 0, F.col("m") * F.log(F.col("m") + F.col("V")))
                    .otherwise(F.lit(0.0))).alias("B"),
              F.first("V").alias("V")))
    return g.select("lang", F.col("N").cast("bigint").alias("n_bigrams"), F.col("V").alias("vocab"),
                    F.round(F.exp((F.col("B") - F.col("A")) / F.col("N")), 4).alias("perplexity"))


def per_token_languages(per_lang: DataFrame) -> DataFrame:
    """(lang, n, n_w): each per-language count next to the token's global count.

    One hash aggregation by token gathers that token's per-language counts (at most
    one entry per language, so the list is bounded) instead of a second aggregation
    plus a join back on the token.
    """
    g = (per_lang.groupBy("tok")
         .agg(F.sum("n").alias("n_w"), F.collect_list(F.struct("lang", "n")).alias("per")))
    return g.select("n_w", F.explode("per").alias("p")).select("p.lang", "p.n", "n_w")


def perplexity_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every token with the global unigram model, then token-weighted
    perplexity per language and overall (rollup; ``is_total`` tells the total from a null language)."""
    per_lang = unigram_counts(lm_tokens(spark, sf_dir))
    # ln(N + V + 1) is a scalar subquery: computed once, inlined as a value.
    log_z = (per_lang.groupBy("tok").agg(F.sum("n").alias("n_w"))
             .agg(F.log(F.sum("n_w") + F.count(F.lit(1)) + 1)).scalar())
    scored = per_token_languages(per_lang).select(
        "lang", "n", (F.log(F.col("n_w") + 1) - log_z).alias("logp"))
    g = (scored.rollup("lang")
         .agg(F.grouping("lang").cast("int").alias("is_total"), F.sum("n").alias("n_tokens"), F.sum(-F.col("n") * F.col("logp")).alias("loss")))
    return g.select("lang", "is_total", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                    F.round(F.col("loss") / F.col("n_tokens"), 6).alias("mean_loss"),
                    F.round(F.exp(F.col("loss") / F.col("n_tokens")), 4).alias("perplexity"))


def _heldout_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, in_train, in_valid, toks`` of each text: how often its words count on either side.

    Texts are split by the seeded order of their ids. Which side a text is on shows in its id alone, so texts stay
    where they are read. Only rows that share an id (each counts once for every row of it, on that row's side) meet
    a table of ids; a map of fixed size tells the scan which rows those may be."""
    d = tables.texts(spark, sf_dir, "doc_id", "text").where(F.col("doc_id").isNotNull())
    ids = tables.table(spark, sf_dir, "documents", "doc_id")
    rows = seeded_order(ids, "doc_id", name="rank", total="n_docs").select(
        "doc_id", (split_label(F.col("rank"), F.col("n_docs")) == "train").alias("train"))
    sides = rows.groupBy("doc_id").agg(F.count_if("train").alias("in_train"), F.count_if(~F.col("train")).alias("in_valid"))
    shared = may_be_in(F.col("doc_id"), sides.where(F.col("in_train") + F.col("in_valid") > 1).select("doc_id"), MAP_WORDS)
    train = train_side(ids).cast("bigint")
    alone = d.where(~shared).select("doc_id", "text", train.alias("in_train"), (F.lit(1) - train).alias("in_valid"))
    several = d.where(shared).join(sides, "doc_id").select("doc_id", "text", "in_train", "in_valid")
    return alone.unionByName(several).select("doc_id", "in_train", "in_valid", T.words(F.lower(F.col("text"))).alias("toks"))


def heldout_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per valid text: tokens and mean loss under the add-one unigram model of the train texts.

    The model never counts a valid text. Only valid tokens are counted per text before they meet the model, so a
    frequent token is one row per text."""
    toks = _heldout_words(spark, sf_dir)
    model = (explode_tokens(toks.where("in_train > 0"), "in_train").groupBy("tok").agg(F.sum("in_train").alias("n")))
    counts = (explode_tokens(toks.where("in_valid > 0"), "doc_id", "in_valid")
              .groupBy("doc_id", "tok").agg(F.sum("in_valid").alias("c")))
    log_z = model.agg(F.log(F.sum("n") + F.count(F.lit(1)) + 1)).scalar()
    scored = (counts.join(model, "tok", "left")
              .withColumn("loss", F.col("c") * (log_z - F.log(F.coalesce("n", F.lit(0)) + 1))))
    return (scored.groupBy("doc_id").agg(F.sum("c").alias("n_tokens"), F.sum("loss").alias("loss"))
            .select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), "loss"))


def heldout_text_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = heldout_loss(spark, sf_dir)
    mean = F.col("loss") / F.col("n_tokens")
    return h.select("doc_id", "n_tokens", F.round(mean, 6).alias("mean_loss"), F.round(F.exp(mean), 4).alias("perplexity"))


def heldout_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-weighted over all valid texts, in one row.

    One count per token on either side says it all: Σ c·(ln Z − ln(n + 1)) over the valid tokens is ln Z·Σ c − Σ c·ln(n + 1)."""
    toks = _heldout_words(spark, sf_dir)
    per_tok = (explode_tokens(toks, "in_train", "in_valid").groupBy("tok")
               .agg(F.sum("in_train").alias("n"), F.sum("in_valid").alias("c")))
    g = per_tok.agg(F.sum("n").alias("N"), F.count_if(F.col("n") > 0).alias("V"), F.nullif(F.sum("c"), F.lit(0)).alias("C"),
                    F.sum(F.col("c") * F.log(F.col("n") + 1)).alias("A"))
    n_texts = toks.where("in_valid > 0").where(F.size("toks") > 0).agg(F.count_distinct("doc_id")).scalar()
    mean = F.log(F.nullif(F.col("N"), F.lit(0)) + F.col("V") + 1) - F.col("A") / F.col("C")
    return g.select(n_texts.alias("n_texts"), F.col("C").cast("bigint").alias("n_tokens"),
                    F.round(mean, 6).alias("mean_loss"), F.round(F.exp(mean), 4).alias("perplexity"))


def kl_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KL(p_lang ‖ q): p = per-language frequencies, q = add-one global model."""
    per_lang = unigram_counts(lm_tokens(spark, sf_dir))
    log_norm = (per_lang.groupBy("tok").agg(F.sum("n").alias("n_w"))
                .agg(F.log(F.sum("n_w") + F.count(F.lit(1)))).scalar())  # ln(S + V)
    per = (per_token_languages(per_lang).groupBy("lang")
           .agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.log("n")).alias("A"),
                F.sum(F.col("n") * F.log(F.col("n_w") + 1)).alias("B")))
    kl = (F.col("A") - F.col("B")) / F.col("N") - F.log("N") + log_norm
    return per.select("lang", F.round(kl, 6).alias("kl"))

def _lang_bigrams(spark: SparkSession, sf_dir: str, lang: str | None) -> DataFrame:
    """Bigram counts keyed by (lang, ctx, tok): each language is its own model."""
    return bigram_counts(lm_tokens(spark, sf_dir, lang))


def _context_sums(bi: DataFrame) -> DataFrame:
    """Per context: successors, largest count and, for each a = 1/T, Σcᵃ and Σcᵃ·ln c.

    p = cᵃ / Σcᵃ, so the largest probability is maxᵃ / Σcᵃ and the entropy is
    ln Σcᵃ − a·Σcᵃ·ln c / Σcᵃ: one partial aggregation, whatever a context's size."""
    sums = []
    for i, t in enumerate(TEMPERATURES):
        w = F.pow(F.col("c").cast("double"), F.lit(1.0 / t))
        sums += [F.sum(w).alias(f"s{i}"), F.sum(w * F.log("c")).alias(f"q{i}")]
    return bi.groupBy("lang", "ctx").agg(F.count(F.lit(1)).alias("n_succ"), F.max("c").alias("mx"), *sums)


def _by_temperature(sums: DataFrame) -> DataFrame:
    per = F.array(*[F.struct(F.lit(t).alias("T"), F.col(f"s{i}").alias("S"), F.col(f"q{i}").alias("Q"))
                    for i, t in enumerate(TEMPERATURES)])
    return sums.select("lang", "ctx", "n_succ", "mx", F.explode(per).alias("p")).select(
        "lang", "ctx", "n_succ", "mx", "p.*")


def temperature_distribution(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """Shape of every context's next-token distribution p ∝ c^(1/T): largest p and entropy."""
    g = _by_temperature(_context_sums(_lang_bigrams(spark, sf_dir, lang)))
    a = F.lit(1.0) / F.col("T")
    return g.select(F.col("T").alias("temperature"), "lang", "ctx", "n_succ",
                    F.round(F.pow(F.col("mx").cast("double"), a) / F.col("S") + TIE, 6).alias("max_p"),
                    (F.round(F.log("S") - a * F.col("Q") / F.col("S"), 6) + F.lit(0.0)).alias("entropy"))


def temperature_probabilities(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """The distribution itself: p of each successor of each context at each temperature."""
    bi = _lang_bigrams(spark, sf_dir, lang)
    g = _by_temperature(_context_sums(bi)).select("lang", "ctx", "T", "S")
    p = F.pow(F.col("c").cast("double"), F.lit(1.0) / F.col("T")) / F.col("S")
    return bi.join(g, ["lang", "ctx"]).select("lang", "ctx", "tok", F.col("T").alias("temperature"),
                                               F.round(p + TIE, 6).alias("p"))


def nucleus_filter(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """Top-p (0.9) per context over integer counts: keep while prior mass < 0.9.

    A context's successors are one window's rows where they are few. Contexts with more than MOST_SUCCESSORS of
    them (not many: the list of these contexts is broadcast) go two levels, so that none is a single task."""
    bi = _lang_bigrams(spark, sf_dir, lang).withColumn("head", F.left("tok", F.lit(BUCKET_CHARS)))
    # what the joins below would ask of one branch only is asked of all, so that they share the counted bigrams
    bi = bi.where(F.col("lang").isNotNull() & F.col("ctx").isNotNull() & F.col("head").isNotNull())
    busy = (bi.groupBy("lang", "ctx").agg(F.count_if(F.col("c") > 0).alias("n")).where(F.col("n") > MOST_SUCCESSORS)
            .select("lang", "ctx", F.lit(True).alias("busy")))
    bi = bi.join(F.broadcast(busy), ["lang", "ctx"], "left")
    # by context first: it tells rows apart sooner than the language when they are sorted
    order = Window.partitionBy("ctx", "lang").orderBy(F.col("c").desc(), "tok")
    few = (bi.where(F.col("busy").isNull())
           .withColumn("prior", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
           .withColumn("total", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("bigint")))
    return (few.drop("busy", "head").unionByName(_two_level_mass(bi.where("busy").drop("busy")))
            .where(F.col("prior") * TOP_P_DEN < F.col("total") * TOP_P_NUM)
            .select("lang", "ctx", "tok", "c", "prior", "total"))


def _two_level_mass(bi: DataFrame) -> DataFrame:
    """``bi`` (with ``head``) with each successor's prior mass and its context's total.

    The successors of a context fall into buckets in its order (count, then a token's first
    characters), the running mass over the bucket table (a row per distinct bucket) offsets the running
    mass inside each bucket."""
    mass = bi.groupBy("lang", "ctx", "c", "head").agg(F.sum("c").alias("m"))
    # heads of one count, then counts: neither window meets a context's single successors
    by_count = mass.groupBy("lang", "ctx", "c").agg(F.sum("m").alias("mc"))
    above = Window.partitionBy("lang", "ctx").orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = (by_count.withColumn("above", F.coalesce(F.sum("mc").over(above), F.lit(0)))
              .withColumn("total", F.sum("mc").over(Window.partitionBy("lang", "ctx")).cast("bigint")))
    before = Window.partitionBy("lang", "ctx", "c").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (mass.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
               .join(counts.select("lang", "ctx", "c", "above", "total"), ["lang", "ctx", "c"])
               .select("lang", "ctx", "c", "head", (F.col("above") + F.col("before")).alias("off"), "total"))
    inside = Window.partitionBy("lang", "ctx", "c", "head").orderBy("tok").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("c").over(inside), F.lit(0))
    return (bi.withColumn("local", local).join(offsets, ["lang", "ctx", "c", "head"])
            .withColumn("prior", (F.col("off") + F.col("local")).cast("bigint")).select("lang", "ctx", "tok", "c", "prior", "total"))


def greedy_next(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """Most frequent successor per context, ties broken by the smaller token."""
    bi = _lang_bigrams(spark, sf_dir, lang)
    return (bi.groupBy("lang", "ctx")
            .agg(F.min_by(F.struct("tok", "c"), F.struct((-F.col("c")).alias("nc"), F.col("tok")))
                 .alias("best"), F.sum("c").alias("total"))
            .select("lang", "ctx", F.col("best.tok").alias("tok"), F.col("best.c").alias("c"), "total"))
