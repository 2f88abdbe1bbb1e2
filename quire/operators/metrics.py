"""Scoreboard work over run logs and responses.

Aggregations group by low-cardinality keys (model, suite) and are partially
aggregated map-side, so a hot key costs one small row per map task.  The one
ordered computation (``run_delta``) uses a segmented lag so a hot (model, suite)
group is spread across many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.functions.ranges import PART, in_ranges
from quire.operators.ranking import segmented_lag
from quire.session import scratch_path
from quire.sources import literals as L



def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.texts(spark, sf_dir, "doc_id", "lang", "text")
    return d.select("doc_id", "lang", T.word_count(F.col("text")).alias("n_words"),
                    F.length("text").cast("bigint").alias("n_chars"))


def token_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing token count → int(words × 1.3); falsy count (NULL or 0) → words."""
    r = tables.responses(spark, sf_dir)
    words = T.word_count(F.col("text"))
    reported = (F.when(F.col("conv_id") % 5 == 0, F.lit(None).cast("bigint"))
                .when(F.col("conv_id") % 5 == 1, F.lit(0).cast("bigint"))
                .otherwise(F.expr("CAST(length(text) div 4 AS BIGINT)")))
    return (r.select("conv_id", "turn", words.alias("n_words"), reported.alias("reported"))
            .withColumn("tokens_missing_fallback",
                        F.coalesce(F.col("reported"),
                                   F.floor(F.col("n_words") * F.lit(L.TOKEN_FALLBACK_FACTOR))
                                   .cast("bigint")))
            .withColumn("tokens_falsy_fallback",
                        F.coalesce(F.nullif(F.col("reported"), F.lit(0)), F.col("n_words"))))


def _rate():
    return F.when(F.col("elapsed") > 0, F.col("tokens") / F.col("elapsed")).otherwise(F.lit(0.0))


def speed_mean_of_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of per-run rates; a missing or zero duration gives a NULL rate (excluded).

    ``mean_tps_or1`` reproduces the 1 ns stand-in for a missing duration.
    """
    r = tables.runs(spark, sf_dir)
    count = F.coalesce(F.nullif(F.col("eval_count"), F.lit(0)), F.col("tokens"))
    ns_rate = F.when(F.col("duration_ns") > 0, count / (F.col("duration_ns") / F.lit(1e9)))
    or1_rate = count / (F.coalesce(F.nullif(F.col("duration_ns"), F.lit(0)), F.lit(1)) / F.lit(1e9))
    return (r.groupBy("model", "suite")
            .agg(F.count(F.lit(1)).alias("n_runs"),
                 F.round(F.avg(_rate()), 6).alias("mean_tps"),
                 F.round(F.avg(ns_rate), 6).alias("mean_tps_ns"),
                 F.round(F.avg(or1_rate), 0).alias("mean_tps_or1")))


def speed_ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.runs(spark, sf_dir)
    return (r.groupBy("model", "suite")
            .agg(F.sum("tokens").cast("bigint").alias("sum_tokens"),
                 F.sum("elapsed").alias("_se"))
            .select("model", "suite", "sum_tokens", F.round("_se", 6).alias("sum_elapsed"),
                    F.round(F.when(F.col("_se") > 0, F.col("sum_tokens") / F.col("_se"))
                            .otherwise(F.lit(0.0)), 6).alias("avg_tps")))


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suite result record per (model, suite): score, passed, total and both rates."""
    r = tables.runs(spark, sf_dir)
    return (r.groupBy("model", "suite")
            .agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"),
                 F.sum("tokens").alias("_tok"), F.sum("elapsed").alias("_el"),
                 F.avg(_rate()).alias("_mean"))
            .select("model", "suite", "passed", "total",
                    F.round(F.lit(100.0) * F.col("passed") / F.col("total"), 6).alias("score"),
                    F.round(F.when(F.col("_el") > 0, F.col("_tok") / F.col("_el"))
                            .otherwise(F.lit(0.0)), 6).alias("avg_tps"),
                    F.round(F.col("_mean"), 6).alias("mean_tps")))


def head_to_head(spark: SparkSession, sf_dir: str, a: str = "A", b: str = "B") -> DataFrame:
    """Both models per suite in one aggregation; suites missing a side give no row."""
    r = tables.runs(spark, sf_dir)
    ia, ib = F.col("model") == a, F.col("model") == b
    g = (r.where(ia | ib).groupBy("suite")
         .agg(F.count_if(ia & F.col("passed")).alias("a_passed"),
              F.count_if(ia).alias("a_total"),
              F.sum(F.when(ia, F.col("tokens"))).alias("_at"),
              F.sum(F.when(ia, F.col("elapsed"))).alias("_ae"),
              F.count_if(ib & F.col("passed")).alias("b_passed"),
              F.count_if(ib).alias("b_total"),
              F.sum(F.when(ib, F.col("tokens"))).alias("_bt"),
              F.sum(F.when(ib, F.col("elapsed"))).alias("_be"))
         .where((F.col("a_total") > 0) & (F.col("b_total") > 0)))
    a_score = F.lit(100.0) * F.col("a_passed") / F.col("a_total")
    b_score = F.lit(100.0) * F.col("b_passed") / F.col("b_total")
    a_tps = F.when(F.col("_ae") > 0, F.col("_at") / F.col("_ae")).otherwise(F.lit(0.0))
    b_tps = F.when(F.col("_be") > 0, F.col("_bt") / F.col("_be")).otherwise(F.lit(0.0))
    return g.select(
        "suite", "a_passed", "a_total", F.round(a_score, 6).alias("a_score"),
        F.round(a_tps, 6).alias("a_tps"),
        "b_passed", "b_total", F.round(b_score, 6).alias("b_score"),
        F.round(b_tps, 6).alias("b_tps"),
        F.round(a_score - b_score, 6).alias("gap"),
        F.round(F.when(b_tps > 0, a_tps / b_tps).otherwise(F.lit(0.0)), 6).alias("speed_ratio"))


def common_suites(spark: SparkSession, sf_dir: str, a: str = "A", b: str = "B") -> DataFrame:
    r = tables.runs(spark, sf_dir).select("model", "suite")
    return (r.where(F.col("model") == a).select("suite")
            .intersect(r.where(F.col("model") == b).select("suite")))


def resolve_model(spark: SparkSession, sf_dir: str,
                  patterns=("A_", "B_", "_view", "click", "zzz")) -> DataFrame:
    """First label (by first appearance) containing each pattern; no match → no row."""
    r = tables.runs(spark, sf_dir)
    labels = (r.groupBy(F.concat("model", F.lit("_"), "suite").alias("label"))
              .agg(F.min("run_id").alias("first_seen")))
    cand = (labels.select("label", "first_seen",
                          F.explode(F.array(*[F.lit(p) for p in patterns])).alias("pattern"))
            .where(F.col("label").contains(F.col("pattern"))))
    return (cand.groupBy("pattern")
            .agg(F.min_by("label", "first_seen").alias("resolved"),
                 F.count(F.lit(1)).alias("n_candidates")))


def summary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each model and suite in long form: every suite of the log, whatever its name; a suite
    that a model never ran has no row."""
    r = tables.runs(spark, sf_dir)
    return (r.groupBy("model", "suite")
            .agg(F.round(F.lit(100.0) * F.count_if("passed") / F.count(F.lit(1)), 6).alias("score")))


def run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-run change of elapsed time versus the previous run of the same (model, suite)."""
    r = tables.runs(spark, sf_dir).select("run_id", "model", "suite", "elapsed")
    parts = in_ranges(r, "model", "suite", "run_id")
    out = segmented_lag(parts, ["model", "suite"], "run_id", "elapsed", F.col(PART), "prev_elapsed")
    return out.select("run_id", "model", "suite", F.round("elapsed", 6).alias("elapsed"),
                      F.round("prev_elapsed", 6).alias("prev_elapsed"),
                      F.round(F.col("elapsed") - F.col("prev_elapsed"), 6).alias("delta"))


def response_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.responses(spark, sf_dir)
    n = F.length("text")
    return r.select("conv_id", "turn",
                    T.preview(F.col("prompt"), 60).alias("prompt_60"),
                    T.preview(F.col("prompt"), 80).alias("prompt_80"),
                    T.preview(F.col("text"), 150).alias("text_150"),
                    T.preview(F.col("text"), 200).alias("text_200"),
                    T.preview(F.col("text"), 400).alias("text_400"),
                    T.more_chars(F.col("text"), 400).alias("more_400"),
                    T.preview(F.col("text"), 500).alias("text_500"),
                    T.more_chars(F.col("text"), 500).alias("more_500"),
                    F.when(n > 400, F.concat(F.lit("   ... ["), (n - 400).cast("string"),
                                             F.lit(" more chars]"))).alias("remainder_note"))


def sample_lists(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """First k responses per model (prompt order), whole, gathered into an ordered list.

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before the
    shuffle, so each group ships at most k rows per map task.
    """
    r = tables.responses(spark, sf_dir)
    w = Window.partitionBy("model").orderBy("prompt_id")
    top = (r.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= k)
           .select("model", "ord", "text"))
    g = top.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("s"))
    return g.select("model", F.transform("s", lambda x: x["text"]).alias("samples"))


def quality_samples(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    s = sample_lists(spark, sf_dir, k)
    return s.select("model", F.size("samples").cast("bigint").alias("n_samples"),
                    F.array_join("samples", " || ").alias("samples"),
                    F.aggregate(F.transform("samples", F.length), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("sample_chars"))


def _validated_suites(r: DataFrame, suites) -> list[str] | None:
    """The asked-for names, checked against the suites that the log has (only those asked for are
    looked up, so what comes back is bounded by the request)."""
    if suites == "all":
        return None
    known = {x.suite for x in r.where(F.col("suite").isin(list(suites))).select("suite").distinct().collect()}
    bad = [s for s in suites if s not in known]
    if bad:
        raise ValueError(f"unknown suite(s) {bad}")
    return list(suites)


def suite_filter(spark: SparkSession, sf_dir: str, suites=("click", "view")) -> DataFrame:
    r = tables.runs(spark, sf_dir)
    chosen = _validated_suites(r, suites)
    if chosen is not None:
        r = r.where(F.col("suite").isin(chosen))
    return r.select("run_id", "model", "suite", "tokens", F.round("elapsed", 6).alias("elapsed"))


def model_filter(spark: SparkSession, sf_dir: str, a_only: bool = True,
                 b_only: bool = False) -> DataFrame:
    """Include A unless b_only, include B unless a_only (both flags → empty)."""
    r = tables.runs(spark, sf_dir)
    keep = ((F.lit(not b_only) & (F.col("model") == "A"))
            | (F.lit(not a_only) & (F.col("model") == "B")))
    return (r.where(keep).groupBy("model", "suite")
            .agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("passed").alias("passed")))


RECORD_STRUCT = "STRUCT<score: DOUBLE, passed: BIGINT, total: BIGINT, avg_tps: DOUBLE>"
RECORD_SCHEMA = f"MAP<STRING, {RECORD_STRUCT}>"


def result_documents(scores: DataFrame) -> DataFrame:
    """model → {suite → record} as nested maps, one document per model: (value) is its JSON text."""
    rec = F.struct("score", "passed", "total", "avg_tps")
    per_model = (scores.groupBy("model")
                 .agg(F.array_sort(F.collect_list(F.struct("suite", rec.alias("r")))).alias("e")))
    return per_model.select(F.to_json(F.create_map("model", F.map_from_entries("e"))).alias("value"))


def read_result_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows (model, suite, record) of the nested documents below a path."""
    doc = F.from_json("value", f"MAP<STRING, {RECORD_SCHEMA}>")
    return (spark.read.text(path).select(F.explode(doc).alias("model", "suites"))
            .select("model", F.explode("suites").alias("suite", "r"))
            .select("model", "suite", "r.score", "r.passed", "r.total", "r.avg_tps"))


def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested result documents written to the sink, read back and flattened for comparison."""
    path = scratch_path(spark, "result-json")
    result_documents(run_scores(spark, sf_dir)).write.mode("overwrite").text(path)
    return read_result_documents(spark, path)


def result_json_filtered(spark: SparkSession, sf_dir: str, kinds=("dict", "number")) -> DataFrame:
    """Long metrics of mixed kinds (dict records, lists of samples, plain numbers);
    only the chosen kinds reach the sink, each in its own folder and record shape; read back.

    The filter sits on the union, so Catalyst prunes the dropped branches before
    any of their work runs.
    """
    s = run_scores(spark, sf_dir)
    dicts = s.select("model", F.col("suite").alias("key"), F.lit("dict").alias("kind"),
                     F.to_json(F.struct("score", "passed", "total", "avg_tps")).alias("payload"))
    lists = (sample_lists(spark, sf_dir)
             .select("model", F.lit("quality").alias("key"), F.lit("list").alias("kind"),
                     F.to_json("samples").alias("payload")))
    numbers = (s.groupBy("model").agg(F.round(F.avg("mean_tps"), 6).alias("v"))
               .select("model", F.lit("avg_speed").alias("key"), F.lit("number").alias("kind"),
                       F.to_json(F.array("v")).alias("payload")))
    path = scratch_path(spark, "result-json-filtered")
    (dicts.unionByName(lists).unionByName(numbers).where(F.col("kind").isin(list(kinds)))
     .write.partitionBy("kind").option("ignoreNullFields", "false").json(path))
    kept = spark.read.schema("model STRING, key STRING, kind STRING, payload STRING").json(path)
    rec = F.when(F.col("kind") == "dict", F.from_json("payload", RECORD_STRUCT))
    value = F.when(F.col("kind") == "number", F.from_json("payload", "ARRAY<DOUBLE>")[0])
    return kept.select("model", "key", "kind", rec["score"].alias("score"), rec["passed"].alias("passed"),
                       rec["total"].alias("total"), rec["avg_tps"].alias("avg_tps"), value.alias("value"))
