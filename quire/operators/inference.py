"""Batch generation, and grading what was generated (``mapInPandas``).

A backend is a ``generate(text, temperature, max_tokens) -> str`` callable made
once per task; any model can stand behind it. No model weights ship with this
repo: the two built-in backends return words of the prompt, so runs are
reproducible and a SQL twin can state their answers. Each call is timed and
counted; a failing call is recorded in ``error`` and graded as a failure
instead of stopping the run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.operators.grading import grade
from quire.operators.haystack import haystack_prompts
from quire.operators.lm import heldout_perplexity
from quire.sources import literals as L

MAX_TOKENS = 2048
Backend = Callable[[str, float, int], str]


def _words(text: str) -> list[str]:
    words = text.split()
    if not words:
        raise ValueError("empty prompt")
    return words


def echo_backend() -> Backend:
    """The prompt's first ``max_tokens`` words."""
    return lambda text, temperature, max_tokens: " ".join(_words(text)[:max_tokens])


def tail_backend() -> Backend:
    """The last half of the prompt's words, ``max_tokens`` at most."""
    def generate(text: str, temperature: float, max_tokens: int) -> str:
        words = _words(text)
        return " ".join(words[-min(max_tokens, (len(words) + 1) // 2):])
    return generate


BACKENDS = {"A": echo_backend, "B": tail_backend}  # model label -> backend


def _run(make_backend: Callable[[], Backend], max_tokens: int, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = make_backend()  # once per task
        for pdf in batches:
            out = pdf[keep].copy()
            texts, elapsed, errors = [], [], []
            for prompt, temp in zip(pdf["prompt"], pdf["eff_temperature"]):
                start = time.perf_counter()
                try:
                    text, err = gen(prompt or "", float(temp), max_tokens), None
                except Exception as e:  # noqa: BLE001 - per-item failure capture
                    text, err = "", f"{type(e).__name__}: {e}"
                elapsed.append(time.perf_counter() - start)
                texts.append(text)
                errors.append(err)
            counts = [len(t.split()) for t in texts]
            out["text"], out["tok_count"], out["elapsed"] = texts, counts, elapsed
            out["tps"] = [n / s if s > 0 else 0.0 for n, s in zip(counts, elapsed)]
            out["error"] = errors
            yield out
    return run


def generate(plan: DataFrame, make_backend: Callable[[], Backend] = echo_backend,
             max_tokens: int = MAX_TOKENS) -> DataFrame:
    """plan (prompt, eff_temperature and any other columns) → the other columns with the
    response, its timing and its error. The prompt rides on the plan: nothing is joined back."""
    keep = [f for f in plan.schema.fields if f.name != "prompt"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return plan.mapInPandas(_run(make_backend, max_tokens, [f.name for f in keep]),
                            schema + ", text STRING, tok_count BIGINT, elapsed DOUBLE, tps DOUBLE, error STRING")


def _both(plan: DataFrame, max_tokens: int) -> DataFrame:
    """Both models over the same plan."""
    out = None
    for model, backend in BACKENDS.items():
        part = generate(plan, backend, max_tokens).withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    return out


def generation_plan(spark: SparkSession, sf_dir: str, spec: str = L.DEFAULT_TEMPERATURES) -> DataFrame:
    """Prompts by temperatures, with the test that each prompt's answer is graded by."""
    p = tables.prompts(spark, sf_dir)
    test = F.pmod(F.expr("conv_id div 2 + (turn + 1) div 2"), F.lit(L.N_TESTS)).cast("int")
    t = F.posexplode(F.split(F.lit(spec), ",")).alias("temp_idx", "t")
    return (p.select("prompt_id", "prompt", test.alias("test_ord"), t)
            .select("prompt_id", "prompt", "test_ord", "temp_idx",
                    F.greatest(F.col("t").cast("double"), F.lit(L.MIN_TEMPERATURE)).alias("eff_temperature")))


def generated(spark: SparkSession, sf_dir: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    return _both(generation_plan(spark, sf_dir), max_tokens)


def batch_generate(spark: SparkSession, sf_dir: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Every response of both models (timing left out: it differs from run to run)."""
    return generated(spark, sf_dir, max_tokens).select("model", "prompt_id", "temp_idx", "text", "tok_count", "error")


def generated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated responses graded and scored; a failed call counts as a failed test."""
    g = grade(generated(spark, sf_dir), L.tests_df(spark)).withColumn("ok", F.col("ok") & F.col("error").isNull())
    return (g.groupBy("rule_set", "model", "suite")
            .agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"),
                 F.count("error").alias("errors"))
            .withColumn("score", F.round(F.lit(100.0) * F.col("passed") / F.col("total"), 6)))


def side_by_side(spark: SparkSession, sf_dir: str, n: int = 200) -> DataFrame:
    """Both models' answers to the same prompt (first temperature), for every prompt."""
    g = generated(spark, sf_dir).where(F.col("temp_idx") == 0)
    sides = []
    for model in BACKENDS:
        m = model.lower()
        sides.append(g.where(F.col("model") == model).select(
            "prompt_id", T.preview(F.col("text"), n).alias(f"{m}_preview"),
            F.length("text").cast("bigint").alias(f"{m}_chars")))
    return sides[0].join(sides[1], "prompt_id")


def context_scores(spark: SparkSession, sf_dir: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Haystack → answer → needle found, counted per model and context size."""
    h = haystack_prompts(spark, sf_dir).withColumn("eff_temperature", F.lit(0.1))
    answers = _both(h, max_tokens)
    needle = F.array_join(T.words(F.col("needle")), " ")
    return (answers.groupBy("model", "target_tokens")
            .agg(F.count_if((F.instr("text", needle) > 0) & F.col("error").isNull()).alias("passed"),
                 F.count(F.lit(1)).alias("total")))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run, one row per model: graded score over all suites, contexts passed, held-out
    perplexity of the count model and the run log's mean speed."""
    scores = (generated_scores(spark, sf_dir).groupBy("model")
              .agg(F.sum("passed").cast("bigint").alias("passed"), F.sum("total").cast("bigint").alias("total")))
    contexts = (context_scores(spark, sf_dir).groupBy("model")
                .agg(F.sum("passed").cast("bigint").alias("contexts_passed"), F.sum("total").cast("bigint").alias("contexts")))
    runs = tables.runs(spark, sf_dir)
    rate = F.when(F.col("elapsed") > 0, F.col("tokens") / F.col("elapsed")).otherwise(F.lit(0.0))
    speed = runs.groupBy("model").agg(F.round(F.avg(rate), 6).alias("mean_tps"))
    ppl = heldout_perplexity(spark, sf_dir).select("perplexity").scalar()
    return (scores.join(contexts, "model", "left").join(speed, "model", "left")
            .select("model", "passed", "total", F.round(F.lit(100.0) * F.col("passed") / F.col("total"), 6).alias("score"),
                    "contexts_passed", "contexts", ppl.alias("perplexity"), "mean_tps"))
