"""Rule-graded evaluation: responses ⋈ rules → verdicts → scores.

The checks are data (``literals.tests_df``): each test carries its conjunctive
normal form as a nested array, evaluated per row with ``forall``/``exists``.
Grading is therefore a broadcast hash join against a 42-row literal table
followed by a projection — no shuffle of response text at all.  Only the score
aggregation shuffles, and it is partially aggregated map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.functions.arrays import let
from quire.sources import literals as L


def needle_hit(haystack: Column, rule, lowered: Column | None = None) -> Column:
    """One needle check: optional lower-case, optional prefix window, substring test."""
    h = F.when(rule["ignore_case"], F.lower(haystack) if lowered is None else lowered).otherwise(haystack)
    h = F.when(rule["prefix_chars"].isNull(), h).otherwise(F.left(h, rule["prefix_chars"]))
    return h.contains(rule["needle"])


def cnf_check(haystack: Column, clauses: Column) -> Column:
    """All clauses hold; inside a clause any needle suffices.

    The text and its lower-case form are bound once per row, not per needle.
    """
    return let({"h": haystack, "hl": F.lower(haystack), "c": clauses}, lambda s: F.forall(
        s["c"], lambda clause: F.exists(clause, lambda r: needle_hit(s["h"], r, s["hl"]))))


def grade(responses: DataFrame, tests: DataFrame) -> DataFrame:
    """Verdict per (response, rule set).  ``tests`` is a bounded literal → broadcast."""
    j = responses.join(F.broadcast(tests), "test_ord")
    checked = F.when(F.col("strip_think"), T.strip_think(F.col("text"))).otherwise(F.col("text"))
    return (j.withColumn("ok", cnf_check(checked, F.col("clauses")))
            .withColumn("status", F.when(F.col("ok"), F.lit("PASS")).otherwise(F.lit("FAIL")))
            .drop("clauses"))


def graded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade(tables.responses(spark, sf_dir), L.tests_df(spark))


def grade_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graded_responses(spark, sf_dir)
    return g.select("rule_set", "model", "suite", "test", "test_ord", "conv_id", "turn",
                    "prompt_id", "ok", "status")


def suite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """passed / total / score % per (rule set, model, suite)."""
    g = graded_responses(spark, sf_dir)
    return (g.groupBy("rule_set", "model", "suite")
            .agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"))
            .withColumn("score", F.round(F.lit(100.0) * F.col("passed") / F.col("total"), 6)))


def failure_report(spark: SparkSession, sf_dir: str, n: int = 150) -> DataFrame:
    """Failed rows only, with a preview of the *unstripped* response."""
    g = graded_responses(spark, sf_dir)
    return (g.where(~F.col("ok"))
            .select("rule_set", "model", "suite", "test", "prompt_id",
                    T.preview(F.col("text"), n).alias("preview"),
                    T.more_chars(F.col("text"), n).alias("more_chars")))


def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each needle of the catalog with how often it hits the responses it grades."""
    rules = L.rules_df(spark)
    r = tables.responses(spark, sf_dir).select("test_ord", "text")
    j = r.join(F.broadcast(rules), "test_ord")
    checked = F.when(F.col("strip_think"), T.strip_think(F.col("text"))).otherwise(F.col("text"))
    hit = needle_hit(checked, F.struct("needle", "ignore_case", "prefix_chars"))
    return (j.groupBy(*[c.strip() for c in L.RULE_COLUMNS.split(",")])
            .agg(F.count(F.lit(1)).alias("n_responses"), F.count_if(hit).alias("hits")))
