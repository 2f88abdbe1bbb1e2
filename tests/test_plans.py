"""Physical-plan checks: no cartesian products, no nested-loop joins on row-sized
inputs, no single-partition exchange except over small aggregated tables, and
filters / column pruning reaching the Parquet scan."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from conftest import SF_SMALL
from quire.plans.registry import QUERIES


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


ROW_QUERIES = [n for n in QUERIES if n not in {
    "jsonl_roundtrip", "materialize_if_absent", "stream_suite_score", "result_json", "result_json_filtered",
    "lowrank_correction", "storage_footprint", "present_sources"}
    and not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", ROW_QUERIES)
def test_no_cartesian_or_nested_loop_join(spark, name):
    p = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["seeded_shuffle", "group_split", "ordered_split", "progress_index",
                                  "batch_plan", "run_delta", "grade_responses", "needle_find"])
def test_single_partition_exchanges_only_over_aggregates(spark, name):
    p = plan_text(QUERIES[name](spark, SF_SMALL))
    details = re.findall(r"\((\d+)\) Exchange\s*\nInput \[\d+\]: \[[^\]]*\]\nArguments: SinglePartition", p)
    for node in details:
        # the child of a single-partition exchange must be the (bounded) bucket / group table,
        # in the main plan or in a scalar subquery
        m = re.search(r"Exchange \(" + node + r"\)\n\s*[:+\- ]*\+- (\w+)", p)
        assert m and m.group(1) in {"HashAggregate", "ObjectHashAggregate", "Project", "Filter"}, (name, node)


def test_filters_and_columns_reach_the_scan(spark):
    from quire.operators import lm
    p = plan_text(lm.nucleus_filter(spark, SF_SMALL, lang="en"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(lang,en\)", p)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert set(c.split(":")[0] for c in schema.split(",")) <= {"doc_id", "lang", "text"}


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small enough to be broadcast unasked."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def hashed_by(plan: str) -> list[str]:
    return re.findall(r"hashpartitioning\(([^)]*?), \d+\)", plan)


def test_grading_shuffles_texts_only_to_pair_turns(spark, no_broadcast):
    keys = hashed_by(plan_text(QUERIES["grade_responses"](spark, SF_SMALL)))
    assert keys and all(re.fullmatch(r"conv_id#\d+L?, [^,]*turn[^,]*", k) for k in keys), keys


@pytest.mark.parametrize("name", ["kl_logits", "blended_loss"])
def test_vectors_never_meet_on_their_label(spark, no_broadcast, name):
    """Only the teacher's cells are aggregated by label; the student's rows meet it by broadcast."""
    p = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "SortMergeJoin" not in p and "ShuffledHashJoin" not in p


def test_texts_never_meet_needles_on_their_item(spark, no_broadcast):
    keys = hashed_by(plan_text(QUERIES["needle_find"](spark, SF_SMALL)))
    assert keys and not any("item_id" in k for k in keys), keys


@pytest.mark.parametrize("name", ["bigram_perplexity", "perplexity_by_group"])
def test_tokens_are_counted_once(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_top_p_tokenises_once(spark, no_broadcast):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # reuse shows in the first plan
    try:
        p = QUERIES["nucleus_filter"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("regexp_extract_all") == 1 and p.count("ReusedExchange") >= 2


def test_needle_search_maps_candidates_before_texts_move(spark, no_broadcast):
    """The scan of the verified texts asks the map of candidate ids below its exchange."""
    p = QUERIES["needle_find"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Filter.*getbit", p)


def test_buckets_follow_rows_not_the_key_range(spark):
    """One outlier and a third of the rows at close keys: no bucket holds more than a few percent."""
    from pyspark.sql import functions as F

    from quire.operators.ranking import range_bucket

    df = spark.range(0, 9000).select((F.when(F.col("id") < 3000, F.col("id")).when(F.col("id") == 8999, F.lit(10**12)).otherwise(F.col("id") * 1000)).alias("k"))
    sizes = [r["count"] for r in df.groupBy(range_bucket(df, "k", 128).alias("b")).count().collect()]
    assert max(sizes) <= 0.02 * 9000


def test_a_hot_context_is_spread_over_buckets(spark, no_broadcast):
    """No window of the top-p filter is keyed by language and context alone over single successors."""
    p = plan_text(QUERIES["nucleus_filter"](spark, SF_SMALL))
    windows = re.findall(r"Arguments: \[.*?windowspecdefinition\((lang#\d+, ctx#\d+[^)]*)", p)
    assert any("head" in w for w in windows)


def test_top_k_per_model_limits_before_the_shuffle(spark):
    """A hot model cannot flood one task: row_number() <= 3 is cut per map task first."""
    p = plan_text(QUERIES["quality_samples"](spark, SF_SMALL))
    tree = p.split("\n\n")[0]
    lines = tree.splitlines()
    exch = [i for i, line in enumerate(lines) if "Exchange" in line and "Broadcast" not in line]
    limits = [i for i, line in enumerate(lines) if "WindowGroupLimit" in line]
    assert exch and any(i > exch[0] for i in limits), tree


def test_top_p_sorts_a_context_once(spark, no_broadcast):
    """Contexts with few successors meet one window; the two levels see none but the busy ones."""
    p = plan_text(QUERIES["nucleus_filter"](spark, SF_SMALL))
    windows = re.findall(r"Arguments: \[.*?windowspecdefinition\((ctx#\d+, lang#\d+, c#\d+L? DESC[^,]*, tok#\d+)", p)
    assert windows


@pytest.mark.parametrize("name", ["heldout_perplexity", "run_summary"])
def test_held_out_tokens_are_counted_without_their_text(spark, no_broadcast, name):
    keys = hashed_by(plan_text(QUERIES[name](spark, SF_SMALL)))
    assert any("tok#" in k for k in keys) and not any("doc_id#" in k and "tok#" in k for k in keys), keys
