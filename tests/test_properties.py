"""Property tests of the operators (exactness, invariants, partition independence)."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from quire import tables
from quire.operators import haystack, lm, losses, quant, ranking, splits
from quire.plans.oracles import ORACLES
from quire.plans.registry import QUERIES


def test_two_level_rank_equals_row_number(spark):
    df = spark.range(0, 5000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("k"))
    r = ranking.two_level_rank(df, ranking.hex_bucket(F.col("k")), [F.col("k"), F.col("id")], name="r")
    ref = df.withColumn("r", F.row_number().over(Window.orderBy("k", "id")))
    assert r.select("id", "r").exceptAll(ref.select("id", "r")).count() == 0


def test_range_rank_and_partitioned_rank(spark):
    df = spark.range(0, 3000).select((F.col("id") * 7919 % 3001).alias("x"), (F.col("id") % 3).alias("g"))
    r = ranking.two_level_rank(df, ranking.range_bucket(df, "x", 16), [F.col("x")], ["g"], "r")
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("x")))
    assert r.select("x", "g", "r").exceptAll(ref.select("x", "g", "r")).count() == 0


def test_segmented_lag_equals_lag(spark):
    df = spark.range(0, 4000).select(F.col("id"), (F.col("id") % 2).alias("g"), (F.col("id") * 3.5).alias("v"))
    out = ranking.segmented_lag(df, ["g"], "id", "v", ranking.range_bucket(df, "id", 32), "p")
    ref = df.withColumn("p", F.lag("v").over(Window.partitionBy("g").orderBy("id")))
    assert out.select("id", "p").exceptAll(ref.select("id", "p")).count() == 0


def test_group_split_of_105_prompts(spark):
    p = spark.range(0, 105).select(F.col("id").alias("prompt_id"))
    r = ranking.seeded_order(p, "prompt_id", total="n").withColumn(
        "split", ranking.split_label(F.col("shuffle_rank"), F.col("n")))
    counts = {row["split"]: row["count"] for row in r.groupBy("split").count().collect()}
    assert counts == {"train": 89, "valid": 16}


def test_split_sides_disjoint_and_temperatures_together(spark):
    plan = splits.group_split(spark, SF_CHECK)
    per_prompt = plan.groupBy("prompt_id").agg(F.count_distinct("split").alias("sides"),
                                               F.count(F.lit(1)).alias("n"))
    assert per_prompt.where("sides != 1 OR n != 3").count() == 0


def test_seeded_order_independent_of_partitioning(spark):
    p = tables.prompts(spark, SF_CHECK).select("prompt_id")
    a = ranking.seeded_order(p.repartition(1), "prompt_id")
    b = ranking.seeded_order(p.repartition(7), "prompt_id")
    assert a.select("prompt_id", "shuffle_rank").exceptAll(b.select("prompt_id", "shuffle_rank")).count() == 0


def _canon_rows(df):
    from oracle_check import canon
    return sorted(tuple(canon(v, False) for v in row) for row in df.collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_at_1_and_8_shuffle_partitions(spark, name):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = _canon_rows(QUERIES[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    eight = _canon_rows(QUERIES[name](spark, SF_SMALL))
    assert one == eight


def test_softmax_and_kl_invariants(spark):
    s = losses.student_logits(spark, SF_SMALL)
    lse = losses.logsumexp(F.col("z"))
    total = F.aggregate(F.transform("z", lambda x: F.exp(x)), F.lit(0.0), lambda a, b: a + b)
    bad = s.select((total / F.exp(lse)).alias("sum_p")).where(F.abs(F.col("sum_p") - 1) > 1e-9).count()
    assert bad == 0
    kl = losses.kl_logits(spark, SF_SMALL)
    assert kl.where("kl_batchmean < -1e-12").count() == 0
    # KL of the teacher against itself is 0
    t = losses.teacher_logits(spark, SF_SMALL).withColumn("z", F.col("t"))
    self_kl = losses._teacher_probs(t).select(losses.kl_rows(losses._teacher_probs(t), 4.0).alias("kl"))
    assert self_kl.where(F.abs("kl") > 1e-9).count() == 0


def test_nucleus_keeps_at_least_one_and_ninety_percent(spark):
    n = lm.nucleus_filter(spark, SF_SMALL)
    g = n.groupBy("ctx").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("kept"), F.first("total").alias("t"))
    assert g.where("k < 1 OR kept * 10 < t * 9").count() == 0


def test_quantisation_error_falls_with_bits_and_is_idempotent(spark):
    e = {r["bits"]: r["mse"] for r in quant.quant_error_by_bits(spark, SF_SMALL).collect()}
    assert e[3] > e[5] > e[6] > e[8] > 0
    v = tables.vectors(spark, SF_SMALL)
    g = v.select(quant.quantize_groups(F.col("v"), F.lit(5)).alias("g"))
    deq = g.select(F.flatten(F.transform("g", lambda gr: F.transform(
        gr["q"], lambda q: gr["mn"] + q * gr["scale"]))).alias("d"))
    again = deq.select(quant.group_errors(quant.quantize_groups(F.col("d"), F.lit(5))).alias("e"))
    assert again.where("e.maxabs > 1e-9").count() == 0


def test_lowrank_error_falls_with_rank(spark):
    m = {r["rank"]: r["mse"] for r in quant.lowrank_correction(spark, SF_SMALL).collect()}
    assert m[0] > m[8] > m[16] > m[32] > m[64]
    assert m[64] < 1e-12


def _placed(spark, lengths, target_tokens, needle_words):
    """Kept sentences, needle position and total words of one haystack of given sentence lengths."""
    from quire.operators.haystack import place_needle

    df = spark.createDataFrame([(1, target_tokens, needle_words, "n" if s == 0 else None, s, "x", w) for s, w in enumerate(lengths)],
                               "item_id BIGINT, target_tokens INT, needle_words BIGINT, needle STRING, slot INT, sentence STRING, words BIGINT")
    rows = sorted(place_needle(df).collect(), key=lambda r: r["pos"])
    at = [i for i, r in enumerate(rows) if r["is_needle"]]
    assert len(at) == 1
    return len(rows) - 1, at[0], sum(r["words"] for r in rows)


@pytest.mark.parametrize("lengths, target_tokens, needle_words, expected", [
    # budget 10 words, half of it 5: sentences of 3 words; two of them (6) reach the half
    ([3] * 8, 40, 2, (3, 2, 11)),      # 3 3 N2 3 = 11 words: budget reached
    ([3] * 8, 40, 9, (3, 2, 18)),      # the needle alone ends the budget; the sentence after it still stands
    ([20] * 3, 40, 2, (1, 0, 22)),     # the first sentence ends the budget: the needle goes in the middle of one
    ([1] * 20, 40, 1, (9, 5, 10)),     # one word each: five, the needle, four more
    ([6, 6, 6], 40, 2, (2, 1, 14)),    # half reached by the first
])
def test_haystack_by_hand(spark, lengths, target_tokens, needle_words, expected):
    assert _placed(spark, lengths, target_tokens, needle_words) == expected


def test_haystack_invariants(spark):
    rows = haystack.haystack_rows(spark, SF_SMALL).groupBy("item_id", "target_tokens").agg(
        F.count_if("is_needle").alias("needles"), F.sum("words").alias("total"), F.first("target_words").alias("target"),
        F.max("words").alias("longest"), F.first("needle_words").alias("needle_words"),
        F.array_sort(F.collect_list(F.struct("pos", "words", "is_needle"))).alias("parts"))
    for r in rows.collect():
        at = [i for i, p in enumerate(r["parts"]) if p["is_needle"]]
        before = sum(p["words"] for p in r["parts"][:at[0]])
        assert r["needles"] == 1 and r["total"] >= r["target"]
        assert r["target"] // 2 <= before <= r["target"] // 2 + r["longest"]  # around the middle
        assert r["total"] - r["parts"][-1]["words"] < r["target"] + r["needle_words"]  # nothing after the budget


def test_needle_find_equals_brute_force(spark):
    docs = tables.texts(spark, SF_SMALL, "doc_id", "text").collect()
    needles = tables.needles(spark, SF_SMALL).collect()
    expected = {(n["item_id"], d["doc_id"]) for n in needles for d in docs if n["text"] and n["text"] in d["text"]}
    got = {(r["item_id"], r["doc_id"]) for r in haystack.needle_find(spark, SF_SMALL).collect()}
    assert got == expected


def test_needles_of_every_length_are_found(spark, tmp_path):
    docs = [(1, "alpha beta gamma delta eps"), (2, "xbetay"), (3, "nothing here"), (4, ""), (5, "a\nb c d e f g h i j k l m")]
    items = [(10, "beta"), (11, "ta ga"), (12, "z"), (13, "lpha beta gamma de"), (14, ""), (15, "b c d e f g h i j k l m"), (16, "e")]
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id BIGINT, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r["item_id"], r["doc_id"]) for r in haystack.needle_find(spark, str(tmp_path)).collect()}
    assert got == {(i, d) for i, n in items for d, t in docs if n and n in t}


def test_words_match_python_split(spark):
    samples = ["  a b\tc\n", "", " ", "x y z", "a\x1cb", "e\u0085f", "tab\x0bv"]
    df = spark.createDataFrame([(s,) for s in samples], "s STRING")
    from quire.functions import text as T
    got = [r["w"] for r in df.select(T.words(F.col("s")).alias("w")).collect()]
    assert got == [s.split() for s in samples]
    stripped = [r["t"] for r in df.select(T.py_strip(F.col("s")).alias("t")).collect()]
    assert stripped == [s.strip() for s in samples]


def test_strip_think(spark):
    from quire.functions import text as T
    samples = ["<think>a\nb</think> ok ", "x</think>y", "<think>1</think>m<think>2</think>n", "plain"]
    df = spark.createDataFrame([(s,) for s in samples], "s STRING")
    got = [r["t"] for r in df.select(T.strip_think(F.col("s")).alias("t")).collect()]
    assert got == ["ok", "x</think>y", "mn", "plain"]


def test_perplexity_overall_equals_unigram(spark):
    u = lm.unigram_perplexity(spark, SF_SMALL).first()["perplexity"]
    g = [r for r in lm.perplexity_by_group(spark, SF_SMALL).collect() if r["lang"] is None][0]
    assert math.isclose(u, g["perplexity"], rel_tol=1e-6)
