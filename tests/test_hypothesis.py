"""Randomised property checks (hypothesis) against plain-Python semantics."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import ranking

WS = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2005\u200a"
      "\u2028\u2029\u202f\u205f\u3000")
ALPHABET = WS + "abéß中<>/"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=40))
def test_words_and_strip_equal_python(spark, samples):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i INT, s STRING")
    got = {r["i"]: (list(r["w"]), r["t"]) for r in
           df.select("i", T.words(F.col("s")).alias("w"), T.py_strip(F.col("s")).alias("t")).collect()}
    for i, s in enumerate(samples):
        assert got[i] == (s.split(), s.strip()), repr(s)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=300),
       st.integers(min_value=1, max_value=9))
def test_two_level_rank_on_random_keys(spark, keys, n_buckets):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id BIGINT, k BIGINT")
    r = ranking.two_level_rank(df, ranking.range_bucket(df, "k", n_buckets), [F.col("k"), F.col("id")],
                               name="r")
    ref = df.withColumn("r", F.row_number().over(Window.orderBy("k", "id")))
    assert r.select("id", "r").exceptAll(ref.select("id", "r")).count() == 0
