"""The keyed permutation is one-to-one for any number of rows, and differs by key."""

from __future__ import annotations


def test_places_are_a_permutation_for_any_size(spark):
    from pyspark.sql import functions as F
    from quire.operators.permute import with_place

    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 63, 64, 65, 100, 1000, 1023, 1024, 1025]
    rows = spark.createDataFrame([(n,) for n in sizes], "n bigint").select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("number"))
    keyed = rows.select("*", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (42, 43, 44)])).alias("key"))
    got = with_place(keyed, "number", "n", "key").groupBy("n", "key").agg(F.count_distinct("place").alias("d"), F.min("place").alias("a"), F.max("place").alias("b"), F.sum(F.expr("int(place = number)")).alias("fixed")).collect()
    assert len(got) == 3 * len(sizes)
    for r in got:
        assert (r.d, r.a, r.b) == (r.n, 0, r.n - 1)
        assert r.n < 100 or r.fixed < 0.1 * r.n  # rows really move
    large = spark.range(3).select((F.col("id") + 3_000_000_000_000).alias("number"), F.lit(5_000_000_000_000).alias("n"), F.lit(1).cast("bigint").alias("key"))
    places = [r.place for r in with_place(large, "number", "n", "key").collect()]
    assert len(set(places)) == 3 and all(0 <= p < 5_000_000_000_000 for p in places)
