"""Packed codes: every width and length comes back, and bytes are what a bit string says."""

from __future__ import annotations

import numpy as np


def test_round_trip_of_all_widths_and_lengths(spark):
    from pyspark.sql import functions as F
    from quire.operators.packing import pack, unpack

    rng = np.random.default_rng(7)
    rows = [(bits, rng.integers(0, 1 << bits, n).tolist()) for bits in range(1, 9) for n in (0, 1, 2, 7, 8, 9, 15, 16, 17, 64, 100)]
    rows += [(8, [255] * 24), (1, [1] * 9), (3, None)]
    df = spark.createDataFrame(rows, "bits int, codes array<int>")
    got = df.select("bits", "codes", pack("codes", "bits").alias("packed")).withColumn("back", unpack("packed", "size(codes)", "bits")).where("codes IS NOT NULL").collect()
    assert len(got) == len(rows) - 1
    for r in got:
        text = "".join(format(c, f"0{r.bits}b") for c in r.codes)
        n = -(-len(text) // 8)
        assert bytes(r.packed) == (int(text.ljust(8 * n, "0"), 2).to_bytes(n, "big") if n else b"")
        assert r.back == r.codes


def test_null_and_empty_vectors(spark, tmp_path):
    from quire.operators import packing

    spark.createDataFrame([(1, None, 0), (2, [], 0), (3, [1.0, 2.0, 3.0], 0), (4, [5.0] * 70, 0)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.vec_id, r.bits): r for r in packing.pack_codes(spark, str(tmp_path)).collect()}
    assert got[2, 3].n_bytes == 0 and got[1, 3].packed is None
    assert got[3, 3].n_bytes == 2 and got[4, 5].n_bytes == 44
    assert {r.vec_id for r in packing.unpack_codes(spark, str(tmp_path)).collect()} == {3, 4}
