"""Quantisation codes as bytes: b bits a code, packed across byte borders.

Eight codes of b bits fill b bytes, so they are folded into one long, and a vector is the bytes of its longs,
cut behind its last code. All of it is array expressions inside the row, without a shuffle.
A null vector has no codes; an empty one has no bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import tables
from quire.operators.quant import _policy, _with_bits, quantize_groups
from quire.session import scratch_path

SCALE_BYTES = 8  # scale and bias of a group, single precision each


def pack(codes: str, bits: str) -> Column:
    """Binary of the integer array ``codes``, of which each is below 2 ** ``bits`` (1 to 8)."""
    # a short last run of eight is filled with zeros at its end
    long = f"aggregate(sequence(1, 8), 0L, (a, i) -> shiftleft(a, int({bits})) | bigint(coalesce(try_element_at({codes}, 8 * k + i), 0)))"
    digits = f"right(lpad(hex({long}), 16, '0'), 2 * int({bits}))"
    whole = f"unhex(array_join(transform(sequence(0, int(ceil(size({codes}) / 8)) - 1), k -> {digits}), ''))"
    return F.expr(f"CASE WHEN size({codes}) = 0 THEN X'' ELSE substring({whole}, 1, int(ceil(size({codes}) * {bits} / 8))) END")


def unpack(packed: str, n: str, bits: str) -> Column:
    """The ``n`` codes of ``bits`` bits in the binary ``packed``."""
    runs = f"int(ceil({n} / 8))"
    text = f"rpad(hex({packed}), 2 * int({bits}) * {runs}, '0')"
    longs = f"transform(sequence(0, {runs} - 1), k -> bigint(conv(substring({text}, 2 * int({bits}) * k + 1, 2 * int({bits})), 16, -10)))"
    code = f"int(shiftrightunsigned(w, int({bits}) * (8 - i)) & (shiftleft(1L, int({bits})) - 1))"
    return F.expr(f"CASE WHEN {n} = 0 THEN cast(array() AS array<int>) ELSE slice(flatten(transform({longs}, w -> transform(sequence(1, 8), i -> {code}))), 1, int({n})) END")


def packed_vectors(v: DataFrame) -> DataFrame:
    """``v (vec_id, v, bits, ...)`` with n_codes, packed, and the scale and bias of each group."""
    q = v.withColumn("g", quantize_groups(F.col("v"), F.col("bits"))).drop("v")
    q = q.withColumn("codes", F.flatten("g.q"))
    return (q.withColumn("packed", pack("codes", "bits")).withColumn("n_codes", F.size("codes"))
            .withColumn("scales", F.col("g.scale").cast("array<float>")).withColumn("biases", F.col("g.mn").cast("array<float>")).drop("g", "codes"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def pack_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's packed codes at each width, as hex, and their number of bytes."""
    p = packed_vectors(_with_bits(tables.vectors(spark, sf_dir).drop("label")))
    return p.select("vec_id", "bits", "n_codes", F.octet_length("packed").alias("n_bytes"), F.lower(F.hex("packed")).alias("packed"))


def unpack_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed vectors, written and read again: codes per group (as ``quantize_groupwise`` gives them) and the
    group's first restored value."""
    p = _stored(packed_vectors(_with_bits(tables.vectors(spark, sf_dir).drop("label"))), "packed")
    c = p.withColumn("codes", unpack("packed", "n_codes", "bits"))
    per = F.expr("transform(sequence(1, size(scales)), k -> struct(slice(codes, 64 * k - 63, 64) AS q, scales[k - 1] AS scale, biases[k - 1] AS bias))")
    g = c.where("n_codes > 0").select("vec_id", "bits", F.posexplode(per).alias("grp", "g"))
    text = F.array_join(F.transform("g.q", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    first = F.col("g.bias").cast("double") + F.element_at("g.q", 1) * F.col("g.scale").cast("double")
    return g.select("vec_id", "bits", "grp", text.alias("codes"), F.round(first, 6).alias("first_value"))


def packed_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the packed table per scheme, counted from what was written; unquantised vectors take four a value."""
    seg = _policy(tables.segments(spark, sf_dir)).select("vec_id", "v", "bits")
    uniform = _with_bits(seg.drop("bits")).withColumn("scheme", F.concat(F.lit("uniform_"), F.col("bits").cast("string")))
    both = uniform.unionByName(seg.withColumn("scheme", F.lit("mixed")))
    plain = both.where("bits IS NULL").select("scheme", (F.size("v") * 4).alias("bytes"), F.lit(0).alias("extra"))
    p = _stored(packed_vectors(both.where("bits IS NOT NULL")), "packed-schemes")
    size = p.select("scheme", F.octet_length("packed").alias("bytes"), (F.size("scales") * F.lit(SCALE_BYTES)).alias("extra")).unionByName(plain)
    return size.groupBy("scheme").agg(F.count("*").alias("n_vectors"), F.sum("bytes").alias("code_bytes"), F.sum("extra").alias("scale_bytes"))
