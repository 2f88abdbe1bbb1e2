"""Maps of fixed size that tell a scan which keys may be wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def may_be_in(key: Column, keys: DataFrame, words: int) -> Column:
    """False only for keys that ``keys`` (of one column) doesn't hold: a test against ``words`` longs of hashed bits, in
    the scan itself. Whatever the number of keys, the map has this size; more keys let more rows through by chance."""
    def bit(c):
        return F.pmod(F.xxhash64(c), F.lit(64 * words))

    marked = (keys.select(bit(F.col(keys.columns[0])).alias("b")).groupBy(F.expr("b div 64").alias("id"))
              .agg(F.expr("bit_or(shiftleft(1L, int(b % 64)))").alias("w")))
    every = keys.sparkSession.range(words).join(marked, "id", "left").select("id", F.coalesce("w", F.lit(0).cast("bigint")).alias("w"))
    bits = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "w"))), lambda x: x["w"]).alias("m")).scalar()
    return F.getbit(F.element_at(bits, (F.floor(bit(key) / 64) + 1).cast("int")), F.pmod(bit(key), F.lit(64)).cast("int")) == 1
