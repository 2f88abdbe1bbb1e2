"""A bounded set of questions against all rows of a table, cell by cell."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk and questions of a block, in the mean: what one cell of the grid holds in memory.
CHUNK_ROWS, BLOCK_ROWS = 16_384, 4_096


def against_all(rows: DataFrame, asked: DataFrame, key: str, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
                chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``fn`` of every chunk of ``rows`` and block of ``asked`` (both dealt out by a hash of ``key``, of no common
    plan). A row travels once per block and a question once per chunk; no pair of them is a row of any plan."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    chunks = max(2 * cores, -(-rows.count() // chunk_rows))
    blocks = max(1, -(-asked.count() // block_rows))

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return df.select("*", F.pmod(F.xxhash64(key), F.lit(own_n)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other)).groupBy("_chunk", "_block")

    return dealt(rows, "_chunk", chunks, "_block", blocks).cogroup(dealt(asked, "_block", blocks, "_chunk", chunks)).applyInArrow(fn, schema)
