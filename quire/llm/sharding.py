"""Sharding by a consistent-hash ring with bounded loads (operator 1).

The ring has ``SLICES`` positions; every shard owns many virtual nodes on it. A row's key
hashes to a position and belongs to the next virtual node clockwise. No shard takes more
than its capacity: rows that find their shard full go on clockwise to the next node whose
shard has room. With no slack, capacities are the floor or ceiling of the mean, so row counts are at
most one apart; with slack, fewer rows move when a shard is added.

Only counts per ring position (a fixed number of them) come to the driver, where full arcs
overflow into the next ones. That gives intervals of the rows' ring order, at most a few per
virtual node, and each row finds its interval by its rank: the exact count of the positions
before its own plus its rank inside it. Rows are shuffled once, as ids and sizes without
their text. Column expressions only.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Positions of the ring (bits of the hash) and virtual nodes of a shard.
RING_BITS = 14
SLICES = 1 << RING_BITS
VNODES = 64


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """Virtual nodes as (position, shard), clockwise. A taken position is passed to the next
    free one, so a further shard leaves the others' nodes where they are (but for those)."""
    taken: dict[int, int] = {}
    if shards * vnodes > SLICES:
        raise ValueError("more virtual nodes than ring positions")
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"shard {shard} node {v}".encode()).digest()[:8], "big") % SLICES
            while at in taken:
                at = (at + 1) % SLICES
            taken[at] = shard
    return sorted(taken.items())


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack:
        return [-(-int(rows * (1 + slack) * 1000) // (shards * 1000)) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(counts: list[int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int]]:
    """Intervals (first rank, end, shard) of the rows in ring order. First every node takes the
    rows of its own arc, then what found no room goes on clockwise."""
    room = list(room)
    sums = [0]
    for c in counts:
        sums.append(sums[-1] + c)
    arcs, start = [], 0  # (first, end, index of its node)
    for j, (at, _) in enumerate(nodes):
        arcs.append((sums[start], sums[at + 1], j))
        start = at + 1
    arcs.append((sums[start], sums[-1], 0))  # beyond the last node: on to the first
    placed, late = [], [[] for _ in nodes]

    def offer(first: int, end: int, shard: int) -> int:
        """Places what fits; the first rank that doesn't."""
        cut = min(end, first + room[shard])
        if cut > first:
            placed.append((first, cut, shard))
            room[shard] -= cut - first
        return cut

    for first, end, j in arcs:
        if (cut := offer(first, end, nodes[j][1])) < end:
            late[j].append((cut, end))
    moving: list[tuple[int, int]] = []
    for step in range(2 * len(nodes)):
        j = step % len(nodes)
        if step < len(nodes):
            moving += late[j]
        moving = [(cut, end) for first, end in moving if (cut := offer(first, end, nodes[j][1])) < end]
    assert not moving, "capacities are smaller than the rows"
    return sorted(placed)


def _positions(counts: list[int], placed: list[tuple[int, int, int]]) -> list[tuple]:
    """Per ring position with rows: rows before it, and its intervals with their slots."""
    base = {}
    taken: dict[int, int] = {}
    for first, end, shard in placed:
        base[first] = taken.get(shard, 0)
        taken[shard] = base[first] + end - first
    ends = [end for _, end, _ in placed]
    out, before = [], 0
    for at, n in enumerate(counts):
        if n:
            own, k = [], bisect_left(ends, before + 1)
            while k < len(placed) and placed[k][0] < before + n:
                own.append((placed[k][0], placed[k][1], placed[k][2], base[placed[k][0]]))
                k += 1
            out.append((at, before, own))
            before += n
    return out


def assign(docs: DataFrame, shards: int, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: one row per row of ``docs`` (doc_id, text).

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1); ``slot`` numbers a shard's rows from 0
    without gaps, in ring order (then doc_id). The key is the id with the text's size and checksum, so null
    and repeated ids spread too; equal rows stand together in either order. An empty table has no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("point", F.xxhash64("doc_id", "size", "text_crc32"))
    rows = rows.withColumn("at", F.shiftrightunsigned("point", 64 - RING_BITS).cast("int"))
    counts = [0] * SLICES
    for at, n in rows.groupBy("at").count().collect():  # at most SLICES rows
        counts[at] = n
    placed = fill(counts, ring(shards, vnodes), capacities(sum(counts), shards, slack))
    table = spark.createDataFrame(_positions(counts, placed),
                                  "at int, before bigint, parts array<struct<first bigint, end bigint, shard int, slot bigint>>")
    rank = Window.partitionBy("at").orderBy("point", "doc_id", "size", "text_crc32")
    ranked = (rows.withColumn("nth", F.row_number().over(rank) - 1)
              .join(F.broadcast(table), "at")  # at most SLICES positions
              .withColumn("rank", F.col("before") + F.col("nth")))
    part = F.filter("parts", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["end"]))[0]
    return (ranked.withColumn("part", part)
            .select("doc_id", "size", "text_crc32", F.col("part.shard").alias("shard"),
                    (F.col("part.slot") + F.col("rank") - F.col("part.first")).alias("slot")))


def op1_sharding(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign(docs, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                       F.lit(None).cast("int").alias("grown_shard"))
