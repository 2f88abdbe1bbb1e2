"""The prefix trie of conversations, all its nodes from one ROLLUP.

A turn at a position has an id: 128 bits of a SHA-256 of position, role and text. WIDTH
consecutive positions are the columns of a block; ``GROUP BY block, prior, ROLLUP(t1, ..., tWIDTH)`` gives one
group for each distinct prefix that ends in the block, and ``grouping_id`` tells its length. ``prior`` is the node
in which the block before ended: the exclusive-or of the ids on its path, which names a node as the path does.
So conversations of any length take part in the same aggregation, one row for each of their blocks.

What a node says of its whole subtree needs no walk through the tree: every member of a node passes
values up, and a second ROLLUP sums them.

* A leaf passes one, through its smallest member: the sum is the number of leaves.
* A conversation c stops adding saved characters where it becomes its node's smallest member.
  With S(c) the characters of its turns before that point, and C(v) those before a node's last turn, the members of v
  other than the smallest save S(c) - C(v) each in its subtree.

Defined results: null roles and texts are empty; rows without conv_id take no part; turns
that share a number are ordered by the SHA-256 of role and text, repeated rows stay separate turns; other columns
are not looked at; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.ranges import LOCAL, OFFSET, PART, TOTAL, range_numbered
from quire.session import scratch_path

#: Positions of one block: columns of the ROLLUP.
WIDTH = 8
#: Blocks whose prior nodes one window computes; longer conversations take several.
STRETCH = 4096
#: Conversations that share a base, and one more than the turns that may be taken from it.
SHARED, HEADS = 100, 6
#: Ids of one piece of the text that is hashed.
PIECE = 8192

SLOTS = range(1, WIDTH + 1)
PATH = [f"t{i}" for i in SLOTS]
NODE = ["depth", "ka", "kb"]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"trie-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _word(digest: Column, at: int) -> Column:
    """64 bits of a hexadecimal digest as a signed long."""
    return F.conv(F.substring(digest, 16 * at + 1, 16), 16, -10).cast("bigint")


def turns_in_order(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every turn's digest and characters in range parts (see ``range_numbered``), and the parts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    slim = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("bigint").alias("chars"))
    return range_numbered(slim, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, digest, chars`` of every conversation that starts with the first turns of its base, and
    ``conv_id, turns`` of all conversations. Turns that stay are joined on their part, so a long conversation
    remains spread; a base has at most SHARED conversations, each of which takes fewer than HEADS turns."""
    rows, parts = turns_in_order(turns)
    rows, parts = _written(rows, "turns"), _written(parts, "parts")
    base_of = F.col("conv_id") - F.col("conv_id") % SHARED
    first = rows.join(parts.where(F.col("conv_id") % SHARED == 0).where(F.col(OFFSET) < HEADS - 1), [PART, "conv_id"]).where(F.col(OFFSET) + F.col(LOCAL) < HEADS)
    bases = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct((F.col(OFFSET) + F.col(LOCAL)).alias("pos"), "digest", "chars"))).alias("lent"))
    own = parts.groupBy("conv_id").agg(F.max(TOTAL).alias("own")).select("conv_id", "own", base_of.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    taken = F.slice(F.coalesce("lent", F.array().cast("array<struct<pos:bigint,digest:string,chars:bigint>>")), 1, F.col("h").cast("int"))
    convs = _written(own.join(bases, "base", "left").select("conv_id", "own", "h", taken.alias("lent")), "convs")
    places = parts.join(convs.select("conv_id", "h", F.size("lent").cast("bigint").alias("m")), "conv_id").select(PART, "conv_id", OFFSET, "h", "m")
    at = F.col(OFFSET) + F.col(LOCAL)
    kept = rows.join(places, [PART, "conv_id"]).where(at > F.col("h")).select("conv_id", (at - F.col("h") + F.col("m")).alias("pos"), "digest", "chars")
    lent = convs.select("conv_id", F.inline("lent")).select("conv_id", "pos", "digest", "chars")
    length = F.size("lent").cast("bigint") + F.greatest(F.lit(0), F.col("own") - F.col("h"))
    return kept.unionByName(lent), convs.select("conv_id", length.alias("turns"))


def blocks_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and block: ids t1.. and characters n1.. of its positions, the node
    ``pa, pb`` in which the block before ended, the characters before it, and the block's own sums.
    A conversation without turns has an empty first block."""
    tag = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("digest")), 256)
    slot = F.expr(f"(pos - 1) % {WIDTH} + 1")
    placed = turns.select("conv_id", F.expr(f"(pos - 1) div {WIDTH}").alias("block"), slot.alias("slot"), tag.alias("tag"), "chars")
    placed = placed.select("conv_id", "block", "slot", "chars", _word(F.col("tag"), 0).alias("a"), _word(F.col("tag"), 1).alias("b"))
    here = [f"max(CASE WHEN slot = {i} THEN {c} END) AS {c}{i}" for i in SLOTS for c in ("a", "b", "chars")]
    own = ["bit_xor(a) AS xa", "bit_xor(b) AS xb", "sum(chars) AS xn", "count(*) AS size"]
    wide = placed.groupBy("conv_id", "block").agg(*map(F.expr, here + own))
    path = [f"CASE WHEN a{i} IS NOT NULL THEN struct(a{i} AS a, b{i} AS b) END AS t{i}" for i in SLOTS]
    wide = wide.selectExpr("conv_id", "block", *path, *[f"chars{i} AS n{i}" for i in SLOTS], "xa", "xb", "xn", "size")
    none = {c: F.lit(0).cast("bigint").alias(c) for c in ("block", "xa", "xb", "xn", "size")}
    empty = convs.where("turns = 0").select("conv_id", *[none[c] if c in none else F.lit(None).cast(wide.schema[c].dataType).alias(c) for c in wide.columns[1:]])
    wide = wide.unionByName(empty).withColumn("stretch", F.expr(f"block div {STRETCH}"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = wide.groupBy("conv_id", "stretch").agg(F.expr("bit_xor(xa)").alias("sa"), F.expr("bit_xor(xb)").alias("sb"), F.sum("xn").alias("sn"))
    starts = sums.select("conv_id", "stretch", F.expr("bit_xor(sa)").over(before).alias("sa"), F.expr("bit_xor(sb)").over(before).alias("sb"), F.sum("sn").over(before).alias("sn")).where("stretch > 0")
    within = Window.partitionBy("conv_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    joined = wide.join(starts, ["conv_id", "stretch"], "left")
    prior = {f"p{c}": zero(F.col(f"s{c}")).bitwiseXOR(zero(F.expr(f"bit_xor(x{c})").over(within))) for c in "ab"}
    return joined.select(*wide.columns, prior["pa"].alias("pa"), prior["pb"].alias("pb"), (zero(F.col("sn")) + zero(F.sum("xn").over(within))).alias("pn"))


def rolled_up(blocks: DataFrame, extra: str) -> DataFrame:
    """One row per trie node: its depth and key, its parent's key, the characters of its last turn and of
    those before it, and the aggregates ``extra`` of its members."""
    groups = blocks.sparkSession.sql(
        f"SELECT block, pa, pb, {', '.join(PATH)}, {WIDTH} - bit_count(grouping_id()) AS level, min(pn) AS pn, "
        f"{', '.join(f'min(n{i}) AS n{i}' for i in SLOTS)}, {extra} FROM {{blocks}} GROUP BY block, pa, pb, ROLLUP({', '.join(PATH)})", blocks=blocks)
    known = {"block", "pa", "pb", "level", "pn", *PATH, *[f"n{i}" for i in SLOTS]}
    more = [c for c in groups.columns if c not in known]
    last = F.element_at(F.array(*PATH), F.when(F.col("level") > 0, F.col("level").cast("int")).otherwise(1))
    # shorter members of a group lack its last turn, and a later block's level 0 is a node of the block before
    nodes = groups.withColumn("last", last).where("level > 0 AND last IS NOT NULL OR level = 0 AND block = 0")
    step = lambda i, value: f"CASE WHEN level >= {i} THEN {value} ELSE 0 END"
    keys = [" ^ ".join([f"p{c}", *[step(i, f"t{i}.{c}") for i in SLOTS]]) + f" AS k{c}" for c in "ab"]
    above = [" ^ ".join([f"p{c}", *[step(i + 1, f"t{i}.{c}") for i in SLOTS]]) + f" AS q{c}" for c in "ab"]
    chars = f"CASE WHEN level > 0 THEN element_at(array({', '.join(f'n{i}' for i in SLOTS)}), int(level)) ELSE 0 END AS chars"
    ahead = " + ".join(["pn", *[step(i + 1, f"n{i}") for i in SLOTS]]) + " AS ahead"
    return nodes.selectExpr(f"block * {WIDTH} + level AS depth", *keys, *above, chars, ahead, *more)


def _pieces(batches):
    """Ids of a node as comma-joined pieces, in their order; the input is sorted by node and id."""
    for batch in batches:
        rows = zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True)
        out = []
        for node, group in groupby(rows, key=lambda r: r[:3]):
            ids = [r[3] for r in group]
            out += [(*node, ids[i], ",".join(map(str, ids[i:i + PIECE]))) for i in range(0, len(ids), PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], [*NODE, "first", "piece"])


def _digests(batches):
    """SHA-256 of each node's pieces, fed one after the other; the input is sorted by node and first id."""
    now, state = None, None
    for batch in batches:
        out = []
        for *node, piece in zip(*[batch.column(c).to_pylist() for c in (*NODE, "piece")], strict=True):
            if node != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if out:
            yield _digest_rows(out)
    if now is not None:
        yield _digest_rows([(*now, state.hexdigest())])


def _digest_rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], [*NODE, "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ascending, comma-joined ids of ``ends (depth, ka, kb, conv_id)``. Ranges join a
    node's ids into pieces in many tasks; only the pieces meet, and are hashed as a stream."""
    order = [*NODE, "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "depth long, ka long, kb long, first long, piece string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """All nodes of the trie of ``turns (conv_id, turn, role, text)``: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    all_turns, convs = rebuilt(turns)
    convs = _written(convs, "lengths")
    blocks = _written(blocks_of(all_turns, convs), "blocks")
    nodes = _written(rolled_up(blocks, "count(*) AS n_convs, min(conv_id) AS conv_id"), "nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("qa").alias("ka"), F.col("qb").alias("kb")]
    children = nodes.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    counted = _written(nodes.join(children, NODE, "left").fillna(0, ["n_children"]), "counted")
    # a node's smallest member, from its first own node on, adds nothing; a conversation that is never the smallest adds all its turns
    own = counted.groupBy("conv_id").agg(F.min_by("ahead", "depth").alias("until"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    stretches = blocks.groupBy("conv_id", "stretch").agg(F.sum("xn").alias("part"))
    total = stretches.groupBy("conv_id").agg(F.sum("part").alias("total"))
    value = total.join(own, "conv_id", "left").select("conv_id", F.coalesce("until", "total").alias("until"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    valued = blocks.join(stretches.select("conv_id", "stretch").join(value, "conv_id"), ["conv_id", "stretch"])
    passed = rolled_up(valued, "sum(until) AS until, sum(leaf) AS n_leaves, min_by(until, conv_id) AS least_until").select(*NODE, "until", "n_leaves", "least_until")
    ends = blocks.groupBy("conv_id").agg(F.sum("size").alias("depth"), F.expr("bit_xor(xa)").alias("ka"), F.expr("bit_xor(xb)").alias("kb"))
    root = counted.where("depth = 0").select(F.col("depth").alias("up"), F.col("conv_id").alias("root_id"))  # one row
    parents = counted.select(F.col("depth").alias("up"), F.col("ka").alias("qa"), F.col("kb").alias("qb"), F.col("conv_id").alias("up_id")).where("depth > 0")
    out = counted.join(passed, NODE).join(ends_digests(ends), NODE, "left")
    out = out.withColumn("up", F.col("depth") - 1).join(parents, ["up", "qa", "qb"], "left").join(F.broadcast(root), "up", "left")
    saved = F.col("until") - F.col("least_until") - (F.col("n_convs") - 1) * F.col("ahead")
    return out.select("conv_id", "depth", F.coalesce("up_id", "root_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on its base."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP13_SQL = """
WITH own AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), crc AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                         lambda acc, x: CASE WHEN xor(acc, x) % 2 = 1 THEN xor(xor(acc, x) >> 1, 3988292384::BIGINT) ELSE xor(acc, x) >> 1 END), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), lent AS (
  SELECT c.conv_id, o.pos, o.role, o.text FROM crc c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
), turns AS (
  SELECT * FROM lent
  UNION ALL
  SELECT c.conv_id, o.pos - c.h + (SELECT count(*) FROM lent l WHERE l.conv_id = c.conv_id) AS pos, o.role, o.text
  FROM crc c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
), prefixes AS (
  SELECT conv_id, pos AS depth, length(text) AS chars,
         string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS path,
         lag(pos) OVER (PARTITION BY conv_id ORDER BY pos DESC) IS NULL AS ends
  FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM turns) FROM crc
), members AS (
  SELECT *, CASE WHEN depth > 0 THEN left(path, 64 * (depth - 1)::INTEGER) END AS up,
         min(conv_id) OVER (PARTITION BY depth, path) AS least
  FROM prefixes
), nodes AS (
  SELECT least AS conv_id, depth, path, any_value(up) AS up, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY ALL
), children AS (
  SELECT up, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
), below AS (
  SELECT m.path, m.depth, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth
  LEFT JOIN children c ON c.up = n.path AND c.depth = n.depth
  GROUP BY 1, 2
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.path = n.path AND b.depth = n.depth
LEFT JOIN children c ON c.up = n.path AND c.depth = n.depth
LEFT JOIN nodes p ON p.path = n.up AND p.depth = n.depth - 1
"""
