"""Hard negatives by Kronecker-packed inner products.

Anchors ask all rows, in a grid of anchor blocks and candidate chunks. Inside one cell of the grid the
components of several candidates are shifted to be non-negative and laid side by side as fields of one wide integer;
a product with an anchor's component then advances all of these inner products at once. The fields
are as wide as the largest sum they may hold, so the scores read back from them are exact.

Defined results: a row without id, label or vector, or with a null or non-finite component, takes
no part. Components a shorter vector lacks count as zero. No row is a partner of a row with its own
id; repeated rows count each. Tied scores go by the smaller id. An empty table gives no rows. Other columns are
not looked at. Two rows whose score is outside a long are no partners.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.batches import list_array, offsets_of
from quire.session import scratch_path

#: Components are rounded down to 1 / SCALE.
SCALE = 256
#: Anchors and candidates of one cell of the grid, at most in the mean.
ANCHOR_BLOCK, CANDIDATE_CHUNK = 4096, 65536
#: Anchors and packed words that are multiplied together, to stay in a core's cache.
TILE, WORDS = 64, 1024
#: Fields of one integer where a single field needs over 64 bits.
BIG_FIELDS = 8
LONG_MAX = (1 << 63) - 1


def finite_vector(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    inf = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def quantized(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of ``floor(SCALE * x)``, zero behind a vector's end: int64, or Python integers beyond it."""
    column = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = np.asarray(column.flatten(), np.float64)
    lengths = np.diff(np.asarray(column.offsets))
    big = len(flat) > 0 and float(np.abs(flat).max()) >= 2.0 ** 52
    out = np.zeros((len(lengths), width), object if big else np.int64)
    whole = [math.floor(SCALE * x) if abs(x) < 2.0 ** 52 else int(x) * SCALE for x in flat.tolist()] if big else np.floor(flat * SCALE).astype(np.int64)
    at = np.repeat(np.arange(len(lengths)) * width - offsets_of(lengths)[:-1], lengths) + np.arange(len(flat))
    out.reshape(-1)[at] = whole
    return out


def packed_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact ``anchors @ candidates.T``, several candidates in each integer."""
    n, m = len(candidates), len(anchors)
    low = int(candidates.min(initial=0))
    reach = int(candidates.max(initial=0)) - low
    bound = max((sum(abs(int(a)) for a in row) for row in anchors), default=0) * reach
    bits = max(1, (2 * bound).bit_length())
    wide = bits > 64 or candidates.dtype == object or anchors.dtype == object
    fields, kind = (BIG_FIELDS, object) if wide else (64 // bits, np.uint64)
    if wide:
        anchors, candidates = anchors.astype(object), candidates.astype(object)
    words_n = -(-n // fields)
    shifted = np.zeros((fields * words_n, candidates.shape[1]), object if wide else np.int64)
    shifted[:n] = candidates - low
    words = np.zeros((candidates.shape[1], words_n), kind)
    for f in range(fields):
        part = shifted[f * words_n:(f + 1) * words_n].T
        words |= part << (bits * f) if wide else part.astype(np.uint64) << np.uint64(bits * f)
    offset = sum(bound << (bits * f) for f in range(fields))
    out = np.empty((m, fields * words_n), object if wide else np.int64)
    correction = (anchors.sum(axis=1) * low - bound).reshape(-1, 1)
    factors = anchors if wide else anchors.astype(np.uint64)  # negative ones wrap; the total doesn't
    mask = (1 << bits) - 1
    for a in range(0, m, TILE):
        for w in range(0, words_n, WORDS):
            block = words[:, w:w + WORDS]
            total = np.full((len(factors[a:a + TILE]), block.shape[1]), offset if wide else np.uint64(offset), kind)
            for d in range(len(block)):
                total += factors[a:a + TILE, d, None] * block[d]
            for f in range(fields):
                field = (total >> (bits * f)) & mask if wide else ((total >> np.uint64(bits * f)) & np.uint64(mask)).astype(np.int64)
                out[a:a + TILE, f * words_n + w:f * words_n + w + block.shape[1]] = field + correction[a:a + TILE]
    return out[:, :n]


def _best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the positions ``at`` (ascending by id), the ``k`` of highest score, ties by position."""
    values = scores[at]
    if len(at) > k:
        least = np.partition(values, len(at) - k)[len(at) - k]
        over = at[values > least]
        at = np.concatenate([over, at[values == least][:k - len(over)]])
        at.sort()
        values = scores[at]
    return at[np.argsort(-values, kind="stable")]


def _cell(candidates: pa.Table, anchors: pa.Table):
    """Each anchor's place and row, its scores against the cell's candidates (sorted by id), their ids, and which of
    them are partners of the same label and of another."""
    candidates = candidates.sort_by("vec_id")
    width = max((int(np.diff(np.asarray(t["vector"].combine_chunks().offsets)).max(initial=0)) for t in (candidates, anchors)), default=0)
    ids, labels = candidates["vec_id"].to_numpy(), candidates["label"].to_numpy()
    wanted = quantized(anchors["vector"], width)
    pool = quantized(candidates["vector"], width)
    for start in range(0, anchors.num_rows, TILE):
        part = anchors.slice(start, TILE)
        scores = packed_products(wanted[start:start + TILE], pool)
        fits = (np.abs(scores) <= LONG_MAX).astype(bool)
        for i, (row, own, label) in enumerate(zip(part["row"].to_pylist(), part["vec_id"].to_pylist(), part["label"].to_pylist(), strict=True)):
            yield start + i, row, scores[i], ids, (labels == label) & fits[i] & (ids != own), (labels != label) & fits[i]


def _positives(count: int):
    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"row": [], "positive_id": [], "positive_score": []}
        if candidates.num_rows and anchors.num_rows:
            for _, row, scores, ids, same, _ in _cell(candidates, anchors):
                at = _best(scores, np.flatnonzero(same), count)
                out["row"] += [row] * len(at)
                out["positive_id"] += ids[at].tolist()
                out["positive_score"] += scores[at].tolist()
        return pa.table(out, pa.schema([(k, pa.int64()) for k in out]))

    return run


def _negatives(count: int, least: int):
    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"row": [], "positive_score": [], "negative_id": [], "negative_score": []}
        if candidates.num_rows and anchors.num_rows:
            asked = anchors["scores"].to_pylist()
            for i, row, scores, ids, _, different in _cell(candidates, anchors):
                at = np.flatnonzero(different)
                for positive in sorted(set(asked[i])):
                    lowest = -(-least * positive // 100)
                    inside = at[(scores[at] >= lowest) & (scores[at] <= positive)]
                    best = _best(scores, inside, count)
                    out["row"] += [row] * len(best)
                    out["positive_score"] += [positive] * len(best)
                    out["negative_id"] += ids[best].tolist()
                    out["negative_score"] += scores[best].tolist()
        return pa.table(out, pa.schema([(k, pa.int64()) for k in out]))

    return run


def _first(df: DataFrame, key: list[str], score: str, name: str, count: int, rank: str) -> DataFrame:
    """The first ``count`` rows of each key; tasks keep no more than these before the shuffle."""
    order = Window.partitionBy(*key).orderBy(F.col(score).desc(), F.col(name))
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= count)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows (vec_id, label,
    vector)``: per anchor its ``positives`` best rows of the same label, and per such pair the ``negatives`` best rows of another label
    that score from ``least`` to 100 per cent of the positive's score.

    The grid sends every candidate once to each block of anchors. Each cell returns its own best rows,
    so that what is ranked together grows with the chunks and not with the rows.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "negatives-rows")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite_vector(F.col("vector"))
    (rows.select("vec_id", "label", F.col("vector").cast("array<double>").alias("vector")).where(ok)
     .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "vector",
             F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")).write.parquet(path))
    kept = spark.read.parquet(path)
    n, asked = kept.agg(F.count("*"), F.count_if("is_anchor")).first()
    chunks = max(-(-n // CANDIDATE_CHUNK), 2 * spark.sparkContext.defaultParallelism)
    blocks = max(1, -(-asked // ANCHOR_BLOCK))
    own_chunk = F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")
    own_block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    pool = kept.select("vec_id", "label", "vector", own_chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    anchors = spark.read.parquet(path).where("is_anchor").select("row", "vec_id", "label", "vector", own_block.alias("block"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")

    def grid(asking: DataFrame, fn, schema: str) -> DataFrame:
        left, right = (t.groupBy("block", "chunk") for t in (pool, asking.select("*", everywhere)))
        return left.cogroup(right).applyInArrow(fn, schema)

    near = grid(anchors, _positives(positives), "row long, positive_id long, positive_score long")
    near_path = scratch_path(spark, "negatives-positives")
    _first(near, ["row"], "positive_score", "positive_id", positives, "place").write.parquet(near_path)
    near = spark.read.parquet(near_path)
    scores = near.groupBy("row").agg(F.collect_set("positive_score").alias("scores"))
    far = grid(anchors.join(scores, "row"), _negatives(negatives, least), "row long, positive_score long, negative_id long, negative_score long")
    far = _first(far, ["row", "positive_score"], "negative_score", "negative_id", negatives, "rank")
    return (near.join(far, ["row", "positive_score"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100; the label of every seventh id moves on by one."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(e.select("vec_id", label.alias("label"), F.col("embedding").alias("vector")), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), pos AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
       n.other AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5
"""
