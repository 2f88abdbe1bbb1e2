"""Do quantised vectors keep their neighbours? Recall@10 of each bit width against full precision.

Queries are the ids divisible by QUERY_STEP, the table is everything; nearness is the largest
inner product (to DIGITS decimals, then the smaller id). The exact form scores blocks of queries against chunks of
rows, each cell returning ten rows per query at most. The probed form cuts the table into inverted lists around
centroids and scores only a query's nearest lists; lists are split into parts of bounded size, so
that neither a long list nor a copied vector makes one long task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import tables
from quire.functions.grid import against_all
from quire.operators.quant import quantize_groups
from quire.session import scratch_path
from quire.sources import literals as L

QUERY_STEP, TOP, DIGITS = 50, 10, 9
#: Rounds of centroid updates, share of the lists that a query probes, rows of a list's part.
ROUNDS, PROBED, PART_ROWS = 2, 0.7, 8192
#: Lists at most: centroids are sent to all tasks (8 MB at 64 dimensions). Beyond it lists grow, and get more parts.
MOST_LISTS = 16_384
#: Inner products that a task holds at once: 16 MB of them, and as much again for each step that takes them on.
TILE = 1 << 21
FULL = 0  # "bits" of the unquantised vectors
SCORES = "query_id long, bits int, vec_id long, score double"
_SCORES = pa.schema([("query_id", pa.int64()), ("bits", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def variants(v: DataFrame) -> DataFrame:
    """``vec_id, x0, x3, ...``: each vector as it is and as its codes at each width say. Null vectors are left out."""
    def back(bits: int):
        groups = quantize_groups(F.col("v"), F.lit(bits))
        return F.flatten(F.transform(groups, lambda g: F.transform(g["q"], lambda q: g["mn"] + q * g["scale"])))

    return v.where("vec_id IS NOT NULL AND size(v) > 0").select("vec_id", F.col("v").alias(f"x{FULL}"), *[back(b).alias(f"x{b}") for b in L.QUANT_BITS])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _steps(rows: int, width: int) -> Iterator[slice]:
    """Runs of rows whose products with ``width`` others fit a tile."""
    step = max(1, TILE // max(1, width))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def _best(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """The TOP best rows of each asked vector and width, an id never among its own."""
    ids, own = rows["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
    found = []
    if len(ids) and len(own):
        top = min(TOP, len(ids))
        for bits in (FULL, *L.QUANT_BITS):
            x, q = _matrix(rows[f"x{bits}"]), _matrix(asked[f"x{bits}"])
            best, near = np.full((len(own), top), -np.inf), np.zeros((len(own), top), np.int64)
            for run in _steps(len(own), len(ids)):
                scores = q[run] @ x.T
                np.round(scores, DIGITS, out=scores)
                scores[own[run, None] == ids[None, :]] = -np.inf
                for i, line in enumerate(scores, run.start):
                    at = np.flatnonzero(line >= np.partition(line, -top)[-top])
                    at = at[np.lexsort((ids[at], -line[at]))][:top]
                    best[i], near[i] = line[at], ids[at]
            i, k = np.nonzero(best > -np.inf)
            found.append(pa.table([own[i], np.full(len(i), bits, np.int32), near[i, k], best[i, k]], _SCORES))
    return pa.concat_tables(found) if found else _SCORES.empty_table()


def _top(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id", "bits").orderBy(F.col("score").desc(), "vec_id")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP).select("query_id", "bits", "vec_id")


def _recall(found: DataFrame, truth: DataFrame | None, widths: list[int]) -> DataFrame:
    """Share of the full-precision neighbours that each width finds, over all queries together."""
    marks = found.withColumn("real", F.lit(False)) if truth is not None else found.withColumn("real", F.col("bits") == FULL)
    if truth is not None:
        marks = marks.unionByName(truth.where(F.col("bits") == FULL).withColumn("real", F.lit(True)))
    seen = [F.max((F.col("bits") == b) & (F.lit(truth is None) | ~F.col("real"))).alias(f"in{b}") for b in widths]
    pairs = marks.groupBy("query_id", "vec_id").agg(F.max("real").alias("real"), *seen)
    total = pairs.where("real").agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n"), *[F.sum(F.col(f"in{b}").cast("int")).alias(f"in{b}") for b in widths])
    per = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.col(f"in{b}").alias("hits")) for b in widths])).alias("p")
    return total.select("n_queries", "n", per).select("p.bits", "n_queries", F.round(F.try_divide("p.hits", "n"), 6).alias("recall_at_10"))


def _asked(table: DataFrame) -> DataFrame:
    return table.where(F.col("vec_id") % QUERY_STEP == 0)


def _table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All variants, written once, and the queries among them as a plan of their own."""
    path = scratch_path(spark, "variants")
    variants(tables.vectors(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path), _asked(spark.read.parquet(path))


def neighbour_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bits, n_queries, recall_at_10 of the exact search at each width."""
    table, asked = _table(spark, sf_dir)
    return _recall(_top(against_all(table, asked, "vec_id", _best, SCORES)), None, list(L.QUANT_BITS))


# ---------------------------------------------------------------- inverted lists
def _nearness(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Larger for a nearer centroid."""
    return np.round(x @ centroids.T - 0.5 * np.square(centroids).sum(axis=1), DIGITS)


def fitted_centroids(table: DataFrame) -> np.ndarray:
    """Rows chosen by a hash of their id, moved ROUNDS times to the mean of the rows nearest to them. Tasks send a sum and
    a count per list, Spark adds them up, and only the centroids come back."""
    spark = table.sparkSession
    n = table.count()
    k = min(MOST_LISTS, int(np.ceil(np.sqrt(n))))
    start = table.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(k).select("vec_id", f"x{FULL}").collect()
    centroids = np.array([r[1] for r in start], np.float64)
    for _ in range(ROUNDS if n else 0):
        shared = spark.sparkContext.broadcast(centroids)

        def sums(batches, shared=shared):
            c = shared.value
            total, count = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0))
                for run in _steps(len(x), len(c)):
                    at = _nearness(x[run], c).argmax(axis=1)
                    np.add.at(total, at, x[run])
                    count += np.bincount(at, minlength=len(c))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"list": pa.array(used, pa.int64()), "n": count[used], "total": pa.array(list(total[used]), pa.list_(pa.float64()))})

        parts = table.select(f"x{FULL}").mapInArrow(sums, "list long, n long, total array<double>")
        cells = parts.select("list", "n", F.posexplode("total").alias("dim", "x")).groupBy("list", "dim").agg((F.sum("x") / F.sum("n")).alias("x"))
        moved = cells.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("c")).select("list", "c.x").collect()
        centroids = centroids.copy()
        for r in moved:
            centroids[r[0]] = r[1]
    return centroids


def _lists_of(df: DataFrame, centroids: np.ndarray, count: int) -> DataFrame:
    """``df`` with the ``count`` nearest lists of each row, nearest first."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(f"x{FULL}"))
            for run in _steps(len(x), len(shared.value)):
                lists = np.argsort(-_nearness(x[run], shared.value), axis=1, kind="stable")[:, :count]
                ends = np.arange(0, lists.size + 1, lists.shape[1], dtype=np.int32)
                own = batch.slice(run.start, run.stop - run.start)
                yield pa.RecordBatch.from_pydict({**{c: own.column(c) for c in own.schema.names}, "lists": pa.ListArray.from_arrays(ends, lists.ravel())})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, lists array<bigint>")


def inverted_lists(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Every row with its list and the part of the list it is in."""
    placed = _written(_lists_of(table, centroids, 1).withColumn("list", F.element_at("lists", 1)).drop("lists"), "inverted-lists")
    parts = placed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(PART_ROWS)).alias("parts"))  # a row per centroid at most
    return placed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")


def neighbour_recall_lists(spark: SparkSession, sf_dir: str, probed: float = PROBED) -> DataFrame:
    """bits (0: full precision), n_queries, recall_at_10 of the probed search, against the exact neighbours."""
    table, asked = _table(spark, sf_dir)
    truth = _written(_top(against_all(table, asked, "vec_id", _best, SCORES)), "neighbours")
    centroids = fitted_centroids(table)
    if not len(centroids):
        return _recall(truth, truth, [FULL, *L.QUANT_BITS])
    listed = inverted_lists(table, centroids)
    sizes = _written(listed.select("list", "part").distinct(), "list-parts")
    probes = _lists_of(asked, centroids, max(1, int(np.ceil(probed * len(centroids))))).withColumn("list", F.explode("lists")).drop("lists")
    probes = probes.join(F.broadcast(sizes), "list")  # a row per part of a list
    found = listed.groupBy("list", "part").cogroup(probes.groupBy("list", "part")).applyInArrow(_best, SCORES)
    return _recall(_top(found), truth, [FULL, *L.QUANT_BITS])
