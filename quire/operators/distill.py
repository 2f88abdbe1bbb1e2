"""Teacher → student distillation, parameter sweep and held-out loss by counting.

The classifier is multinomial naive Bayes over hashed words of ``labels.quality``:
training is one aggregation of counts (mergeable, one pass), scoring is a join with the
counts' log-odds, of at most the hash width in rows. The student has far fewer features and
learns from soft targets: an example counts with weight α·p_teacher + (1−α)·y for label 1
and with the rest for label 0. Train and valid come from the seeded group split of the
labelled ids; only train rows are ever counted, only valid rows scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.operators.ranking import seeded_order, split_label
from quire.session import scratch_path
from quire.sources import literals as L

TEACHER_WIDTH, STUDENT_WIDTH = 4096, 64
SMOOTHING = 1.0
GRID = [(w, s) for w in (256, 4096) for s in (0.1, 1.0, 10.0)]
CLIP = 30.0   # log-odds beyond this count as certain


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, split, h, tf): hashed words of each labelled text. Ids are ranked and
    split first; texts are joined afterwards."""
    lab = tables.table(spark, sf_dir, "labels", "doc_id", "quality").where("quality IS NOT NULL")
    r = seeded_order(lab, "doc_id", name="rank", total="n")
    ids = r.select("doc_id", F.col("quality").cast("double").alias("y"), split_label(F.col("rank"), F.col("n")).alias("split"))
    docs = tables.texts(spark, sf_dir, "doc_id", "text")
    toks = ids.join(docs, "doc_id").select("doc_id", "y", "split", F.explode_outer(T.words(F.lower(F.col("text")))).alias("tok"))
    counts = toks.groupBy("doc_id", "y", "split", "tok").agg(F.count("tok").alias("tf"))
    return counts.select("doc_id", "y", "split", T.md5_int(F.col("tok")).alias("h"), "tf")


def stored_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``examples``, written once: texts are tokenised and split one time, whatever is fitted on them."""
    path = scratch_path(spark, "examples")
    examples(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def _feature(width: Column) -> Column:
    return F.pmod(F.col("h"), width)


def log_odds(train: DataFrame, target: Column, key: list[str], smoothing: Column, width: Column) -> tuple[DataFrame, DataFrame]:
    """(*key, f, w): per feature the smoothed log-odds of label 1; (*key, prior, unseen): those of the
    classes and of a feature without counts. Counts may be fractional. ``train``: (*key, doc_id, f, tf) rows."""
    t = train.withColumn("t", target)
    cells = t.where("tf > 0").groupBy(*key, "f").agg(F.sum(F.col("t") * F.col("tf")).alias("c1"), F.sum((1 - F.col("t")) * F.col("tf")).alias("c0"))
    total = cells.groupBy(*key).agg(F.sum("c1").alias("s1"), F.sum("c0").alias("s0"))
    docs = t.select(*key, "doc_id", "t").distinct().groupBy(*key).agg((F.log(F.sum("t")) - F.log(F.sum(1 - F.col("t")))).alias("prior"))
    w = (F.log((F.col("c1") + smoothing) / (F.col("s1") + smoothing * width))
         - F.log((F.col("c0") + smoothing) / (F.col("s0") + smoothing * width)))
    unseen = F.log(F.col("s0") + smoothing * width) - F.log(F.col("s1") + smoothing * width)
    stats = total.join(docs, key)  # one row per key
    out = cells.join(F.broadcast(stats), key)
    return out.select(*key, "f", w.alias("w")), stats.select(*key, "prior", unseen.alias("unseen"))


def scored(rows: DataFrame, weights: DataFrame, stats: DataFrame, key: list[str]) -> DataFrame:
    """(*key, doc_id, y, split, s): log-odds of each document. The weights have at most a hash
    width of rows per key, the stats one row per key."""
    j = rows.join(F.broadcast(weights), [*key, "f"], "left")
    j = j.join(F.broadcast(stats), key)
    s = F.first("prior") + F.sum(F.when(F.col("tf") > 0, F.col("tf") * F.coalesce("w", "unseen")).otherwise(F.lit(0.0)))
    return (j.groupBy(*key, "doc_id", "y", "split")
            .agg(F.least(F.greatest(s, F.lit(-CLIP)), F.lit(CLIP)).alias("s")))


def _loss() -> Column:
    return F.avg(F.log1p(F.exp(F.when(F.col("y") > 0, -F.col("s")).otherwise(F.col("s")))))


def _fit_score(rows: DataFrame, target: Column, width: int) -> DataFrame:
    r = rows.withColumn("f", _feature(F.lit(width))).withColumn("width", F.explode(F.array(F.lit(width))))  # a grid of one point
    weights, stats = log_odds(r.where("split = 'train'"), target, ["width"], F.lit(SMOOTHING), F.lit(float(width)))
    return scored(r, weights, stats, ["width"])


def _valid(s: DataFrame, name: str) -> DataFrame:
    return (s.where("split = 'valid'").agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_eval"), F.round(_loss(), 4).alias("log_loss")))


def distill_student(spark: SparkSession, sf_dir: str, alpha: float = L.DISTILL_ALPHA) -> DataFrame:
    ex = stored_examples(spark, sf_dir)
    teacher = _fit_score(ex, F.col("y"), TEACHER_WIDTH)
    p = F.lit(1.0) / (1 + F.exp(-F.col("s")))
    soft = ex.join(teacher.select("doc_id", (F.lit(alpha) * p + F.lit(1 - alpha) * F.col("y")).alias("target")), "doc_id")
    return (_valid(teacher, "teacher")
            .unionByName(_valid(_fit_score(soft, F.col("target"), STUDENT_WIDTH), "student_soft"))
            .unionByName(_valid(_fit_score(ex, F.col("y"), STUDENT_WIDTH), "student_hard")))


def param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid of hash widths and smoothings, each fitted on the train side and scored on the valid
    side, once; all grid points are counted by the same aggregation."""
    point = F.explode(F.array(*[F.struct(F.lit(w).alias("num_features"), F.lit(s).alias("smoothing")) for w, s in GRID])).alias("g")
    rows = stored_examples(spark, sf_dir).select("*", point).select("doc_id", "y", "split", "h", "tf", "g.*")
    rows = rows.withColumn("f", _feature(F.col("num_features")))
    key = ["num_features", "smoothing"]
    weights, stats = log_odds(rows.where("split = 'train'"), F.col("y"), key, F.col("smoothing"), F.col("num_features").cast("double"))
    s = scored(rows, weights, stats, key).where("split = 'valid'")
    right = F.avg(F.when((F.col("s") > 0) == (F.col("y") > 0), 1.0).otherwise(0.0))
    return s.groupBy(*key).agg(F.round(_loss(), 4).alias("log_loss"), F.round(right, 4).alias("accuracy"))


def valid_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _fit_score(stored_examples(spark, sf_dir), F.col("y"), TEACHER_WIDTH)
    return s.groupBy(F.col("split").alias("model")).agg(F.count(F.lit(1)).alias("n_eval"), F.round(_loss(), 4).alias("log_loss"))
