"""Corpus pipeline: from the documents to token ids, in five stages.

Each stage takes and returns documents (all their columns; the last returns digests of the token
ids) and works on everything its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, jaccard, pii, toxicity
from quire.session import scratch_path


def _new_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    column = _new_name(docs, "toxicity")
    return toxicity.score(docs, *toxicity.fit(docs, labels), column).where(F.col(column) < 0.5).drop(column)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones. Rows with one id are one
    document; documents without an id stay."""
    gone = jaccard.join_classes(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    hit = decontaminate.find_items(docs, items).where(F.size("hits") > 0).select(F.col("doc_id").alias("hit_id"), F.col("doc_key").alias("hit_key")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("hit_id")) & (F.xxhash64(docs["text"]) == F.col("hit_key"))
    return docs.join(hit.hint("shuffle_hash"), same, "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind; ``n_chars`` follows the text."""
    out = pii.redact(pii.detect(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(out.columns[-1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, encoded and decoded."""
    return bpe.round_trip(docs, bpe.load_ranks(bpe.default_ranks_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("byte_bpe", tokenize),
]

#: Trained scores, boosted trees and pair merges: no SQL states them. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written once to the shared folder, because
    the next one reads it more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
