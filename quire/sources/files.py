"""File sources and sinks: JSONL train/valid sets, materialise-if-absent,
present-source discovery and storage footprint.

Written tables go to the shared checkpoint folder named by the session
(``spark.checkpoint.dir``), never to a machine-local path.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.operators.splits import ranked_prompts
from quire.session import scratch_path
from quire.sources.publishing import publish

JSONL_SCHEMA = "text STRING, split STRING"


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, one folder per split; nulls are written, not dropped."""
    (df.write.mode(mode).partitionBy("split").option("ignoreNullFields", "false")
     .option("compression", "none").json(path))


def read_jsonl(spark: SparkSession, path: str, schema: str = JSONL_SCHEMA) -> DataFrame:
    """Explicit schema; a malformed line fails the job like ``json.loads`` would."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def calibration_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered examples with their prompt's split; metadata dropped before the sink."""
    split = ranked_prompts(spark, sf_dir).select("prompt_id", "split")
    r = tables.responses(spark, sf_dir).select("prompt_id", "prompt", "text")
    return (r.join(split, "prompt_id")
            .select(T.chat_example(F.col("prompt"), F.col("text")).alias("text"), "split"))


def _summary(df: DataFrame) -> DataFrame:
    return df.select("split", F.md5("text").alias("text_md5"),
                     F.length("text").cast("bigint").alias("n_chars"))


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "calibration-jsonl")
    write_jsonl(calibration_examples(spark, sf_dir), path)
    return _summary(read_jsonl(spark, path))


def materialize_if_absent(spark: SparkSession, sf_dir: str, path: str | None = None,
                          regenerate: bool = False) -> DataFrame:
    """Write the calibration set only when none is published there (or forced), then load it; a folder that a
    writer left half-way counts as absent."""
    path = path or scratch_path(spark, "calibration-cache")
    publish(spark, path, lambda folder: write_jsonl(calibration_examples(spark, sf_dir), folder), replace=regenerate)
    # asked for again: the set that is there stays, and nothing is written
    there = publish(spark, path, lambda folder: write_jsonl(calibration_examples(spark, sf_dir).limit(0), folder))
    return _summary(read_jsonl(spark, there))


def present_sources(spark: SparkSession, sf_dir: str,
                    names=("documents", "labels", "pages", "missing_table")) -> DataFrame:
    """Skip absent inputs with a notice, union the present ones by name."""
    frames = []
    for n in names:
        try:
            df = spark.read.parquet(os.path.join(sf_dir, f"{n}.parquet"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
                raise  # there, but not readable: no reason to skip it
            print(f"SKIP {n}: not found")
            continue
        frames.append(df.withColumn("source_table", F.lit(n)))
    if not frames:
        return spark.createDataFrame([], "source_table STRING, n_rows BIGINT")
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.groupBy("source_table").agg(F.count(F.lit(1)).alias("n_rows"))


def storage_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File sizes from the binaryFile source (content column pruned), in bytes and GiB."""
    f = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
         .option("recursiveFileLookup", "true").load(sf_dir).select("path", "length"))
    # a table is a file or a folder of files; it is the first part of the path with the suffix
    per = f.select(F.regexp_extract("path", r"([^/]+)\.parquet(?:/|$)", 1).alias("name"),
                   F.col("length").alias("bytes"))
    return (per.groupBy(F.col("name")).agg(F.sum("bytes").alias("bytes"))
            .withColumn("gib", F.round(F.col("bytes") / F.lit(1024.0 ** 3), 9)))
