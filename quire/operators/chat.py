"""Chat rendering, think-stripping and the prompt × temperature plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.sources import literals as L


def inject_think(conv_id, text):
    """Deterministic think tags (the inputs never carry any): a closed pair, an orphan close."""
    return (F.when(conv_id % 3 == 0,
                   F.concat(F.lit("<think>"), F.left(text, F.lit(40)), F.lit("</think>\n"), text))
            .when(conv_id % 3 == 1, F.concat(F.left(text, F.lit(30)), F.lit("</think>"), text))
            .otherwise(text))


def chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.prompts(spark, sf_dir)
    c = T.chat_prompt(F.col("prompt"))
    return p.select("prompt_id", c.alias("chat"), F.length(c).cast("bigint").alias("n_chars"))


def chat_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training example text; generation metadata is dropped before the sink.

    ``ends_mid_sentence`` flags responses cut by a generation cap; they are kept.
    """
    r = tables.responses(spark, sf_dir)
    e = T.chat_example(F.col("prompt"), F.col("text"))
    return r.select("conv_id", "turn", e.alias("text"), F.length(e).cast("bigint").alias("n_chars"),
                    T.ends_mid_sentence(F.col("text")).alias("ends_mid_sentence"))


def turn_segment(role, text):
    """One rendered message: start marker, role, newline, content, end marker, newline."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit(L.CHAT_END + "\n"))


def chat_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered conversations, message by message: read in order of ``turn``, a conversation's
    rows are its text, which ends in the open assistant turn.

    Rows stay apart on purpose: a conversation may hold a third of all turns, and is
    never gathered into one task. Only the open turns need a (partial) aggregation.
    """
    c = tables.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    turns = c.select("conv_id", "turn", turn_segment(F.col("role"), F.col("text")).alias("rendered"))
    last = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    return turns.unionByName(last.select("conv_id", "turn", F.lit(L.CHAT_ASSISTANT_OPEN).alias("rendered")))


def strip_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.responses(spark, sf_dir)
    t = inject_think(F.col("conv_id"), F.col("text"))
    strict = T.strip_think(t)
    lenient = T.strip_think(t, lenient=True)
    return r.select("conv_id", "turn",
                    strict.contains("</think>").alias("has_orphan"),
                    F.length(strict).cast("bigint").alias("strict_chars"),
                    F.length(lenient).cast("bigint").alias("lenient_chars"),
                    F.md5(strict).alias("strict_md5"), F.md5(lenient).alias("lenient_md5"))


def temperature_plan(spark: SparkSession, sf_dir: str,
                     spec: str = L.DEFAULT_TEMPERATURES) -> DataFrame:
    """Prompt × temperature plan rows with the normalised sampling settings.

    The temperature list is parsed by Spark (split + cast) and fanned out with a
    generator, so the plan needs no join.
    """
    p = tables.prompts(spark, sf_dir)
    plan = p.select("prompt_id", F.posexplode(F.split(F.lit(spec), ",")).alias("temp_idx", "t"))
    t = F.col("t").cast("double")
    return plan.select("prompt_id", F.col("temp_idx").cast("int").alias("temp_idx"),
                       t.alias("temperature"),
                       F.greatest(t, F.lit(L.MIN_TEMPERATURE)).alias("eff_temperature"),
                       (t > 0).alias("do_sample"), F.lit(L.TOP_P).alias("top_p"))
