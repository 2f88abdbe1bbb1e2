"""JSONL training examples of the usual shapes, read with our source: closed and orphan think
tags, answers that stop in mid sentence, and the lines' text as it was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources import files

ANSWERS = ["Done.", "<think>why</think>It stops in", "no open tag</think> Fine!", "tail</think>\nends, then", "Ok? <think>a\nb</think>"]


def test_examples_survive_the_round_trip(spark, tmp_path):
    rows = [(f"<|im_start|>user\nq{i}<|im_end|>\n<|im_start|>assistant\n{a}<|im_end|>", "train") for i, a in enumerate(ANSWERS)]
    files.write_jsonl(spark.createDataFrame(rows, "text STRING, split STRING"), str(tmp_path / "set"))
    df = files.read_jsonl(spark, str(tmp_path / "set"))
    assert sorted(r["text"] for r in df.collect()) == sorted(t for t, _ in rows)
    resp = F.regexp_extract("text", r"(?s)<\|im_start\|>assistant\n(.*)<\|im_end\|>$", 1)
    got = df.select(F.regexp_extract("text", "q(\\d)", 1).alias("i"), T.strip_think(resp).contains("</think>").alias("orphan"),
                    T.ends_mid_sentence(resp).alias("cut")).orderBy("i").collect()
    assert [r["orphan"] for r in got] == [False, False, True, True, False]
    assert [r["cut"] for r in got] == [False, True, False, True, True]
