"""Source / sink semantics: JSONL round trip, fail-fast parsing, materialise-if-absent,
skipped inputs, and the incremental streaming grader."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quire.session import ensure_checkpoint_dir, scratch_path
from quire.sources import files


def test_jsonl_keeps_nulls_and_round_trips(spark):
    path = scratch_path(spark, "t-jsonl")
    df = spark.createDataFrame([("a\nb", "train"), (None, "valid")], "text STRING, split STRING")
    files.write_jsonl(df, path)
    lines = []
    for root, _dirs, names in os.walk(path):
        for n in names:
            if n.endswith(".json"):
                with open(os.path.join(root, n)) as f:
                    lines += [json.loads(x) for x in f if x.strip()]
    assert {"text": None} in lines and {"text": "a\nb"} in lines
    back = files.read_jsonl(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([("a\nb", "train"), (None, "valid")], key=str)


def test_malformed_line_fails_the_read(spark):
    path = scratch_path(spark, "t-bad")
    os.makedirs(os.path.join(path, "split=train"))
    with open(os.path.join(path, "split=train", "part-0.json"), "w") as f:
        f.write('{"text": "ok"}\n{"text": broken\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, path).collect()


def test_materialize_if_absent_keeps_the_first_write(spark):
    path = scratch_path(spark, "t-cache")
    first = files.materialize_if_absent(spark, SF_SMALL, path=path).count()
    files.write_jsonl(spark.createDataFrame([("x", "train")], "text STRING, split STRING"), path,
                      mode="ignore")
    assert files.read_jsonl(spark, path).count() == first
    forced = files.materialize_if_absent(spark, SF_SMALL, path=path, regenerate=True).count()
    assert forced == first


def test_absent_source_is_skipped(spark, capsys):
    out = files.present_sources(spark, SF_SMALL, names=("labels", "no_such_table"))
    rows = {r["source_table"]: r["n_rows"] for r in out.collect()}
    assert set(rows) == {"labels"} and rows["labels"] > 0
    assert "SKIP no_such_table" in capsys.readouterr().out


def test_streaming_grader_is_incremental(spark):
    from quire import tables
    from quire.operators.grading import suite_score
    from quire.streaming.grader import start_grader

    ensure_checkpoint_dir(spark)
    base = scratch_path(spark, "t-stream")
    src, out, ck = (os.path.join(base, x) for x in ("src", "out", "ck"))
    r = tables.responses(spark, SF_SMALL)
    first, second = r.where(F.col("conv_id") % 2 == 0), r.where(F.col("conv_id") % 2 == 1)
    first.write.json(os.path.join(src, "a"))
    os.makedirs(os.path.join(src, "b"))
    # the grader reads the source folder's files; land the second half later
    q = start_grader(spark, os.path.join(src, "*"), out, ck)
    q.awaitTermination()
    n1 = spark.read.parquet(out).agg(F.sum("total")).first()[0]
    assert n1 == first.count() * 3
    second.write.mode("overwrite").json(os.path.join(src, "b"))
    q = start_grader(spark, os.path.join(src, "*"), out, ck)  # resumes from the checkpoint
    q.awaitTermination()
    got = {(x["rule_set"], x["model"], x["suite"]): (x["passed"], x["total"])
           for x in spark.read.parquet(out).collect()}
    want = {(x["rule_set"], x["model"], x["suite"]): (x["passed"], x["total"])
            for x in suite_score(spark, SF_SMALL).collect()}
    assert got == want


def test_batch_generation_captures_failures(spark):
    from quire.operators.inference import echo_backend, generate

    def flaky():
        ok = echo_backend()

        def gen(text, temperature, max_tokens):
            if "boom" in text:
                raise RuntimeError("backend failed")
            return ok(text, temperature, max_tokens)
        return gen

    plan = spark.createDataFrame([(1, 0.2, "hello world hello"), (2, 0.4, "boom now"), (3, 0.01, "a b a c"), (4, 0.2, None)],
                                 "prompt_id BIGINT, eff_temperature DOUBLE, prompt STRING")
    out = {r["prompt_id"]: r for r in generate(plan, flaky, max_tokens=2).collect()}
    assert out[2]["error"].startswith("RuntimeError") and out[2]["tok_count"] == 0 and out[2]["text"] == ""
    assert out[1]["error"] is None and (out[1]["text"], out[1]["tok_count"]) == ("hello world", 2)
    assert out[3]["text"] == "a b" and out[4]["error"] == "ValueError: empty prompt"
    assert all(r["elapsed"] >= 0 for r in out.values())


def test_a_failed_call_fails_its_test(spark):
    from quire.operators.grading import grade
    from quire.sources import literals as L

    rows = spark.createDataFrame([(t, "", None) for t in range(L.N_TESTS)], "test_ord INT, text STRING, error STRING")
    passing = {r["test_ord"] for r in grade(rows, L.tests_df(spark)).where("ok").collect()}
    failed = rows.select("test_ord", "text", F.lit("RuntimeError: x").alias("error"))
    g = grade(failed, L.tests_df(spark)).withColumn("ok", F.col("ok") & F.col("error").isNull())
    assert g.where("ok").count() == 0 and passing <= set(range(L.N_TESTS))


def test_unreadable_table_is_not_skipped(spark, tmp_path):
    from quire.sources.files import present_sources

    (tmp_path / "documents.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        present_sources(spark, str(tmp_path), ("documents", "missing")).collect()


def test_footprint_of_folder_tables(spark, tmp_path):
    from quire.sources.files import storage_footprint

    spark.range(100).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    size = sum(p.stat().st_size for p in (tmp_path / "many.parquet").glob("*.parquet"))
    assert [(r["name"], r["bytes"]) for r in storage_footprint(spark, str(tmp_path)).collect()] == [("many", size)]
