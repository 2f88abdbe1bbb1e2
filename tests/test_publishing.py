"""Published folders and resumed generations: half-written, twice written, stopped and failing."""

from __future__ import annotations

import os
import threading

from conftest import SF_SMALL


def test_only_published_versions_count(spark, tmp_path):
    from quire.sources.publishing import committed, publish, published

    path = f"{tmp_path}/a/set"
    assert published(spark, path) is None and committed(spark, f"{tmp_path}/a") == []
    spark.range(3).write.parquet(f"{path}/v-dead")  # a writer that never came to its marker
    assert published(spark, path) is None
    first = publish(spark, path, spark.range(10).write.parquet)
    assert spark.read.parquet(first).count() == 10
    assert publish(spark, path, lambda p: 1 / 0) == first  # nothing is written where something is published
    second = publish(spark, path, spark.range(5).write.parquet, replace=True)
    assert second != first and published(spark, path) == second and spark.read.parquet(second).count() == 5
    assert [os.path.basename(p) for p in committed(spark, f"{tmp_path}/a")] == [os.path.basename(second)]


def test_a_writer_that_fails_publishes_nothing(spark, tmp_path):
    import pytest
    from quire.sources.publishing import publish, published

    def half(folder):
        spark.range(3).write.parquet(f"{folder}/part")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        publish(spark, f"{tmp_path}/x", half)
    assert published(spark, f"{tmp_path}/x") is None
    assert spark.read.parquet(publish(spark, f"{tmp_path}/x", spark.range(4).write.parquet)).count() == 4


def test_two_writers_leave_one_whole_set(spark, tmp_path):
    from quire.sources.publishing import publish, published

    path, start, seen = f"{tmp_path}/both", threading.Barrier(2), []

    def writer(n):
        def write(folder):
            start.wait(60)  # both are past the first look
            spark.range(n).write.parquet(folder)
        seen.append(publish(spark, path, write))

    threads = [threading.Thread(target=writer, args=(n,)) for n in (10, 20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert spark.read.parquet(published(spark, path)).count() in (10, 20)
    assert published(spark, path) in seen


def test_half_written_calibration_set_is_rebuilt(spark, tmp_path):
    from quire.sources import files

    path = f"{tmp_path}/cache"
    whole = files.materialize_if_absent(spark, SF_SMALL).count()
    files.write_jsonl(files.calibration_examples(spark, SF_SMALL).limit(1), f"{path}/v-half")
    assert files.materialize_if_absent(spark, SF_SMALL, path=path).count() == whole


def _plan(spark):
    rows = [(i, f"word{i} " * (i % 5 + 1), 0.5) for i in range(60)]
    return spark.createDataFrame(rows, "id bigint, prompt string, eff_temperature double")


def test_stopped_run_goes_on_and_equals_an_unbroken_one(spark, tmp_path):
    from quire.operators import resumable as r

    plan = _plan(spark)
    r.run(plan, ["id"], f"{tmp_path}/whole")
    calls = spark.sparkContext.accumulator(0)

    def counted():
        def call(text, temperature, max_tokens):
            calls.add(1)
            return " ".join(text.split()[:max_tokens])
        return call

    assert r.run(plan, ["id"], f"{tmp_path}/broken", counted, stop_after=2) == 2
    part = r.results(spark, f"{tmp_path}/broken", ["id"]).count()
    assert 0 < part < 60
    spark.range(1).write.parquet(f"{tmp_path}/broken/wave-lost/v-1")  # a wave that died before its marker
    r.run(plan, ["id"], f"{tmp_path}/broken", counted)
    got, want = (sorted(map(tuple, r.results(spark, f"{tmp_path}/{s}", ["id"]).collect())) for s in ("broken", "whole"))
    assert got == want and len(got) == 60 and calls.value == 60  # no finished item is asked again
    assert r.run(plan, ["id"], f"{tmp_path}/broken") == 0


def test_failures_are_retried_and_then_given_up(spark, tmp_path):
    from quire.operators import resumable as r

    def flaky():
        def call(text, temperature, max_tokens):
            if "word7 " in text + " ":
                raise TimeoutError("no answer")
            return text.strip()
        return call

    store = f"{tmp_path}/store"
    r.run(_plan(spark), ["id"], store, flaky)
    dead = r.dead_letters(spark, store, ["id"]).collect()
    assert [(d.id, d.failures, d.errors) for d in dead] == [(7, r.ATTEMPTS, ["TimeoutError: no answer"])]
    by_id = {x.id: x for x in r.results(spark, store, ["id"]).collect()}
    assert by_id[7].error and by_id[7].attempts == r.ATTEMPTS and by_id[8].error is None and by_id[8].attempts == 1
    assert r.run(_plan(spark), ["id"], store, flaky) == 0  # dead items stay dead
