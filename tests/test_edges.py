"""Every SQL-checked query on a fixture with hand-written guard-path rows.

The given tables never contain these cases, so they are appended to a copy of
sf0.001 in the test's scratch folder: zero and missing durations, a run without
a token count, empty / blank / one-word documents, a conversation with a lone
system turn, an empty prompt, an all-zero and a constant vector, and needles of
one, two and three tokens (the q-gram and shortest-shingle search paths).
"""

from __future__ import annotations

import os

import pytest

from conftest import SF_SMALL
from oracle_check import TABLES, compare, duck

import __spark_entry__ as E

QUERIES = E.queries()
ORACLES = E.oracle_sql()

EDGE_ROWS = {
    "events": ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
               [(900001, None, 2, "click", 0.0, '{"k": 0}'),
                (900002, None, 3, "view", 0.0, '{"k": 40}'),
                (900003, None, 4, "error", 12.5, '{"j": 1}')]),
    "documents": ("doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
                  [(900001, "", "en", "s0", 0), (900002, "   \n\t ", "en", "s0", 6),
                   (900003, "solo", "en", "s1", 4),
                   (900004, "xx the quick brown fox ab yy zz", "en", "s1", 31)]),
    "conversations": ("conv_id BIGINT, turn BIGINT, role STRING, text STRING",
                      [(900001, 0, "system", "be brief"),
                       (900002, 0, "user", ""), (900002, 1, "assistant", "no idea, 19 and 42")]),
    "embeddings": ("vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
                   [(900001, [0.0] * 64, 3), (900002, [0.25] * 64, 4)]),
    "benchmark": ("item_id BIGINT, text STRING",
                  [(900001, "ab"), (900002, "quick brown"), (900003, "the quick brown")]),
}


@pytest.fixture(scope="module")
def edge_dir(spark):
    from quire.session import scratch_path

    out = scratch_path(spark, "edge-fixture")
    for t in TABLES:
        src = os.path.join(SF_SMALL, f"{t}.parquet")
        df = spark.read.parquet(src)
        if t in EDGE_ROWS:
            schema, rows = EDGE_ROWS[t]
            df = df.unionByName(spark.createDataFrame(rows, schema))
        df.coalesce(1).write.parquet(os.path.join(out, f"{t}.parquet"))
    return out


@pytest.fixture(scope="module")
def con(edge_dir):
    return duck(edge_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle_on_edge_rows(spark, con, edge_dir, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES[name], edge_dir)
    assert r["status"] == "OK", r
