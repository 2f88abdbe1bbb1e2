"""Neighbours of quantised vectors: exact and probed search against numpy, with copies, nulls and no rows."""

from __future__ import annotations

import numpy as np
import pytest

from quire.operators import nearest as n


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
        return str(tmp_path)
    return write


def _rows():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 64)).astype(np.float32)
    x[200:450] = x[200]  # a third are copies
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x, [(i, v.tolist(), 0) for i, v in enumerate(x)]


def test_recall_of_copies_and_nulls(spark, folder, monkeypatch):
    x, rows = _rows()
    sf = folder([*rows, (900, None, 0), (None, x[0].tolist(), 0), (950, [], 1)])
    monkeypatch.setattr(n, "PART_ROWS", 16)  # lists in many parts
    exact = {r.bits: r for r in n.neighbour_recall(spark, sf).collect()}
    probed = {r.bits: r.recall_at_10 for r in n.neighbour_recall_lists(spark, sf).collect()}
    assert {r.n_queries for r in exact.values()} == {14}
    assert exact[8].recall_at_10 > 0.95 > exact[3].recall_at_10
    assert probed[0] >= 0.9 and all(probed[b] <= 1 for b in exact)
    whole = {r.bits: r.recall_at_10 for r in n.neighbour_recall_lists(spark, sf, probed=1.0).collect()}
    assert whole == {0: 1.0, **{b: r.recall_at_10 for b, r in exact.items()}}  # all lists: the exact search


def test_exact_neighbours_equal_numpy(spark, folder):
    x, rows = _rows()
    sf = folder(rows)
    top = n._top(n.against_all(*n._table(spark, sf), "vec_id", n._best, n.SCORES)).where("bits = 0").collect()
    for q in range(0, len(x), n.QUERY_STEP):
        s = np.round(x.astype(float) @ x[q].astype(float), n.DIGITS)
        s[q] = -np.inf
        assert sorted(r.vec_id for r in top if r.query_id == q) == sorted(np.lexsort((np.arange(len(s)), -s))[:10].tolist())


def test_no_rows(spark, folder):
    sf = folder([])
    assert {r.recall_at_10 for r in n.neighbour_recall(spark, sf).collect()} == {None}
    assert {r.n_queries for r in n.neighbour_recall_lists(spark, sf).collect()} == {0}


def test_a_tile_bounds_what_a_task_holds(spark, monkeypatch):
    """Scores of a cell are never one matrix: a tile's size, not the cell's, says how many are held at once."""
    x, _ = _rows()
    back = {f"x{b}": [v.tolist() for v in x.astype(float)] for b in (n.FULL, *n.L.QUANT_BITS)}
    table = n.pa.table({"vec_id": list(range(len(x))), **back})
    whole = n._best(table, table.slice(0, 300))
    held, real = [], np.partition

    def partition(line, k):
        held.append(line.base.size if line.base is not None else line.size)
        return real(line, k)

    monkeypatch.setattr(n, "TILE", 5000)
    monkeypatch.setattr(n.np, "partition", partition)
    assert n._best(table, table.slice(0, 300)).equals(whole)
    assert held and max(held) <= 5000
    centroids = x[:40].astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(float))], "vec_id bigint, x0 array<double>")
    got = {r.vec_id: r.lists for r in n._lists_of(df, centroids, 3).collect()}
    for i, v in enumerate(x.astype(float)):
        near = np.round(v @ centroids.T - 0.5 * np.square(centroids).sum(axis=1), n.DIGITS)
        assert got[i] == np.lexsort((np.arange(40), -near))[:3].tolist()
