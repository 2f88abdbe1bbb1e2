"""Hard negatives, nearest neighbours and the prefix trie against brute force, with every awkward case."""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

VECTORS = "vec_id bigint, vector array<double>, label int, node bigint, cell bigint, row bigint, chunk int, block int, score double, rank int, members array<bigint>, is_anchor boolean, is_query boolean"
CLASHES = (None, None, None, None, None, None, None, None, None, None)


def _vectors(n=240, dims=6):
    """Copies of one vector, a repeated row, an id with two vectors, ties, nulls, unusable and short vectors."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((n, dims))
    base[40:120] = base[40]
    rows = [(i, base[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(5, base[5].tolist(), 1), (7, base[9].tolist(), 2)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * dims, 2), (903, [math.nan] + [1.0] * (dims - 1), 1), (904, [math.inf] + [1.0] * (dims - 1), 1)]
    rows += [(905, [None] + [1.0] * (dims - 1), 1), (906, [1.0, 2.0], 2), (None, base[3].tolist(), 1), (907, base[4].tolist(), None), (-100, base[60].tolist(), 3)]
    return rows


def _usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _frame(spark, rows):
    return spark.createDataFrame([r + CLASHES for r in rows], VECTORS).repartition(4)


# ---------------------------------------------------------------- hard negatives

def _mined(rows, anchor):
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e15 else int(x) * 256 for x in v], y) for i, v, y in rows if i is not None and y is not None and _usable(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, va, ya in kept:
        if anchor(a):
            scored = sorted([(-dot(va, v), i, y) for i, v, y in kept if i != a and abs(dot(va, v)) < 1 << 63], key=lambda r: r[:2])
            for p, pid, _ in [r for r in scored if r[2] == ya][:5]:
                inside = [r for r in scored if r[2] != ya and -80 * p <= -100 * r[0] <= -100 * p][:5]
                out += [(a, pid, k + 1, nid, -p, -s) for k, (s, nid, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize(("blocks", "chunks"), [(4096, 65536), (3, 7)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, blocks, chunks):
    from pyspark.sql import functions as F
    from quire.llm import hard_negatives as h

    monkeypatch.setattr(h, "ANCHOR_BLOCK", blocks)
    monkeypatch.setattr(h, "CANDIDATE_CHUNK", chunks)
    rows = _vectors()
    got = h.hard_negatives(_frame(spark, rows), F.col("vec_id") % 20 == 0)
    want = _mined(rows, lambda i: i % 20 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_hard_negatives_of_huge_components_and_no_rows(spark):
    from pyspark.sql import functions as F
    from quire.llm.hard_negatives import hard_negatives

    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(4) * 10.0 ** (4 * (i % 3))).tolist(), i % 2) for i in range(60)] + [(100, [1e300, 1.0], 0), (101, [9e299, 1.0], 1), (102, [1e300, -1.0], 0)]
    got = hard_negatives(_frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == _mined(rows, lambda i: i % 10 == 0)
    assert hard_negatives(_frame(spark, []), F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("reach", [0, 1, 3, 300, 1 << 20, 1 << 40])
def test_packed_products_are_exact(reach):
    from quire.llm.hard_negatives import packed_products

    rng = np.random.default_rng(reach)
    a, b = (rng.integers(-reach, reach + 1, (n, 9)) for n in (70, 2500))
    got = packed_products(a, b)
    assert (got == a.astype(object) @ b.astype(object).T).all()
    assert packed_products(a[:0], b).shape == (0, 2500) and packed_products(a, b[:0]).shape == (70, 0)


# ---------------------------------------------------------------- nearest neighbours

def _nearest(rows, asked, k):
    kept = sorted({(i, tuple(v)) for i, v, _ in rows if i is not None and _usable(v) and any(v)})
    out = {}
    for q, vq in kept:
        if asked(q):
            scored = sorted((-sum(x * y for x, y in zip(vq, v)), i) for i, v in kept if i != q)
            out.setdefault(q, []).append([(i, -s) for s, i in scored[:k]])
    return out


def test_nearest_neighbours_of_few_rows_are_exact(spark):
    from pyspark.sql import functions as F
    from quire.llm.neighbours import nearest

    rows = _vectors()
    got = defaultdict(list)
    for r in nearest(_frame(spark, rows), F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = _nearest(rows, lambda i: i % 10 == 0, 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, (near,) in want.items():
        assert len(got[q]) == len(near)
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        hits += len({i for i, _ in near} & {i for i, _ in got[q]}) / len(near)
    assert hits / len(want) >= 0.98
    # a copy of vector 40 finds the smallest ids of the other copies at one score
    assert [i for i, _ in got[100]][:20] == [i for i, _ in want[100][0]]


@pytest.mark.parametrize("norms", ["equal", "skewed"])
def test_nearest_neighbours_recall(spark, norms):
    from pyspark.sql import functions as F
    from quire.llm.neighbours import nearest

    rng = np.random.default_rng(8)
    x = rng.standard_normal((2500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms == "skewed":
        x *= np.exp(rng.standard_normal(len(x)))[:, None]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = nearest(_frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits / (125 * 20) >= 0.95
    assert all(abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9 for r in got)


def test_nearest_neighbours_of_no_and_one_row(spark):
    from pyspark.sql import functions as F
    from quire.llm.neighbours import nearest

    assert nearest(_frame(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert nearest(_frame(spark, [(10, [1.0, 2.0], 1)]), F.col("vec_id") % 10 == 0).collect() == []
    two = nearest(_frame(spark, [(10, [1.0, 2.0], 1), (11, [3.0], 1)]), F.col("vec_id") % 10 == 0).collect()
    assert [tuple(r) for r in two] == [(10, 1, 11, 3.0)]


def _cells(spark, x):
    from quire.llm import neighbours as n

    rows = spark.createDataFrame([(v.tolist(), [i]) for i, v in enumerate(x)], "vector array<double>, members array<long>").repartition(4)
    longest = float(np.linalg.norm(x, axis=1).max())
    return n._written(n._numbered(rows.mapInArrow(n._encode(x.shape[1], longest), n.CODES), len(x)), "test")


def test_rounds_and_searches_send_a_row_for_each_pair_of_cells(spark):
    from pyspark.sql import functions as F
    from quire.llm import neighbours as n

    x = np.random.default_rng(3).standard_normal((1500, 16))
    codes = _cells(spark, x)
    graph = n._written(n.first_graph(codes.select("cell", "node", "code", "scale", "extra", *n.KEYS), len(x), 24), "test")
    better = n.improved(graph, 24, 1)
    plan = better._jdf.queryExecution().executedPlan().toString()
    # before: a row for each link and introduction, ranked by windows (Generate, Window)
    assert not any(word in plan for word in ("Generate", "Window", "SortMergeJoin", "BroadcastHashJoin"))
    cells = codes.select("cell").distinct().count()
    links = graph.select("node", "near", "fresh").mapInArrow(n._backs(12, 1), "cell long, node binary, back binary, fresh binary")
    assert 1 < cells and links.count() <= 32 * cells
    assert links.agg(F.sum(F.length("back"))).first()[0] // 8 > 12 * len(x) / 2

    # a node's list is of the right length, without itself and copies, best first, and a round makes it better
    vector = {r.node: np.array(r.vector) for r in codes.select("node", "vector").collect()}
    longest = max(map(np.linalg.norm, vector.values()))
    full = lambda v: np.append(v, math.sqrt(max(0, longest ** 2 - v @ v))) / longest
    sums = []
    for table in (graph, better):
        total = 0
        for r in table.collect():
            near, score = np.frombuffer(r.near, np.int64), np.frombuffer(r.score, np.float32)
            assert len(near) == len(set(near)) == 24 and r.node not in near and (np.diff(score) <= 1e-5).all()
            assert r.new == sum(r.fresh)
            if r.node % 50 == 0:
                assert np.allclose(score, [full(vector[r.node]) @ full(vector[i]) for i in near], atol=5e-3)
            total += score.sum()
        sums.append(total)
    assert sums[1] > sums[0]


@pytest.mark.parametrize("n", [0, 1, 2, 3000])
def test_packed_sorts_equal_plain_ones(n):
    from quire.llm import neighbours as nb

    rng = np.random.default_rng(n)
    group, score = rng.integers(0, 7, n), rng.choice(rng.standard_normal(400), n).astype(np.float32)
    for ids in (rng.integers(0, 300, n), rng.integers(0, 1 << 46, n) >> rng.integers(0, 40, n)):
        for bits in (12, 48):  # 48: few bits are left for the ids, so that some look the same
            first = nb._first_of_each(group, bits, ids)
            seen = {}
            for i, pair in enumerate(zip(group.tolist(), ids.tolist())):
                seen.setdefault(pair, i)
            assert sorted(first.tolist()) == sorted(seen.values()) and (np.diff(group[first]) >= 0).all()
        of = lambda at: sorted((g, -round(float(s), 4)) for g, s in zip(group[at], score[at]))
        want = []
        for g in range(7):
            want += sorted((i for (h, _), i in seen.items() if h == g), key=lambda i: -score[i])[:5]
        best = nb._top(group, 12, ids, score, 5)
        assert of(best) == of(np.array(want, int)) and (np.diff(group[best]) >= 0).all()
        down = nb._descending(np.array([np.inf, 2.5, 1e-30, 0.0, -0.0, -1e-30, -2.5, -np.inf]))[0]
        assert (np.diff(down) >= 0).all() and down[3] == down[4]
    order = nb._in_order((group, 3))
    assert order.tolist() == np.argsort(group, kind="stable").tolist()


def test_best_of_rows_with_ties_are_no_more_than_asked():
    from quire.llm.neighbours import _best_of

    scores = np.array([[1, 1, 1, 1, 0], [5, 4, 3, 2, 1], [-np.inf, -np.inf, 2, -np.inf, -np.inf]], np.float32)
    row, col = _best_of(scores, 2)
    assert row.tolist() == [0, 0, 1, 1, 2] and (scores[row, col] == [1, 1, 5, 4, 2]).all()
    assert len(_best_of(scores, 9)[0]) == 11


# ---------------------------------------------------------------- prefix trie

TURNS = "conv_id bigint, turn bigint, role string, text string, block int, depth int, pa bigint, level int, t1 string, n1 int, digest string, size int"


def _turns():
    """Shared starts, copies, a long conversation twice, equal turn numbers, nulls, repeated rows, negative ids."""
    rng = np.random.default_rng(4)
    rows = []
    for c in itertools.chain(range(0, 40), range(100, 130), range(200, 212), [305, 317, -3, -100, -7]):
        for t in range(int(rng.integers(0, 9))):
            rows.append((c, t, ["user", "assistant", None][t % 3], f"text {'é😀' * (t % 2)}{int(rng.integers(0, 2))}" if rng.random() < 0.9 else None))
    long = [("user", f"long {t}") for t in range(45)]
    for c in (400, 401, 402):
        rows += [(c, t, *turn) for t, turn in enumerate(long[: 45 - (c == 402)])]
    rows += [(410, None, "user", "first"), (410, None, "user", "first"), (410, 3, "user", "tie a"), (410, 3, "user", "tie b"), (410, 3, "user", "tie b"), (None, 1, "user", "lost"), (420, 1, "", "")]
    return rows


def _trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = [out[c] for c in children[node]]
        ends = sorted(c for c in members[node] if len(convs[c]) == len(node))
        n = len(members[node])
        out[node] = (min(members[node]), len(node), min(members[node[:-1]]) if node else None, n, len(below), sum(b[5] for b in below) or 1,
                     sum(b[6] for b in below) + ((n - 1) * len(node[-1][1]) if node else 0), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(out.values(), key=str)


@pytest.mark.parametrize(("width", "stretch", "piece"), [(8, 4096, 8192), (3, 2, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, width, stretch, piece):
    from quire.llm import prefix_trie as p

    for name, value in {"WIDTH": width, "STRETCH": stretch, "PIECE": piece, "SLOTS": range(1, width + 1), "PATH": [f"t{i}" for i in range(1, width + 1)]}.items():
        monkeypatch.setattr(p, name, value)
    rows = _turns()
    got = p.prefix_trie(spark.createDataFrame([r + (None,) * 8 for r in rows], TURNS).repartition(6))
    assert sorted(map(tuple, got.collect()), key=str) == _trie(rows)


def test_trie_of_no_turns_and_of_one_hot_conversation(spark):
    from quire.llm.prefix_trie import prefix_trie

    assert prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    rows = [(1, t, "user", "x") for t in range(300)] + [(2, 0, "user", "x")]
    got = prefix_trie(spark.createDataFrame([r + (None,) * 8 for r in rows], TURNS).repartition(6))
    assert sorted(map(tuple, got.collect()), key=str) == _trie(rows)


def test_range_numbers_are_row_numbers(spark):
    from pyspark.sql import functions as F
    from quire.functions.ranges import LOCAL, OFFSET, PART, TOTAL, range_numbered

    rng = np.random.default_rng(6)
    rows = [(int(g), int(x)) for g, x in zip(rng.choice([1, 1, 1, 2, 3], 4000), rng.integers(0, 50, 4000))] + [(None, 1), (4, None)]
    numbered, parts = range_numbered(spark.createDataFrame(rows, "g int, x int").repartition(3), ["g"], [F.col("x")])
    assert numbered.select(PART).distinct().count() > 3  # the large group isn't in one part
    got = numbered.join(parts, numbered.g.eqNullSafe(parts.g) & (numbered[PART] == parts[PART])).select(numbered.g, "x", (F.col(OFFSET) + F.col(LOCAL)).alias("n"), TOTAL).collect()
    assert len(got) == len(rows)
    for g in {r.g for r in got}:
        own = sorted((r for r in got if r.g == g), key=lambda r: r.n)
        assert [r.n for r in own] == list(range(1, len(own) + 1)) and {r[TOTAL] for r in own} == {len(own)}
        assert [r.x for r in own] == sorted((r.x for r in own), key=lambda x: (x is not None, x or 0))
