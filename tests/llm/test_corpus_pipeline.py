"""The pipeline, stage by stage and as a whole, against brute force on small tables."""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pytest
from test_llm_operators import PATTERNS, _contaminated, _linked_components, _passes

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "tiny item"), (None, "w1"), (3, None)]


def _tables():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)] + ["été", "漢字"]

    def text(n, extra=()):
        ws = list(rng.choice(words, n))
        for x in extra:
            ws.insert(int(rng.integers(len(ws))), x)
        return " ".join(ws)

    docs, labels = [], []
    for i in range(200):
        toxic = i % 4 == 0
        docs.append((i, text(40, ["nasty", "vilest"] if toxic else ())))
        labels.append((i, int(toxic)))
    copy = text(80)
    near = copy.replace(" w", " changed w", 1)
    docs += [(300, copy), (301, copy), (302, near), (303, copy.upper())]
    docs += [(310, text(20) + " Alpha beta gamma, delta epsilon zeta eta theta iota kappa. " + text(20)), (311, "a tiny item"), (312, "tiny items")]
    docs += [(320, text(10) + " mail a.b@x-y.org or +1 (375) 555-4393, 10.0.0.255 é 4111 1111 1111 1111"), (321, text(12) + " call +49 30 1234567 me@x.de")]
    docs += [(330, None), (331, ""), (332, " \n"), (None, copy), (None, text(30)), (340, "long " * 4000), (350, "twice " + docs[1][1]), (350, "twice " + docs[1][1])]
    rows = [(i, t, None if k % 7 == 0 else "en", f"s{k % 3}" if k % 5 else None, None if k % 6 == 0 else len(t or ""), k) for k, (i, t) in enumerate(docs)]
    return rows, labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    rows, labels = _tables()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, toxicity int").repartition(4).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels + [(9, None), (None, 1)], "doc_id bigint, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def _key(row):
    return tuple((x is not None, x) for x in row)


def _expected_stages(spark, sf_dir):
    """Rows after each stage, computed one document at a time."""
    import public_tokenizers
    import tiktoken
    from quire.llm import bpe, toxicity as tx

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    net, empty = tx.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r in rows if tx.Scorer(net, empty).scores([(r[1] or "").encode()])[0] < 0.5]
    yield "toxicity", rows
    smallest = {i: c for i, _, c in _linked_components([r[:2] for r in rows])}
    rows = [r for r in rows if r[0] is None or smallest[r[0]] == r[0]]
    yield "jaccard_join", rows
    rows = [r for r in rows if not _contaminated(r[1], ITEMS)[1]]
    yield "decontamination", rows

    def redact(text):
        spans = sorted((m.start(), m.end(), k) for k in PATTERNS for m in re.finditer(PATTERNS[k], text or "") if _passes(k, m.group()))
        out, at = "", 0
        for start, end, kind in spans:
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        return out + text[at:] if spans else text

    rows = [(r[0], t, *r[2:4], len(t) if t != r[1] else r[4], *r[5:]) for r in rows for t in [redact(r[1])]]
    yield "pii", rows
    ranks = bpe.load_ranks(bpe.default_ranks_path())
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        out.append((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    yield "byte_bpe", out


def test_stages_and_run_equal_brute_force(spark, sf_dir, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for (name, stage), (expected_name, want) in zip(cp.STAGES, _expected_stages(spark, sf_dir), strict=True):
        assert name == expected_name
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert sorted(map(tuple, out.collect()), key=_key) == sorted(want, key=_key), name
        if name != "byte_bpe":
            assert out.columns == docs.columns
            if name in ("toxicity", "jaccard_join", "decontamination"):
                assert 0 < out.count() < before
                before = out.count()
        docs = out
    assert sorted(map(tuple, cp.run(spark, sf_dir).collect()), key=_key) == sorted(want, key=_key)


def test_stages_of_no_rows(spark, sf_dir):
    import corpus_pipeline as cp

    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, sf_dir).collect() == []


def test_queries_are_registered_and_optional():
    import __spark_entry__ as e

    names = e.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", n).group() for n in names if n.startswith("op")}
    assert "pipeline" in names and set(e.oracle_sql()) <= set(names)
