"""Trained student, back-off model and low-rank factors against plain numpy and Python."""

from __future__ import annotations

import collections
import hashlib
import math

import numpy as np

from conftest import SF_SMALL


def test_student_equals_a_numpy_run(spark):
    from quire.operators import student as s

    rng = np.random.default_rng(3)
    n = 300
    shares = rng.dirichlet(np.full(s.WIDTH, 0.05), n)
    y = (shares[:, :s.WIDTH // 2].sum(axis=1) > 0.5).astype(float)
    teacher = np.where(y > 0, 2.0, -2.0) + rng.normal(0, 0.5, n)
    rows = [(i, float(y[i]), "train" if i % 6 else "valid", float(teacher[i]), [*shares[i].tolist(), 1.0]) for i in range(n)]
    log, weights = s.train(spark.createDataFrame(rows, "doc_id bigint, y double, split string, s double, x array<double>"))
    assert log[-1][3] < 0.9 * log[0][3]  # the valid loss falls

    from quire.sources import literals as L

    ids = spark.createDataFrame([(i,) for i in range(n)], "doc_id bigint")
    slots = {r.doc_id: [r[f"e{e}"] for e in range(L.NUM_EPOCHS)] for r in ids.select("doc_id", *[s._slot(e).alias(f"e{e}") for e in range(L.NUM_EPOCHS)]).collect()}
    x = np.concatenate([shares, np.ones((n, 1))], axis=1)
    train, valid = np.array([i for i in range(n) if i % 6]), np.arange(0, n, 6)
    w, m, v, best = np.zeros(s.WIDTH + 1), np.zeros(s.WIDTH + 1), np.zeros(s.WIDTH + 1), (math.inf, None)

    def loss_and_slope(at, w):
        u = x[at] @ w
        sig = lambda z: 1 / (1 + np.exp(-z))
        p, q = sig(teacher[at] / 4), sig(u / 4)
        loss = 0.7 * 16 * (p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q))) + 0.3 * -np.log(np.where(y[at] > 0, sig(u), 1 - sig(u)))
        return loss.mean(), (0.7 * 4 * (q - p) + 0.3 * (sig(u) - y[at])) @ x[at] / len(at)

    best = (loss_and_slope(valid, w)[0], w)
    for e in range(L.NUM_EPOCHS):
        for step in range(s.STEPS):
            t = e * s.STEPS + step
            micros = collections.defaultdict(list)
            for i in train:
                if slots[i][e] // L.GRAD_ACCUMULATION == step:
                    micros[slots[i][e] % L.GRAD_ACCUMULATION].append(i)
            g = np.mean([loss_and_slope(np.array(at), w)[1] for at in micros.values()], axis=0)
            g *= min(1.0, 1.0 / np.sqrt((g * g).sum()))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - s.rate(t, s.STEPS * L.NUM_EPOCHS) * (m / (1 - 0.9 ** (t + 1)) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8) + 0.01 * w)
        score = loss_and_slope(valid, w)[0]
        assert abs(score - log[e + 1][3]) < 1e-9
        best = min(best, (score, w), key=lambda b: b[0])
    assert np.allclose(best[1], weights, atol=1e-9)


def test_student_without_rows(spark):
    from quire.operators import student as s

    log, weights = s.train(spark.createDataFrame([], "doc_id bigint, y double, split string, s double, x array<double>"))
    assert not weights.any() and len(log) == 4


def test_backoff_probabilities_sum_to_one(spark):
    from quire.operators import backoff as b
    from pyspark.sql import functions as F

    texts = [(1, "a b a c a b"), (2, "b a c"), (3, "c c a b a"), (4, None), (5, ""), (6, "a x y")]
    counts = b.triple_counts(spark.createDataFrame(texts, "doc_id bigint, text string"), F.col("doc_id") < 6)
    rows = counts.collect()
    vocabulary = sorted({r.w for r in rows if r.c}) + ["<unknown>"]
    contexts = [("a", "b"), ("", ""), ("", "a"), ("b", "a"), ("never", "a"), ("never", "seen")]
    asked = spark.createDataFrame([(u, v, w) for u, v in contexts for w in vocabulary], "u string, v string, w string")
    got = b.probabilities(counts.select("u", "v", "w", "c"), asked).collect()
    for u, v in contexts:
        for k in ("p1", "p2", "p3"):
            assert abs(sum(r[k] for r in got if (r.u, r.v) == (u, v)) - 1) < 1e-12
    assert all(r[k] > 0 for r in got for k in ("p1", "p2", "p3"))


def test_backoff_beats_add_one_on_held_out_text(spark):
    from quire.operators import backoff, lm

    p = {r.order: r for r in backoff.backoff_perplexity(spark, SF_SMALL).collect()}
    flat = lm.heldout_perplexity(spark, SF_SMALL).first()
    assert {r.n_tokens for r in p.values()} == {flat.n_tokens}
    assert p[3].perplexity < flat.perplexity and p[3].perplexity < p[2].perplexity < p[1].perplexity


def test_lowrank_factors_are_the_best_ones(spark):
    from quire.operators import lowrank as w

    rng = np.random.default_rng(5)
    r = rng.standard_normal((200, 5)) @ rng.standard_normal((5, 24)) + 0.05 * rng.standard_normal((200, 24))
    res = spark.createDataFrame([(i, line.tolist()) for i, line in enumerate(r)], "vec_id bigint, r array<double>").repartition(4)
    right, captured = w.right_factor(res, 4)
    exact = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(captured, exact[:4] ** 2, rtol=1e-6)
    assert np.allclose(right.T @ right, np.eye(4), atol=1e-9)
    left = {x.vec_id: np.array(x.left) for x in w.left_factor(res, right).collect()}
    rest = r - np.array([left[i] for i in range(len(r))]) @ right.T
    assert abs((rest ** 2).sum() - (exact[4:] ** 2).sum()) < 1e-6 * (r ** 2).sum()
    none = spark.createDataFrame([], "vec_id bigint, r array<double>")
    assert w.right_factor(none, 4)[0].shape == (0, 0)


def test_backoff_in_slices_equals_plain_loops(spark, tmp_path, monkeypatch):
    """Slices add up to the whole model, and none leaves its shuffle files on disk."""
    from quire.operators import backoff as b

    rng = np.random.default_rng(8)
    texts = {i: " ".join(rng.choice([*"abcdefgh", "é", "ß"], rng.integers(0, 30)).tolist()) for i in range(120)}
    rows = [*texts.items(), (500, None), (501, " ")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    side = spark.createDataFrame([(i,) for i, _ in rows], "doc_id bigint")
    train = {r[0]: r[1] for r in side.select("doc_id", b.train_side(side)).collect()}
    c, asked = collections.Counter(), collections.Counter()
    for i, text in texts.items():
        w = ["", "", *text.split()]
        (c if train[i] else asked).update(zip(w, w[1:], w[2:]))
    c2 = collections.Counter((v, w) for _, v, w in c)
    c1 = collections.Counter(w for _, w in c2)
    loss = [0.0, 0.0, 0.0]
    for (u, v, w), n in asked.items():
        p = 1 / (len(c1) + 1)
        for k, (own, context) in enumerate([(c1[w], list(c1.values())), (c2[v, w], [x for (a, _), x in c2.items() if a == v]),
                                            (c[u, v, w], [x for (a, d, _), x in c.items() if (a, d) == (u, v)])]):
            if context:
                p = max(own - 0.75, 0) / sum(context) + 0.75 * len(context) / sum(context) * p
            loss[k] -= n * math.log(p)
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    monkeypatch.setattr(b, "SLICE_WORDS", 250)
    before = files.getAllFiles().size()
    df = b.backoff_perplexity(spark, str(tmp_path))
    assert files.getAllFiles().size() <= before
    got = {r.order: r for r in df.collect()}
    n = sum(asked.values())
    assert {r.n_tokens for r in got.values()} == {n}
    assert all(abs(got[k + 1].mean_loss - loss[k] / n) < 2e-6 for k in range(3))


def test_top_p_of_few_and_of_busy_contexts(spark, tmp_path, monkeypatch):
    """One window and two levels give the same rows as plain loops, whichever contexts go which way."""
    from quire.operators import lm

    rng = np.random.default_rng(4)
    texts = [(i, " ".join(rng.choice(["aa", "aab", "aabb", "b", "bbb", "c", "é"], rng.integers(0, 40)).tolist()), ["en", "de", None][i % 3]) for i in range(60)]
    spark.createDataFrame([*texts, (90, None, "en")], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang in texts:
        w = text.split()
        for a, b in zip(w, w[1:]):
            if lang:
                counts[lang, a][b] += 1
    want = set()
    for (lang, ctx), after in counts.items():
        prior, total = 0, sum(after.values())
        for tok, c in sorted(after.items(), key=lambda x: (-x[1], x[0].encode())):
            if prior * 10 < total * 9:
                want.add((lang, ctx, tok, c, prior, total))
            prior += c
    for most in (0, 6, 100):  # all, some and none are busy
        monkeypatch.setattr(lm, "MOST_SUCCESSORS", most)
        assert {tuple(r) for r in lm.nucleus_filter(spark, str(tmp_path)).collect()} == want


def test_held_out_texts_that_share_an_id(spark, tmp_path):
    """A row counts once for every row of its id, on that row's side; rows without an id count nowhere."""
    from quire.operators import lm
    from quire.sources import literals as L

    rng = np.random.default_rng(6)
    ids = [*range(40), *range(0, 40, 3), *range(0, 40, 9), None]
    texts = [(i, " ".join(rng.choice([*"abcdefg"], rng.integers(0, 12)).tolist())) for i in ids]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    # a row without an id takes the first place of the order
    order = [None, *sorted((i for i in ids if i is not None), key=lambda i: (hashlib.md5(f"{L.SHUFFLE_SEED}:{i}".encode()).hexdigest(), i))]
    cut = math.floor(len(ids) * L.TRAIN_RATIO)
    train, valid = collections.Counter(order[1:cut]), collections.Counter(order[cut:])
    n, asked = collections.Counter(), collections.Counter()
    for i, text in texts:
        for w in text.split():
            n[w] += train[i]
            asked[i, w] += valid[i]
    z = sum(n.values()) + sum(c > 0 for c in n.values()) + 1
    loss = sum(c * math.log(z / (n[w] + 1)) for (_, w), c in asked.items())
    total = sum(asked.values())
    got = lm.heldout_perplexity(spark, str(tmp_path)).first()
    assert (got.n_tokens, got.n_texts) == (total, len({i for (i, _), c in asked.items() if c}))
    assert abs(got.mean_loss - loss / total) < 2e-6
    assert sum(r.n_tokens for r in lm.heldout_text_perplexity(spark, str(tmp_path)).collect()) == total
