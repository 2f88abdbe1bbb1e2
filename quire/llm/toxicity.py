"""Toxicity scores by a bidirectional gated recurrent network (operator 6).

A text's words go through overlapping windows. Each word is the sum of a hashed word
embedding and its hashed character n-grams; a GRU reads the window in both directions,
attention pools its states, and a linear layer gives the window's logit. A text's score
is that of its highest window, so a single passage in a very long text counts in full.

The network is trained in numpy on the driver from a bounded sample of labelled texts
(``SAMPLE_ROWS`` per label, of at most ``SAMPLE_BYTES`` each); labels of held-out rows are never
read. Only its weights (of fixed size) are sent to tasks, where whole texts are scored in
Arrow batches, without a shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.batches import offsets_of, text_slices
from quire.llm.decontaminate import words_of

#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 16, 8
#: Hashed embeddings: buckets of words and of character n-grams, and their width; GRU width.
WORD_BUCKETS, GRAM_BUCKETS, WIDTH, HIDDEN = 1 << 13, 1 << 14, 8, 8
GRAM_SIZES = (3, 4)
#: Training sample: rows of each label (smallest hashes first), longest text, steps, texts of a step,
#: windows of a text in a step (drawn anew each time).
SAMPLE_ROWS, SAMPLE_BYTES, STEPS, STEP_TEXTS, STEP_WINDOWS = 1500, 1 << 16, 400, 24, 30
RATE, SEED = 0.015, 11
#: Words whose gate inputs a task keeps; a full store is emptied (results don't change).
KEPT_WORDS = 100_000
#: Windows that go through the network together.
LOT = 2048


def word_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each word; buckets of its character n-grams and where each word's start."""
    grams, counts = [], []
    for w in words:
        marked = b"^" + w + b"$"
        own = [zlib.crc32(marked[i:i + n]) % GRAM_BUCKETS for n in GRAM_SIZES for i in range(len(marked) - n + 1)] or [0]
        grams += own
        counts.append(len(own))
    return (np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in words), np.int64, len(words)),
            np.array(grams, np.int64), offsets_of(counts))


def window_starts(n_words: int) -> np.ndarray:
    """Starts of windows that cover a text; a text of no more than one window has one."""
    return np.arange(0, max(1, n_words - WINDOW + STRIDE), STRIDE) if n_words else np.zeros(0, np.int64)


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Network:
    """Weights, forward pass and gradients. Words are indices into ``x`` (words, 2 * WIDTH)."""

    def __init__(self, rng: np.random.Generator):
        h, e = HIDDEN, 2 * WIDTH

        def near_zero(*shape, scale):
            return rng.normal(0.0, scale, shape).astype(np.float32)

        self.p = {"word": near_zero(WORD_BUCKETS, WIDTH, scale=0.1), "gram": near_zero(GRAM_BUCKETS, WIDTH, scale=0.1),
                  "b": np.zeros((2, 3 * h), np.float32), "w": near_zero(2, e, 3 * h, scale=e ** -0.5), "u": near_zero(2, h, 3 * h, scale=h ** -0.5),
                  "a": near_zero(2 * h, h, scale=(2 * h) ** -0.5), "v": near_zero(h, scale=h ** -0.5),
                  "o": near_zero(2 * h, scale=(2 * h) ** -0.5), "c": np.full(1, -1.0, np.float32)}

    def inputs(self, word, grams, gram_at):
        """Input of each word: its embedding, and the sum of its n-grams' over the root of their number."""
        sums = np.add.reduceat(self.p["gram"][grams], gram_at[:-1], axis=0)
        return np.concatenate([self.p["word"][word], sums / np.sqrt(np.diff(gram_at))[:, None].astype(np.float32)], axis=1)

    def gates(self, x, d):
        return x @ self.p["w"][d] + self.p["b"][d]

    def _read(self, gates, index, mask, d, keep):
        """States of one direction for windows (lot, WINDOW) of word indices."""
        h3 = np.zeros((len(index), HIDDEN), np.float32)
        states = np.empty((WINDOW, len(index), HIDDEN), np.float32)
        u, trace = self.p["u"][d], []
        for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
            g, k = gates[index[:, t]], h3 @ u
            zr = _sigmoid(g[:, :2 * HIDDEN] + k[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN:] + r * k[:, 2 * HIDDEN:])
            new = (n + z * (h3 - n)) * mask[:, t, None] + h3 * (1 - mask[:, t, None])
            if keep:
                trace.append((t, h3, z, r, n, k[:, 2 * HIDDEN:]))
            h3 = new
            states[t] = new
        return states, trace

    def forward(self, gates, index, mask, keep=False):
        """Logit of each window; with ``keep``, what the gradients need."""
        read = [self._read(gates[d], index, mask, d, keep) for d in (0, 1)]
        s = np.concatenate([read[0][0], read[1][0]], axis=2)  # (WINDOW, lot, 2 * HIDDEN)
        q = np.tanh(s @ self.p["a"])
        e = np.where(mask.T > 0, q @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = (alpha[:, :, None] * s).sum(axis=0)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return logit, ((read, s, q, alpha, pooled) if keep else None)

    def gradients(self, dlogit, kept, x, index, mask):
        """Gradients of all weights but the embeddings, and of ``x``."""
        read, s, q, alpha, pooled = kept
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "gram")}
        g["c"][0] = dlogit.sum()
        g["o"] = pooled.T @ dlogit
        dpooled = dlogit[:, None] * self.p["o"]
        ds = alpha[:, :, None] * dpooled
        dalpha = (s * dpooled).sum(axis=2)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["v"] = np.einsum("tlh,tl->h", q, de)
        dq = de[:, :, None] * self.p["v"] * (1 - q * q)
        g["a"] = np.einsum("tli,tlh->ih", s, dq)
        ds = ds + dq @ self.p["a"].T
        dx = np.zeros_like(x)
        for d in (0, 1):
            u, dh = self.p["u"][d], np.zeros((len(index), HIDDEN), np.float32)
            for t, before, z, r, n, kn in reversed(read[d][1]):
                m = mask[:, t, None]
                dh = dh + ds[t][:, d * HIDDEN:(d + 1) * HIDDEN]
                dnew = dh * m
                dz = dnew * (before - n) * z * (1 - z)
                dn = dnew * (1 - z) * (1 - n * n)
                dr = dn * kn * r * (1 - r)
                dgate = np.concatenate([dz, dr, dn], axis=1)
                dk = np.concatenate([dz, dr, dn * r], axis=1)
                g["u"][d] += before.T @ dk
                dh = dh * (1 - m) + dnew * z + dk @ u.T
                g["b"][d] += dgate.sum(axis=0)
                words = x[index[:, t]]
                g["w"][d] += words.T @ dgate
                np.add.at(dx, index[:, t], dgate @ self.p["w"][d].T)
        return g, dx


def train(texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = SEED) -> Network:
    """Network fitted to whole texts: a text's logit is the softmax-weighted mean of its windows',
    which comes ever closer to the highest one. Texts without words are left out."""
    rng = np.random.default_rng(seed)
    net = Network(rng)
    known: dict[bytes, int] = {}
    docs = [np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int64) for t in texts]
    by_label = [[i for i, d in enumerate(docs) if len(d) and labels[i] == y] for y in (0, 1)]
    if not all(by_label):
        return net
    word, grams, gram_at = word_buckets(list(known))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        index, owner, target = [], [], []
        for k in range(STEP_TEXTS):
            y = k % 2
            d = docs[by_label[y][rng.integers(len(by_label[y]))]]
            starts = window_starts(len(d))
            if len(starts) > STEP_WINDOWS:
                starts = rng.choice(starts, STEP_WINDOWS, replace=False)
            at = starts[:, None] + np.arange(WINDOW)
            index.append(np.where(at < len(d), d[np.minimum(at, len(d) - 1)], -1))
            owner += [k] * len(starts)
            target.append(y)
        index, owner, target = np.concatenate(index), np.array(owner), np.array(target, np.float32)
        mask = (index >= 0).astype(np.float32)
        used, at = np.unique(np.maximum(index, 0), return_inverse=True)
        at = at.reshape(index.shape)
        fan = np.diff(gram_at)[used]
        own = offsets_of(fan)
        g_used = grams[np.repeat(gram_at[used], fan) + np.arange(own[-1]) - np.repeat(own[:-1], fan)]
        x = net.inputs(word[used], g_used, own)
        logit, kept = net.forward([net.gates(x, d) for d in (0, 1)], at, mask, keep=True)
        first = np.searchsorted(owner, np.arange(STEP_TEXTS))
        top = np.maximum.reduceat(logit, first)
        e = np.exp(logit - top[owner])
        share = e / np.add.reduceat(e, first)[owner]
        text_logit = np.add.reduceat(share * logit, first)
        derr = (_sigmoid(text_logit) - target) / STEP_TEXTS
        dlogit = (derr[owner] * share * (1 + logit - text_logit[owner])).astype(np.float32)
        g, dx = net.gradients(dlogit, kept, x, at, mask)
        g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
        np.add.at(g["word"], word[used], dx[:, :WIDTH])
        np.add.at(g["gram"], g_used, np.repeat(dx[:, WIDTH:] / np.sqrt(fan)[:, None].astype(np.float32), fan, axis=0))
        rate = RATE * min(1.0, 2.0 * (1 - (step - 1) / steps))
        for k, v in net.p.items():
            m1, m2 = moments[k]
            m1 += 0.1 * (g[k] - m1)
            m2 += 0.01 * (g[k] * g[k] - m2)
            v -= (rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Scores texts in a task; keeps the gate inputs of the words it has seen."""

    def __init__(self, net: Network, empty: float):
        self.net, self.empty = net, empty
        self.clear()

    def clear(self):
        self.ids: dict[bytes, int] = {}
        self.gates = [np.zeros((KEPT_WORDS, 3 * HIDDEN), np.float32) for _ in (0, 1)]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if len(self.ids) > KEPT_WORDS:
            self.clear()
        words = [words_of(t) for t in texts]
        before = len(self.ids)
        ids = self.ids
        flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in ws), np.int64)
        if len(ids) > before:
            new = list(ids)[before:]
            x = self.net.inputs(*word_buckets(new))
            for d in (0, 1):
                if len(ids) > len(self.gates[d]):
                    more = max(len(ids) - len(self.gates[d]), KEPT_WORDS)
                    self.gates[d] = np.concatenate([self.gates[d], np.zeros((more, 3 * HIDDEN), np.float32)])
                self.gates[d][before:len(ids)] = self.net.gates(x, d)
        lengths = np.array([len(w) for w in words], np.int64)
        base = offsets_of(lengths)
        starts = [window_starts(n) for n in lengths.tolist()]
        count = np.array([len(s) for s in starts])
        at = np.concatenate([np.zeros(0, np.int64), *(b + s for b, s in zip(base[:-1], starts))]).astype(np.int64)
        end = np.repeat(base[1:], count)
        logits = np.empty(len(at), np.float32)
        for a in range(0, len(at), LOT):
            place = at[a:a + LOT, None] + np.arange(WINDOW)
            mask = (place < end[a:a + LOT, None]).astype(np.float32)
            logits[a:a + LOT] = self.net.forward(self.gates, flat[np.minimum(place, len(flat) - 1)], mask)[0]
        out = np.full(len(texts), self.empty)
        some = count > 0
        if some.any():
            out[some] = _sigmoid(np.maximum.reduceat(logits, offsets_of(count)[:-1][some]).astype(np.float64))
        return out


def held_out():
    """Rows whose labels are never learned from (a null id counts as an empty one)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Network, float]:
    """Network, and the share of label 1 among all rows it may learn from (the score of texts without
    words). ``labels``: doc_id, toxic; null labels and ids are left out. Without both labels the
    network is untrained and the share still holds."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n, ones = usable.agg(F.count("*"), F.sum("toxic")).first()
    order = F.xxhash64("doc_id")
    ids = None
    for y in (0, 1):
        part = usable.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(SAMPLE_ROWS)
        ids = part if ids is None else ids.unionByName(part)
    sample = (docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text")
              .join(F.broadcast(ids), "doc_id")  # at most 2 * SAMPLE_ROWS rows
              .orderBy("doc_id", "toxic", "text").limit(2 * SAMPLE_ROWS).collect())
    net = train([r.text.encode() for r in sample], [r.toxic for r in sample])
    return net, (ones or 0) / n if n else 0.0


def score(docs: DataFrame, net: Network, empty: float, column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in ``column``: the highest window's; null and empty
    texts, and texts without words, get ``empty``. Rows and their other columns are kept as they are;
    ``column`` must be a new name."""
    shared = docs.sparkSession.sparkContext.broadcast((net, empty))
    text, names = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]

    def rows(batches):
        scorer = Scorer(*shared.value)
        for batch in batches:
            found = [scorer.scores(texts) for _, _, texts in text_slices(batch.column(text))]
            scores = pa.array(np.concatenate(found) if found else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*names, "score"])

    plain = docs.toDF(*names)
    return plain.mapInArrow(rows, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])).toDF(*docs.columns, column)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, *fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
