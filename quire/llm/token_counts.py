"""Token counts by trie-shared dynamic programming (operator 5).

Distinct pre-tokens are walked in sorted order, which is the depth-first order of
their trie: what two neighbours share is a path already scored. A node's forward
score (the best sum of unigram scores over segmentations of its prefix) is computed
once, however many pre-tokens pass through it; the count of the best segmentation is
stored at each terminal and added up per document. Tries live within tasks, so
no pre-token is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import row_slices, text_bytes
from quire.llm.bpe import default_ranks_path, load_ranks
from quire.llm.pretokens import class_table, slice_texts

#: Terminals kept per task; a full store is emptied and filled again (results don't change).
KEPT_TERMINALS = 400_000
#: Zipf-Mandelbrot shift of the unigram prior over the vocabulary's ranks.
ZIPF_SHIFT = 2.7


def unigram_scores(ranks: dict[bytes, int], shift: float = ZIPF_SHIFT) -> dict[bytes, float]:
    """Log-probability of each piece under a Zipf-Mandelbrot law over its rank: the rank
    files carry no probabilities, only an order of frequency."""
    total = math.log(sum(1 / (r + shift) for r in ranks.values()))
    return {p: -math.log(r + shift) - total for p, r in ranks.items()}


def trie_counts(words: list[bytes], scores: dict[bytes, float], longest: int) -> dict[bytes, int]:
    """Tokens of each word's best segmentation (ties: fewer tokens). ``words`` are distinct.

    ``best[i]`` and ``count[i]`` belong to the trie node at depth i of the current path;
    a new word keeps the nodes it shares with the previous one."""
    out: dict[bytes, int] = {}
    best, count, last = [0.0], [0], b""
    for word in sorted(words):
        shared, most = 0, min(len(word), len(last))
        while shared < most and word[shared] == last[shared]:
            shared += 1
        del best[shared + 1:], count[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            top, tokens = -math.inf, 0
            for start in range(max(0, end - longest), end):
                score = scores.get(word[start:end])
                if score is not None:
                    score += best[start]
                    if score > top or (score == top and count[start] + 1 < tokens):
                        top, tokens = score, count[start] + 1
            best.append(top)
            count.append(tokens)
        out[word] = count[-1]
        last = word
    return out


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], text: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of each whole text (null or empty: 0 and 0). Rows
    are kept one to one; every byte is a piece, so every text can be segmented."""
    shared = docs.sparkSession.sparkContext.broadcast((unigram_scores(ranks), class_table()))

    def rows(batches):
        scores, classes = shared.value
        longest = max(map(len, scores))
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = text_bytes(batch.column(1))
            n_pre, n_tok = [], []
            for a, b in row_slices(texts):
                tokens, first = slice_texts(texts[a:b], classes)
                if len(known) >= KEPT_TERMINALS:
                    known = {}
                known.update(trie_counts([w for w in set(tokens) if w not in known], scores, longest))
                sums = np.zeros(len(tokens) + 1, np.int64)
                np.cumsum(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)), out=sums[1:])
                n_pre += np.diff(first).tolist()
                n_tok += np.diff(sums[first]).tolist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_pretokens": pa.array(n_pre, pa.int64()),
                                              "n_tokens": pa.array(n_tok, pa.int64())})

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(
        rows, "doc_id bigint, n_pretokens bigint, n_tokens bigint")


def op5_token_counts(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, load_ranks(ranks_path or default_ranks_path()))
