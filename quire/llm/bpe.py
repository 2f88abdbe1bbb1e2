"""Byte-level BPE encoding and decoding (operator 8).

Texts are cut into pre-tokens by the vectorised automaton of ``pretokens``; each
distinct slice is merged once per task by its pair ranks and cached as packed ids,
so a text's encoding is the join of its slices' cached ids. Decoding looks up the
bytes of each id; the running lengths of those are the offsets of the tokens.
The work is per row: no shuffle, whole texts, nothing but the vocabulary (a file
of fixed size) is broadcast. It is Python in Arrow batches because byte-pair merging
is a loop over a changing sequence, which no column expression states.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import map_batches, offsets_of, row_slices, text_bytes
from quire.llm.pretokens import class_table, slice_texts

#: Cached slices per task; a full cache is emptied and filled again (results don't change).
CACHE_SLICES = 200_000
CACHED_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the lowest-ranked adjacent pair is merged (leftmost first) until
    no pair has a rank. A heap over a linked list, so a slice of n bytes takes n log n."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts at i
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != j:
            continue  # one of the two parts has changed since
        right = end[i]
        alive[right] = False
        end[i] = j
        if j < n:
            prev[j] = i
            if (r := ranks.get(piece[i:end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))
        before = prev[i]
        if before >= 0 and (r := ranks.get(piece[before:j])) is not None:
            heapq.heappush(heap, (r, before, j))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class SliceIds(dict):
    """Slice -> its ids as packed little-endian 32-bit integers."""

    def __init__(self, ranks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        packed = np.array(merge_pairs(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHE_SLICES:
                self.clear()
            self[piece] = packed
        return packed


def _coder(spark: SparkSession, ranks: dict[bytes, int]):
    """What tasks need: the ranks and the class table, both of fixed size."""
    return spark.sparkContext.broadcast((ranks, class_table()))


def _encode_all(texts: list[bytes], ids: SliceIds, classes: np.ndarray) -> list[bytes]:
    """Packed ids of each text."""
    out = []
    for a, b in row_slices(texts):
        tokens, first = slice_texts(texts[a:b], classes)
        packed = list(map(ids.__getitem__, tokens))
        out += [b"".join(packed[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
    return out


def encode(docs: DataFrame, ranks: dict[bytes, int], text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, offsets array<int>``: the ids of each whole text and the byte
    at which each token starts. A null or empty text has empty arrays; rows are kept one
    to one, repeated and null ids included; other columns of ``docs`` are not read."""
    shared = _coder(docs.sparkSession, ranks)

    def rows(batches):
        ranks, classes = shared.value
        ids = SliceIds(ranks)
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            sizes[rank] = len(piece)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            packed = _encode_all(texts, ids, classes)
            lists = [np.frombuffer(p, "<u4") for p in packed]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "ids": pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32())),
                "offsets": pa.array([offsets_of(sizes[x])[:-1].astype(np.int32) for x in lists], pa.list_(pa.int32())),
            })

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(
        rows, "doc_id bigint, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``doc_id, bytes binary`` of rows ``doc_id, ids``. Null ids decode to no bytes; an id
    outside the vocabulary is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast({r: p for p, r in ranks.items()})

    def cols(batch):
        pieces = shared.value
        return {"doc_id": batch.column(0),
                "bytes": pa.array([b"".join(map(pieces.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()], pa.binary())}

    return map_batches(encoded.select("doc_id", "ids"), cols, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each whole text: encoded, then
    decoded from the ids, in one pass (ids and bytes never leave the task)."""
    shared = _coder(docs.sparkSession, ranks)

    def rows(batches):
        ranks, classes = shared.value
        ids = SliceIds(ranks)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        for batch in batches:
            texts = text_bytes(batch.column(1))
            counts, id_sums, byte_sums = [], [], []
            for packed in _encode_all(texts, ids, classes):
                counts.append(len(packed) // 4)
                id_sums.append(hashlib.sha256(packed).hexdigest())
                decoded = b"".join(map(pieces.__getitem__, np.frombuffer(packed, "<u4").tolist()))
                byte_sums.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()),
                                              "ids_sha256": id_sums, "decoded_sha256": byte_sums})

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(
        rows, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op8_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, load_ranks(ranks_path or default_ranks_path()))
