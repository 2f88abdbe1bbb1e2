"""Substring dedup by super-k-mer partitioning (operator 10).

A window is 50 consecutive words. Its minimiser is the smallest hash of its 8-word
grams; consecutive windows of a document that share it form a super-k-mer, one run
of words.

1. Light pass: (minimiser, doc_id) only. Minimisers that two documents share are found by
   a partially aggregated min and max; most text is out from here on.
2. Each run with a shared minimiser travels once, as one packed string, to its
   minimiser's bucket. There its windows are sorted, so equal ones stand together, and the
   smallest document of each is known exactly.
3. Removed ranges go back to their documents, where covered words are dropped.

A minimiser with more than ``HOT_WINDOWS`` windows (a passage or group of copies that very many
share, or a long periodic text) would make a bucket too large for one task. Its windows are spread by
their own 128-bit digests instead and take the smallest document by a partially
aggregated minimum, and a join that splits hot keys: the same windows by another key.
Both joins with the documents use the same hash partitioning by ``doc_id``, so the texts
are shuffled once. Python in Arrow batches for hashing, packing and sorting words.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import mix64, offsets_of, row_slices, text_bytes
from quire.session import scratch_path

#: Words of a window, and of the grams whose smallest hash places it.
WINDOW = 50
GRAM = 8
#: Windows of a minimiser from which on they are spread one by one: some 20 MB of windows are sorted together at most.
HOT_WINDOWS = 1 << 16
#: Windows of one run that are cut out at a time.
CUT = 4096


def _runs(words: list[list[bytes]], window: int, gram: int):
    """Runs of consecutive windows with one minimiser: minimiser, document row, first word,
    windows."""
    lengths = np.array([len(w) for w in words], np.int64)
    base = offsets_of(lengths)
    n = int(base[-1])
    windows = np.maximum(lengths - window + 1, 0)
    total = int(windows.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    codes = np.fromiter((zlib.crc32(w) for ws in words for w in ws), np.uint64, n)
    grams = codes[:n - gram + 1].copy()
    for k in range(1, gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + codes[k:n - gram + 1 + k]
    grams = mix64(grams)
    span, low, reach = window - gram + 1, grams, 1  # smallest of `span` grams, by doubling
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[:len(low) - (span - reach)], low[span - reach:])
    doc = np.repeat(np.arange(len(words)), windows)
    at = np.arange(total) - np.repeat(offsets_of(windows)[:-1], windows)
    low = low[base[doc] + at]
    first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])])
    return low[first], doc[first], at[first], np.diff(np.append(first, total))


def minimisers(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``minimiser, doc_id, windows`` of each row: how many of its windows have the minimiser."""

    def rows(batches):
        for batch in batches:
            ids, texts = np.asarray(batch.column(0)), text_bytes(batch.column(1))
            for a, b in row_slices(texts):
                low, doc, _, n = _runs([t.split() for t in texts[a:b]], window, gram)
                order = np.lexsort((low, doc))
                low, doc, n = low[order], doc[order], offsets_of(n[order])
                new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])][:len(low)])
                windows = n[np.append(new[1:], len(low))] - n[new]
                yield pa.RecordBatch.from_pydict({"minimiser": pa.array(low[new].view(np.int64)), "doc_id": pa.array(ids[a:b][doc[new]], pa.int64()), "windows": pa.array(windows, pa.int64())})

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(rows, "minimiser bigint, doc_id bigint, windows bigint")


def _pack(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """``minimiser, doc_id, doc_key, first, words``: runs whose minimiser is in ``cold``."""

    def rows(batches):
        for batch in batches:
            texts = text_bytes(batch.column(2))
            wanted = [set(c or ()) for c in batch.column(3).to_pylist()]
            texts = [t if w else b"" for t, w in zip(texts, wanted)]
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in row_slices(texts):
                words = [t.split() for t in texts[a:b]]
                out = ([], [], [], [], [])
                for low, doc, at, n in zip(*(x.tolist() for x in _signed(_runs(words, window, gram)))):
                    if low in wanted[a + doc]:
                        for column, value in zip(out, (low, ids[a + doc], keys[a + doc], at, b" ".join(words[doc][at:at + n + window - 1]))):
                            column.append(value)
                yield pa.RecordBatch.from_pydict({
                    "minimiser": pa.array(out[0], pa.int64()), "doc_id": pa.array(out[1], pa.int64()), "doc_key": pa.array(out[2], pa.int64()),
                    "first": pa.array(out[3], pa.int32()), "words": pa.array(out[4], pa.binary())})

    return marked.select("doc_id", "doc_key", "text", "cold").mapInArrow(
        rows, "minimiser bigint, doc_id bigint, doc_key bigint, first int, words binary")


def _signed(runs):
    return (runs[0].view(np.int64), *runs[1:])


def _window_slices(words: bytes, window: int) -> list[bytes]:
    ends = [i for i, c in enumerate(words) if c == 0x20]
    ends.append(len(words))
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [words[s:e] for s, e in zip(starts, ends[window - 1:])]


def _sorted_bucket(rows: list[tuple], window: int, out: tuple) -> None:
    """Windows of a bucket's runs, sorted; appends removed ranges to ``out``."""
    slices, owner, place = [], [], []
    for r, (_, doc_id, _, _, words) in enumerate(rows):
        found = _window_slices(words, window)
        slices += found
        owner += [r] * len(found)
        place += range(len(found))
    gone = [[] for _ in rows]
    order = sorted(range(len(slices)), key=slices.__getitem__)
    i, n = 0, len(order)
    while i < n:
        j = i + 1
        while j < n and slices[order[j]] == slices[order[i]]:
            j += 1
        if j > i + 1:
            least = min(rows[owner[k]][1] for k in order[i:j])
            for k in order[i:j]:
                if rows[owner[k]][1] > least:
                    gone[owner[k]].append(place[k])
        i = j
    for (_, doc_id, doc_key, first, _), places in zip(rows, gone):
        places.sort()
        k = 0
        while k < len(places):
            m = k
            while m + 1 < len(places) and places[m + 1] == places[m] + 1:
                m += 1
            for column, value in zip(out, (doc_id, doc_key, first + places[k], m - k + 1)):
                column.append(value)
            k = m + 1


_RANGES = "doc_id bigint, doc_key bigint, first int, windows int"


def _range_batch(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(out[0], pa.int64()), "doc_key": pa.array(out[1], pa.int64()),
                                       "first": pa.array(out[2], pa.int32()), "windows": pa.array(out[3], pa.int32())})


def _sort_buckets(packed: DataFrame, window: int) -> DataFrame:
    """Ranges of windows that a smaller document has, from the buckets of all minimisers."""

    def rows(batches):
        held: list[tuple] = []
        out = ([], [], [], [])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[-1][0]:
                    _sorted_bucket(held, window, out)
                    held = []
                held.append(row)
            if out[0]:
                yield _range_batch(out)
                out = ([], [], [], [])
        if held:
            _sorted_bucket(held, window, out)
            yield _range_batch(out)

    return packed.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(rows, _RANGES)


def _window_batch(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"digest": pa.array(out[0], pa.binary()), "doc_id": pa.array(out[1], pa.int64()),
                                       "doc_key": pa.array(out[2], pa.int64()), "first": pa.array(out[3], pa.int32())})


def _hot_windows(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """``digest, doc_id, doc_key, first`` of each window whose minimiser is in ``hot``."""

    def rows(batches):
        for batch in batches:
            texts = text_bytes(batch.column(2))
            wanted = [set(c or ()) for c in batch.column(3).to_pylist()]
            texts = [t if w else b"" for t, w in zip(texts, wanted)]
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in row_slices(texts, 1 << 18):
                words = [t.split() for t in texts[a:b]]
                out = ([], [], [], [])
                for low, doc, at, n in zip(*(x.tolist() for x in _signed(_runs(words, window, gram)))):
                    if low in wanted[a + doc]:
                        for k in range(0, n, CUT):  # a run may be as long as its text
                            for w in _window_slices(b" ".join(words[doc][at + k:at + min(n, k + CUT) + window - 1]), window):
                                out[0].append(hashlib.blake2b(w, digest_size=16).digest())
                            size = min(n, k + CUT) - k
                            out[1].extend([ids[a + doc]] * size)
                            out[2].extend([keys[a + doc]] * size)
                            out[3].extend(range(at + k, at + k + size))
                            if len(out[0]) >= 8 * CUT:
                                yield _window_batch(out)
                                out = ([], [], [], [])
                yield _window_batch(out)

    return marked.select("doc_id", "doc_key", "text", "hot").mapInArrow(rows, "digest binary, doc_id bigint, doc_key bigint, first int")


def _drop_ranges(joined: DataFrame, window: int, with_text: bool) -> DataFrame:
    def rows(batches):
        for batch in batches:
            texts = text_bytes(batch.column(2))
            counts, removed, sums, kept = [], [], [], []
            for key, text, ranges in zip(batch.column(1).to_pylist(), texts, batch.column(3).to_pylist()):
                words = text.split()
                counts.append(len(words))
                mine = [r for r in ranges or () if r["doc_key"] == key]
                if mine:
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, [r["first"] for r in mine], 1)
                    np.add.at(gone, [r["first"] + r["windows"] + window - 1 for r in mine], -1)
                    covered = np.cumsum(gone)[:-1] > 0
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                left = b" ".join(words)
                removed.append(counts[-1] - len(words))
                sums.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": sums}
                | ({"kept_text": pa.array(kept, pa.binary()).cast(pa.string())} if with_text else {}))

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return joined.select("doc_id", "doc_key", "text", "ranges").mapInArrow(rows, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_windows: int = HOT_WINDOWS, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): words, words removed and a digest of the
    rest (``with_text``: the rest itself, joined by blanks).

    A word goes if a window that covers it also starts in a document with a smaller
    doc_id, judged on the input. Rows with the same doc_id don't remove each other's
    words; rows without one neither remove nor lose any. Null and empty texts have no
    words; texts shorter than a window lose none; other columns are not read.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), "text")
    light_path, shared_path = scratch_path(spark, "minimisers"), scratch_path(spark, "shared-minimisers")
    minimisers(keyed, window, gram).write.parquet(light_path)
    light = spark.read.parquet(light_path)
    (light.groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("windows").alias("n"))
     .where("a < b").select("minimiser", (F.col("n") > hot_windows).alias("is_hot")).write.parquet(shared_path))
    shared = spark.read.parquet(shared_path)
    lists = (light.join(shared, "minimiser").groupBy("doc_id")
             .agg(F.collect_set(F.when(~F.col("is_hot"), F.col("minimiser"))).alias("cold"),
                  F.collect_set(F.when(F.col("is_hot"), F.col("minimiser"))).alias("hot")))
    marked = keyed.join(lists.hint("shuffle_hash"), "doc_id", "left")
    ranges = _sort_buckets(_pack(marked, window, gram), window)
    if not shared.where("is_hot").isEmpty():
        hot = _hot_windows(marked, window, gram)  # in this plan, so that it reuses the exchange of the texts
        least = hot.groupBy("digest").agg(F.min("doc_id").alias("least"))
        ranges = ranges.unionByName(hot.join(least, "digest").where("doc_id > least")
                                    .select("doc_id", "doc_key", "first", F.lit(1).alias("windows")))
    by_doc = ranges.groupBy("doc_id").agg(F.collect_set(F.struct("doc_key", "first", "windows")).alias("ranges"))
    return _drop_ranges(keyed.join(by_doc.hint("shuffle_hash"), "doc_id", "left"), window, with_text)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS win
      FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE doc_id IS NOT NULL AND len(w) >= {WINDOW})),
least AS (SELECT win, min(doc_id) AS m FROM s GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + {WINDOW})) AS q FROM s JOIN least USING (win) WHERE doc_id > m),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY q) AS t
         FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) ANTI JOIN gone USING (rid, q) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (rid)
"""
