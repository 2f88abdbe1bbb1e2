"""Benchmark decontamination by a distributed positional inverted index (operator 3).

1. Test windows: ten consecutive words of an item (a shorter item is one window).
2. Index: every document's postings (term, positions) of the test terms, written to the
   shared folder; document-partitioned, so building it moves no text.
3. Rarity: occurrences of each term over the whole index, added up per task and then
   per term.
4. Search: a window's lists are intersected from its rarest term on, each shifted by
   the term's offset in the window. The survivors of all terms are exact phrases;
   with ``slop`` the other terms may stand up to that many words off (proximity).

The test windows are a stated query set, taken in blocks of at most ``BLOCK_WINDOWS``, so
what is sent to tasks is bounded whatever the size of the benchmark. Python in Arrow
batches: positions are intersected with numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import list_array, offsets_of, row_slices, text_bytes
from quire.session import scratch_path

#: Words of a window.
WINDOW = 10
#: Windows searched for in one pass over the documents.
BLOCK_WINDOWS = 200_000
#: Shifted positions looked at together inside a task.
STEP = 1 << 20

# A-Z lower-cased; 0-9, a-z and all bytes of non-ASCII characters kept; the rest separates.
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct ``item_id, words`` (joined by a blank). Items without an id, a text or a
    word have none; rows with the same id are one item."""

    def rows(batches):
        for batch in batches:
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words = words_of(text)
                size = min(window, len(words))
                grams = {b" ".join(words[s:s + size]) for s in range(len(words) - size + 1)} if size else ()
                ids += [i] * len(grams)
                found += grams
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.string()), "words": pa.array(found, pa.binary())})

    known = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    return known.mapInArrow(rows, "item_id string, words binary").distinct()


class Block:
    """A block of test windows: term ids per window, by rarity, and the items of each."""

    def __init__(self, rows: list[tuple[str, bytes]], width: int):
        self.items = sorted({i for i, _ in rows})
        rank = {i: k for k, i in enumerate(self.items)}
        by_window: dict[bytes, list[int]] = {}
        for i, words in rows:
            by_window.setdefault(words, []).append(rank[i])
        self.terms: dict[bytes, int] = {}
        self.width = width
        self.of = np.full((len(by_window), width), -1, np.int32)  # term at each offset, -1: none
        for w, words in enumerate(by_window):
            for k, word in enumerate(words.split()):
                self.of[w, k] = self.terms.setdefault(word, len(self.terms))
        self.item_at = offsets_of([len(v) for v in by_window.values()])
        self.item_of = np.array([i for v in by_window.values() for i in v], np.int64)

    def rank_by(self, counts: np.ndarray) -> None:
        """Offsets of each window from its rarest term to its most frequent one, and the
        windows by rarest term."""
        often = np.where(self.of >= 0, counts[self.of], np.iinfo(np.int64).max)
        self.order = np.argsort(often, axis=1, kind="stable").astype(np.int32)
        anchor = np.take_along_axis(self.of, self.order[:, :1], 1)[:, 0]
        self.by_anchor = np.argsort(anchor, kind="stable")
        self.anchored = offsets_of(np.bincount(anchor, minlength=len(self.terms)))


def build_index(docs: DataFrame, block: Block) -> DataFrame:
    """Postings of each document, as written to the shared folder: ``doc_id, doc_key,
    n_words`` and, term by term, ``terms``, ``counts`` and all ``positions``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block.terms)

    def rows(batches):
        term_id = shared.value.get
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for a, b in row_slices(texts):
                words = [words_of(t) for t in texts[a:b]]
                lengths = np.array([len(w) for w in words], np.int64)
                total = int(lengths.sum())
                ids = np.fromiter((term_id(w, -1) for ws in words for w in ws), np.int64, total)
                doc = np.repeat(np.arange(b - a), lengths)
                at = np.arange(total) - np.repeat(offsets_of(lengths)[:-1], lengths)
                keep = np.flatnonzero(ids >= 0)
                keep = keep[np.lexsort((ids[keep], doc[keep]))]  # stable: positions stay in order
                ids, doc, at = ids[keep], doc[keep], at[keep]
                new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])][:len(ids)])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(a, b - a), "doc_key": batch.column(1).slice(a, b - a),
                    "n_words": pa.array(lengths),
                    "terms": list_array(ids[new].astype(np.int32), np.searchsorted(doc[new], np.arange(b - a + 1)), pa.int32()),
                    "counts": list_array(np.diff(np.append(new, len(ids))).astype(np.int32), np.searchsorted(doc[new], np.arange(b - a + 1)), pa.int32()),
                    "positions": list_array(at.astype(np.int32), np.searchsorted(doc, np.arange(b - a + 1)), pa.int32()),
                })

    path = scratch_path(spark, "positional-index")
    (docs.select("doc_id", F.xxhash64("text").alias("doc_key"), "text")
     .mapInArrow(rows, "doc_id bigint, doc_key bigint, n_words bigint, terms array<int>, counts array<int>, positions array<int>")
     .write.parquet(path))
    return spark.read.parquet(path)


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of each test term in all documents: one row per term and task is
    shuffled, one row per term (bounded by the block) comes back."""

    def rows(batches):
        sums = np.zeros(n_terms, np.int64)
        for batch in batches:
            terms, counts = (np.asarray(batch.column(k).flatten()) for k in (0, 1))
            sums += np.bincount(terms, counts, n_terms).astype(np.int64)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"term": pa.array(seen, pa.int64()), "n": pa.array(sums[seen], pa.int64())})

    out = np.zeros(n_terms, np.int64)
    for term, n in (index.select("terms", "counts").mapInArrow(rows, "term bigint, n bigint")
                    .groupBy("term").agg(F.sum("n").alias("n")).collect()):
        out[term] = n
    return out


def _shifted(block: Block, words, doc_row, term, position):
    """(document, window, place of its first word) for each posting of a window's rarest term."""
    fan = block.anchored[term + 1] - block.anchored[term]
    total = int(fan.sum())
    nth = np.arange(total) - np.repeat(offsets_of(fan)[:-1], fan)
    window = block.by_anchor[np.repeat(block.anchored[term], fan) + nth]
    return np.repeat(doc_row, fan), window, np.repeat(position, fan) - block.order[window, 0]


def _search(block: Block, slop: int | None, n_words, terms, term_docs, counts, positions):
    """Phrase and proximity hits of a chunk of documents: two lists of (document row,
    window, place in ``words``), and where each document starts in ``words``."""
    pad = block.width + (slop or 0)
    base = offsets_of(n_words + 2 * pad)[:-1] + pad
    words = np.full(int((n_words + 2 * pad).sum()) + pad, -1, np.int32)  # test terms by place
    term = np.repeat(terms, counts)
    doc_row = np.repeat(term_docs, counts)
    place = base[doc_row] + positions
    words[place] = term
    exact, near = [], []
    anchors = np.flatnonzero(block.anchored[term + 1] > block.anchored[term])
    cost = np.cumsum(block.anchored[term[anchors] + 1] - block.anchored[term[anchors]])
    cuts = np.append(np.searchsorted(cost, np.arange(STEP, int(cost[-1]) + STEP, STEP)), len(anchors)) if len(cost) else ()
    done = 0
    for cut in cuts:
        part = anchors[done:max(cut, done + 1)]
        done += len(part)
        if not len(part):
            continue
        found = _shifted(block, words, doc_row[part], term[part], place[part])
        for hits, reach in ((exact, 0), (near, slop)):
            if reach is None:
                continue
            d, w, s = found
            for k in range(1, block.width):  # on from the rarest term
                off = block.order[w, k]
                want = block.of[w, off]
                ok = want < 0
                for shift in range(-reach, reach + 1):
                    ok |= words[s + off + shift] == want
                d, w, s = d[ok], w[ok], s[ok]
            hits.append((d, w, s))
    return exact, near, base, len(words)


def _named(block: Block, hits, n_docs: int):
    """Per document: the sorted items of its windows, as a list array."""
    d = np.concatenate([h[0] for h in hits]) if hits else np.zeros(0, np.int64)
    w = np.concatenate([h[1] for h in hits]) if hits else np.zeros(0, np.int64)
    fan = block.item_at[w + 1] - block.item_at[w]
    nth = np.arange(int(fan.sum())) - np.repeat(offsets_of(fan)[:-1], fan)
    item = block.item_of[np.repeat(block.item_at[w], fan) + nth]
    pairs = np.unique(np.repeat(d, fan) * len(block.items) + item)
    doc, item = np.divmod(pairs, max(1, len(block.items)))
    names = pa.array(block.items, pa.string()).take(pa.array(item, pa.int64()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int32()), names)


def search_index(index: DataFrame, block: Block, slop: int | None = None) -> DataFrame:
    """``doc_id, doc_key, n_words, hits`` (positions of words inside phrase matches),
    ``items`` and ``near_items`` (null without ``slop``)."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def rows(batches):
        block = shared.value
        for batch in batches:
            n_words = np.asarray(batch.column("n_words"))
            col = {k: (np.asarray(batch.column(k).flatten()), np.asarray(batch.column(k).offsets)) for k in ("terms", "counts", "positions")}
            col = {k: (v, o - o[0]) for k, (v, o) in col.items()}
            for a, b in row_slices(n_words, STEP, int):
                t0, t1 = (int(col["terms"][1][i]) for i in (a, b))
                p0, p1 = (int(col["positions"][1][i]) for i in (a, b))
                term_docs = np.repeat(np.arange(b - a), np.diff(col["terms"][1][a:b + 1]))
                exact, near, base, size = _search(block, slop, n_words[a:b], col["terms"][0][t0:t1].astype(np.int64), term_docs,
                                                  col["counts"][0][t0:t1], col["positions"][0][p0:p1])
                cover = np.zeros(size + 1, np.int32)
                for _, w, s in exact:
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + (block.of[w] >= 0).sum(axis=1), -1)
                hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                doc = np.searchsorted(base, hit, side="right") - 1
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a), "doc_key": batch.column("doc_key").slice(a, b - a),
                    "n_words": pa.array(n_words[a:b]),
                    "hits": list_array((hit - base[doc]).astype(np.int32), np.searchsorted(doc, np.arange(b - a + 1)), pa.int32()),
                    "items": _named(block, exact, b - a),
                    "near_items": pa.nulls(b - a, pa.list_(pa.string())) if slop is None else _named(block, near, b - a)})

    return index.select("doc_id", "doc_key", "n_words", "terms", "counts", "positions").mapInArrow(
        rows, "doc_id bigint, doc_key bigint, n_words bigint, hits array<int>, items array<string>, near_items array<string>")


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None,
               block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, doc_key, n_words, hits, items, near_items``.

    ``doc_key`` is xxhash64 of the text (with the id, it names a row up to equal ones);    ``hits``: ascending positions (from 0) of the words inside any occurrence of a test
    window; ``items``: ids (as strings, sorted) of items with such windows;
    ``near_items``: with ``slop``, items with a window whose other words all stand
    within ``slop`` words of their place relative to its rarest word. Null and empty texts
    have no words; repeated rows each get their row; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    path = scratch_path(spark, "test-windows")
    test_windows(items, window).write.parquet(path)
    windows = spark.read.parquet(path)
    blocks = max(1, -(-windows.count() // block_windows))
    parts = []
    for b in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b)
        block = Block(sorted((i, bytes(w)) for i, w in part.collect()), window)
        index = build_index(docs, block)
        block.rank_by(term_counts(index, len(block.terms)))
        parts.append(search_index(index, block, slop))
    if blocks == 1:
        return parts[0]
    every = parts[0].withColumn("b", F.lit(0))
    for b, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("b", F.lit(b)))
    # equal rows have equal hits: one entry per block, and as many rows as there were
    merged = (every.groupBy("doc_id", "doc_key", "n_words")
              .agg(F.count_if(F.col("b") == 0).alias("copies"),
                   *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("hits", "items", "near_items")]))
    if slop is None:
        merged = merged.withColumn("near_items", F.lit(None).cast("array<string>"))
    return (merged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
            .select("doc_id", "doc_key", "n_words", "hits", "items", "near_items"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_items(docs, items).select(
        "doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k,
              array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, s, k, array_to_string(w[s:s + k - 1], ' ') AS win
       FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s
             FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT dw.rid, dw.s, dw.k, iw.item_id FROM dw JOIN iw USING (k, win)),
h AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM m) GROUP BY rid),
n AS (SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n, 0) AS BIGINT) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN n USING (rid)
"""
