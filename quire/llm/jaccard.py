"""N-gram Jaccard join, size-aware (operator 7).

A document's set holds its distinct four-word shingles as 64-bit hashes. Two sets
link when 100 * |A and B| >= 85 * |A or B|. Equal sets are collapsed first by their digest.

Light sets (at most ``boundary`` shingles). Sets of sizes s and t link exactly when they share
a subset of o(s, t) shingles, so each light set emits the o-subsets for every size a partner
may have; an equal key is a link, nothing is left to verify.

Heavy sets. Inverted lists over prefixes: in any one total order of shingles, linked sets
share one of the first |A| - ceil(0.85 |A|) + 1. The order puts rarely used
counters of a fixed-size count sketch of all shingles first, so what very many documents share is
left out of nearly all prefixes. Light sets with a possible heavy partner are listed too.

The boundary minimises the estimated cost: subset keys of light sets against postings
of listed ones, from the sizes of all documents.

Lists are scanned without emitting all pairs of a group: first every member against its
list's first document; verified links are contracted to components, and only pairs of
members in different components are left. A pair is out when the prefix that ends first has too
many shingles that no other set lists, or when too few are common, for the overlap that its
sizes need (positional bounds); the rest is verified on whole sets. So no link between different components is missed, and the components are exact.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.maps import may_be_in
from quire.llm.batches import list_array, mix64, offsets_of, text_slices
from quire.llm.components import by_shuffle, components
from quire.session import scratch_path

#: Words of a shingle; linked from this percentage on.
SHINGLE = 4
PERCENT = 85
#: Counters of the sketch that orders shingles (fixed, whatever the corpus).
SKETCH_BITS = 21
_CHUNK = 4096
#: Largest light size considered, and the cost of a posting in subset keys.
MOST_LIGHT = 20
POSTING_COST = 4.0
#: Longs of the map that tells scans which documents a verification may need; the others' texts stay unread by it.
WANTED_WORDS = 1 << 16


def min_overlap(s: int, t: int, percent: int = PERCENT) -> int:
    """Shingles that linked sets of these sizes share at least."""
    return -(-percent * (s + t) // (100 + percent))


def prefix_size(s, percent: int = PERCENT):
    return s + (-percent * s // 100) + 1  # s - ceil(percent * s / 100) + 1


def partner_sizes(s: int, percent: int = PERCENT) -> range:
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def shingle_sets(words: list[list[bytes]], size: int = SHINGLE):
    """Sorted distinct shingle hashes of each word list: flat values and row offsets."""
    lengths = np.array([len(w) for w in words], np.int64)
    base = offsets_of(lengths)
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, int(base[-1]))
    counts = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(words)), counts)
    at = base[doc] + np.arange(int(counts.sum())) - np.repeat(offsets_of(counts)[:-1], counts)
    padded = np.append(codes, np.zeros(size, np.uint64))
    h = padded[at]
    for k in range(1, size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + padded[at + k]
    for d in np.flatnonzero((lengths > 0) & (lengths < size)):  # the whole sequence
        h[np.searchsorted(doc, d)] = xxhash.xxh3_64_intdigest(b" ".join(words[d]), seed=int(lengths[d]))
    h = mix64(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][:len(h)]
    return h[new], np.searchsorted(doc[new], np.arange(len(words) + 1))


def _chunks(batch, column: int):
    for a, b, texts in text_slices(batch.column(column)):
        yield a, b, *shingle_sets([t.lower().split() for t in texts])


def usage_sketch(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the counters of all documents' shingles, and the number of sets by size up to
    2 * ``MOST_LIGHT``. Counters are summed within tasks, then by chunk, and written; they become
    classes in tasks, so that one byte of each comes to the driver."""
    n_sizes = 2 * MOST_LIGHT + 1
    spark = docs.sparkSession

    def rows(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        sizes = np.zeros(n_sizes, np.uint32)
        for batch in batches:
            for _, _, sets, at in _chunks(batch, 0):
                np.add.at(counts, (sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                n = np.diff(at)
                sizes += np.bincount(n[n < n_sizes], minlength=n_sizes).astype(np.uint32)
        chunks = counts.reshape(-1, _CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([*used.tolist(), -1], pa.int32()),
            "counts": pa.array([*(chunks[c].tobytes() for c in used), sizes.tobytes()], pa.binary())})

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(counts, np.uint32).astype(np.uint64)
                sums[chunk] = sums[chunk] + counts if chunk in sums else counts
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary()),
                                              "total": pa.array([int(v.sum()) for v in sums.values()], pa.int64())})

    path = scratch_path(spark, "jaccard-counters")
    docs.select("text").mapInArrow(rows, "chunk int, counts binary").repartition("chunk").mapInArrow(added, "chunk int, counts binary, total bigint").write.parquet(path)
    counters = spark.read.parquet(path)
    mean = (counters.where("chunk >= 0").agg(F.sum("total")).first()[0] or 0) / (1 << SKETCH_BITS)

    def classed(batches):
        for batch in batches:
            parts = [usage_classes(np.frombuffer(c, np.uint64), mean).tobytes() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"chunk": batch.column(0), "classes": pa.array(parts, pa.binary())})

    classes = np.full(1 << SKETCH_BITS, usage_classes(np.zeros(1, np.uint64), mean)[0], np.uint8)
    for chunk, part in counters.where("chunk >= 0").select("chunk", "counts").mapInArrow(classed, "chunk int, classes binary").collect():
        classes[chunk * _CHUNK:(chunk + 1) * _CHUNK] = np.frombuffer(part, np.uint8)
    sizes = counters.where("chunk < 0").select("counts").collect()  # one row
    return classes, np.frombuffer(sizes[0][0], np.uint64) if sizes else np.zeros(n_sizes, np.uint64)


def usage_classes(counts: np.ndarray, mean: float) -> np.ndarray:
    """Seven bits per counter, rarely used counters first: deviations from the mean of all counters in
    quarters of a standard deviation, and logarithmic far above it."""
    z = (counts.astype(np.float64) - mean) / math.sqrt(max(mean, 1e-9))
    return np.clip(np.where(z < 8, 32 + 4 * z, 64 + 4 * np.log2(np.maximum(z, 8) / 8)), 0, 127).astype(np.uint8)


def light_boundary(sizes: np.ndarray, percent: int = PERCENT) -> int:
    """Largest light size, by cost: subset keys of light sets plus postings of listed sets."""

    def cost(x: int) -> float:
        total = 0.0
        for s in range(1, len(sizes)):
            if s <= x:
                total += float(sizes[s]) * sum(math.comb(s, min_overlap(s, t, percent)) for t in partner_sizes(s, percent) if t <= x)
            if s > x or partner_sizes(s, percent)[-1] > x:
                total += float(sizes[s]) * POSTING_COST * prefix_size(s, percent)
        return total

    return min(range(MOST_LIGHT + 1), key=cost)


def _subset_keys(values: list[int], boundary: int) -> tuple[list[int], list[bool]]:
    """Keys of a light set's subsets for each partner size; is it the smaller size of the two?"""
    s, keys, small = len(values), [], []
    for t in partner_sizes(s):
        if t <= boundary:
            low, high, size = min(s, t), max(s, t), min_overlap(s, t)
            if size > s:
                continue
            for subset in itertools.combinations(values, size):
                keys.append(xxhash.xxh3_64_intdigest(np.array((low, high, *subset), np.uint64).tobytes()) - (1 << 63))
                small.append(s == low)
    return keys, small


def signatures(docs: DataFrame, classes: np.ndarray, boundary: int) -> DataFrame:
    """``doc_id, n, digest`` of each row, its ``prefix`` in the total order and its ``subsets``."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def rows(batches):
        classes = shared.value
        for batch in batches:
            for a, b, sets, at in _chunks(batch, 1):
                n = np.diff(at)
                doc = np.repeat(np.arange(b - a), n)
                value = (classes[(sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (sets & np.uint64((1 << 56) - 1))
                value = value[np.lexsort((value, doc))]
                listed = (n > 0) & ((n > boundary) | (100 * n // PERCENT > boundary))
                size = np.where(listed, prefix_size(n), 0)
                first = np.arange(len(value)) - np.repeat(at[:-1], n) < np.repeat(size, n)
                digests, keys, small, key_at = [], [], [], [0]
                for i, k in zip(at[:-1].tolist(), n.tolist()):
                    digests.append(hashlib.blake2b(sets[i:i + k].tobytes(), digest_size=16).digest())
                    if 0 < k <= boundary:
                        more, flags = _subset_keys(sets[i:i + k].tolist(), boundary)
                        keys += more
                        small += flags
                    key_at.append(len(keys))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(a, b - a), "n": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.binary()),
                    "prefix": list_array(value[first].view(np.int64), offsets_of(size), pa.int64()),
                    "subsets": list_array(np.array(keys, np.int64), np.array(key_at), pa.int64()),
                    "smaller": list_array(np.array(small, bool), np.array(key_at), pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id bigint, n bigint, digest binary, prefix array<bigint>, subsets array<bigint>, smaller array<boolean>")


def _subset_links(classes: DataFrame) -> DataFrame:
    """Links of light sets: everyone in a key's list shares the key's subset with the list's first
    set of the smaller size, which is as much as either size needs."""
    keys = classes.select("rep", F.explode(F.arrays_zip("subsets", "smaller")).alias("k")).select("rep", F.col("k.subsets").alias("key"), F.col("k.smaller").alias("smaller"))
    first = keys.groupBy("key").agg(F.min(F.when(F.col("smaller"), F.col("rep"))).alias("u"), F.count("*").alias("size")).where("size > 1 AND u IS NOT NULL").drop("size")
    return keys.join(by_shuffle(first), "key").where("rep <> u").select("u", F.col("rep").alias("v")).distinct()


def _need(n_a, n_b):
    return F.ceil(PERCENT * (F.col(n_a) + F.col(n_b)) / F.lit(100 + PERCENT))


def _prefix(n):
    """Column form of ``prefix_size``."""
    return F.col(n) - F.floor((PERCENT * F.col(n) + 99) / F.lit(100)) + 1


def _may_link(a: str, b: str):
    """Sizes and prefixes allow a link. Of two prefixes, the one that ends first in the total order has
    all its shingles that the other set has in the other prefix, too; so its ``bare`` shingles (listed
    by no one else) are not shared, and the overlap is at most its set without them."""
    n_a, n_b = f"n_{a}", f"n_{b}"
    most = F.when(F.col(f"last_{a}") <= F.col(f"last_{b}"), F.col(n_a) - F.col(f"bare_{a}")).otherwise(F.col(n_b) - F.col(f"bare_{b}"))
    return (100 * F.col(n_a) >= PERCENT * F.col(n_b)) & (100 * F.col(n_b) >= PERCENT * F.col(n_a)) & (most >= _need(n_a, n_b))


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``u, v`` whose whole sets link. The map of the ids spares the other documents'
    sets the shuffle; what it lets through by chance finds no pair in the join."""
    spark = docs.sparkSession
    path = scratch_path(spark, "jaccard-pairs")
    pairs.select("u", "v").write.parquet(path)
    pairs = spark.read.parquet(path)
    wanted = may_be_in(F.col("doc_id"), pairs.select(F.explode(F.array("u", "v")).alias("id")), WANTED_WORDS)

    def rows(batches):
        for batch in batches:
            for a, b, sets, at in _chunks(batch, 1):
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).slice(a, b - a), "hashes": list_array(sets.view(np.int64), at, pa.int64())})

    sets = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & wanted).mapInArrow(rows, "id bigint, hashes array<bigint>")
    left = sets.select(F.col("id").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("hashes").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (pairs.join(by_shuffle(left), "u").join(by_shuffle(right), "v")
            .where(100 * both >= PERCENT * (F.size("a") + F.size("b") - both)).select("u", "v"))


def _lists(classes: DataFrame) -> DataFrame:
    """Postings (key, rep) of prefix shingles that two sets or more list, with each list's first set
    and its size."""
    postings = classes.select(F.explode("prefix").alias("key"), "rep")
    first = postings.groupBy("key").agg(F.min("rep").alias("u"), F.count("*").alias("size")).where("size > 1")
    return postings.join(by_shuffle(first), "key")


def _listed_sets(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """``rep, n, last, bare``: size, end of the prefix, and prefix shingles that no other set lists."""
    listed = lists.groupBy("rep").agg(F.count("*").alias("listed"))
    return (classes.select("rep", "n", F.try_element_at("prefix", F.lit(-1)).alias("last"))
            .join(by_shuffle(listed), "rep").select("rep", "n", "last", (_prefix("n") - F.col("listed")).alias("bare")))


def _as_side(sets: DataFrame, side: str) -> DataFrame:
    return sets.select(F.col("rep").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "last", "bare")])


def _beyond(side: str):
    """Shingles of a set behind its prefix."""
    return F.col(f"n_{side}") - _prefix(f"n_{side}")


def _left_pairs(lists: DataFrame, sets: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of different components that may link.

    Only lists with several components can hold one. Of a pair, take the set whose prefix ends first: it
    needs t = need - (its shingles behind the prefix) common ones among its l shingles in such
    lists, so at least one among any l - t + 1 of them. Pairs are formed in the l - t + 1 shortest
    only (none if l < t); then their common prefix shingles are counted exactly."""
    labelled = (lists.select("key", "rep", "size").join(by_shuffle(found.withColumnRenamed("node", "rep")), "rep", "left")
                .withColumn("label", F.coalesce("component", "rep")).drop("component"))
    # the most frequent component of a list is only met by members of the others
    main = (labelled.groupBy("key", "label").agg(F.count("*").alias("members"))
            .groupBy("key").agg(F.max_by("label", F.struct("members", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels"))
    own = Window.partitionBy("rep")  # a set's own postings: at most its prefix
    mixed = (labelled.join(by_shuffle(main), "key")
             .withColumn("nth", F.row_number().over(own.orderBy("size", "key")) - 1).withColumn("l", F.count("*").over(own))
             .join(by_shuffle(sets.select("rep", "n", "last")), "rep"))

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "label", "nth", "l", "n", "last")], *(["main"] if x == "b" else []))

    first_ends = F.col("last_a") <= F.col("last_b")
    need = _need("n_a", "n_b")
    shared = F.when(first_ends, F.col("l_a") - F.col("nth_a") + _beyond("a")).otherwise(F.col("l_b") - F.col("nth_b") + _beyond("b"))
    pairs = (side(mixed.where("label <> main"), "a").join(by_shuffle(side(mixed, "b")), "key")
             .where((F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("main")) | (F.col("rep_a") < F.col("rep_b"))))
             .where((100 * F.col("n_a") >= PERCENT * F.col("n_b")) & (100 * F.col("n_b") >= PERCENT * F.col("n_a")) & (shared >= need))
             .select(F.least("rep_a", "rep_b").alias("u"), F.greatest("rep_a", "rep_b").alias("v")).distinct())
    full = sets.join(by_shuffle(classes.select("rep", "prefix")), "rep")
    for x in ("u", "v"):
        pairs = pairs.join(by_shuffle(full.select(F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "last", "prefix")])), x)
    beyond = F.when(F.col("last_u") <= F.col("last_v"), _beyond("u")).otherwise(_beyond("v"))
    return pairs.where(F.size(F.array_intersect("prefix_u", "prefix_v")) + beyond >= _need("n_u", "n_v")).select("u", "v").distinct()


def join_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, n_shingles, component_id``.

    Null, empty and blank texts have an empty set and are linked with nothing; rows with
    equal sets are linked; rows with the same doc_id are one document, linked by any of its texts;
    rows without a doc_id are linked with nothing and have no component. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    usage, sizes = usage_sketch(docs)
    boundary = light_boundary(sizes)
    sig_path, class_path, list_path = (scratch_path(spark, f"jaccard-{k}") for k in ("signatures", "classes", "lists"))
    signatures(docs, usage, boundary).write.parquet(sig_path)
    sig = spark.read.parquet(sig_path)
    (sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest")
     .agg(F.min(F.struct("doc_id", "n", "prefix", "subsets", "smaller")).alias("m"))
     .select("digest", F.col("m.doc_id").alias("rep"), "m.n", "m.prefix", "m.subsets", "m.smaller").write.parquet(class_path))
    classes = spark.read.parquet(class_path)
    _lists(classes).write.parquet(list_path)
    lists = spark.read.parquet(list_path)
    set_path = scratch_path(spark, "jaccard-listed-sets")
    _listed_sets(lists, classes).write.parquet(set_path)
    sets = spark.read.parquet(set_path)
    star = (lists.where("rep <> u").select("u", F.col("rep").alias("v")).distinct()
            .join(by_shuffle(_as_side(sets, "u")), "u").join(by_shuffle(_as_side(sets, "v")), "v").where(_may_link("u", "v")).select("u", "v").distinct())
    links_path = scratch_path(spark, "jaccard-links")
    same_id = (sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y")
               .select("doc_id"))  # documents with several texts link the classes of each
    reps = sig.select("doc_id", "digest").join(by_shuffle(same_id), "doc_id").join(by_shuffle(classes.select("digest", "rep")), "digest").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    _verified(star, docs).unionByName(_subset_links(classes)).unionByName(reps).write.parquet(links_path)
    links = spark.read.parquet(links_path)
    found = components(links)
    more = _verified(_left_pairs(lists, sets, classes, found), docs)
    final = components(links.unionByName(more))
    member = sig.select("doc_id", "n", "digest").join(by_shuffle(classes.select("digest", "rep")), "digest", "left")
    return (member.join(by_shuffle(final.select(F.col("node").alias("rep"), "component")), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {SHINGLE} THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + {SHINGLE - 1}], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(c.m AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) c USING (doc_id)
"""
