"""Quality rules with adaptive thresholds (operator 9).

Per document, in one pass over the whole text: words, characters in words, symbols,
repeated lines, words inside repeated three-word windows. Fixed cutoffs are replaced
by fences around the quartiles of a document's own language and source. Quantiles
come from log-binned sketches (relative error ``ACCURACY``): bin counts, which merge by
addition, so a hot source is summed per task before anything is shuffled, and
the same rows always give the same thresholds. A group's sketch is blended with its
language's, as if it had ``PRIOR_ROWS`` more documents spread like those, and a language's in the same way
with that of all documents, so that no size is a border; the wider sketches are
the groups' sketches merged. The verdict is a join of documents with thresholds.
Python in Arrow batches for the counts only (a window repeated in one text is
a per-row sort); everything after is column expressions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.batches import map_batches, offsets_of, row_slices, text_bytes
from quire.session import scratch_path

# Symbol characters; white space between words.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
#: Base rule: fewest words, most percent of words in repeated windows.
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Relative error of a sketch's quantiles.
ACCURACY = 0.01
#: Weight of the wider group's sketch, in rows.
PRIOR_ROWS = 100
#: Quartile distances beyond a quartile that are still kept.
FENCE = 3.0
#: Least quartile distance by feature, so that groups of near-equal documents keep theirs.
SPREAD = {"symbols": 0.02, "repeats": 0.1, "dup_lines": 0.15, "word_length": 0.7}

_CONTINUATION = bytes(range(0x80, 0xC0))


def _repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Per document: words inside a three-word window that its text has twice or more."""
    lengths = np.array([len(w) for w in words], np.int64)
    base = offsets_of(lengths)
    ids = np.empty(int(base[-1]), np.int64)
    next_id = 0
    for ws, at in zip(words, base[:-1].tolist()):
        own: dict[bytes, int] = {}
        ids[at:at + len(ws)] = [own.setdefault(w, len(own)) for w in ws]
        ids[at:at + len(ws)] += next_id  # words of different documents never share an id
        next_id += len(own)
    n = len(ids)
    cover = np.zeros(n + 1, np.int64)
    doc = np.repeat(np.arange(len(words)), lengths)
    at = np.flatnonzero(doc[2:] == doc[:-2]) if n >= 3 else np.zeros(0, np.int64)
    if len(at):
        pair = ids[at] * next_id + ids[at + 1]
        if next_id > 1 << 20:  # three ids don't fit 63 bits: number the pairs first
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair * next_id + ids[at + 2]
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        again = np.r_[same, False] | np.r_[False, same]
        starts = at[order[again]]
        cover[:n] = np.bincount(starts, minlength=n)[:n]
        cover[:n] = cover[:n] + np.r_[0, cover[:n - 1]] + np.r_[0, 0, cover[:n - 2]]
    sums = offsets_of(cover[:n] > 0)
    return sums[base[1:]] - sums[base[:-1]]


def _repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return len(lines), len(lines) - len(set(lines))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of each whole text (null or empty: zeros)."""

    def cols(batch):
        texts = text_bytes(batch.column(3))
        out = {name: [] for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
        for a, b in row_slices(texts):
            words = [t.split() for t in texts[a:b]]
            out["n_repeat_words"] += _repeated_words(words).tolist()
            out["n_words"] += map(len, words)
            for t in texts[a:b]:
                lines, dup = _repeated_lines(t)
                out["n_lines"].append(lines)
                out["n_dup_lines"].append(dup)
                out["word_chars"].append(len(t.translate(None, BLANKS + _CONTINUATION)))
                out["n_symbols"].append(len(t) - len(t.translate(None, SYMBOLS)))
        return {"doc_id": batch.column(0), "lang": batch.column(1), "source": batch.column(2)} | {
            k: pa.array(v, pa.int64()) for k, v in out.items()}

    return map_batches(docs.select("doc_id", "lang", "source", "text"), cols,
                       "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, "
                       "n_lines bigint, n_dup_lines bigint, n_repeat_words bigint")


def _measures() -> dict:
    """Features under adaptive thresholds; 0 where there is nothing to divide by."""
    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {"symbols": ratio("n_symbols", "word_chars"), "repeats": ratio("n_repeat_words", "n_words"),
            "dup_lines": ratio("n_dup_lines", "n_lines"), "word_length": ratio("word_chars", "n_words")}


def sketches(measured: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable log-binned sketches: ``*by, feature, bin, n``. Bin 0 holds zeros; bin i the
    values in (g^(i-O-1), g^(i-O)], g = (1 + a) / (1 - a). Merging is adding ``n``."""
    log_g = math.log((1 + ACCURACY) / (1 - ACCURACY))
    value = F.col("value")
    bins = F.when(value <= 0, F.lit(0)).otherwise((F.ceil(F.log(value) / log_g) + F.lit(_ORIGIN)).cast("int"))
    names = list(SPREAD)
    parts = ", ".join(f"'{k}', {k}" for k in names)
    return (measured.select(*by, F.expr(f"stack({len(names)}, {parts}) AS (feature, value)"))
            .groupBy(*by, "feature", bins.alias("bin")).agg(F.count("*").alias("n")))


_ORIGIN = 2000


def _quantile(q: float):
    """Smallest bin that reaches the share ``q`` (but for rounding of the weights), as its middle value."""
    g = (1 + ACCURACY) / (1 - ACCURACY)
    at = F.min(F.when(F.col("upto") >= F.col("rows") * (q - 1e-9), F.col("bin")))
    return F.when(at == 0, F.lit(0.0)).otherwise(2 * F.pow(F.lit(g), at - _ORIGIN) / (g + 1))


def blended(sketch: DataFrame, wider: DataFrame, by: list[str], of: list[str]) -> DataFrame:
    """The sketches of ``by`` with ``PRIOR_ROWS`` rows more that are spread like the ``wider`` sketch, that of the columns ``of``."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*of, "feature"))
    prior = wider.select(*[F.col(c).alias(f"of_{c}") for c in of], F.col("feature").alias("f"), "bin", (share * PRIOR_ROWS).alias("n"))
    same = F.col("feature") == F.col("f")
    for c in of:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    added = sketch.select(*by, "feature").distinct().join(prior, same).select(*by, "feature", "bin", "n")
    return sketch.select(*by, "feature", "bin", F.col("n").cast("double").alias("n")).unionByName(added).groupBy(*by, "feature", "bin").agg(F.sum("n").alias("n"))


def fences(by_group: DataFrame) -> DataFrame:
    """``lang, source, cuts`` of the sketches of all groups: per feature the lowest and highest value that is kept. The
    window runs over the bins of one sketch, whose number the accuracy bounds."""
    by_lang = by_group.groupBy("lang", "feature", "bin").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    by = ["lang", "source"]
    sketch = blended(by_group, blended(by_lang, overall, ["lang"], []), by, ["lang"])
    one = Window.partitionBy(*by, "feature")
    spread = F.create_map(*[x for k, v in SPREAD.items() for x in (F.lit(k), F.lit(v))])
    reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), spread[F.col("feature")])
    return (sketch.withColumn("upto", F.sum("n").over(one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("rows", F.sum("n").over(one))
            .groupBy(*by, "feature").agg(_quantile(0.25).alias("q1"), _quantile(0.75).alias("q3"))
            .groupBy(*by)
            .agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct((F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))))).alias("cuts")))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, lang, source, text): counts, ``base_failed``, ``kept``.

    ``kept`` is false where the base rule fails or a feature lies beyond its fence. Null
    languages and sources are groups of their own; ties at a fence are kept; an empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "quality-features")
    measures = _measures()
    features(docs).withColumns(measures).write.parquet(path)
    measured = spark.read.parquet(path)
    cuts = fences(sketches(measured, ["lang", "source"])).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "cuts")
    inside = F.lit(True)
    for k in SPREAD:
        cut = F.col("cuts")[k]
        inside &= (F.col(k) >= cut["low"]) & (F.col(k) <= cut["high"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (measured.join(cuts, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text"))


def _blend_sql(own: str, wider: str, of: str, by: str) -> str:
    """The sketches of table ``own`` with PRIOR_ROWS rows spread like the table ``wider`` has them."""
    same = " AND ".join(["o.feature = s.feature"] + [f"o.{c} IS NOT DISTINCT FROM s.{c}" for c in of.split(", ") if c])
    keys = ", ".join(x for x in (of, "feature") if x)
    return f"""SELECT {by}, feature, bin, sum(n) AS n FROM (
         SELECT {by}, feature, bin, n::DOUBLE AS n FROM {own}
         UNION ALL
         SELECT {', '.join('o.' + c for c in by.split(', '))}, o.feature, s.bin, s.share * {PRIOR_ROWS}
         FROM (SELECT DISTINCT {by}, feature FROM {own}) o
         JOIN (SELECT *, n / sum(n) OVER (PARTITION BY {keys}) AS share FROM {wider}) s ON {same}) GROUP BY {by}, feature, bin"""


def _quantile_sql(q: float) -> str:
    g = (1 + ACCURACY) / (1 - ACCURACY)
    at = f"min(bin) FILTER (WHERE upto >= rows * {q - 1e-9!r}::DOUBLE)"
    return f"CASE WHEN {at} = 0 THEN 0.0 ELSE 2 * pow({g!r}::DOUBLE, {at} - {_ORIGIN}) / ({g!r}::DOUBLE + 1) END"


_RATIOS = {"symbols": "n_symbols / word_chars", "repeats": "n_repeat_words / n_words", "dup_lines": "n_dup_lines / n_lines", "word_length": "word_chars / n_words"}
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
       regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT rid, p, array_to_string(w[p:p + 2], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
again AS (SELECT rid, p FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
covered AS (SELECT rid, count(DISTINCT p + k) AS n FROM again, range(0, 3) r(k) GROUP BY rid),
c AS (SELECT d.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
       CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
       FROM d LEFT JOIN covered USING (rid)),
m AS MATERIALIZED (SELECT *, {', '.join(f'coalesce({r.replace(" / ", "::DOUBLE / nullif(")}, 0), 0.0) AS {k}' for k, r in _RATIOS.items())} FROM c),
v AS ({' UNION ALL '.join(f"SELECT lang, source, '{k}' AS feature, {k} AS value FROM m" for k in _RATIOS)}),
gs AS (SELECT lang, source, feature, CASE WHEN value <= 0 THEN 0 ELSE CAST(ceil(ln(value) / {math.log((1 + ACCURACY) / (1 - ACCURACY))!r}::DOUBLE) + {_ORIGIN} AS BIGINT) END AS bin, count(*) AS n FROM v GROUP BY ALL),
ls AS (SELECT lang, feature, bin, sum(n) AS n FROM gs GROUP BY ALL),
al AS (SELECT feature, bin, sum(n) AS n FROM gs GROUP BY ALL),
lb AS ({_blend_sql('ls', 'al', '', 'lang')}),
gb AS ({_blend_sql('gs', 'lb', 'lang', 'lang, source')}),
q AS (SELECT lang, source, feature, {_quantile_sql(0.25)} AS q1, {_quantile_sql(0.75)} AS q3 FROM (
       SELECT *, sum(n) OVER (PARTITION BY lang, source, feature ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, feature) AS rows FROM gb) GROUP BY lang, source, feature),
f AS (SELECT lang, source, feature, q1 - reach AS low, q3 + reach AS high FROM (
       SELECT *, {FENCE} * greatest(q3 - q1, CASE feature {' '.join(f"WHEN '{k}' THEN {x}" for k, x in SPREAD.items())} END) AS reach FROM q)),
beyond AS (SELECT DISTINCT rid FROM m JOIN f ON f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source
       WHERE {' OR '.join(f"f.feature = '{k}' AND (m.{k} < f.low OR m.{k} > f.high)" for k in _RATIOS)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND rid NOT IN (SELECT rid FROM beyond) AS kept
FROM m
"""
