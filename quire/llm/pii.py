"""Personal data by candidate gradient boosting (operator 4).

Base spans (e-mail, ip, card, phone) come from strict patterns and their checks, and always
stay. High-recall generators then propose further, overlapping spans (written-out e-mails,
number groups without a country code, near-addresses) in what the base left. Boosted trees
score every proposal from its format and its context; the checked spans are their positive
examples, and proposals that fail all checks the negative ones, each distinct match and context once. Per kind, the
threshold is the lowest score whose precision on the held-out half of all examples is ``PRECISION``; proposals from it
on are added.

All spans are found inside the row: ``split`` and ``regexp_extract_all`` by the same pattern give the pieces
between and the matches, whose running lengths are the positions. The fitted trees become a
column expression, so scoring moves no row. Patterns are possessive where that
changes no match, which keeps them linear and free of recursion on very long texts.
Column expressions only; the trees are fitted by Spark ML on a bounded sample of each kind and label (``SAMPLE``).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.arrays import let
from quire.session import scratch_path

KINDS = ["email", "ip", "card", "phone"]
#: Examples of each kind and label (by hash of the example) of whose two halves one fits the trees; thresholds see all held-out ones.
SAMPLE = 10_000
#: Score bins of the held-out examples.
BINS = 10_000
#: Least held-out precision of a threshold, and examples behind it.
PRECISION = 0.99
LEAST_EXAMPLES = 20
TREES, DEPTH = 12, 3
_BLOCK = 128
_MASK = "\u0001"

# Base patterns. Possessive forms of
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip  [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+                                   phone  \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has no match of the pattern.
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9][\x20().0-9-]"}
#: Generators of proposals, by the kind they propose.
PROPOSE = {
    "email": r"[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+",
    "ip": r"[0-9]++(?:[.:_][0-9]++){2,7}+",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20.-][0-9]{4}){3})(?![0-9])",
    "phone": r"\+?[0-9(](?:[\x20().-]?[0-9]){5,14}+",
}
PROPOSE_HINT = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9][.:_][0-9]", "card": r"[0-9][\x20.-]?[0-9]", "phone": r"[0-9][\x20().-]?[0-9]"}
#: Words in front of a span that speak for personal data.
CUES = r"(?i)(?:mail|tel|phone|call|fax|contact|card|visa|account|ip|host|addr)"


def _running(steps: Column) -> Column:
    """Exclusive running sums of an int array, in blocks, so that a row with very many
    matches stays far from quadratic."""
    add = lambda a, b: a + b
    zero = F.lit(0).cast("bigint")

    def blocks(s):
        n = (F.size(s) + (_BLOCK - 1)) / _BLOCK
        return F.transform(F.sequence(F.lit(0), F.floor(n).cast("int") - 1), lambda b: F.aggregate(F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK)), zero, add))

    return let({"s": steps, "b": F.when(F.size(steps) > 0, blocks(steps)).otherwise(F.array().cast("array<bigint>"))},
               lambda r: let({"s": r["s"], "b": F.transform(r["b"], lambda _, i: F.aggregate(F.slice(r["b"], F.lit(1), i), zero, add))},
                             lambda q: F.transform(q["s"], lambda _, i: F.get(q["b"], F.floor(i / _BLOCK).cast("int"))
                                                   + F.aggregate(F.slice(q["s"], F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK), zero, add))))


def find_spans(text: Column, pattern: str, hint: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, match, before, after), positions in code
    points; empty where ``hint`` isn't found."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>")
    found = let({"m": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "p": F.split(text, pattern, -1)},
                lambda r: let({"m": r["m"], "p": r["p"], "at": _running(F.transform(r["m"], lambda m, i: (F.length(m) + F.length(F.get(r["p"], i))).cast("bigint")))},
                              lambda q: F.transform(q["m"], lambda m, i: F.struct(
                                  (F.get(q["at"], i) + F.length(F.get(q["p"], i))).alias("start"),
                                  (F.get(q["at"], i) + F.length(F.get(q["p"], i)) + F.length(m)).alias("end"),
                                  m.alias("match"), F.right(F.get(q["p"], i), F.lit(16)).alias("before"), F.left(F.get(q["p"], i + 1), F.lit(4)).alias("after")))))
    return F.when(text.rlike(hint), found).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a digit string pass the checksum? Of at most 19 digits; longer ones don't."""
    def add(total, x):
        d = F.when(x["i"] % 2 == 1, x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)).otherwise(x["d"])
        return total + d

    items = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.when(F.length(digits).between(1, 19), F.aggregate(items, F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _octets(m: Column) -> Column:
    """Every number of a dotted string is at most 255 (leading zeros don't count)."""
    def fits(part):
        bare = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(bare) <= 3, F.concat(F.lit("0"), bare).cast("int") <= 255).otherwise(F.lit(False))

    return F.forall(F.filter(F.split(m, "[^0-9]+"), lambda p: p != ""), fits)


def passes(kind: str, m: Column) -> Column:
    """The check of a kind's base match."""
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return let({"d": _digits(m)}, lambda r: F.length(r["d"]).between(16, 19) & luhn(r["d"]))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def plausible(kind: str, m: Column) -> Column:
    """A proposal that may well be right: no negative example."""
    if kind == "email":
        return m.rlike(r"(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,}$")
    if kind == "ip":
        return m.rlike(r"^[0-9]+(?:[._:][0-9]+){3}$") & _octets(m)
    if kind == "card":
        return luhn(_digits(m))
    return F.startswith(m, F.lit("+"))


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(find_spans(text, BASE[kind], HINT[kind]), lambda s: passes(kind, s["match"]))


def _masked(text: Column, kind: str) -> Column:
    """The text with a kind's base matches overwritten at their length, so that what is proposed next keeps
    its positions and meets none of them."""
    pattern = BASE[kind]
    out = let({"m": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "p": F.split(text, pattern, -1)},
              lambda r: F.array_join(F.transform(r["p"], lambda p, i: F.when(
                  i < F.size(r["m"]), let({"x": F.get(r["m"], i)}, lambda s: F.concat(p, F.when(passes(kind, s["x"]), F.repeat(F.lit(_MASK), F.length(s["x"]))).otherwise(s["x"]))))
                  .otherwise(p)), ""))
    return F.when(text.rlike(HINT[kind]), out).otherwise(text)


def _count(m: Column, pattern: str) -> Column:
    return F.regexp_count(m, F.lit(pattern)).cast("double")


def span_features(kind: str, s: Column) -> list[Column]:
    """Format and context of a span, as doubles."""
    m, flag = s["match"], lambda c: c.cast("double")
    return [F.lit(float(KINDS.index(kind))), F.length(m).cast("double"), _count(m, "[0-9]"), _count(m, "[A-Za-z]"), _count(m, r"[\x20()-]"), _count(m, r"\."),
            _count(m, "@"), _count(m, "[0-9]+"), flag(F.startswith(m, F.lit("+"))), flag(luhn(_digits(m))), flag(_octets(m)),
            flag(F.length(F.regexp_extract(m, r"\.([A-Za-z]+)$", 1)) >= 2), flag(s["before"].rlike(r"(^|[\s(,:;])$")), flag(s["before"].rlike(CUES)),
            flag(s["before"].rlike("[0-9]")), flag(s["after"].rlike(r"^($|[\s),.;])")), flag(s["after"].rlike("[0-9]"))]


def _tree_column(debug: str, x: list[Column]) -> Column:
    """A tree's printed rules as nested conditions."""
    lines = [line.strip() for line in debug.splitlines()]
    at = next(i for i, line in enumerate(lines) if line.startswith(("If", "Predict")))

    def node(i: int) -> tuple[Column, int]:
        if lines[i].startswith("Predict"):
            return F.lit(float(lines[i].split(":")[1])), i + 1
        feature, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[i]).groups()
        low, i = node(i + 1)
        high, i = node(i + 1)  # past the "Else" line
        return F.when(x[int(feature)] <= float(cut), low).otherwise(high), i

    return node(at)[0]


class Model:
    """Fitted trees with a threshold per kind."""

    def __init__(self, trees: list[tuple[float, str]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, x: list[Column]) -> Column:
        margin = F.lit(0.0)
        for weight, debug in self.trees:
            margin = margin + F.lit(weight) * _tree_column(debug, x)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-2 * margin))


def _worth_a_look(text: Column) -> Column:
    """Texts without a digit, an @ or a written-out at have no span and no proposal: one cheap scan
    spares them all patterns."""
    return (F.instr(text, "@") > 0) | text.rlike("[0-9]") | (F.instr(text, "(at)") > 0) | (F.instr(text, "[at]") > 0)


def _columns(docs: DataFrame) -> DataFrame:
    """Base spans of every kind, and the rest of the text for proposals."""
    out = docs.withColumn("body", F.when(_worth_a_look(F.col("text")), F.col("text")).otherwise(F.lit("")))
    rest = F.col("body")
    for kind in KINDS:
        out = out.withColumn(f"base_{kind}", base_spans(F.col("body"), kind))
        rest = F.col("rest") if kind != KINDS[0] else rest
        out = out.withColumn("rest", _masked(rest, kind))
    return out.withColumns({f"new_{k}": find_spans(F.col("rest"), PROPOSE[k], PROPOSE_HINT[k]) for k in KINDS})


def _examples(found, kind: str, label: float) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.xxhash64(s["match"], s["before"], s["after"]).alias("hash"),
                                                 F.array(*span_features(kind, s)).alias("x")))


def _implausible(kind: str):
    return lambda s: ~plausible(kind, s["match"])


def fit(docs: DataFrame) -> Model:
    """Trees from at most half of ``SAMPLE`` checked spans and as many failing proposals of each kind, those with the
    smallest even hashes; thresholds from the odd hashes of all texts. Copies count once. Without both labels nothing is added."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    spark = docs.sparkSession
    found = _columns(docs.where(_worth_a_look(F.col("text"))))
    every = F.concat(*[_examples(f"base_{k}", k, 1.0) for k in KINDS],
                     *[_examples(F.filter(f"new_{k}", _implausible(k)), k, 0.0) for k in KINDS])
    all_path, path = scratch_path(spark, "pii-spans"), scratch_path(spark, "pii-examples")
    # one pass over the texts; equal hashes have equal x
    found.select(F.explode(every).alias("e")).select("e.*").dropDuplicates(["kind", "label", "hash"]).write.parquet(all_path)
    spans = spark.read.parquet(all_path)
    even, held = spans.where(F.col("hash") % 2 == 0), spans.where(F.col("hash") % 2 != 0)
    first = [even.where((F.col("kind") == k) & (F.col("label") == y)).orderBy("hash").limit(SAMPLE // 2) for k in KINDS for y in (1.0, 0.0)]
    reduce(DataFrame.unionByName, first).coalesce(1).write.parquet(path)
    learn = spark.read.parquet(path).withColumn("features", array_to_vector("x"))
    if learn.select("label").distinct().count() < 2:
        return Model([], {})
    # one ordered partition: sums in a fixed order, so that a refit gives the same trees
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(learn.coalesce(1).sortWithinPartitions("label", "hash", "kind"))
    model = Model([(float(w), t.toDebugString) for w, t in zip(fitted.treeWeights, fitted.trees)], {})
    x = [F.col("x")[i] for i in range(len(span_features("email", F.col("s"))))]
    bins = (held.select("kind", "label", model.score(x).alias("p")).groupBy("kind", F.floor(F.col("p") * BINS).alias("bin"))
            .agg(F.min("p").alias("p"), F.count("*").alias("n"), F.sum("label").alias("right")).collect())  # at most BINS + 1 rows a kind
    seen: dict[str, list[float]] = {}
    for kind, _, p, n, right in sorted(bins, key=lambda r: -r["bin"]):
        total = seen[kind] = [a + b for a, b in zip(seen.get(kind, [0, 0.0]), (n, right))]
        if total[0] >= LEAST_EXAMPLES and total[1] >= PRECISION * total[0]:
            model.thresholds[kind] = p
    return model


def _as_spans(found, kind: str, base: bool) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base")))


def _selected(model: Model, kind: str):
    """Does a proposal's score reach its kind's threshold?"""
    def test(s):
        x = span_features(kind, s)
        return let({"x": F.array(*x)}, lambda r: model.score([r["x"][i] for i in range(len(x))])) >= model.thresholds[kind]

    return test


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` (with a text column) with ``spans`` as last column: array of (kind, start, end, base) in order of kind, then
    start. Where ``docs`` has a column of that name, the new one's gets underscores until it is free.

    Positions are code points of the whole text, end exclusive; a null or empty text has none.
    Base spans of different kinds may overlap; added ones meet no base span. Rows and their other
    columns are kept as they are.
    """
    model = model or fit(docs.select("text"))
    keep, column = docs.columns, "spans"
    while column in keep:
        column += "_"
    names = [f"c{i}" for i in range(len(keep))]
    found = _columns(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col("text").alias("text")))
    shape = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    per_kind = []
    for kind in KINDS:
        spans = _as_spans(f"base_{kind}", kind, True)
        if model.trees and kind in model.thresholds:
            added = F.filter(f"new_{kind}", _selected(model, kind))
            spans = F.array_sort(F.concat(spans, _as_spans(added, kind, False)))
        per_kind.append(spans)
    spans = F.concat(*per_kind).cast(shape)
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], spans.alias(column))


def redact(detected: DataFrame) -> DataFrame:
    """``detected`` with ``text`` replaced: each run of overlapping spans (its last column) becomes [KIND] of its first span."""
    column = detected.columns[-1]
    joined = F.aggregate(
        F.array_sort(F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"), F.concat(acc["out"], F.array(F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text"), (acc["at"] + 1).cast("int"))))
    return detected.withColumn("text", F.when(F.size(column) > 0, joined).otherwise(F.col("text")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["base"])
    return (detect(docs).withColumn("base", base)
            .select("doc_id", *[F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in KINDS],
                    F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")))
