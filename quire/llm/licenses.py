"""License scans (operator 2): sparse TF-IDF cosine to templates, then directory inheritance.

Every line of a whole text, and every paragraph of several lines, is a sparse vector of
term counts times inverse document frequencies over the templates; so are the templates. The
best cosine of at least ``LEAST_COSINE`` is a file's own licence. A file without one inherits that
of the nearest ancestor directory that holds a licence file, found by joining each
distinct directory's ancestors with the directories of licence files.

Lines are picked by two bounds without loss: a unit that has none of a template's
heaviest terms has at most the cosine that the rest of the template can give (Cauchy-Schwarz), so only
units with such a term are split into terms; and no cosine is above the share of a unit's norm that the templates' terms
have, so that only units whose share reaches the threshold are counted to the end. Terms are counted
inside the row, never shuffled. Column expressions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.arrays import let

LEAST_COSINE = 0.5

# Grant and header sentences of public licences (one or more for each).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work; CC0 1.0 public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. No part may be reproduced without the prior written permission of the copyright holder."),
]
# Words which no vector holds. None: function words count like any other.
STOP_WORDS: frozenset[str] = frozenset()
# Code points of scripts that put no spaces around words (Thai, Lao, Burmese, Hangul, Khmer, kana, Han).
# They separate terms, as a licence's name often stands right beside them.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1100, 0x11FF), (0x1780, 0x17FF), (0x3040, 0x318F), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7FB), (0xF900, 0xFAFF),
            (0xFF66, 0xFFDC), (0x20000, 0x3FFFF)]
_OTHERS = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)
#: A letter, digit or accent, for Python and for Spark.
LETTER = f"(?:(?![{_OTHERS}])[^\\W_]|[\u0300-\u036f])"
SPARK_LETTER = r"[a-z0-9\u0300-\u036f[\p{L}\p{N}&&[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in UNSPACED) + "]]]"
#: Terms: runs of letters and digits, joined by single dots or hyphens.
TERM, SPARK_TERM = (f"{letter}+(?:[.-]{letter}+)*" for letter in (LETTER, SPARK_LETTER))
# Base names of licence files.
LICENSE_FILES = ["LICENSE", "LICENSE.txt", "LICENSE.md", "COPYING", "NOTICE"]


def _vectors(templates) -> tuple[dict[str, float], list[dict[str, float]], float]:
    """Inverse document frequencies, unit template vectors, and the weight of unknown terms."""
    counts = [Counter(t for t in re.findall(TERM, text.lower()) if t not in STOP_WORDS) for _, text in templates]
    n = len(counts)
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    vectors = []
    for c in counts:
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        vectors.append({t: k * idf[t] / norm for t, k in c.items()})
    return idf, vectors, math.log(1 + n) + 1


def anchor_terms(vectors: list[dict[str, float]], least: float) -> list[str]:
    """Terms of which a unit needs one at least to reach the cosine ``least`` with any template:
    what a template has besides its anchors weighs less than ``least``."""
    anchors: set[str] = set()
    for v in vectors:
        rest = 1.0 - sum(w * w for t, w in v.items() if t in anchors)
        for t, w in sorted(v.items(), key=lambda x: (-x[1], x[0])):
            if rest < least * least * 0.999:
                break
            if t not in anchors:
                anchors.add(t)
                rest -= w * w
    return sorted(anchors)


def _best(words: Column, idf: dict[str, float], vectors: list[dict[str, float]], unknown: float, least: float) -> Column:
    """``cosine, t``: a unit's highest cosine and minus its template, null below ``least``; counted inside the row.

    The templates' terms give the dots and the squared norm ``e``. Any other occurrence adds ``unknown`` squared at
    least, so most units are out before their other terms are sorted and counted.
    """
    weights = F.create_map(*[x for t, w in sorted(idf.items()) for x in (F.lit(t), F.array(*[F.lit(float(y)) for y in (w, *[v.get(t, 0.0) for v in vectors])]))])
    bound = least * least * 0.999
    zero = F.lit(0.0)

    def weighed(known):
        return F.transform(F.array_distinct(known), lambda t: F.struct((F.size(F.filter(known, lambda k: k == t)) * F.element_at(weights, t)[0]).alias("w"), F.element_at(weights, t).alias("v")))

    def squares(terms):  # the r-th copy of a term adds r * r - (r - 1) * (r - 1)
        start = F.struct(F.lit("").alias("last"), F.lit(0).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("sum"))
        return F.aggregate(F.array_sort(terms), start, lambda a, t: let({"a": a, "t": t, "r": F.when(t == a["last"], a["r"] + 1).otherwise(F.lit(1).cast("bigint"))},
                           lambda x: F.struct(x["t"].alias("last"), x["r"].alias("r"), (x["a"]["sum"] + 2 * x["r"] - 1).alias("sum"))), lambda a: a["sum"])

    def dot(k):
        return lambda a, x: a + x["w"] * x["v"][k + 1]

    def dots(s):
        return F.array(*[F.aggregate(s["d"], zero, dot(k)) for k in range(len(vectors))])

    def cosines(s):
        return let({"dots": s["dots"], "norm": F.sqrt(s["e"] + squares(s["other"]) * (unknown * unknown))},
                   lambda x: F.array_max(F.transform(x["dots"], lambda dot, k: F.struct(F.round(dot / x["norm"], 6).alias("cosine"), (-k).alias("t")))))

    found = F.regexp_extract_all(words, F.lit(SPARK_TERM), F.lit(0))
    found = F.filter(found, lambda t: ~t.isin(sorted(STOP_WORDS))) if STOP_WORDS else found
    best = let({"t": found}, lambda r: let(
        {"d": let({"k": F.filter(r["t"], lambda t: t.isin(sorted(idf)))}, lambda k: weighed(k["k"])), "other": F.filter(r["t"], lambda t: ~t.isin(sorted(idf)))}, lambda q: let(
            {"d": q["d"], "other": q["other"], "e": F.aggregate(q["d"], zero, lambda a, x: a + x["w"] * x["w"]), "least": F.size(q["other"]) * (unknown * unknown)}, lambda s: F.when(
                (s["e"] > 0) & (s["e"] >= bound * (s["e"] + s["least"])), let(
                    {"dots": dots(s), "other": s["other"], "e": s["e"], "least": s["least"]}, lambda u: F.when(
                        F.pow(F.array_max(u["dots"]), F.lit(2.0)) >= bound * (u["e"] + u["least"]), cosines(u)))))))
    return let({"b": best}, lambda x: F.when(x["b"]["cosine"] >= least, x["b"]))


def own_licenses(files: DataFrame, templates=TEMPLATES, least: float = LEAST_COSINE, key: tuple[str, ...] = ("file_key",)) -> DataFrame:
    """``*key, license, cosine`` of the files (*key, text) with a licence of their own: the
    highest cosine of a line or paragraph; ties go to the first template. Null and empty texts have none."""
    idf, vectors, unknown = _vectors(templates)
    anchors = f"(?<!{SPARK_LETTER})(?:" + "|".join(re.escape(a).replace("\\-", "-") for a in anchor_terms(vectors, least)) + f")(?!{SPARK_LETTER})"
    text = F.lower("text")
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: F.instr(F.trim(p), "\n") > 0)
    units = (files.where(text.rlike(anchors))
             .select(*key, F.explode(F.concat(F.split(text, "\n"), paragraphs)).alias("words"))
             .where(F.col("words").rlike(anchors)))
    names = F.array(*[F.lit(name) for name, _ in templates])
    return (units.select(*key, _best(F.col("words"), idf, vectors, unknown, least).alias("best"))
            .groupBy(*key).agg(F.max("best").alias("best")).where(F.col("best").isNotNull())
            .select(*key, names[-F.col("best.t")].alias("license"), F.col("best.cosine").alias("cosine")))


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, down to the root ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan(files: DataFrame, templates=TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """``file_key, path, own_license, cosine, license, license_from`` of every row of ``files``
    (file_key, path, text); ``license_from`` is the key of the file that states it.

    A file without a licence inherits the nearest directory's; a directory with several licence
    files has that of the highest cosine, then of the smallest key. Null paths have no directory and inherit
    nothing; rows with the same key are one file and share its licence, rows without a key are told apart by path and
    text, and ``license_from`` is null where the stating file has no key; other columns are not read.
    """
    named = F.xxhash64("path", "text"), F.col("file_key").isNull()
    files = files.select("file_key", "path", "text", F.coalesce("file_key", named[0]).alias("own_key"), named[1].alias("unnamed"))
    own = own_licenses(files.select("own_key", "unnamed", "text"), templates, least, ("own_key", "unnamed"))
    stated = files.drop("text").join(own, ["own_key", "unnamed"], "left")
    paths = files.select("path")
    name = F.element_at(F.split("path", "/"), -1)
    directory = F.element_at(ancestors(F.col("path")), 1)
    holders = (stated.where(F.col("license").isNotNull() & name.isin(LICENSE_FILES))
               .groupBy(directory.alias("dir")).agg(F.max(F.struct("cosine", (-F.col("file_key")).alias("k"), "license")).alias("best"))
               .select("dir", F.col("best.license").alias("license"), (-F.col("best.k")).alias("license_from")))
    homes = paths.where(F.col("path").isNotNull()).select(directory.alias("home")).distinct()
    above = homes.select("home", F.posexplode(F.concat(F.array("home"), F.when(F.col("home") != "", ancestors(F.col("home"))).otherwise(F.array().cast("array<string>")))).alias("up", "dir"))
    nearest = (above.join(holders, "dir").groupBy("home").agg(F.min(F.struct("up", "license", "license_from")).alias("n"))
               .select("home", F.col("n.license").alias("from_dir"), F.col("n.license_from").alias("dir_key")))
    return (stated.withColumn("home", directory).join(nearest, "home", "left")
            .select("file_key", "path", F.col("license").alias("own_license"), "cosine",
                    F.coalesce("license", "from_dir").alias("license"),
                    F.when(F.col("license").isNotNull(), F.col("file_key")).otherwise(F.col("dir_key")).alias("license_from")))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: three directory levels below their source, and a licence file's name for the
    first document of each level's block of ids."""
    i = F.col("doc_id")
    level = F.when(i % 4096 == 0, F.lit("")).when(i % 256 == 0, F.format_string("/d%d", F.expr("doc_id div 4096")))\
        .otherwise(F.format_string("/d%d/e%d", F.expr("doc_id div 4096"), F.expr("doc_id div 256")))
    name = F.when(i % 16 == 0, F.lit("LICENSE")).otherwise(F.format_string("f%d.txt", i))
    return docs.select(i.alias("file_key"), F.concat(F.col("source"), level, F.lit("/"), name).alias("path"), "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return scan(document_paths(docs)).withColumnRenamed("file_key", "doc_id")
