"""Operator 4: licence scan by sparse TF-IDF cosine to templates, with inheritance along directories, on built-in expressions.

Every line of every text is compared with the templates; inverse document frequencies are counted over all texts. Words that no
template holds carry the weight of a word never seen, so foreign words lower the cosine. A line can reach the threshold only
if it holds one of each template's heaviest words (those whose absence leaves too little of the template's norm); only such
lines are taken apart, and their words meet the templates in a join. The best line at or above the threshold is the file's own
licence, its first such line if several are equal.

A file that is a licence file (by its name) grants its licence to its directory and all below. A file without a licence of its own
inherits from the nearest ancestor directory that has one: the distinct directories are expanded into their ancestors,
joined with the granting directories, and the deepest match is joined back to the files. Grants of one directory are first
reduced to the best.

Defined results: null or empty text has no own licence. A null path has no directory and inherits nothing. Rows with one path are
judged each by itself; repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tribolens.llm.columns import join_rows
from tribolens.plans.storage import materialise

LEAST = 0.7
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
# Forms in which files state a licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0, dedicated to the public domain."),
    ("MPL-2.0", "This source code is subject to the terms of the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
WORD_BREAK = r"[^a-z0-9]+"


def template_words() -> list[dict[str, int]]:
    counted = []
    for _, text in TEMPLATES:
        words = [w for w in re.split(WORD_BREAK, text.lower()) if w]
        counted.append({w: words.count(w) for w in words})
    return counted


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def frequencies(docs: DataFrame) -> tuple[dict[str, float], float]:
    """Inverse document frequency of the templates' words over all texts, and that of an unseen word."""
    vocabulary = sorted({w for counted in template_words() for w in counted})
    known = F.split(F.lit(" ".join(vocabulary)), " ")
    counts = docs.select(F.explode(F.array_intersect(words(F.coalesce("text", F.lit(""))), known)).alias("word")).groupBy(
        "word").count().collect()
    total = docs.count()
    seen = {r["word"]: r["count"] for r in counts}
    return {w: weight(total, seen.get(w, 0)) for w in vocabulary}, weight(total, 0)


def weight(total: int, seen: int) -> float:
    return math.log((1 + total) / (1 + seen)) + 1


def template_vectors(idf: dict[str, float]) -> list[dict[str, float]]:
    vectors = []
    for counted in template_words():
        vector = {w: (1 + math.log(n)) * idf[w] for w, n in counted.items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        vectors.append({w: x / norm for w, x in vector.items()})
    return vectors


def needed_words(vectors: list[dict[str, float]], least: float) -> list[str]:
    """Words of which a line at the threshold must hold one."""
    needed = set()
    for vector in vectors:
        rest = 1.0
        for w, x in sorted(vector.items(), key=lambda e: (-e[1], e[0])):
            if rest < least * least * 0.999:
                break
            needed.add(w)
            rest -= x * x
    return sorted(needed)


def own_licences(files: DataFrame, least: float) -> DataFrame:
    """(doc_id, tag, own_license, own_score, own_line) of files with a line at the threshold; `files` has doc_id, tag, text."""
    spark = files.sparkSession
    idf, unseen = frequencies(files)
    vectors = template_vectors(idf)
    hint = r"(?i)(?<![a-z0-9])(?:" + "|".join(needed_words(vectors, least)) + r")(?![a-z0-9])"
    lines = files.filter(F.col("text").rlike(hint)).select("doc_id", "tag", F.posexplode(F.split("text", "\n")).alias(
        "line", "content")).filter(F.col("content").rlike(hint)).select("doc_id", "tag", "line", words(F.col("content"))
                                                                         .alias("words"))
    terms = materialise(lines.select("doc_id", "tag", "line", F.explode("words").alias("word")).groupBy(
        "doc_id", "tag", "line", "word").agg((1 + F.log(F.count("*"))).alias("tf")))
    known = spark.createDataFrame(sorted(idf.items()), "word string, idf double")
    entries = spark.createDataFrame([(w, i, TEMPLATES[i][0], x) for i, v in enumerate(vectors) for w, x in v.items()],
                                    "word string, template int, license string, part double")
    # Both tables are as large as the template list.
    weighed = terms.join(F.broadcast(known), "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    key = ["doc_id", "tag", "line"]
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(F.broadcast(entries), "word").groupBy(*key, "template", "license").agg(
        F.sum(F.col("x") * F.col("part")).alias("dot"))
    norms = norms.withColumnsRenamed({c: f"_{c}" for c in key})
    same = dots["doc_id"].eqNullSafe(norms["_doc_id"]) & (dots["tag"] == norms["_tag"]) & (dots["line"] == norms["_line"])
    scored = dots.join(norms, same).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= least)
    best = F.max(F.struct("score", (-F.col("line")).alias("line"), (-F.col("template")).alias("template"), "license"))
    return scored.groupBy("doc_id", "tag").agg(best.alias("b")).select(
        "doc_id", "tag", F.col("b.license").alias("own_license"), F.col("b.score").alias("own_score"),
        (-F.col("b.line")).alias("own_line"))


def directory(path: Column) -> Column:
    """Directory of a path, with a slash at its end; the root is the empty text."""
    return F.regexp_extract(path, r"(?s)^(.*/)?[^/]*$", 1)


def inherited(files: DataFrame) -> DataFrame:
    """(dir, inherited_license, inherited_from) of directories with a granting ancestor; `files` has path, dir, own_*."""
    grants = files.filter(F.col("path").rlike(LICENCE_FILE) & F.col("own_license").isNotNull()).groupBy(
        F.col("dir").alias("granting")).agg(F.max(F.struct("own_score", "own_license")).alias("g"))
    steps = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.when(n == 0, "").otherwise(
        F.concat(F.array_join(F.slice(steps, F.lit(1), n), "/"), F.lit("/"))))
    dirs = files.filter("dir is not null").select("dir").distinct().select("dir", F.explode(ancestors).alias("granting"))
    nearest = F.max_by(F.struct("granting", "g"), F.length("granting"))
    return dirs.join(grants, "granting").groupBy("dir").agg(nearest.alias("n")).select(
        "dir", F.col("n.g.own_license").alias("inherited_license"), F.col("n.granting").alias("inherited_from"))


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, path, own_license, own_score, own_line, license and inherited_from of every file; `files` has doc_id, path, text."""
    files = files.select("doc_id", "path", "text", F.hash("text").alias("tag"))
    own = own_licences(files, least)
    files = join_rows(files.select("doc_id", "tag", "path", directory(F.col("path")).alias("dir")), own)
    files = materialise(files)
    granted = inherited(files)
    found = files.join(granted, "dir", "left")
    lacks = F.col("own_license").isNull()
    return found.select("doc_id", "path", "own_license", "own_score", "own_line",
                        F.coalesce("own_license", "inherited_license").alias("license"),
                        F.when(lacks, F.col("inherited_from")).alias("inherited_from"))
