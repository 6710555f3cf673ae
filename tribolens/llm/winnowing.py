"""Operator 8: benchmark decontamination by winnowing, on built-in expressions only.

Both sides are cut into words (runs of letters A-Z after folding, digits and non-ASCII characters). The fingerprints of a text are
the least k-gram hashes of every w consecutive k-grams, with w = window - k + 1: any shared run of `window` words holds w
consecutive k-grams, whose least is chosen on both sides, so every such run shares a fingerprint. An item shorter than
`window` words is one window of m words; for each such m that occurs, winnowing runs with k = m and w = 1.

Document fingerprints meet those of the items in a join. Each hit is extended to the windows that contain its k-gram, and these
are compared word by word with the items' windows. The words of equal windows are hit. Rows exist per fingerprint and per
window near a hit; no pair of a document and an item is formed without a common fingerprint. The item side is written
once and broadcast only if its row count is under a bound; otherwise the same joins shuffle.

Defined results: null or empty text has no words. Items without words, and items with a null id, match nothing. Repeated items
count by distinct id. Rows with one document id and different texts are judged each by itself; a null id is an id like
any other; repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tribolens.llm.columns import join_rows, let, small_side
from tribolens.plans.storage import materialise

WINDOW, GRAM = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text; only A-Z are folded, which `lower` does alone on ASCII texts and would not on others."""
    folded = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(folded, F.lit("")), BREAKS), lambda w: w != "")


def gram_hashes(words_: Column, k: int) -> Column:
    """Hash of every k consecutive words; none if there are fewer."""
    return F.when(F.size(words_) >= k, let(F.transform(words_, lambda w: F.xxhash64(w)), lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))))


def fingerprints(words_: Column, k: int, w: int) -> Column:
    """Distinct least hashes of every w consecutive k-grams; null for fewer than k + w - 1 words."""
    if w == 1:
        return F.array_distinct(gram_hashes(words_, k))
    return F.when(F.size(words_) >= k + w - 1, let(gram_hashes(words_, k), lambda g: F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size(g) - w), lambda i: F.least(*(F.get(g, i + j) for j in range(w)))))))


def windows_near(words_: Column, prints: Column, k: int, window: int) -> Column:
    """(start, text) of the windows that contain a k-gram whose hash is among `prints`."""
    def around(g: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda p: F.array_contains(prints, F.get(g, p)))
        return F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(
            F.greatest(p - (window - k), F.lit(0)), F.least(p, F.size(words_) - window)))))

    return F.when(F.size(words_) >= window, F.transform(let(gram_hashes(words_, k), around), lambda s: F.struct(
        s.alias("start"), F.array_join(F.slice(words_, s + 1, window), " ").alias("window"))))


def matches(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, tag, start, item_id) of windows of `window` words that `items(item_id, words)` and documents share.

    `docs` has doc_id, tag and text; the items are windows of this size or longer.
    """
    w = window - gram + 1
    item_prints = small_side(materialise(items.select(F.explode(fingerprints(F.col("words"), gram, w)).alias("print"))
                                         .distinct()))
    item_windows = small_side(materialise(items.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - window + 1),
        lambda i: F.array_join(F.slice(F.col("words"), i, window), " "))).alias("window")).distinct()))
    prints = docs.select("doc_id", "tag", F.explode(let(words(F.col("text")), lambda ws: fingerprints(ws, gram, w)))
                         .alias("print"))
    met = small_side(materialise(prints.join(item_prints, "print").groupBy("doc_id", "tag").agg(
        F.collect_set("print").alias("prints"))))
    near = join_rows(docs, met, "inner").select("doc_id", "tag", F.explode(let(
        words(F.col("text")), lambda ws: windows_near(ws, F.col("prints"), gram, window))).alias("x"))
    return near.select("doc_id", "tag", F.col("x.start").alias("start"), F.col("x.window").alias("window")).join(
        item_windows, "window").select("doc_id", "tag", "start", F.lit(window).alias("size"), "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), spans (start, size) of shared windows, per document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.hash("text").alias("tag"))
    items = materialise(benchmark.filter("item_id is not null").select(
        "item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct())
    short = items.filter(F.size("words") < window)
    sizes = [row[0] for row in short.select(F.size("words")).distinct().collect()]
    found = matches(docs, items.filter(F.size("words") >= window), window, gram)
    for size in sorted(sizes):
        found = found.unionByName(matches(docs, short.filter(F.size("words") == size), size, size))
    spans = found.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "size")).alias("spans"),
                                               F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))))
    sizes = docs.select("doc_id", "tag", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return join_rows(sizes, spans).select(
        "doc_id", "tag", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"), "spans")
