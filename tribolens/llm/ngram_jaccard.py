"""Operator 1: documents whose sets of word n-grams have a Jaccard similarity at or above a threshold.

Sets are compared by their 64-bit n-gram hashes. Every filter below is exact: it never loses a pair at the threshold.

* Equal sets are one class, found by a 128-bit key with map-side combining; only its first document goes on.
* Rare-first prefixes: n-grams are ordered by an estimate of their document frequency (a merged sketch of all texts; any order
  common to all sets is right, a better estimate only makes fewer candidates) and then by hash. Two similar sets share an
  n-gram within their first n - ceil(t n) + 1. A second sketch keeps prefix n-grams estimated in two or more documents.
* Pairs of one bucket (documents with a common prefix n-gram) pass the length filter, the positional filter (what may
  still follow the shared n-gram) and the suffix filter, which bounds the overlap by the smaller count in each of 64
  slices of the hash range, before texts are fetched; then each pair is verified once.
* No bucket is expanded into all its pairs. First every document is verified against the leaders of the buckets it shares most
  often; links join documents into components. What is left to test are pairs of one bucket in different components:
  members outside a bucket's largest component against all its members. A group of copies is mostly one component by then.
  Links inside a component cannot change the result and are not tested.

Defined results: null or empty text, or text without words, is an empty set, linked with nothing. A text of fewer than k words is
one n-gram. A null id gets a null component. Rows that share an id share what
any of their texts is linked to. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tribolens.llm import sketch
from tribolens.llm.components import components
from tribolens.llm.words import chunks, mix, shingles
from tribolens.plans.storage import materialise

WORDS, PERCENT = 4, 85
LEADERS = 2
CELLS = 64
ORDER_WIDTH = 1 << 21
SHARED_WIDTHS, SHARED_DEPTH, BYTES_PER_PREFIX = (1 << 14, 1 << 25), 3, 40
# A pair table up to this many rows of 16 bytes is broadcast; a larger one is joined by shuffles.
BROADCAST_PAIRS = 200_000


def prefix_of(grams: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    """The rarest n - ceil(t n) + 1 n-grams, rarest first."""
    n = len(grams)
    if not n:
        return grams
    rank = order[(grams & np.uint64(len(order) - 1)).astype(np.int64)]
    return grams[np.lexsort((grams, rank))[: n - (percent * n + 99) // 100 + 1]]


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row: set size, key of the set, possibly shared prefix n-grams with places, slice counts if any is shared."""
    context = docs.sparkSession.sparkContext

    def grams(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in chunks(batch):
            yield np.concatenate(shingles(part.column("text"), k) or [np.empty(0, np.uint64)])

    order = context.broadcast(sketch.build(docs, grams, ORDER_WIDTH, 1, 65535, lambda c: c.tobytes(), np.uint16))

    def prefixes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        ranks = np.frombuffer(order.value, np.uint16)
        for part in chunks(batch):
            yield np.concatenate([prefix_of(s, ranks, percent) for s in shingles(part.column("text"), k)]
                                 or [np.empty(0, np.uint64)])

    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    wanted = max(1, 2 * size // BYTES_PER_PREFIX)
    width = min(max(1 << (wanted - 1).bit_length(), SHARED_WIDTHS[0]), SHARED_WIDTHS[1])
    twice = context.broadcast(sketch.build(docs, prefixes, width, SHARED_DEPTH, 2, sketch.repeated_bits))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, bits = np.frombuffer(order.value, np.uint16), np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for found in shingles(part.column("text"), k):
                    prefix = prefix_of(found, ranks, percent)
                    place = np.flatnonzero(sketch.seen_twice(bits, prefix, width, SHARED_DEPTH))
                    cells = np.bincount((found >> np.uint64(58)).astype(np.int64), minlength=CELLS)
                    rows.append((len(found), int(mix(found).sum().astype(np.int64)),
                                 int(mix(found ^ sketch.SALT).sum().astype(np.int64)), prefix[place].view(np.int64),
                                 place.astype(np.int32), cells.astype(np.int32) if len(place) else None))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds))],
                    names=["doc_id", "n", "key_a", "key_b", "grams", "places", "cells"])

    return docs.mapInArrow(sign, "doc_id long, n long, key_a long, key_b long, grams array<long>, places array<int>, "
                                 "cells array<int>")


def may_reach(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    return (100 + percent) * overlap >= percent * (n + m)


def similar_length(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def both_sides(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with `columns` of both documents; only rows of documents in a pair are shuffled while pairs are few."""
    if pairs.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    left, right = (pairs.join(sets.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)),
                              side) for side in ("a", "b"))
    return left.join(right, ["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that pass length and suffix filter and reach the threshold on their texts."""
    common = F.aggregate(F.zip_with("cells_a", "cells_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    kept = materialise(both_sides(pairs, sets, ["n", "cells"]).filter(
        similar_length(F.col("n_a"), F.col("n_b"), percent) & may_reach(common, F.col("n_a"), F.col("n_b"), percent))
        .select("a", "b"))
    both = both_sides(kept, texts, ["text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for row, (x, y) in enumerate(zip(shingles(part.column("text_a"), k),
                                                 shingles(part.column("text_b"), k))):
                    inner = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * inner >= percent * (len(x) + len(y) - inner):
                        keep.append(at + row)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def leader_pairs(shared: DataFrame) -> DataFrame:
    """Each document with the leaders of most of its buckets."""
    lead = shared.groupBy("gram").agg(F.min("doc_id").alias("leader"))
    counts = (shared.join(lead, "gram").filter("doc_id != leader").groupBy("doc_id", "leader")
              .agg(F.count("*").alias("times")))
    best = F.slice(F.sort_array(F.collect_list(F.struct("times", "leader")), asc=False), 1, LEADERS)
    return (counts.groupBy("doc_id").agg(best.alias("best")).select("doc_id", F.explode("best").alias("x"))
            .select(F.least("doc_id", "x.leader").alias("a"), F.greatest("doc_id", "x.leader").alias("b")).distinct())


def crossing_pairs(shared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket in different components that pass the length and the positional filter."""
    rows = (shared.join(labels, shared["doc_id"] == labels["node"], "left")
            .select("gram", "doc_id", "n", "place", F.coalesce("component", "doc_id").alias("component")))
    rows = materialise(rows)
    sizes = rows.groupBy("gram", "component").agg(F.count("*").alias("size"))
    main = (sizes.groupBy("gram").agg(F.max_by("component", "size").alias("main"), F.count("*").alias("parts"))
            .filter("parts > 1").select("gram", "main"))
    rows = rows.join(main, "gram")
    x, y = rows.filter("component != main").alias("x"), rows.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    rest = F.least(n - F.col("x.place"), m - F.col("y.place"))
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.doc_id") < F.col("y.doc_id"))
    pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") != F.col("y.component")) & once
                   & similar_length(n, m, percent) & may_reach(rest, n, m, percent))
    return pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def similar_groups(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the least id reachable by links, of every document."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = materialise(signatures(texts, k, percent))
    key = ["key_a", "key_b", "n"]
    known = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classes = signed.filter(known).groupBy(*key).agg(F.min("doc_id").alias("first"))
    member = signed.select("doc_id", *key).join(classes, key, "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(known, F.col("first")).otherwise(F.col("doc_id")).alias("first"))
    firsts = signed.filter(known & (F.size("grams") > 0)).select(*key, "doc_id", "grams", "places").join(
        classes, key).filter("doc_id = first")
    rows = firsts.select("doc_id", "n", F.explode(F.arrays_zip("grams", "places")).alias("x")).select(
        F.col("x.grams").alias("gram"), "doc_id", "n", F.col("x.places").alias("place"))
    common = rows.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = materialise(rows.join(common.filter("low < high").select("gram"), "gram"))
    sets = signed.filter("cells is not null").select("doc_id", "n", "cells")

    links = materialise(verified(materialise(leader_pairs(shared)), sets, texts, k, percent))
    labels = components(links)
    others = materialise(crossing_pairs(shared, labels, percent))
    links = links.unionByName(verified(others, sets, texts, k, percent))
    labels = components(links)
    return member.join(labels, member["first"] == labels["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id"))
