"""Operator 12: what each of five filters removes, in every order of the filters.

A  fewer than 200 words                       D  holds any of # $ % & * |
B  fewer than half of the words are distinct  E  the same text as a document with a smaller id
C  more than 3 % capital letters A-Z

Copies (E) are found in radix tries over whole texts:

* Texts are range-partitioned by prefixes. A prefix of four characters whose texts are too many for one task is replaced by prefixes four
  times as long, and so on; every length is one count over all texts, combined before the shuffle. What is still too large when
  the prefix is the whole text is one text, and its rows are shared by several tasks.
* A task inserts its texts into a compressed trie (edges hold byte strings) whose terminals keep the least id, and reads from the
  terminal of each row whether its id is larger. This is done before the shuffle, where conditions A to D are counted too, so a group of
  copies sends one text per task; then in each range; and for shared texts once more.

Each document becomes a mask of its failed filters. Masks are counted per part, and the 600 steps of all orders are sums over at most
32 mask counts of a part.

Defined results: a null text is empty (it fails A), a null language is the part ''. A row with a null id is no copy and makes no copies; rows
with one id and text are not copies of each other. Of several labels of one id the best quality and the worst toxicity count. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribolens.llm.columns import small_side
from tribolens.llm.words import chunks, split, text_bytes, word_hashes
from tribolens.plans.scans import ranged_totals
from tribolens.plans.storage import materialise

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, SIGNS = 200, 50, 3, b"#$%&*|"
FIRST_PREFIX, LONGER = 4, 4
# Memory of one task's trie: texts and about ROW_BYTES for the nodes and flags of a row.
TASK_BYTES, ROW_BYTES = 32 << 20, 400


class Node:
    __slots__ = ("label", "children", "least")

    def __init__(self, label: bytes):
        self.label, self.children, self.least = label, {}, None


def shared_length(x: bytes, y: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class TextTrie:
    """Compressed trie of byte strings; the end of each inserted text keeps the least id."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, text: bytes, number: int) -> Node:
        node, place = self.root, 0
        while place < len(text):
            child = node.children.get(text[place])
            if child is None:
                node.children[text[place]] = child = Node(text[place:])
            elif not text.startswith(child.label, place):
                common = shared_length(child.label, text[place : place + len(child.label)])
                fork = Node(child.label[:common])
                child.label = child.label[common:]
                fork.children[child.label[0]] = child
                node.children[text[place]] = child = fork
            place += len(child.label)
            node = child
        if node.least is None or number < node.least:
            node.least = number
        return node


def mask_of(texts: pa.Array) -> np.ndarray:
    """Failed filters of each text, A to D, as bits."""
    words = split(texts, lower=False)
    hashes, n = word_hashes(words), np.diff(words.bounds)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(words.bounds[:-1], words.bounds[1:])], np.int64)
    data, places = text_bytes(texts)

    def count(found: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(found)])[places])

    capitals, points = count((data >= 65) & (data <= 90)), count((data & 0xC0) != 0x80)
    signs = count(np.isin(data, np.frombuffer(SIGNS, np.uint8)))
    return ((n < LEAST_WORDS) * 1 + (100 * distinct < LEAST_DISTINCT_PERCENT * n) * 2
            + (100 * capitals > MOST_CAPITALS_PERCENT * points) * 4 + (signs > 0) * 8)


class Ranges(NamedTuple):
    """First texts of all ranges but the first, and how many tasks share the rows of a text that is too large for one (few)."""

    bounds: list[bytes]
    shared: dict[bytes, int]

    def of(self, text: bytes) -> int:
        return bisect_right(self.bounds, text)


def ranges(texts: DataFrame, task_bytes: int) -> Ranges:
    """Text ranges of about `task_bytes`, bounded by prefixes that are as long as needed.

    Prefixes whose texts fit one task are added up in text order and cut; the driver gets one bound a task. A text lies in the range of its
    prefix, as no other prefix that was kept begins with it.
    """
    rest, length, leaves, shared = texts, FIRST_PREFIX, None, {}
    while True:
        sizes = materialise(rest.groupBy(F.substring("text", 1, length).alias("prefix")).agg(
            F.sum(F.octet_length("text") + ROW_BYTES).alias("bytes"), F.max(F.length("text")).alias("longest")))
        heavy, whole = F.col("bytes") > task_bytes, F.col("longest") <= length
        for row in sizes.filter(heavy & whole).toLocalIterator():
            shared[row["prefix"].encode()] = -(-row["bytes"] // task_bytes)
        done = sizes.filter(~heavy | whole).select("prefix", F.least("bytes", F.lit(task_bytes)).alias("bytes"))
        leaves = done if leaves is None else leaves.unionByName(done)
        longer = sizes.filter(heavy & ~whole).select("prefix")
        if longer.isEmpty():
            break
        rest = rest.join(small_side(longer), F.substring("text", 1, length) == F.col("prefix"), "left_semi")
        length *= LONGER
    upto = ranged_totals(leaves, [], "prefix", {"upto": ("sum", F.col("bytes"))})
    bounds = upto.groupBy(F.floor((F.col("upto") - 1) / task_bytes).alias("range")).agg(F.min("prefix").alias("first")).select("first").collect()
    return Ranges(sorted(r["first"].encode() for r in bounds)[1:], shared)


ROWS = "doc_id long, part string, mask int, text string, range int, open boolean"


def through_trie(cut: Ranges, task_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Flags copies among the rows of a task and drops their texts; rows whose least id may be elsewhere keep the text (`open`).

    Rows without a text pass. Masks that are null are counted. A trie of more than `task_bytes` is worked off and begun anew: the next step
    brings the rest together.
    """

    def finished(rows: list[pa.RecordBatch], ends: list[Node | None]) -> Iterator[pa.RecordBatch]:
        at = 0
        for part in rows:
            ids, own = part.column("doc_id").to_pylist(), ends[at : at + part.num_rows]
            at += part.num_rows
            copies = np.array([end is not None and i > end.least for end, i in zip(own, ids)], bool)
            left = [None if c else t for c, t in zip(copies.tolist(), part.column("text").to_pylist())]
            masks = part.column("mask").to_numpy() | (copies.astype(np.int32) << 4)
            table = {name: part.column(name) for name in part.schema.names}
            table |= {"mask": pa.array(masks, pa.int32()), "text": pa.array(left, pa.string())}
            yield pa.RecordBatch.from_pydict(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, ends, rows, size = TextTrie(), [], [], 0
        for batch in batches:
            for part in chunks(batch):
                texts, ids = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
                raw = [None if t is None else t.encode() for t in texts]
                ends += [None if i is None or t is None else trie.insert(t, i) for t, i in zip(raw, ids)]
                first = part.column("mask").null_count > 0
                table = {"doc_id": part.column("doc_id"), "part": part.column("part"), "mask": part.column("mask")}
                if first:
                    table["mask"] = pa.array(mask_of(part.column("text")).astype(np.int32))
                    # A null id is compared with nothing.
                    raw = [None if i is None else t for t, i in zip(raw, ids)]
                    share = np.array([cut.shared.get(t, 1) if cut.shared and t is not None else 1 for t in raw])
                    place = np.array([0 if t is None else cut.of(t) for t in raw])
                    salt = np.array([hash(i) for i in ids]) % share
                    table["text"] = pa.array([t if i is not None else None for t, i in zip(texts, ids)], pa.string())
                    table["range"] = pa.array((place + salt) % (len(cut.bounds) + 1), pa.int32())
                    table["open"] = pa.array(share > 1)
                else:
                    table["text"] = pa.array([t if o else None for t, o in zip(texts, part.column("open").to_pylist())], pa.string())
                    table |= {"range": part.column("range"), "open": part.column("open")}
                rows.append(pa.RecordBatch.from_pydict(table))
                size += sum(len(t) for t in texts if t is not None) + ROW_BYTES * part.num_rows
                if first and size > task_bytes:
                    yield from finished(rows, ends)
                    trie, ends, rows, size = TextTrie(), [], [], 0
        yield from finished(rows, ends)

    return run


def failed_filters(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """doc_id, part (language) and mask of failed filters, bit 0 for A, of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(None).cast("int").alias("mask"))
    cut = ranges(rows.select("text"), task_bytes)
    step = through_trie(cut, task_bytes)
    combined = rows.mapInArrow(step, ROWS)
    ranged = materialise(combined.repartitionById(len(cut.bounds) + 1, "range").mapInArrow(step, ROWS))
    columns = ["doc_id", "part", "mask"]
    if not cut.shared:
        return ranged.select(*columns)
    # Of a text that many tasks share, one row of each task is left.
    last = ranged.filter("text is not null").withColumn("open", F.lit(False)).repartition(F.xxhash64("text")).mapInArrow(step, ROWS)
    return ranged.filter("text is null").select(*columns).unionByName(last.select(*columns))


def steps() -> list[tuple]:
    """(mask, order, step, filter, kept, removed, redundant, unique) for all orders and masks."""
    result = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            for mask in range(1 << len(FILTERS)):
                fails, gone = bool(mask & bit), bool(mask & before)
                result.append((mask, "".join(order), step, name, int(not (fails or gone)), int(fails and not gone),
                               int(fails and gone), int(mask == bit)))
            before |= bit
    return result


STEPS = "mask int, filter_order string, step int, filter string, is_kept int, is_removed int, is_redundant int, is_unique int"


def audit(docs: DataFrame, labels: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Per part, order and step: documents kept, removed, redundant, failing only this filter; good and toxic lost; Shapley sum."""
    spark = docs.sparkSession
    masks = materialise(failed_filters(docs, task_bytes))
    rated = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    lost = masks.join(rated, "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n")).join(lost, ["part", "mask"], "left").fillna(0)
    per_step = counts.join(F.broadcast(spark.createDataFrame(steps(), STEPS)), "mask").groupBy(
        "part", "filter_order", "step", "filter").agg(
        *(F.sum(F.col("n") * F.col(f"is_{name}")).alias(name) for name in ("kept", "removed", "redundant")),
        F.sum(F.col("n") * F.col("is_unique")).alias("unique_fails"),
        F.sum(F.col("good") * F.col("is_removed")).alias("good_lost"),
        F.sum(F.col("toxic") * F.col("is_removed")).alias("toxic_lost"))
    shares = per_step.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return per_step.join(shares, ["part", "filter"]).drop("filter")
