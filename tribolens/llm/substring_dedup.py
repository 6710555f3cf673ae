"""Operator 7: removal of repeated passages, with a count-min prefilter before the exact grouping of windows.

A passage is a window of `window` consecutive words. Two passes read the texts:

1. Every task counts, once per document, the *anchors* of its windows in a count-min sketch; the sketches are merged. The
   anchor of a window is the least hash among its inner sequences of half its length, so it depends on the window alone:
   a window that occurs in two documents brings its anchor into both, and neighbouring windows mostly share one, which
   keeps the sketch a dozen times smaller than one of all windows. The estimate of an anchor never lies below the number
   of documents that hold any of its windows.
2. Windows whose anchor is estimated in two or more documents, and no others, are grouped exactly by their 64-bit hash: the
   least document id of each group decides which occurrences go. A false estimate costs a row, never a result.

A window counts once per row, however often the row repeats it. Grouping combines map-side, and the join back splits hot
windows (AQE). Sketch width follows the text volume between fixed
bounds; past the upper bound more windows are grouped needlessly, with the same result.

Defined results: null or empty text has no words. A text below `window` words loses nothing. A null id is neither earlier nor
later than any document and loses nothing. Rows with one id and different texts are judged each by itself against smaller
ids; repeated rows give repeated results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribolens.llm import sketch
from tribolens.llm.words import chunks, sequence_hashes, split, text_bytes, word_hashes

WINDOW = 50
DEPTH = 4
WIDTHS = (1 << 14, 1 << 25)
# Bytes of text per anchor: about 6.5 a word, and two anchors for every 27 words at 50-word windows.
BYTES_PER_ANCHOR = 80


def sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    """Least of every n consecutive values."""
    span = 1
    while span * 2 <= n:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = n - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def windows(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, window hashes and anchors of each text that has a window."""
    inner = max(1, window // 2)
    words = split(batch.column("text"), lower=False)
    hashes = word_hashes(words)
    for row, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
        if b - a >= window:
            yield (row, sequence_hashes(hashes[a:b], window),
                   sliding_least(sequence_hashes(hashes[a:b], inner), window - inner + 1))


def sketch_width(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    wanted = max(1, 3 * size // (2 * BYTES_PER_ANCHOR))
    return min(max(1 << (wanted - 1).bit_length(), WIDTHS[0]), WIDTHS[1])


def candidate_windows(docs: DataFrame, window: int) -> DataFrame:
    """Distinct windows per row whose anchor the merged sketch puts into two or more documents: (hash, doc_id, tag)."""
    width = sketch_width(docs)

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in chunks(batch):
            found = [np.unique(least) for _, _, least in windows(part, window)]
            if found:
                yield np.concatenate(found)

    bits = docs.sparkSession.sparkContext.broadcast(
        sketch.build(docs, anchors, width, DEPTH, 2, sketch.repeated_bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for part in chunks(batch):
                ids, tags = part.column("doc_id").to_pylist(), part.column("tag").to_pylist()
                rows = []
                for row, hashes, least in windows(part, window):
                    heads = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
                    twice = sketch.seen_twice(table, least[heads], width, DEPTH)
                    found = np.unique(hashes[np.repeat(twice, np.diff(np.r_[heads, len(least)]))])
                    rows.append((found.view(np.int64), np.full(len(found), ids[row]),
                                 np.full(len(found), tags[row], np.int32)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)],
                                                     names=["hash", "doc_id", "tag"])

    return (docs.filter(F.col("doc_id").isNotNull())
            .mapInArrow(candidates, "hash long, doc_id long, tag int"))


def kept_words(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            data, places = text_bytes(part.column("text"))
            gone_of = part.column("gone")
            hashes_of = {row: hashes for row, hashes, _ in windows(part, window)} if gone_of.null_count < len(part) else {}
            sizes, removed, kept = [], [], []
            for row, gone in enumerate(gone_of):
                words = data[places[row] : places[row + 1]].tobytes().split()
                sizes.append(len(words))
                if gone.is_valid:
                    first = np.flatnonzero(np.isin(hashes_of[row], gone.values.to_numpy().view(np.uint64)))
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge[first] += 1
                    edge[first + window] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                removed.append(sizes[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept text (words joined by a space) of every document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.hash("text").alias("tag"))
    found = candidate_windows(docs, window)
    first = found.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    first = first.filter("first_id < last_id").select("hash", "first_id")
    gone = (found.join(first, "hash").filter("first_id < doc_id")
            .groupBy("doc_id", "tag").agg(F.collect_list("hash").alias("gone")))
    return docs.join(gone, ["doc_id", "tag"], "left").select("doc_id", "text", "gone").mapInArrow(
        lambda batches: kept_words(batches, window), "doc_id long, n_words long, n_removed long, kept string")
