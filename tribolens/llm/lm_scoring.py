"""Operator 9: cross-entropy difference of a target and a background bigram model over all words of the corpus.

Both models read the same vocabulary (every word of every document), order and smoothing. Target counts come from the
documents rated good (quality without toxicity), background counts from all documents, scaled to the target's size, so that
the smoothing weighs the same in both: P(b | a) = (n(a,b) + MASS p(b)) / (n(a) + MASS). No count is capped and no word left out.
Only the prior p has classes: the WORDS most frequent words are cells of their own, every other word is in one of CLASSES
cells by length and ending; a cell has (n(cell) + 1) / (n + SIZE), and a word of a class its share (n(word) + 1) / (n(cell) +
words of the cell). The score of a document is the mean over its tokens of the target loss minus the background loss in bits;
the lower, the closer to the target.

Documents are dealt with the target ids into blocks of about BLOCK_BYTES by a hash of the id. A block sends each of its
distinct words and bigrams once, with its counts, to the bucket of its 64-bit hash; the bucket adds up all blocks and answers each
in the order of its question. So a frequent bigram is as many entries as there are blocks, not as there are documents. Blocks
and buckets grow in number with the text, not in size; the driver sees the counts of the cells only.

Defined results: null or empty text has no tokens, and its losses are null. Without target documents, the target model is
its prior without counts. A null label counts as 0; labels of null ids or of unknown documents are ignored; repeated labels of one
id must all be good. Every row is scored, repeated or with null id as well; rows with one id are in one block, rows with a null
id are dealt by their text. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribolens.llm.words import Words, chunks, mix, split, word_hashes
from tribolens.plans.storage import materialise

WORDS, CLASSES = 768, 256
SIZE = WORDS + CLASSES + 1
START = SIZE - 1
MASS = 50.0
BLOCK_BYTES = 4 << 20
PAIR, WORD, TOTAL = 0, 1, 2
_BEGIN, _END, _ODD = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(word_hashes(split(part.column("text"), True)), return_counts=True) for part in chunks(batch)]
            if found:
                hashes, place = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                times = np.bincount(place, np.concatenate([n for _, n in found]), len(hashes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(times)], names=["word", "times"])

    return docs.select("text").mapInArrow(count, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))


def vocabulary(docs: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words, sorted."""
    rows = word_counts(docs).orderBy(F.desc("times"), "word").limit(WORDS).collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def token_classes(words: Words) -> np.ndarray:
    ending = word_hashes(words._replace(starts=np.maximum(words.starts, words.ends - 2)))
    size = np.minimum((words.ends - words.starts) // 3, 7).astype(np.uint64)
    return WORDS + (mix(ending + size) % np.uint64(CLASSES)).astype(np.int64)


def token_numbers(words: Words, known: np.ndarray) -> np.ndarray:
    """Cell of every token in the prior."""
    return cells(word_hashes(words), token_classes(words), known)


def cells(hashes: np.ndarray, classes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if len(known) and len(hashes):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, at, classes)
    return classes


class Grams(NamedTuple):
    """Distinct words and bigrams of a block, each ordered by hash, and which of them every token is.

    A text's first word follows BEGIN (index len(words)); its last is followed by END, and so is BEGIN once in each text with words.
    `bigram` has all tokens, then the last words, then BEGIN of these texts.
    """

    words: np.ndarray
    classes: np.ndarray
    word: np.ndarray
    pairs: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bigram: np.ndarray
    bounds: np.ndarray
    filled: np.ndarray


def grams(texts: pa.Array) -> Grams:
    split_ = split(texts, True)
    found, first, word = np.unique(word_hashes(split_), return_index=True, return_inverse=True)
    classes = token_classes(split_)[first]
    bounds, n = split_.bounds, len(found)
    filled = np.flatnonzero(np.diff(bounds) > 0)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[bounds[filled]] = n
    sides = [np.concatenate([before, word[bounds[filled + 1] - 1], np.full(len(filled), n)]),
             np.concatenate([word, np.full(2 * len(filled), n)])]
    codes, bigram = np.unique(sides[0] * (n + 1) + sides[1], return_inverse=True)
    a, b = codes // (n + 1), codes % (n + 1)
    hashes = mix(np.append(found, _BEGIN)[a] * _ODD + np.append(found, _END)[b])
    order = np.argsort(hashes)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return Grams(found, classes, word, hashes[order], a[order], b[order], place[bigram], bounds, filled)


def packed(numbers: np.ndarray) -> bytes:
    """Bytes by their place in the number, so that compression sees the empty ones side by side."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def target_rows(part: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Documents of a block in a fixed order, and which of them are targets."""
    rated = part.column("rated").to_numpy(zero_copy_only=False)
    good, docs = part.filter(pa.array(rated)).column("doc_id"), part.filter(pa.array(~rated))
    docs = docs.sort_by([("doc_id", "ascending")]).combine_chunks()
    return docs, pc.is_in(docs.column("doc_id"), good.combine_chunks()).to_numpy(zero_copy_only=False) & pc.is_valid(
        docs.column("doc_id")).to_numpy(zero_copy_only=False)


def texts_of(docs: pa.Table) -> pa.Array:
    return pa.concat_arrays(docs.column("text").chunks) if docs.num_rows else pa.array([], pa.string())


QUESTION = "bucket long, block long, kind int, keys binary, near binary, total binary, classes binary"
ANSWER = "block long, kind int, bucket long, near binary, total binary, word long, class int, n_near long, n_total long"
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def arrow_rows(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(list(c), KINDS[k]) for c, k in zip(columns, kinds)], names=list(names))


def questions(part: pa.Table, bits: int) -> pa.Table:
    """Distinct words and bigrams of a block with their counts, by bucket."""
    docs, target = target_rows(part)
    g = grams(texts_of(docs))
    near = np.repeat(target, np.diff(g.bounds))
    block, rows = part.column("block")[0].as_py(), []
    pair_near = np.concatenate([near, target[g.filled], target[g.filled]])
    for kind, keys, of, good in ((PAIR, g.pairs, g.bigram, pair_near), (WORD, g.words, g.word, near)):
        counts = [np.bincount(x, minlength=len(keys)) for x in (of[good], of)]
        ends = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        for bucket, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if a < b:
                classes = g.classes[a:b].astype("<i2").tobytes() if kind == WORD else None
                rows.append((bucket, block, kind, packed(np.diff(keys[a:b], prepend=np.uint64(0))),
                             *(packed(c[a:b]) for c in counts), classes))
    return arrow_rows(rows, QUESTION)


def answers(part: pa.Table) -> pa.Table:
    """Counts over all blocks for each question of a bucket, and every word of the bucket once."""
    bucket, result = part.column("bucket")[0].as_py(), []
    for kind in (PAIR, WORD):
        asked = part.filter(pc.equal(part.column("kind"), kind))
        if not asked.num_rows:
            continue
        blobs = [asked.column(c).to_pylist() for c in ("keys", "near", "total")]
        keys = [np.cumsum(unpacked(x), dtype=np.uint64) for x in blobs[0]]
        found, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        near, total = (np.bincount(place, np.concatenate([unpacked(x) for x in c]), len(found)).astype(np.int64) for c in blobs[1:])
        at = 0
        rows = []
        for block, own in zip(asked.column("block").to_pylist(), keys):
            mine = place[at : at + len(own)]
            at += len(own)
            rows.append((block, kind, bucket, packed(near[mine]), packed(total[mine]), None, None, None, None))
        result.append(arrow_rows(rows, ANSWER))
        if kind == WORD:
            classes = np.concatenate([np.frombuffer(x, "<i2") for x in asked.column("classes").to_pylist()])[first]
            n = len(found)
            columns = [pa.nulls(n, pa.int64()), pa.array(np.full(n, TOTAL, np.int32)), pa.nulls(n, pa.int64()),
                       pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(found.view(np.int64)),
                       pa.array(classes.astype(np.int32)), pa.array(near), pa.array(total)]
            result.append(pa.table(columns, names=result[0].column_names))
    return pa.concat_tables(result)


class Prior(NamedTuple):
    """Most frequent words (sorted hashes), and per cell its target count, count in all documents, and number of words."""

    known: np.ndarray
    near: np.ndarray
    total: np.ndarray
    words: np.ndarray

    def scale(self) -> float:
        """What a count in all documents weighs."""
        return max(self.near.sum(), 1.0) / max(self.total.sum(), 1.0)


def prior(words: DataFrame) -> Prior:
    """From (word, class, n_near, n_total) of all words."""
    top = sorted(words.orderBy(F.desc("n_total"), "word").limit(WORDS).collect(), key=lambda r: r["word"] % (1 << 64))
    near, total, size = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE)
    for r in words.groupBy("class").agg(F.sum("n_near"), F.sum("n_total"), F.count("*")).collect():
        near[r[0]], total[r[0]], size[r[0]] = r[1], r[2], r[3]
    for i, r in enumerate(top):
        near[r["class"]] -= r["n_near"]
        total[r["class"]] -= r["n_total"]
        size[r["class"]] -= 1
        near[i], total[i], size[i] = r["n_near"], r["n_total"], 1
    return Prior(np.array([r["word"] for r in top], np.int64).view(np.uint64), near, total, size)


def losses(g: Grams, pair: np.ndarray, word: np.ndarray, of_cell: np.ndarray, size: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Bits of every bigram of a block, from the counts of its bigrams, its words and the cells."""
    share = np.where(cell < WORDS, 1.0, (word + 1) / (of_cell[cell] + size[cell]))
    p = (of_cell[cell] + 1) / (of_cell.sum() + SIZE) * share
    last = g.after == len(g.words)
    context = np.append(word, 0.0)
    context[g.before[last]] -= pair[last]
    context[-1] = -context[-1]
    inner = np.flatnonzero(~last)
    result = np.zeros(len(pair))
    result[inner] = -np.log2((pair[inner] + MASS * p[g.after[inner]]) / (context[g.before[inner]] + MASS))
    return result


SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"


def rated(part: pa.Table, replies: pa.Table, of: Prior) -> pa.Table:
    """Scores of the documents of a block."""
    docs, _ = target_rows(part)
    g = grams(texts_of(docs))
    replies = replies.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    counts = {}
    for kind, keys in ((PAIR, g.pairs), (WORD, g.words)):
        own = replies.filter(pc.equal(replies.column("kind"), kind))
        for name in ("near", "total"):
            parts = [unpacked(x) for x in own.column(name).to_pylist()]
            counts[kind, name] = np.concatenate(parts).astype(float) if parts else np.empty(0)
            if len(counts[kind, name]) != len(keys):
                raise RuntimeError("a block has other words than it asked for")
    cell = cells(g.words, g.classes, of.known)
    n, means = np.diff(g.bounds), []
    for name, by in (("near", 1.0), ("total", of.scale())):
        bits = losses(g, counts[PAIR, name] * by, counts[WORD, name] * by, getattr(of, name) * by, of.words, cell)
        total = np.concatenate([[0.0], np.cumsum(bits[g.bigram[: len(g.word)]])])
        means.append((total[g.bounds[1:]] - total[g.bounds[:-1]]) / np.maximum(n, 1))
    means.append(means[0] - means[1])
    return pa.table([docs.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array(m, mask=n == 0) for m in means)],
                    names=[c.split(" ")[0] for c in SCORES.split(", ")])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and difference (bits per token) of every document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bad = F.max(F.when((F.coalesce("quality", F.lit(0)) > 0) & (F.coalesce("toxic", F.lit(0)) == 0), 0).otherwise(1))
    good = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        bad.alias("bad")).filter("bad = 0").select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("rated"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    bits = max(1, math.ceil(math.log2(blocks)))
    dealt = docs.withColumn("rated", F.lit(False)).unionByName(good).withColumn(
        "block", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(blocks)))
    dealt = dealt.select("block", "doc_id", "text", "rated")
    asked = dealt.groupBy("block").applyInArrow(lambda part: questions(part, bits), QUESTION)
    replies = materialise(asked.groupBy("bucket").applyInArrow(answers, ANSWER))
    of = prior(replies.filter(F.col("kind") == TOTAL).select("word", "class", "n_near", "n_total"))
    own = replies.filter(F.col("kind") != TOTAL).select("block", "kind", "bucket", "near", "total")
    return dealt.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(lambda part, answer: rated(part, answer, of), SCORES)
