"""Operator 10: packing of token sequences by lexical retrieval.

Documents are tokenized once into a written table, then dealt out by ranges of (lexical key, id): the key, a least hash over
neighbouring ids, puts copies and near copies side by side, and the id splits any number of equal keys. Within a partition,
consecutive documents form shards of bounded size, each with a BM25 inverted index of its documents. Whole windows of a
long document are sequences of their own; what remains of it is an item. The longest unused item of the shard is the seed:
it is searched in the index by all its terms but the end id, and unused items fill its window from the best match down, however many it takes; the
last is cut where the window ends, and its rest stays in the index. Items without a common term follow, longest first. What a shard cannot fill goes on into the next; the end of a partition is cut into
sequences whose lengths are powers of two, which need no padding. So nothing is padded, whatever the input.

Defined results: null text is empty and has only the end id. Rows with one id or a null id are packed each by itself; repeated
rows are packed repeatedly. An empty table gives no sequence. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tribolens.llm.token_store import tokenised, unpacked
from tribolens.llm.tokens import END

WINDOW = 2048
SHARD_DOCS, SHARD_TOKENS = 2000, 2_000_000
K1, B = 1.2, 0.75


class Item:
    """What is left of a document: `ids[start:]`."""

    __slots__ = ("doc_id", "ids", "start")

    def __init__(self, doc_id: int | None, ids: np.ndarray, start: int = 0):
        self.doc_id, self.ids, self.start = doc_id, ids, start

    def __len__(self) -> int:
        return len(self.ids) - self.start

    def terms(self) -> np.ndarray:
        """What is left without the end id, which every document has and which says nothing about it."""
        left = self.ids[self.start :]
        return left[:-1] if len(left) and left[-1] == END else left

    def take(self, n: int) -> tuple[Item, int, int]:
        piece = (self, self.start, n)
        self.start += n
        return piece


class Index:
    """BM25 postings of a shard's items, by term."""

    def __init__(self, items: list[Item]):
        self.n = self.held = len(items)
        bodies = [x.terms() for x in items]
        size = np.array([len(x) for x in bodies])
        owner = np.repeat(np.arange(self.n), size)
        terms = np.concatenate(bodies).astype(np.int64)
        pair, times = np.unique(terms * self.n + owner, return_counts=True)
        term, self.item = pair // self.n, pair % self.n
        self.head = np.r_[np.flatnonzero(np.r_[True, term[1:] != term[:-1]]), len(pair)]
        df = np.diff(self.head)
        idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(size.mean(), 1.0))
        self.weight = np.repeat(idf, df) * times * (K1 + 1) / (times + norm[self.item])
        order = np.argsort(self.item, kind="stable")
        number = np.repeat(np.arange(len(df)), df)[order]
        self.of_item = np.split(number, np.cumsum(np.bincount(self.item, minlength=self.n))[:-1])

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """All unused items that share a term with the seed, best first."""
        if 2 * unused.sum() < self.held:
            self.held = int(unused.sum())
            keep = unused[self.item]
            self.head = np.r_[0, np.cumsum(keep)][self.head]
            self.item, self.weight = self.item[keep], self.weight[keep]
        own = self.of_item[seed]
        if not len(own):
            return np.empty(0, np.int64)
        parts = [slice(a, b) for a, b in zip(self.head[own].tolist(), self.head[own + 1].tolist())]
        score = np.bincount(np.concatenate([self.item[x] for x in parts]), np.concatenate([self.weight[x] for x in parts]),
                            self.n) * unused
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack(items: list[Item], window: int) -> tuple[list[list[tuple[Item, int, int]]], list[Item]]:
    """Full sequences of pieces, and the items too short to fill one more."""
    sequences = []
    for item in items:
        while len(item) >= window:
            sequences.append([item.take(window)])
    items = [x for x in items if len(x)]
    left = sum(map(len, items))
    if left < window:
        return sequences, items
    index = Index(items)
    unused = np.ones(len(items), bool)
    order = sorted(range(len(items)), key=lambda i: -len(items[i]))
    at = 0
    while left >= window:
        while not unused[order[at]]:
            at += 1
        seed = order[at]
        unused[seed] = False
        pieces, room = [items[seed].take(len(items[seed]))], window
        room -= pieces[0][2]
        best = index.neighbours(seed, unused).tolist() if room else []
        for i in chain(best, (i for i in order[at:] if unused[i])):
            if not room:
                break
            pieces.append(items[i].take(min(room, len(items[i]))))
            room -= pieces[-1][2]
            unused[i] = len(items[i]) > 0
        sequences.append(pieces)
        left -= window
    return sequences, [x for x, u in zip(items, unused) if u]


def last_pieces(items: list[Item]) -> list[list[tuple[Item, int, int]]]:
    """Sequences of falling power-of-two lengths over all that is left."""
    left, sequences = sum(map(len, items)), []
    queue = iter(items)
    item = next(queue, None)
    while left:
        room, pieces = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            if not len(item):
                item = next(queue)
                continue
            pieces.append(item.take(min(room, len(item))))
            room -= pieces[-1][2]
        sequences.append(pieces)
    return sequences


def packed_sequences(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces: doc_id, start and ids (little-endian unsigned 32-bit) of each, size of its document, sequence and offset there."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        items: list[Item] = []
        tokens = 0

        def rows(sequences: list[list[tuple[Item, int, int]]]) -> pa.RecordBatch:
            nonlocal number
            columns: list[list] = [[] for _ in range(6)]
            for pieces in sequences:
                offset = 0
                for item, start, n in pieces:
                    row = (item.doc_id, start, item.ids[start : start + n].tobytes(), len(item.ids), number, offset)
                    for column, value in zip(columns, row):
                        column.append(value)
                    offset += n
                number += 1
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[
                "doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc_id, n, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids"))):
                items.append(Item(doc_id, unpacked(blob, n)))
                tokens += n
                if len(items) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                    sequences, items = pack(items, window)
                    tokens = sum(map(len, items))
                    yield rows(sequences)
        sequences, items = pack(items, window)
        yield rows(sequences + last_pieces(items))

    tokens = tokenised(docs, tokenizer)
    dealt = tokens.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "n_tokens", "ids")
    return dealt.select("doc_id", "n_tokens", "ids").mapInArrow(
        fill, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")
