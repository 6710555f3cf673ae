"""Operator 11: two tokenizations of each text laid side by side: overlapping tokens, groups, and how usual each pairing is.

Tokenizer A is a byte-level vocabulary of the tokenizers library, B a SentencePiece model (operator 13). Both cut a space and the text;
a token covers the bytes of its vocabulary entry.

Per batch, tokens of both sides stand in order of their place, keyed by document. `merge_asof` gives each token start the other side's
covering token; the union of both directions is all overlaps. Places where tokens of both sides end cut the document into groups.

How many documents hold an id pair linked is counted over the whole corpus. A block is the documents of about CHUNK_BYTES of text. Its
distinct pairs with their document counts and, per document, the list of its links as places in the block's pairs are written once.
Pair counts are a sum over all blocks; then each block asks for the counts of its distinct pairs by a join on the pair and meets its
documents again by its number. A pair stands once per block in these joins, so no pair is hot, and nothing is broadcast.

Defined results: a text that is null, empty, or that either tokenizer does not give back byte for byte has no tokens: zeros and an
empty digest. Each row is a document of its own, with repeated or null ids too. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribolens.llm.pieces import MARK, repeated, with_space
from tribolens.llm.tokens import LETTER_OF
from tribolens.llm.words import chunks, text_bytes
from tribolens.plans.storage import materialise

CHUNK_BYTES = 1 << 19
# Fixed value: how byte-level vocabularies cut a text before merging.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokens(NamedTuple):
    """Tokens of several texts, one behind the other: id, start and end in the joined bytes of these texts, number of the text."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray


class Entries:
    """Bytes of every entry of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries])
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def lengths(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bytes of each text, given its ids."""
        return np.diff(np.concatenate([[0], np.cumsum(self.size[ids])])[bounds])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return repeated(self.data, self.size, ids)[0]

    def laid_out(self, ids: np.ndarray, doc: np.ndarray) -> Tokens:
        ends = np.cumsum(self.size[ids])
        return Tokens(ids, ends - self.size[ids], ends, doc)


def byte_level(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """Encoder of a byte-level vocabulary file, and the bytes of its entries; names of special tokens in a text are plain text.

    Where the file is a plain byte-level vocabulary (ids in order of the merges, texts cut by the usual pattern), tiktoken works on the
    same entries, at a third of the time; any other file is left to the tokenizers library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.loads(Path(path).read_text())
    back = {letter: byte for byte, letter in LETTER_OF.items()}

    def raw(entry: str) -> bytes:
        return bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()

    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    named = {**vocabulary, **{t["content"]: t["id"] for t in spec["added_tokens"]}}
    entries = [b""] * (max(named.values()) + 1)
    for entry, i in named.items():
        entries[i] = raw(entry)
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    cuts = spec["pre_tokenizer"] or {}
    plain = (spec["normalizer"] is None and cuts.get("type") == "ByteLevel" and cuts.get("use_regex") and not cuts.get("add_prefix_space")
             and all(vocabulary.get(x) == 256 + i for i, x in enumerate(joined)) and len(vocabulary) == 256 + len(joined))
    if plain:
        quick = tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL_PATTERN, special_tokens={},
                                  mergeable_ranks={raw(entry): i for entry, i in vocabulary.items()})
        return lambda texts: quick.encode_ordinary_batch(texts, num_threads=1), entries
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return lambda texts: [e.ids for e in slow.encode_batch_fast(texts, add_special_tokens=False)], entries


class TwoTokenizers:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, raw = byte_level(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.entries = (Entries(raw), Entries([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                                               for i, p in enumerate(pieces)]))

    def sides(self, texts: pa.Array) -> tuple[Tokens, Tokens]:
        """Tokens of both sides; texts that one side does not give back have none."""
        whole = with_space(texts)
        data, places = text_bytes(whole)
        plain = [t or "" for t in texts.to_pylist()]
        lists = self.a(whole.to_pylist()), self.b.encode(plain, num_threads=1) if plain else []
        sides = []
        for own in lists:
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)])
            sides.append((np.fromiter(chain.from_iterable(own), np.int32, bounds[-1]), bounds))
        size = np.diff(places)
        kept = size > 0
        for entries, (ids, bounds) in zip(self.entries, sides):
            kept &= entries.lengths(ids, bounds) == size
        while True:
            wanted, of_text = data[np.repeat(kept, size)], np.flatnonzero(kept)
            own = [ids[np.repeat(kept, np.diff(bounds))] for ids, bounds in sides]
            changed = (wanted != self.entries[0].joined(own[0])) | (wanted != self.entries[1].joined(own[1]))
            if not changed.any():
                break
            kept[np.repeat(of_text, size[kept])[changed]] = False
        return tuple(entries.laid_out(ids, np.repeat(of_text, np.diff(bounds)[kept]))
                     for entries, ids, (_, bounds) in zip(self.entries, own, sides))


def covering(left: Tokens, right: Tokens) -> np.ndarray:
    """For each token of `left`, the token of `right` that covers its start."""
    found = pd.merge_asof(pd.DataFrame({"place": left.starts, "doc": left.doc}),
                          pd.DataFrame({"place": right.starts, "doc": right.doc, "token": np.arange(len(right.ids))}),
                          on="place", by="doc", direction="backward")
    return found["token"].to_numpy(np.int64)


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all overlapping tokens, in order: both directions, equal starts once."""
    if not len(a.ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    of_a, of_b = covering(a, b), covering(b, a)
    later = np.flatnonzero(a.starts[of_b] < b.starts)
    left = np.concatenate([np.arange(len(a.ids)), of_b[later]])
    right = np.concatenate([of_a, later])
    # Each overlap begins at the later of the two starts; two ascending runs are merged.
    order = np.argsort(np.concatenate([a.starts, b.starts[later]]), kind="stable")
    return left[order], right[order]


def groups(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each token of a and of b, and the text of each group."""
    ends = np.intersect1d(a.ends, b.ends, assume_unique=True)
    doc = a.doc[np.searchsorted(a.ends, ends)] if len(ends) else np.empty(0, np.int64)
    return np.searchsorted(ends, a.ends), np.searchsorted(ends, b.ends), doc


class Names:
    """Decimal ids with the mark behind them: a comma, or what ends the ids of one side of a group."""

    def __init__(self, size: int, mark: str):
        self.table = np.array([f"{i}{x}" for i in range(size) for x in (",", mark)], object)

    def of(self, ids: np.ndarray, group: np.ndarray) -> np.ndarray:
        return self.table[ids * 2 + np.append(np.diff(group) > 0, True)]


def group_texts(names: tuple[Names, Names], a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray, rows: int) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` for each text."""
    total = len(a.ids) + len(b.ids)
    if not total:
        return [""] * rows
    out = np.empty(total, object)
    n = int(group_a[-1]) + 1
    count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    before_a, before_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    out[np.arange(len(a.ids)) + before_b[group_a]] = names[0].of(a.ids, group_a)
    out[np.arange(len(b.ids)) + (before_a + count_a)[group_b]] = names[1].of(b.ids, group_b)
    edges = np.searchsorted(a.doc, np.arange(rows + 1)) + np.searchsorted(b.doc, np.arange(rows + 1))
    words = out.tolist()
    return ["".join(words[x:y])[:-1] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id and `groups`: array of (a ids, b ids, end), the end as a byte place in a space and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = TwoTokenizers(a_path, b_path)
        for batch in batches:
            for part in chunks(batch, limit=CHUNK_BYTES // 2):
                a, b = both.sides(part.column("text"))
                group_a, group_b, doc = groups(a, b)
                ends = a.ends[np.flatnonzero(np.append(np.diff(group_a) > 0, True))] if len(a.ids) else np.empty(0, np.int64)
                begin = a.starts[np.searchsorted(a.doc, doc)] if len(doc) else ends
                edges = np.arange(len(doc) + 1)
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(g, edges), pa.int32()), pa.array(t.ids))
                         for g, t in ((group_a, a), (group_b, b))]
                rows = pa.StructArray.from_arrays([*lists, pa.array(ends - begin, pa.int64())], names=["a", "b", "end"])
                bounds = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "groups": pa.ListArray.from_arrays(bounds, rows)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(
        run, f"doc_id {kind}, groups array<struct<a: array<int>, b: array<int>, end: bigint>>")


def linked_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per document, with its links as places in the pairs of its block, and a row per block, with its distinct pairs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, wide boolean, links binary, "
              "pairs array<long>, n_docs array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = TwoTokenizers(a_path, b_path)
        names = Names(len(both.entries[0].size), "|"), Names(len(both.entries[1].size), ";")
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(batch, limit=CHUNK_BYTES):
                rows = part.num_rows
                a, b = both.sides(part.column("text"))
                left, right = overlaps(a, b)
                pairs, place = np.unique((a.ids[left].astype(np.int64) << 32) | b.ids[right], return_inverse=True)
                doc = a.doc[left]
                held = np.unique(doc * max(len(pairs), 1) + place)
                n_docs = np.bincount(held % max(len(pairs), 1), minlength=len(pairs))
                group_a, group_b, group_doc = groups(a, b)
                texts = group_texts(names, a, b, group_a, group_b, rows)
                wide = len(pairs) > 1 << 16
                raw = place.astype("<u4" if wide else "<u2").tobytes()
                edges = (np.searchsorted(doc, np.arange(rows + 1)) * (4 if wide else 2)).tolist()
                none = [None]
                table = {
                    "block": [block] * (rows + 1), "doc_id": pa.concat_arrays([part.column("doc_id"), pa.nulls(1, part.column("doc_id").type)]),
                    "n_a": [*np.bincount(a.doc, minlength=rows).tolist(), None],
                    "n_b": [*np.bincount(b.doc, minlength=rows).tolist(), None],
                    "n_groups": [*np.bincount(group_doc, minlength=rows).tolist(), None],
                    "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts] + none,
                    "wide": [wide] * rows + none,
                    "links": [raw[x:y] for x, y in zip(edges, edges[1:])] + none,
                    "pairs": pa.array([None] * rows + [pairs], pa.list_(pa.int64())),
                    "n_docs": pa.array([None] * rows + [n_docs], pa.list_(pa.int32())),
                }
                kinds = {"block": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
                         "groups_sha256": pa.string(), "wide": pa.bool_(), "links": pa.binary()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) if k in kinds else v for k, v in table.items()})
                block += 1

    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (A id in the upper 32 bits, B id below), n: documents that hold it, best: no pair of the same A id has more."""
    rows = blocks.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("x"))
    counts = rows.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n_docs").alias("n"))
    a_id = F.shiftright("pair", 32)
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))
    return counts.withColumn("a_id", a_id).join(most, "a_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_statistics(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = materialise(linked_blocks(docs, a_path, b_path))
    counts = materialise(pair_counts(blocks))
    asked = blocks.filter("pairs is not null").select(F.col("block").alias("asker"), F.explode("pairs").alias("pair"))
    answers = asked.join(counts, "pair").select("asker", "pair", "n", "best")

    def meet(rows: pa.Table, counted: pa.Table) -> pa.Table:
        order = np.argsort(counted.column("pair").to_numpy())
        n, best = counted.column("n").to_numpy()[order], counted.column("best").to_numpy()[order]
        links = [np.frombuffer(raw, "<u4" if wide else "<u2") for raw, wide in zip(
            rows.column("links").to_pylist(), rows.column("wide").to_pylist())]
        table = {name: rows.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups")}
        table["n_links"] = pa.array([len(x) for x in links], pa.int64())
        table["n_best"] = pa.array([int(best[x].sum()) for x in links], pa.int64())
        table["count_sum"] = pa.array([int(n[x].sum()) for x in links], pa.int64())
        table["groups_sha256"] = rows.column("groups_sha256")
        return pa.table(table)

    members = blocks.filter("pairs is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "wide", "links")
    return members.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(
        meet, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
