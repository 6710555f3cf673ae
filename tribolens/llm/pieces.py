"""Operator 13: SentencePiece ids of whole texts, and back.

A text's ids are those that merging would give: the two adjacent symbols whose joined piece scores highest are joined first,
the left one at a tie, until no joined piece is known. They are found without merging the text:

* An Aho-Corasick automaton over all pieces gives the longest piece at every place in one pass.
* Going from left to right, the longest piece is taken, then ever shorter prefixes of it. A piece may follow the last one only if
  the two are compatible: merging their joined text anew gives back just these two. Merges never cross the border of two
  compatible neighbours, so a row of compatible neighbours is what merging the whole text gives, and there is only one.
* Where no piece may follow, the place is marked in a bitfield of failed places and the last piece is taken back. No place fails
  twice, so the work stays in proportion to the text.

Between two bytes that no piece holds side by side nothing can be merged, so texts are cut there, and each distinct part of a batch is
encoded once; parts are mostly words. Only models that leave the text as it is, but for space marks and one space
ahead, are accepted. Characters without a piece become byte ids.

Defined results: a null or empty text has the begin and end id only and decodes to an empty text. Every row gives one row with its id,
null and repeated ids too; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tribolens.llm.words import chunks, text_bytes

MARK = "▁"
CACHED_PARTS, CACHED_PAIRS, CACHED_LENGTH = 200_000, 1_000_000, 64


class PieceTable:
    """Pieces of one model, with the encoder described above. Works on marked text: a space is written as MARK."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if self.model.normalize("  ﬁ b ") != f"{MARK * 3}ﬁ{MARK}b{MARK}":
            raise ValueError("the model changes texts before it cuts them")
        model, n = self.model, self.model.vocab_size()
        known = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        self.id_of = {model.id_to_piece(i): i for i in known}
        self.score = {piece: model.get_score(i) for piece, i in self.id_of.items()}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.joins = np.zeros((256, 256), bool)
        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            raw = np.frombuffer(piece.replace(MARK, " ").encode(), np.uint8)
            self.joins[raw[:-1], raw[1:]] = True
            if len(piece) > 1:
                self.automaton.add_word(piece, len(piece))
        self.joins[:, 128:192] = True  # inside a character
        self.automaton.make_automaton()
        self.shorter: dict[str, str] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging, for short texts."""
        symbols, score = list(text), self.score
        while True:
            best, place = None, 0
            for i in range(len(symbols) - 1):
                found = score.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or found > best):
                    best, place = found, i
            if best is None:
                return symbols
            symbols[place : place + 2] = [symbols[place] + symbols[place + 1]]

    def prefix(self, piece: str) -> str:
        """The longest shorter piece that begins `piece`; empty for a single character."""
        found = self.shorter.get(piece)
        if found is None:
            found = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if k == 1 or piece[:k] in self.id_of), "")
            self.shorter[piece] = found
        return found

    def compatible(self, left: str, right: str) -> bool:
        """May `right` follow `left`? With nothing before it: does merging ever end in `right`?"""
        if len(self.fits) >= CACHED_PAIRS:
            self.fits.clear()
        found = self.fits[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def cut(self, text: str) -> list[str]:
        """Pieces of a marked text; a character without a piece stands alone."""
        n = len(text)
        longest = [1] * n
        for end, size in self.automaton.iter(text):
            longest[end - size + 1] = size  # later ends are longer pieces of the same start
        fits, compatible, shorter = self.fits.get, self.compatible, self.prefix
        failed = bytearray((n >> 3) + 1)
        taken: list[str] = []
        place, last, piece = 0, "", text[: longest[0]] if n else ""
        while place < n:
            while piece:
                end = place + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    known = fits((last, piece))
                    if known or known is None and compatible(last, piece):
                        break
                piece = shorter(piece)
            if piece:
                taken.append(piece)
                place, last = end, piece
                piece = text[place : place + longest[place]] if place < n else ""
            else:
                failed[place >> 3] |= 1 << (place & 7)
                piece = taken.pop()
                place -= len(piece)
                last = taken[-1] if taken else ""
        return taken

    def ids(self, text: str) -> list[int]:
        result: list[int] = []
        for piece in self.cut(text):
            found = self.id_of.get(piece)
            if found is None:
                result += [self.byte_ids[b] for b in piece.encode()]
            else:
                result.append(found)
        return result


def repeated(values: np.ndarray, sizes: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs `item` of `values`, whose runs have `sizes`, one behind the other, and the place where each begins (and the end)."""
    begin = np.cumsum(sizes) - sizes
    size = sizes[item]
    place = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(begin[item] - place[:-1], size) + np.arange(place[-1])], place


def distinct_parts(data: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Distinct parts of UTF-8 `data` cut at `starts`, and which of them each part is."""
    edges = np.append(starts, len(data)).astype(np.int64)
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))
    coded = parts.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Memory:
    """Ids of short parts already seen in the task, as bytes; emptied when it is full."""

    def __init__(self, encode_all: Callable[[list[str]], list[list[int]]]):
        self.encode_all, self.known = encode_all, {}

    def ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one behind the other, and how many each has."""
        if len(self.known) + len(parts) > CACHED_PARTS:
            self.known.clear()
        known = self.known
        new = [p for p in parts if p not in known]
        fresh = {p: array("I", ids).tobytes() for p, ids in zip(new, self.encode_all(new))}
        found = [known.get(p) or fresh[p] for p in parts]
        known.update(item for item in fresh.items() if len(item[0]) <= CACHED_LENGTH)
        return np.frombuffer(b"".join(found), np.uint32), np.array([len(x) >> 2 for x in found], np.int64)


def with_space(texts: pa.Array) -> pa.Array:
    """A space ahead of every text that is not empty."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return pc.if_else(pc.equal(pc.binary_length(plain), 0), plain, pc.binary_join_element_wise(space, plain, none))


class PieceEncoder:
    def __init__(self, path: str):
        self.table = PieceTable(path)
        self.memory = Memory(lambda parts: [self.table.ids(p.replace(" ", MARK)) for p in parts])

    def bare(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and the place where each text begins (and the end)."""
        data, places = text_bytes(pc.replace_substring(with_space(texts), MARK, " "))
        first = np.zeros(len(data) + 1, bool)
        first[places] = True
        first[1:-1] |= ~self.table.joins[data[:-1], data[1:]]
        starts = np.flatnonzero(first[:-1])
        parts, item = distinct_parts(data, starts)
        ids, place = repeated(*self.memory.ids(parts), item)
        return ids, place[np.searchsorted(starts, places)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same with begin and end ids."""
        ids, ends = self.bare(texts)
        begin = ends + 2 * np.arange(len(ends))
        out = np.empty(begin[-1], np.uint32)
        out[begin[:-1]], out[begin[1:] - 1] = self.table.model.bos_id(), self.table.model.eos_id()
        out[np.arange(len(ids)) + 1 + 2 * np.repeat(np.arange(len(texts)), np.diff(ends))] = ids
        return out, begin


def as_binary(ids: np.ndarray, begin: np.ndarray) -> pa.Array:
    """One little-endian run of bytes per text."""
    raw = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
    return pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer((begin * 4).astype(np.int64)), raw]).cast(pa.binary())


def decoded(model, ids: np.ndarray, begin: np.ndarray) -> pa.Array:
    whole = ids.tolist()
    lists = [whole[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
    return pa.array(model.decode(lists, num_threads=1) if lists else [], pa.string())


def encode(docs: DataFrame, path: str, with_decoded: bool = False) -> DataFrame:
    """doc_id and `ids`, unsigned 32-bit little-endian, begin and end id included; on demand `decoded`, the text made of them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(path)
        for batch in batches:
            for part in chunks(batch):
                ids, begin = encoder.encode(part.column("text"))
                columns = {"doc_id": part.column("doc_id"), "ids": as_binary(ids, begin)}
                if with_decoded:
                    columns["decoded"] = decoded(encoder.table.model, ids, begin)
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(
        run, f"doc_id {kind}, ids binary" + (", decoded string" if with_decoded else ""))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of ids as `encode` gives them; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceTable(path).model
        for batch in batches:
            for part in chunks(batch, "ids"):
                raw = [np.frombuffer(x or b"", "<u4").tolist() for x in part.column("ids").to_pylist()]
                texts = model.decode(raw, num_threads=1) if raw else []
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text": pa.array(texts, pa.string())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
