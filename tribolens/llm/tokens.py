"""Ids of a public byte-pair vocabulary for whole batches of texts.

The tokenizer is slow on text with ever new words, so each distinct piece of a task is encoded once. Pieces are cut only where the
tokenizer cuts too, whatever stands on either side: at ASCII white space, around each ASCII digit, and between ASCII letters
and other ASCII characters. Apostrophes and all non-ASCII characters stay with their neighbours.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from tribolens.llm.words import Words, text_bytes, word_hashes

END = 1
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
WHITE, GLUE, LETTER, DIGIT, SIGN = range(5)


def byte_kinds() -> np.ndarray:
    kinds = np.full(256, SIGN, np.uint8)
    kinds[128:] = GLUE
    kinds[ord("'")] = GLUE
    kinds[[9, 10, 11, 12, 13, 32]] = WHITE
    for b in range(128):
        if chr(b).isalpha():
            kinds[b] = LETTER
        elif chr(b).isdigit():
            kinds[b] = DIGIT
    return kinds


KIND_OF = byte_kinds()
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def pieces(texts: pa.Array) -> Words:
    """The pieces of all texts, A-Z folded."""
    data, places = text_bytes(texts)
    data = FOLD[data]
    kind = KIND_OF[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[places] = True
    a, b = kind[:-1], kind[1:]
    cut[1:-1] |= (a == WHITE) | (b == WHITE) | ((a > GLUE) & (b > GLUE) & ((a != b) | (a == DIGIT)))
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    solid = kind[starts] != WHITE
    starts, ends = starts[solid], ends[solid]
    return Words(data, starts, ends, np.searchsorted(starts, places))


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself if it is printable, else one above 255, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


LETTER_OF = byte_letters()


def spelled(piece: str) -> str | None:
    """A piece of letters as the vocabulary spells it; None for any other, and where case or composition is not plain."""
    if piece.isascii():
        return piece if piece.isalpha() else None
    # The capital sigma is the one letter whose lower case depends on its neighbours.
    low = piece.lower()
    if not low.isalpha() or len(low) != len(piece) or "\u03a3" in piece or not unicodedata.is_normalized("NFC", piece):
        return None
    return low.encode().decode("latin-1").translate(LETTER_OF)


class Encoder:
    """Encodes batches of texts; remembers the ids of every piece seen so far in the task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = np.empty(0, np.uint64)
        self.place = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.begin = np.zeros(1, np.int64)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and their number per piece; letters go straight to the merges, the rest through the whole tokenizer."""
        plain = [spelled(t) for t in texts]
        rest = iter(self.plain([t for t, p in zip(texts, plain) if p is None]))
        ids: list[int] = []
        sizes = []
        merges = self.tokenizer.model.tokenize
        for word in plain:
            found = next(rest).tolist() if word is None else [token.id for token in merges(word)]
            ids += found
            sizes.append(len(found))
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def learn(self, found: Words, new: np.ndarray, first: np.ndarray) -> None:
        """Encode pieces of unknown hash; `first` is a place where each stands."""
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, new), len(self.known) - 1)
            fresh = self.known[at] != new
            new, first = new[fresh], first[fresh]
        if not len(new):
            return
        raw = found.data.tobytes()
        ids, sizes = self.encode_pieces(
            [raw[a:b].decode() for a, b in zip(found.starts[first].tolist(), found.ends[first].tolist())])
        place = np.arange(len(new)) + len(self.begin) - 1
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        self.known, self.place = np.concatenate([self.known, new]), np.concatenate([self.place, place])
        order = np.argsort(self.known, kind="stable")
        self.known, self.place = self.known[order], self.place[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one behind the other, each text closed by END, and the place where each text begins."""
        found = pieces(texts)
        distinct, first, inverse = np.unique(word_hashes(found), return_index=True, return_inverse=True)
        self.learn(found, distinct, first)
        rows, pieces_of = len(texts), np.diff(found.bounds)
        item = self.place[np.searchsorted(self.known, distinct)][inverse] if len(distinct) else np.empty(0, np.int64)
        size = self.begin[item + 1] - self.begin[item]
        place = np.cumsum(size) - size + np.repeat(np.arange(rows), pieces_of)
        ends = np.concatenate([[0], np.cumsum(size)])[found.bounds[1:]]
        begin = np.concatenate([[0], ends + np.arange(1, rows + 1)])
        out = np.full(begin[-1], END, np.uint32)
        # Ids of all pieces by their rank in the piece: most pieces have few.
        for rank in range(int(size.max(initial=0))):
            more = size > rank
            place, item, size = place[more], item[more], size[more]
            out[place + rank] = self.ids[self.begin[item] + rank]
        return self.corrected(texts, out, begin)

    def corrected(self, texts: pa.Array, out: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with the name of a special token go through the tokenizer whole."""
        rows = [i for i, t in enumerate(texts.to_pylist()) if t and "<|" in t and any(s in t for s in SPECIAL)]
        if not rows:
            return out, begin
        parts = [out[a:b] for a, b in zip(begin[:-1], begin[1:])]
        for i, ids in zip(rows, self.plain([texts[i].as_py() for i in rows])):
            parts[i] = np.append(ids, np.uint32(END))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
