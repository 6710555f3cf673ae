"""Words and word-sequence hashes of whole texts, vectorised over the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SEPARATORS = b" \t\n\x0b\x0c\r"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


class Words(NamedTuple):
    """Words of several texts: `starts`/`ends` are byte places in `data`, `bounds[i]:bounds[i+1]` are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD
    x ^= x >> np.uint64(29)
    x *= _STEP
    x ^= x >> np.uint64(32)
    return x


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text; a longer text is a slice of its own."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    place = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < len(place):
        done = place[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(place, done + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each; a null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[places[0] : places[-1]], places - places[0]


def split(texts: pa.Array, lower: bool, separators: bytes = SEPARATORS) -> Words:
    """Words between separators, by default ASCII white space; `lower` folds A-Z only."""
    data, places = text_bytes(texts)
    if lower:
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        data = fold[data]
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[places] = True
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, places))


def word_hashes(words: Words) -> np.ndarray:
    """One 64-bit hash per word: a sum of scrambled (place in word, byte) pairs."""
    if not len(words.starts):
        return np.empty(0, np.uint64)
    sizes = words.ends - words.starts
    first = np.cumsum(sizes) - sizes
    inner = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    bytes_ = words.data[np.repeat(words.starts, sizes) + inner]
    parts = mix(((inner.astype(np.uint64) + np.uint64(1)) << np.uint64(8)) + bytes_)
    return mix(np.add.reduceat(parts, first) + sizes.astype(np.uint64) * _STEP)


def sequence_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; the caller masks those that cross a text's end."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    power = np.ones(n + 1, np.uint64)
    power[1:] = _STEP
    np.cumprod(power, out=power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=total[1:])
    inverse = np.ones(n - k + 1, np.uint64)
    inverse[1:] = np.uint64(pow(int(_STEP), -1, 1 << 64))
    np.cumprod(inverse, out=inverse)
    return mix((total[k:] - total[:-k]) * inverse + np.uint64(k))


def shingles(texts: pa.Array, k: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word sequences of each text; with fewer words, of the whole sequence."""
    words = split(texts, lower)
    hashes = word_hashes(words)
    grams = sequence_hashes(hashes, k)
    sets = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        if b - a >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        else:
            sets.append(sequence_hashes(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return sets
