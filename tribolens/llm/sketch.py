"""Count-min sketches of hashes: one per task, merged by block over a shuffle, sent out once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 13
SALT = np.uint64(0xA24BAED4963EE407)


def places(hashes: np.ndarray, width: int, depth: int) -> Iterator[np.ndarray]:
    """Counter of each hash in each row of the sketch; rows lie one behind the other. `width` is a power of two."""
    value = hashes
    for row in range(depth):
        yield (value & np.uint64(width - 1)).astype(np.int64) + row * width
        value = value * SALT
        value ^= value >> np.uint64(31)


def build(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], width: int, depth: int,
          most: int, finish: Callable[[np.ndarray], bytes], kind: type = np.uint8) -> bytes:
    """Merged sketch over all rows of `df`, its blocks passed through `finish` and put together in order.

    Each task counts in an array of width x depth counters of `kind` and sends its non-zero counters, or a whole block
    where that is shorter; counters stop at `most`, which min-merging allows: a stopped sum is never below the stopped
    true count. What reaches the driver is the finished sketch, whose size is set by the parameters, not by the table.
    """
    size = width * depth
    block = min(BLOCK, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            for found in hashes_of(batch):
                for where in places(found, width, depth):
                    where, times = np.unique(where, return_counts=True)
                    total[where] = np.minimum(total[where].astype(np.int64) + times, most)
        for first in range(0, size // block, 1024):
            rows = []
            for k in range(first, min(first + 1024, size // block)):
                part = total[k * block : (k + 1) * block]
                used = np.flatnonzero(part)
                if len(used) * (2 + part.itemsize) >= part.nbytes:
                    rows.append((k, b"", part.tobytes()))
                elif len(used):
                    rows.append((k, used.astype(np.uint16).tobytes(), part[used].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                     pa.array([r[2] for r in rows], pa.binary())], names=["block", "places", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, where, counts in zip(*(column.to_pylist() for column in batch.columns)):
                total = sums.setdefault(k, np.zeros(block, kind))
                used = np.frombuffer(where, np.uint16) if where else slice(None)
                total[used] = np.minimum(total[used].astype(np.int64) + np.frombuffer(counts, kind), most)
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([finish(total)], pa.binary())],
                                             names=["block", "counts"])

    merged = (df.mapInArrow(count, "block int, places binary, counts binary").repartition("block")
              .mapInArrow(merge, "block int, counts binary"))
    parts = dict(merged.collect())
    empty = finish(np.zeros(block, kind))
    return b"".join(bytes(parts.get(k, empty)) for k in range(size // block))


def repeated_bits(counts: np.ndarray) -> bytes:
    """One bit per counter: does it stand at two or more?"""
    return np.packbits(counts >= 2, bitorder="little").tobytes()


def seen_twice(bits: np.ndarray, hashes: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Is the estimate of each hash, the least of its counters, two or more?"""
    result = np.ones(len(hashes), bool)
    for where in places(hashes, width, depth):
        result &= (bits[where >> 3] >> (where & 7).astype(np.uint8)) & 1 == 1
    return result
