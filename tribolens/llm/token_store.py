"""Operator 2: token ids written as frequency-ranked, byte-aligned variable-length codes, and read back.

A store is two Parquet tables. `ranks` lists token ids from the most to the least frequent over all documents. `blocks` has a
row per document in ascending id order: the ids' ranks in 1 to 4 bytes each (`data`), and apart from them the byte counts,
four 2-bit codes to a control byte (`control`), so that a reader gets all lengths from one table lookup per control byte
and all ids by one masked copy. A row holds its part (range of ids) and the number of ids before it in that part; the start in
the whole store adds the sizes of the parts before.

Texts are tokenized once into a written table; frequencies and codes are taken from it. Rows move by one range shuffle on the id.

Defined results: null text is empty and has only the end id. Null ids come first. Rows with one id follow each other by number of
ids, then by ids; repeated rows are kept. An empty table gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tribolens.llm.columns import small_side
from tribolens.llm.words import chunks
from tribolens.plans.storage import materialise, new_table_path

TOKENIZE_BYTES = 3 << 20
LENGTHS = np.stack([np.arange(256) >> shift & 3 for shift in (0, 2, 4, 6)], 1).astype(np.uint8) + 1


def packed(ids: np.ndarray) -> bytes:
    """Ids of the working table: plain little-endian integers under zstd."""
    return pa.compress(ids.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=4 * n, codec="zstd"), "<u4")


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """Written table (doc_id, n_tokens, ids, key); `key` is the least hash of two neighbouring ids, for lexical grouping."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tribolens.llm.tokens import Encoder
        from tribolens.llm.words import mix

        encoder = Encoder(path)
        for batch in batches:
            for part in chunks(batch, limit=TOKENIZE_BYTES):
                ids, begin = encoder.encode(part.column("text"))
                pairs = mix((ids[:-1].astype(np.uint64) << np.uint64(32)) | ids[1:])
                blobs, keys = [], []
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                    blobs.append(packed(ids[a:b]))
                    keys.append(int(pairs[a : b - 1].min().astype(np.int64)) if b - a > 1 else 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(begin)), pa.array(blobs, pa.binary()),
                     pa.array(keys, pa.int64())], names=["doc_id", "n_tokens", "ids", "key"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialise(docs.mapInArrow(encode, "doc_id long, n_tokens long, ids binary, key long"))


def frequency_order(tokens: DataFrame) -> np.ndarray:
    """Token ids by falling frequency, then by id. What is collected is a row per id of the vocabulary."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for blob, n in zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist()):
                found = np.bincount(unpacked(blob, n), minlength=len(total))
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "times"])

    counts = tokens.select("ids", "n_tokens").mapInArrow(count, "id long, times long")
    rows = counts.groupBy("id").agg(F.sum("times").alias("times")).toPandas()
    return rows["id"].to_numpy()[np.lexsort((rows["id"], -rows["times"]))].astype(np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes."""
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    wide = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), wide[np.arange(4) <= code[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    wide = np.zeros((n, 4), np.uint8)
    wide[np.arange(4) < length[:, None]] = np.frombuffer(data, np.uint8)
    return wide.view("<u4").reshape(-1)


def write_store(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Tokenize `docs` (doc_id, text) and write the store to `path`."""
    spark = docs.sparkSession
    tokens = tokenised(docs, tokenizer)
    order = frequency_order(tokens)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank_of)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column("n_tokens").to_pylist()
            coded = [encode_ranks(sent.value[unpacked(b, n)]) for b, n in zip(batch.column("ids").to_pylist(), sizes)]
            starts = done + np.cumsum([0, *sizes[:-1]])
            done += sum(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([part] * len(sizes), pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(sizes, pa.int64()), *(pa.array(list(c), pa.binary()) for c in zip(*coded))],
                names=["doc_id", "part", "start", "n_tokens", "control", "data"])

    ordered = tokens.select("doc_id", "n_tokens", "ids").repartitionByRange("doc_id").sortWithinPartitions(
        "doc_id", "n_tokens", "ids")
    ordered.mapInArrow(code, "doc_id long, part int, start long, n_tokens long, control binary, data binary"
                       ).write.option("compression", "zstd").parquet(f"{path}/blocks")
    ids = spark.createDataFrame([(rank, int(i)) for rank, i in enumerate(order)], "rank int, id int")
    ids.coalesce(1).write.parquet(f"{path}/ranks")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers) of every document."""
    ranks = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")
    sent = spark.sparkContext.broadcast(ranks["id"].to_numpy().astype("<u4"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("control", "data", "n_tokens")))
            ids = [sent.value[decode_ranks(*row)].tobytes() for row in rows]
            yield batch.drop_columns(["control", "data"]).append_column("ids", pa.array(ids, pa.binary()))

    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = small_side(materialise(sizes.select("part", before.alias("before"))))
    read = blocks.mapInArrow(decode, "doc_id long, part int, start long, n_tokens long, ids binary")
    return read.join(parts, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


def new_store(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write a store to a new folder and read it back."""
    path = new_table_path(docs.sparkSession)
    write_store(docs, tokenizer, path)
    return read_store(docs.sparkSession, path)
