"""Registered queries of this subpackage: name to query, and name to reference SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribolens.llm import (
    alignment, filter_audit, licenses, lm_scoring, ngram_jaccard, packing, pieces, quality, reference_sql, secrets, substring_dedup,
    syncmers, token_store, winnowing,
)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer() -> str:
    return vocabulary("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similar_groups(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_store.new_store(table(spark, sf_dir, "documents"), tokenizer())
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.grade(docs, table(spark, sf_dir, "labels")).drop("text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a source and language; short ones are the licence files of their directory."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    name = F.when(F.length("text") <= 300, F.concat(F.lit("LICENSE."), number)).otherwise(
        F.concat_ws("/", (F.col("doc_id") % 10).cast("string"), F.concat(number, F.lit(".txt"))))
    return licenses.scan(docs.select("doc_id", F.concat_ws("/", "source", "lang", name).alias("path"), "text"))


def op5_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = secrets.base_spans(F.col("spans"))
    counts = [secrets.count_of(kind).alias(f"n_{kind}") for kind in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"))


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.listed(F.col("anchors")).alias("fingerprint"),
        syncmers.listed(F.col("edited_anchors")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        syncmers.likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(packing.packed_sequences(table(spark, sf_dir, "documents"), tokenizer()))


def packing_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                                     vocabulary("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_decoded=True)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_token_store, op3_quality, op4_license_scan, op5_secret_links, op6_syncmers,
    op7_substring_dedup, op8_winnowing, op9_lm_scoring, op10_packing, op11_alignment, op12_filter_audit, op13_sentencepiece)}
ORACLES = {"op1_ngram_jaccard": reference_sql.OP1, "op7_substring_dedup": reference_sql.OP7,
           "op8_winnowing": reference_sql.OP8, "op12_filter_audit": reference_sql.OP12}
