"""From raw documents to packed training sequences: five stages, each a written table that the next one reads.

quality     documents graded toxic or of low quality go (operator 3)
duplicates  of each group of near copies, five-word shingles at a similarity of 0.8, the least id stays (operator 1)
benchmark   documents that hold a benchmark passage go (operator 8)
secrets     credentials, linked parts included, are replaced by a mark; no document goes (operator 5)
packing     what is left is tokenized and packed into sequences of 2048 ids (operator 10)

The stages read their input in small Arrow batches (SMALL_BATCHES, set on the session), which bounds what an executor holds beside its
heap. All stages but the last return the columns of their input, whatever their names. Where an id is null or repeated, the duplicates
stage groups rows instead of ids: of each group one row stays, a null id only if the group has no other.
SQL cannot express the fitted classifier, so there is no reference SQL; the tests compare with plain Python.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribolens.llm import ngram_jaccard, packing, quality, registry, secrets, winnowing
from tribolens.llm.columns import join_rows, small_side
from tribolens.plans.storage import materialise

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in SMALL_BATCHES.items():
            spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    return run_stage


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Documents whose other columns have names that no operator uses, and the way back to their names."""
    others = {name: f"column_{i}" for i, name in enumerate(docs.columns) if name not in ("doc_id", "text")}
    return docs.withColumnsRenamed(others), {new: old for old, new in others.items()}


def restored(result: DataFrame, names: dict[str, str], docs: DataFrame) -> DataFrame:
    kept = [name if name in ("doc_id", "text") else new for name in docs.columns
            for new in ([k for k, v in names.items() if v == name] or [name])]
    return result.select(*kept).withColumnsRenamed(names)


@small_batches
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, names = shielded(docs)
    return restored(quality.grade(plain, registry.table(spark, sf_dir, "labels")).filter("keep"), names, docs)


@small_batches
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = docs.groupBy("doc_id").count().filter("doc_id is null or count > 1")
    if not ids.isEmpty():
        return distinct_rows(docs)
    groups = ngram_jaccard.similar_groups(docs.select("doc_id", "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    copies = small_side(materialise(groups.filter("component_id < doc_id").select("doc_id").distinct()))
    return docs.join(copies, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def distinct_rows(docs: DataFrame) -> DataFrame:
    """Documents whose ids do not name one row: grouped by a written row number, the least id of a group stays, null ids last."""
    plain, names = shielded(docs)
    plain = materialise(plain.withColumn("row", F.monotonically_increasing_id()))
    groups = ngram_jaccard.similar_groups(plain.select(F.col("row").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    groups = materialise(groups.select(F.col("doc_id").alias("row"), "component_id").join(plain.select("row", "doc_id"), "row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    kept = groups.groupBy("component_id").agg(first.alias("f")).select(F.col("f.row").alias("row"))
    return restored(plain.join(kept, "row", "left_semi").drop("row"), names, docs)


@small_batches
def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, names = shielded(docs)
    found = winnowing.contamination(docs.select("doc_id", "text"), registry.table(spark, sf_dir, "benchmark"))
    hit = small_side(materialise(found.filter("n_hit > 0").select("doc_id", "tag").distinct()))
    return restored(join_rows(plain.withColumn("tag", F.hash("text")), hit, "left_anti"), names, docs)


@small_batches
def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, names = shielded(docs)
    found = secrets.scan(docs.select("doc_id", "text")).filter(F.size("spans") > 0).distinct()
    result = join_rows(plain.withColumn("tag", F.hash("text")), small_side(materialise(found)))
    result = result.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(
        secrets.redacted(F.col("text"), F.col("spans"))))
    size = next((new for new, old in names.items() if old == "n_chars"), None)
    if size:
        result = result.withColumn(size, F.when(F.col("spans").isNull(), F.col(size)).otherwise(F.length("text")))
    return restored(result, names, docs)


@small_batches
def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(docs.select("doc_id", "text"), registry.tokenizer())


STAGES = [
    ("quality", good_documents),
    ("duplicates", distinct_documents),
    ("benchmark", uncontaminated_documents),
    ("secrets", redacted_documents),
    ("packing", packed_documents),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return registry.packing_digest(docs)
