"""The pipeline: columns, effect of each stage on planted cases, and every stage on its predecessor's rows."""

import sys
from pathlib import Path

import plain
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage of a run over the smallest tables."""
    from tribolens.plans.storage import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
        seen.append(docs)
    return seen


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_stay(stages):
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.dtypes == before.dtypes


def test_clean_documents_pass_the_classifier(spark, stages):
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = texts(stages[1])
    good = [i for i, x in labels.items() if x == (1, 0)]
    bad = [i for i, x in labels.items() if x != (1, 0)]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    groups = plain.similar_groups(sorted(before.items()), 5, 80)
    assert set(after) == {first for _, first in groups.values()}


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = texts(stages[2]), texts(stages[3])
    hit = plain.contamination(sorted(before.items()), items, 10)
    assert set(after) == {i for i, x in hit.items() if not x[1]}


def test_secrets_are_replaced(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    for i, text in before.items():
        spans = plain.base_spans(text or "")
        if not spans and after[i] != text:
            assert "[REDACTED]" in after[i]
        for start, _, end, _ in spans:
            assert text[start:end] not in after[i]


def test_all_tokens_are_packed(stages):
    whole = {}
    for r in stages[5].collect():
        whole.setdefault(r["doc_id"], [0, r["doc_tokens"]])[0] += len(r["ids"]) // 4
    assert set(whole) == set(texts(stages[4])) and all(a == b for a, b in whole.values())


def test_other_columns_may_have_any_name(spark, docs):
    for _, stage in pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_one_row_stays_where_ids_repeat(spark):
    """An id with a copy and a text of its own, repeated rows, and copies with a null id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d), (None, c), (None, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).repartition(3)
    found = pipeline.distinct_documents(spark, docs, SF)
    assert found.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"]) for r in found.collect())
    assert got == sorted([("1", a), ("2", b), ("3", c), ("None", d), ("None", ""), ("4", "")])
