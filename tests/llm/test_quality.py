"""The ordinal model: gradients, order of thresholds, and accuracy on labels that it has not seen."""

import numpy as np
from pyspark.sql import functions as F

from tribolens.llm import quality

SF = "/root/testdata/sf0.1"


def test_thresholds_are_ordered_and_scores_rise():
    rng = np.random.default_rng(0)
    good, bad, poor = (np.sort(rng.integers(1, 1 << 60, 6).astype(np.uint64)) for _ in range(3))
    lists, grades = [], []
    for i in range(300):
        grade = i % 3
        lists.append(np.unique(np.concatenate([(bad, poor, good)[grade][rng.random(6) < 0.6],
                                               rng.integers(1, 1 << 60, 3).astype(np.uint64)])))
        grades.append(grade)
    model = quality.fit(lists, np.array(grades))
    weight = dict(zip(model.features.tolist(), model.weights))
    assert model.thresholds[0] < model.thresholds[1]
    means = [np.mean([weight[x] for x in part.tolist()]) for part in (bad, poor, good)]
    assert means[0] < means[1] < means[2]


def test_one_grade_or_none():
    assert len(quality.fit([], np.array([])).features) == 0
    assert len(quality.fit([np.arange(5, dtype=np.uint64)] * 9, np.array([2] * 9)).features) == 0


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = F.col("doc_id") % 4 != 0
    held = quality.graded(labels.filter(~seen))
    rated = quality.grade(docs, labels.filter(seen)).join(held, "doc_id").groupBy("grade").agg(
        F.avg(F.col("keep").cast("int")).alias("kept"), F.avg("expected_grade").alias("expected")).orderBy("grade").collect()
    kept, expected = [r["kept"] for r in rated], [r["expected"] for r in rated]
    assert kept[0] < 0.1 and kept[2] > 0.97 and kept[1] < 0.4
    assert expected[0] < expected[1] < expected[2]
