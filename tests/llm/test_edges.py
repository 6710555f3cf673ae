"""Nulls, repeated rows, one id with two texts, very long texts, empty tables, clashing columns: the docstrings' results."""

import pytest
from pyspark.sql import functions as F

from tribolens.llm import licenses, lm_scoring, ngram_jaccard, packing, quality, registry, secrets, substring_dedup, syncmers
from tribolens.llm import token_store, winnowing


@pytest.fixture(scope="module")
def labels(spark, rows):
    good = [(rows[i][0], i % 4 and 1, int(i == 2)) for i in range(10)]
    return spark.createDataFrame([*good, (None, 1, 0), (5, None, None), (99999, 1, 0), (rows[1][0], 0, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    return spark.createDataFrame([(1, rows[9][1]), (None, "x"), (2, None), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def operators(labels, benchmark):
    path = registry.tokenizer()
    return {
        "groups": ngram_jaccard.similar_groups,
        "passages": substring_dedup.remove_repeated_passages,
        "hits": lambda d: winnowing.contamination(d, benchmark),
        "secrets": secrets.scan,
        "prints": syncmers.fingerprints,
        "quality": lambda d: quality.grade(d, labels),
        "lm": lambda d: lm_scoring.score(d, labels),
        "licences": lambda d: licenses.scan(d.withColumn("path", F.lit("a/b"))),
        "store": lambda d: token_store.new_store(d, path),
        "packing": lambda d: packing.packed_sequences(d, path),
    }


NAMES = ["groups", "passages", "hits", "secrets", "prints", "quality", "lm", "licences", "store", "packing"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(operators, empty, name):
    assert operators[name](empty).count() == 0


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("packing",)])
def test_odd_rows_give_one_row_each(operators, odd, name):
    found = operators[name](odd).select("doc_id").collect()
    assert sorted(str(r[0]) for r in found) == sorted(str(r[0]) for r in odd.select("doc_id").collect())


def by_id(df, *columns):
    found = {}
    for r in df.select("doc_id", *columns).collect():
        found.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    return found


def test_groups(operators, odd):
    got = by_id(operators["groups"](odd), "component_id", "n_shingles")
    assert all(c is None for c, _ in got[None])
    assert got[7000] == [(7000, 0)] and got[7001] == [(7001, 0)]
    assert [c for c, _ in got[7002]] == [7002, 7002]


def test_passages(operators, odd, rows):
    got = by_id(operators["passages"](odd), "n_words", "n_removed")
    assert all(gone == 0 for _, gone in got[None]) and got[7000] == [(0, 0)]
    assert got[7002] == [(60_000, 0)] * 2
    n = len(rows[9][1].split())
    assert got[7004] == [(n, n)]


def test_hits(operators, odd):
    got = by_id(operators["hits"](odd), "n_words", "n_hit", "items")
    assert got[7000] == [(0, 0, [])] and got[7004][0][1] == got[7004][0][0] and got[7004][0][2] == ["1"]
    assert sorted(x[1] > 0 for x in got[7003]) == [False, True]


def test_packing(operators, odd):
    pieces = operators["packing"](odd)
    total = pieces.agg(F.sum(F.octet_length("ids") / 4)).first()[0]
    stored = operators["store"](odd)
    assert total == stored.agg(F.sum("n_tokens")).first()[0]
    starts = [(r["start"], r["n_tokens"]) for r in stored.orderBy("start").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_prints(operators, odd):
    got = by_id(operators["prints"](odd), "text", "edited", "anchors")
    for text, edited, _ in got[None]:
        part = len(text) // 4
        assert edited == text[: len(text) - part] + text[:part]
    assert got[7000][0][2] == []


def test_quality_and_lm(operators, odd):
    assert all(0 <= p[0] <= 2 for parts in by_id(operators["quality"](odd), "expected_grade").values() for p in parts)
    assert by_id(operators["lm"](odd), "n_tokens", "difference")[7000] == [(0, None)]


def test_no_labels(spark, operators, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.grade(docs, none).select("p_best").distinct().count() == 1
    assert lm_scoring.score(docs, none).filter("difference is null").count() == 2
