"""The registered queries on the smallest tables: against their SQL, or the columns and rows they owe."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import check_queries  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402

from tribolens.llm import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_reference_sql(spark, name):
    assert name in oracle_sql()
    assert check_queries.compare(spark, check_queries.connect(SF), SF, name)[0] == "ok"


COLUMNS = {
    "op2_token_store": "doc_id start n_tokens ids_crc32",
    "op3_quality": "doc_id expected_grade p_low p_best keep",
    "op4_license_scan": "doc_id path own_license own_score own_line license inherited_from",
    "op5_secret_links": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op6_syncmers": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_lm_scoring": "doc_id n_tokens target_loss background_loss difference",
    "op11_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_for_each_document(spark, name):
    found = queries()[name](spark, SF)
    assert found.columns == COLUMNS[name].split()
    ids = [r[0] for r in found.select("doc_id").collect()]
    assert sorted(ids) == sorted(r[0] for r in registry.table(spark, SF, "documents").select("doc_id").collect())


@pytest.mark.parametrize("name", ["op10_packing", "pipeline"])
def test_pieces(spark, name):
    found = queries()[name](spark, SF)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert found.filter("length < 1 or start < 0 or offset + length > 2048").count() == 0
