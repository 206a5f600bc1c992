"""Training-data queries against their SQL on the smallest tables, and the shape of the rest."""

import pytest

from tests.oracle import compare
from usagemill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, name):
    compare(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


COLUMNS = {
    "op2_progressive_jpeg": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op4_language": "doc_id held_out lang_pred score",
    "op5_entropy_mix": "doc_id size source_size target taken copies rate", "op6_quality": "doc_id held_out score predicted", "op7_simhash": "doc_id fingerprint component_id",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_every_document_has_a_row(spark, name):
    out = queries.queries()[name](spark, SF)
    assert out.columns == COLUMNS[name].split()
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
