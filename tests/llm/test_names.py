"""Every operator's query by its name: the columns it must return, one row for each row of its table."""

import pytest

from paperloom.llm.queries import ORACLES, QUERIES

#: The columns of the queries without SQL, their table and its key.
COLUMNS = {
    "op3_url_filter": ("pages", "page_id host path rule verdict"),
    "op5_language_id": ("documents", "doc_id held_out lang_pred score"),
    "op6_mixing": ("documents", "doc_id size source_size target taken"),
    "op7_toxicity": ("documents", "doc_id held_out score predicted"),
    "op8_suffix_dedup": ("documents", "doc_id n_bytes n_removed n_spans kept_sha256"),
    "op9_byte_bpe": ("documents", "doc_id n_tokens ids_sha256 decoded_sha256"),
    "op10_quality_rules": ("documents", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
    "op11_token_files": ("documents", "doc_id start n_tokens ids_crc32"),
}


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) == set(COLUMNS) | set(ORACLES)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, sf, name):
    source, columns = COLUMNS[name]
    out = QUERIES[name](spark, sf)
    assert set(columns.split()) <= set(out.columns)
    key = columns.split()[0]
    want = spark.read.parquet(f"{sf}/{source}.parquet").select(key)
    got = out.select(key)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
